"""Document quality by an interpolated modified Kneser-Ney model of UTF-8 bytes, trained on trusted texts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import cut, map_batches, stored, texts

#: Bytes of an n-gram, and bits of a byte: 48 bits in all.
ORDER, BITS = 6, 8
#: A model of more rows than this is not held in memory at once, but in shards of at most so many rows, one after the other.
MOST_ROWS = 4_000_000
#: Bytes before an n-gram's last one that name its shard. Orders up to this one have few rows and are in every shard.
SHARD_BYTES = 2
#: Trusted ids up to this number are sent to all executors; more are joined by a shuffle of ids and texts.
MOST_IDS = 1_000_000
#: Log probabilities are whole multiples of 1 / SCALE, so that sums are exact in any order.
SCALE = 1 << 16
#: One of so many trusted documents is not learned from, but used to set the thresholds.
FOLDS = 5
#: Share of the trusted documents not learned from that lie below their language's threshold.
QUANTILE = 0.99
#: Bytes of the typical document that are mixed into each score, so that very short texts aren't judged.
PRIOR = 100
#: Steps of log perplexity in which quantiles are counted.
STEPS = 1000


def grams(text: str) -> np.ndarray:
    """The n-gram that ends at each byte of a text in lower case, blanks as one space, after ORDER - 1 leading spaces."""
    c = np.frombuffer((" " * (ORDER - 1) + " ".join(text.lower().split())).encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    n = len(c) - ORDER + 1
    return reduce(lambda g, k: g << BITS | c[k : k + n], range(1, ORDER), c[:n])


def _low(g: Column, size: int) -> Column:
    return g.bitwiseAND(F.lit((1 << BITS * size) - 1).cast("long"))


def gram_counts(docs: DataFrame) -> DataFrame:
    """g and n: each n-gram of all texts and how often it stands there, summed in part by batch and task."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        code, times = np.unique(np.concatenate([grams(t) for t in texts(batch)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(times)], ["g", "n"])

    return map_batches(docs.select("text"), run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


def discounts(of: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and over 2, from how many n-grams have the counts 1 to 4."""
    n1, n2, n3, n4 = of
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(float(k), max(0.05, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def _steps(p: Column) -> Column:
    """The natural log of a probability in multiples of 1 / SCALE."""
    return F.round(F.log(p) * SCALE).cast("int")


def train(trusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model of the texts of ``trusted``: (k, g, logp) of each seen k-gram, and (k, h, logb) of each context.

    logp and logb are natural logs in multiples of 1 / SCALE. Counts of the highest order are of occurrences,
    those below of distinct bytes before. The tables of an order are split by n-gram over the cluster and joined
    with their contexts' totals, and with the next lower order by their last bytes; only counts of counts of each
    order reach the driver. Freed mass is a sum over three counts, so every run gives the same values.
    """
    counts = {ORDER: cut(gram_counts(trusted))}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = cut(counts[k + 1].groupBy(_low(F.col("g"), k).alias("g")).agg(F.count(F.lit(1)).alias("n")))
    probability, back = {}, []
    for k in range(1, ORDER + 1):
        of = counts[k].agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]).first()
        d = discounts([x or 0 for x in of])
        cost = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        ones, twos, more = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.count_if(F.col("n") > 2)
        stats = [F.sum("n").alias("s"), (ones * d[0] + twos * d[1] + more * d[2]).alias("freed")]
        if k == 1:
            s, freed = counts[1].agg(*stats).first()
            unseen = (freed or 0.0) / (s or 1) / (1 << BITS) or 1.0
            probability[1] = cut(counts[1].select("g", ((F.col("n") - cost) / F.lit(float(s or 1)) + F.lit(unseen)).alias("p")))
            back.append(counts[1].sparkSession.range(1).select(F.lit(1).alias("k"), F.lit(0).cast("long").alias("h"), _steps(F.lit(unseen)).alias("logb")))
            continue
        h = F.shiftright("g", BITS)
        context = cut(counts[k].groupBy(h.alias("h")).agg(*stats).select("h", "s", (F.col("freed") / F.col("s")).alias("b")))
        lower = probability[k - 1].select(F.col("g").alias("low"), F.col("p").alias("p_low"))
        joined = counts[k].select("g", "n", h.alias("h"), _low(F.col("g"), k - 1).alias("low")).join(context, "h").join(lower, "low")
        probability[k] = cut(joined.select("g", ((F.col("n") - cost) / F.col("s") + F.col("b") * F.col("p_low")).alias("p")))
        back.append(context.select(F.lit(k).alias("k"), "h", _steps(F.col("b")).alias("logb")))
    seen = [probability[k].select(F.lit(k).alias("k"), "g", _steps(F.col("p")).alias("logp")) for k in probability]
    return reduce(DataFrame.unionByName, seen), reduce(DataFrame.unionByName, back)


class Table:
    """Whole numbers by code: open addressing in two arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(1.5 * len(keys)).bit_length()))
        size = 1 << int(64 - self.shift)
        self.keys, self.values = np.full(size + 64, -1, np.int64), np.zeros(size + 64, np.int32)
        slot, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            if slot[left].max() >= len(self.keys):
                self.keys = np.concatenate((self.keys, np.full(64, -1, np.int64)))
                self.values = np.concatenate((self.values, np.zeros(64, np.int32)))
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]
            won = left[self.keys[slot[left]] == keys[left]]
            self.values[slot[won]] = values[won]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] += 1
        self.keys = np.append(self.keys, -1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none) and whether there is one."""
        slot = self.slot(keys)
        at = self.keys[slot]
        found = at == keys
        value = np.where(found, self.values[slot], np.int32(0))
        todo = np.flatnonzero(~found & (at != -1))
        while len(todo):
            slot[todo] += 1
            at = self.keys[slot[todo]]
            hit = at == keys[todo]
            value[todo[hit]] = self.values[slot[todo[hit]]]
            found[todo[hit]] = True
            todo = todo[~hit & (at != -1)]
        return value, found


class Model:
    """A trained model in memory."""

    def __init__(self, seen: DataFrame, back: DataFrame):
        """Gathers one order after the other, so that the driver never holds more than one beside the tables."""
        self.seen = {k: self.table(seen, k, "g", "logp") for k in range(1, ORDER + 1)}
        self.back = {k: self.table(back, k, "h", "logb") for k in range(2, ORDER + 1)}
        self.unseen = back.where("k = 1").first().logb

    @staticmethod
    def table(df: DataFrame, k: int, key: str, value: str) -> Table:
        got = df.where(F.col("k") == k).select(key, value).toArrow().combine_chunks()
        return Table(got.column(0).to_numpy(), got.column(1).to_numpy())

    def log_probability(self, g: np.ndarray) -> np.ndarray:
        """Log of each n-gram's last byte given those before, in steps: the longest seen suffix, backed off to."""
        total = np.zeros(len(g), np.int64)
        left = np.arange(len(g))
        for k in range(ORDER, 0, -1):
            if not len(left):
                return total
            code = g[left] & ((1 << BITS * k) - 1)
            value, found = self.seen[k].get(code)
            total[left[found]] += value[found]
            left, code = left[~found], code[~found]
            if k > 1:
                total[left] += self.back[k].get(code >> BITS)[0]
        total[left] += self.unseen
        return total


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")


def score_in_memory(docs: DataFrame, seen: DataFrame, back: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes and logp (in steps) of each row, with a model of MOST_ROWS rows at most sent to every worker."""
    held = docs.sparkSession.sparkContext.broadcast(Model(seen, back))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [grams(t) for t in texts(batch)]
        ends = np.cumsum([0, *map(len, parts)])
        sums = np.concatenate(([0], np.cumsum(held.value.log_probability(np.concatenate(parts)))))[ends]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(p) for p in parts], pa.int64()), pa.array(np.diff(sums))], ["doc_id", "lang", "n_bytes", "logp"])

    return map_batches(_rows(docs).select("doc_id", "lang", "text"), run, "doc_id long, lang string, n_bytes long, logp long")


def shards(seen: DataFrame, back: DataFrame, most_rows: int) -> list[tuple[DataFrame, DataFrame, int, int]] | None:
    """Parts of a model of ``most_rows`` rows at most beside those of low orders: its tables, and the shard keys (from, up to) they serve.

    An n-gram's key is its SHARD_BYTES bytes before the last one. All its suffixes of more than SHARD_BYTES bytes, and their
    contexts, have the same key, so each n-gram is resolved within one shard. Both tables are stored in the order of their keys,
    and a shard reads its own rows of them. Only counts by key (65,536 at most) reach the driver. None if one key alone has more rows.
    """
    places = (seen, F.shiftright("g", BITS)), (back, F.col("h"))
    keyed = [stored(df.where(F.col("k") > SHARD_BYTES).withColumn("key", _low(code, SHARD_BYTES)).repartitionByRange("key").sortWithinPartitions("key")) for df, code in places]
    counted = reduce(DataFrame.unionByName, [df.select("key") for df in keyed]).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    ranges, held = [[0, 0]], 0
    for r in counted.orderBy("key").collect():
        if r.n > most_rows:
            return None
        if held + r.n > most_rows:
            ranges.append([r.key, 0])
            held = 0
        held += r.n
    for mine, after in zip(ranges, [*ranges[1:], [1 << BITS * SHARD_BYTES]], strict=True):
        mine[1] = after[0]
    low = [cut(df.where(F.col("k") <= SHARD_BYTES)) for df in (seen, back)]
    return [(*[few.unionByName(df.where(F.col("key").between(a, b - 1)).drop("key")) for few, df in zip(low, keyed, strict=True)], a, b) for a, b in ranges]


def score_by_shards(docs: DataFrame, parts: list[tuple[DataFrame, DataFrame, int, int]]) -> DataFrame:
    """As ``score_in_memory``, to the last bit, with the ``shards`` of a larger model sent to the workers one after the other.

    A pass over the texts for each shard gives each text's count and sum of the n-grams that the shard resolves: of the
    texts themselves nothing is shuffled or written. Repeated texts give the same sums again, of which one counts.
    """
    rows, sums = _rows(docs), []
    for number, (seen, back, a, b) in enumerate(parts):
        held = docs.sparkSession.sparkContext.broadcast(Model(seen, back))

        def run(batch: pa.RecordBatch, held=held, number=number, a=a, b=b) -> pa.RecordBatch:
            found = [grams(t) for t in texts(batch)]
            ends = np.cumsum([0, *map(len, found)])
            code = np.concatenate(found)
            key = code >> BITS & ((1 << BITS * SHARD_BYTES) - 1)
            mine = (key >= a) & (key < b)
            n = np.concatenate(([0], np.cumsum(mine)))[ends]
            logp = np.concatenate(([0], np.cumsum(held.value.log_probability(code[mine]))))[n]
            some = pa.array(np.diff(n) > 0)
            out = [batch.column(0), pa.array(np.full(batch.num_rows, number, np.int32)), pa.array(np.diff(n)), pa.array(np.diff(logp))]
            return pa.RecordBatch.from_arrays([c.filter(some) for c in out], ["digest", "shard", "n_bytes", "logp"])

        sums.append(stored(map_batches(rows.select("digest", "text"), run, "digest binary, shard int, n_bytes long, logp long")))
        held.destroy()
    one = reduce(DataFrame.unionByName, sums).groupBy("digest", "shard").agg(F.max("n_bytes").alias("n_bytes"), F.max("logp").alias("logp"))
    return _with_sums(rows, one.groupBy("digest").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("logp").alias("logp")))


def _with_sums(rows: DataFrame, scored: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return rows.drop("text").join(scored, "digest", "left").select("doc_id", "lang", *[F.coalesce(c, zero).alias(c) for c in ("n_bytes", "logp")])


def score_by_join(docs: DataFrame, seen: DataFrame, back: DataFrame) -> DataFrame:
    """As ``score_in_memory``, to the last bit, for a model of any size.

    The distinct n-grams of all texts are resolved order by order in joins split by n-gram; the counted n-grams of
    each distinct text then join the resolved ones, the hottest of which the planner may split, and texts' sums
    join their rows by digest.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(grams(t), return_counts=True) for t in texts(batch)]
        ends = pa.array(np.cumsum([0, *[len(c) for c, _ in found]]).astype(np.int32))
        listed = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[k] for f in found]).astype(np.int64))) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), *listed], ["digest", "g", "n"])

    rows = _rows(docs)
    listed = map_batches(rows.select("digest", "text").dropDuplicates(["digest"]), run, "digest binary, g array<long>, n array<long>")
    counted = stored(listed.select("digest", F.explode(F.arrays_zip("g", "n")).alias("x")).select("digest", "x.g", "x.n"))
    todo, done = counted.select("g").distinct().withColumn("sum", F.lit(0).cast("long")), []
    for k in range(ORDER, 0, -1):
        mine = seen.where(F.col("k") == k).select(F.col("g").alias("key"), "logp")
        tried = cut(todo.withColumn("key", _low(F.col("g"), k)).join(mine, "key", "left"))
        done.append(tried.where("logp is not null").select("g", (F.col("sum") + F.col("logp")).alias("value")))
        todo = tried.where("logp is null").select("g", "sum", F.shiftright("key", BITS).alias("h"))
        context = back.where(F.col("k") == k).select("h", "logb")
        todo = todo.join(context, "h", "left").select("g", (F.col("sum") + F.coalesce("logb", F.lit(0))).alias("sum"))
    done.append(todo.select("g", F.col("sum").alias("value")))
    value = stored(reduce(DataFrame.unionByName, done))
    scored = counted.join(value, "g").groupBy("digest").agg(F.sum("n").alias("n_bytes"), F.sum(F.col("n") * F.col("value")).alias("logp"))
    return _with_sums(rows, scored)


def score(docs: DataFrame, seen: DataFrame, back: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, lang, n_bytes and logp of each row: by the whole model in memory, its shards, or joins where not even one key's rows may be held."""
    if seen.count() + back.count() <= most_rows:
        return score_in_memory(docs, seen, back)
    parts = shards(seen, back, most_rows)
    return score_by_join(docs, seen, back) if parts is None else score_by_shards(docs, parts)


def quantile_by(scores: DataFrame, value: str, by: list[str], share: float) -> DataFrame:
    """The ``share`` quantile of ``value`` in each group, of values rounded up to steps.

    An aggregate that counts rows by step, in part before the shuffle, so a group of most rows becomes its steps.
    """
    return scores.groupBy(*by).agg((F.percentile(F.ceil(F.col(value) * STEPS), share) / STEPS).alias(value))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents whose labels all have quality 1, and toxic 0 where there is such a column."""
    bad = F.max(F.coalesce(F.col("toxic").cast("int"), F.lit(0))) if "toxic" in labels.columns else F.lit(0)
    found = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), bad.alias("bad"))
    return found.where("q = 1 and bad = 0 and doc_id is not null").select("doc_id")


def is_held_out(folds: int) -> Column:
    """One fold of the documents by a hash of doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, folds: int = FOLDS, most_rows: int = MOST_ROWS, most_ids: int = MOST_IDS) -> DataFrame:
    """doc_id, lang, n_bytes, log_perplexity, threshold and kept of each row.

    The model learns from all trusted texts (see ``trusted_ids``) of all folds but one. log_perplexity is the mean
    of -log p over the text's bytes and PRIOR bytes of the typical trusted document of its language. threshold is
    the ``quantile`` of the trusted documents of the language that the model has not learned from, so that it
    holds for documents at large; languages without one take that of all such documents, and without any the
    threshold is null and all is kept. Null and empty texts have the typical score and are kept; a null lang
    counts as a language of its own. Repeated rows come back each, and count as often. Trusted ids are sent
    to all executors up to ``most_ids`` of them; with more, ids and texts are shuffled.
    """
    trusted = stored(trusted_ids(labels))
    few = trusted.count() <= most_ids
    learn, judge = (F.broadcast(x) if few else x for x in (trusted.where(~is_held_out(folds)), trusted.where(is_held_out(folds))))
    seen, back = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(learn, "doc_id", "left_semi"))
    scores = cut(score(docs, seen, back, most_rows).withColumn("log_perplexity", -F.col("logp") / SCALE))
    known = scores.where("n_bytes > 0").join(judge, "doc_id", "left_semi").withColumn("mean", F.col("log_perplexity") / F.col("n_bytes"))
    typical = stored(quantile_by(known, "mean", ["lang"], 0.5).withColumnRenamed("mean", "typical"))
    middle = F.coalesce("typical", known.agg((F.percentile(F.ceil(F.col("mean") * STEPS), 0.5) / STEPS).alias("m")).scalar(), F.lit(0.0))
    smooth = (F.col("log_perplexity") + PRIOR * middle) / (F.col("n_bytes") + PRIOR)
    scores = cut(scores.join(F.broadcast(typical) if few else typical, "lang", "left").withColumn("log_perplexity", smooth))
    known = scores.where("n_bytes > 0").join(judge, "doc_id", "left_semi")
    limit = stored(quantile_by(known, "log_perplexity", ["lang"], quantile).withColumnRenamed("log_perplexity", "own"))
    anyone = known.agg((F.percentile(F.ceil(F.col("log_perplexity") * STEPS), quantile) / STEPS).alias("m"))
    out = scores.join(F.broadcast(limit) if few else limit, "lang", "left").withColumn("threshold", F.coalesce("own", anyone.scalar()))
    kept = F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", F.nullif("lang", F.lit("")).alias("lang"), "n_bytes", "log_perplexity", "threshold", kept.alias("kept"))
