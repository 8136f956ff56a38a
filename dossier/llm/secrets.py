"""Secret scans by DataFrame expressions: three base patterns, and strings that a test battery finds random."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.binding import let
from dossier.llm.common import replaced, whole_row

#: The base patterns. Letters of the names count in either case.
ASSIGN = (
    "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
#: Runs of so many characters or more are candidates of the battery.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: By encoding: its test, and its alphabet in order of value.
ENCODINGS = (
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: Chance that two characters of a prose word agree; structured strings of an alphabet of k do in 2 / k at least.
PROSE = 0.065
#: Least joint p-value of the chi-squared, runs and serial-correlation tests of a string that passes as random.
LEAST_RANDOM = 0.005
# Coefficients of a published expansion of the complementary error function (relative error under 1.2e-7 everywhere).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
#: Terms of a Poisson tail that are added one by one.
TERMS = 60
#: Expected share of false discoveries, upper ends of the length classes, and steps of -log10 p.
FALSE_SHARE, CLASSES, STEPS, LEVELS = 0.05, (23, 31, 47, 63), 20, 400
BLOCK = 256


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>>: the matches of ``pattern`` with their places in code points.

    The places are running sums of the lengths of what stands between matches and of the matches, in blocks
    of BLOCK, so that a text with very many matches stays cheap.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = let(
        F.struct(found.alias("m"), F.split(text, pattern, -1).alias("b")),
        lambda p: F.transform(p["m"], lambda m, k: F.struct(F.length(F.get(p["b"], k)).alias("gap"), F.length(m).alias("size"), m.alias("value"))),
    )
    blocks = let(parts, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda k: F.slice(p, k * BLOCK + 1, BLOCK)))
    return let(blocks, lambda bs: F.flatten(F.zip_with(bs, _starts(bs), _in_block)))


def _starts(blocks: Column) -> Column:
    empty = F.array().cast("array<int>")
    return F.aggregate(
        F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x["gap"] + x["size"])),
        F.struct(empty.alias("a"), F.lit(0).alias("at")),
        lambda s, n: F.struct(F.array_append(s["a"], s["at"]).alias("a"), (s["at"] + n).alias("at")),
        lambda s: s["a"],
    )


def _in_block(block: Column, start: Column) -> Column:
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.aggregate(
        block,
        F.struct(empty.alias("a"), start.alias("at")),
        lambda s, x: F.struct(
            F.array_append(s["a"], F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["size"]).alias("end"), x["value"].alias("value"))).alias("a"),
            (s["at"] + x["gap"] + x["size"]).alias("at"),
        ),
        lambda s: s["a"],
    )


def matches(text: Column, pattern: str) -> Column:
    """As ``located``; texts without a match skip the work."""
    return F.when(text.rlike(pattern), located(text, pattern)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of the base patterns; kind is the place in KINDS."""
    long_enough = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 1)) >= 12)
    kinds = (long_enough, matches(text, ACCESS), matches(text, HEX))
    return F.array_sort(F.concat(*[_of_kind(m, k) for k, m in enumerate(kinds)]))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def erfc(x: Column) -> Column:
    """Complementary error function of a value of 0 or more, to 7 digits however small it is."""

    def at(t: Column) -> Column:
        power = F.lit(ERFC[-1])
        for c in reversed(ERFC[:-1]):
            power = power * t + c
        return t * F.exp(power - x * x)

    return let(1 / (1 + x / 2), at)


def two_sided(z: Column) -> Column:
    """Chance that a standard normal value is as far from 0 as ``z``."""
    return erfc(F.abs(z) / math.sqrt(2))


def upper_tail(z: Column) -> Column:
    """Chance that a standard normal value is above ``z``."""
    return let(two_sided(z) / 2, lambda half: F.when(z > 0, half).otherwise(1 - half))


def joint(*ps: Column) -> Column:
    """Joint p-value of three independent tests by Fisher's method: minus the logarithm of their product is half a chi-squared value of 6 degrees."""
    logs = -sum((F.ln(F.greatest(p, F.lit(1e-300))) for p in ps), F.lit(0.0))
    return let(logs, lambda h: F.exp(-h) * (1 + h + h * h / 2))


def log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series from x + 8 on, and the factors between."""
    up = x + 8
    near = (up + 0.5) * F.ln(up) - up + math.log(2 * math.pi) / 2 + 1 / (12 * up) - 1 / (360 * up * up * up) + 1 / (1260 * F.pow(up, F.lit(5.0)))
    return near - sum((F.ln(x + k) for k in range(1, 9)), F.lit(0.0))


def poisson_at_most(x: Column, mean: Column) -> Column:
    """Base-10 logarithm of the chance that a Poisson count of ``mean`` is at most ``x``, for ``x`` under the mean; else 0.

    The chance of ``x`` itself, times a sum of falling ratios; what is left after TERMS of them is bounded by a geometric sum.
    """
    ratios = F.aggregate(
        F.sequence(F.lit(0), F.lit(TERMS - 1)),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, j: let(s["term"] * F.greatest(x - j, F.lit(0.0)) / mean, lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum"))),
        lambda s: s["sum"] + s["term"] * x / (mean - x),
    )
    return F.when(x < mean, F.least(F.lit(0.0), (x * F.ln(mean) - mean - log_factorial(x) + F.ln(ratios)) / math.log(10))).otherwise(0.0)


def battery(value: Column) -> Column:
    """struct<class, level> of a candidate: its length class, and -log10 of its p-value in steps.

    The encoding is the first of ENCODINGS that takes all characters ('=' aside). The p-values of chi-squared uniformity over its
    alphabet (Wilson-Hilferty score, upper tail), of the runs test on upper and lower half of the alphabet and of lag-one serial
    correlation (both two-sided) are joined by Fisher's method, and the string passes as random from LEAST_RANDOM on. Its own p-value is
    the chance that a structured string has as low a chi-squared value, which is as few pairs of equal characters: their number is a
    Poisson count whose mean grows with the square of the length, so short strings can't reach small values. Digits alone, and
    failures, have level 0.
    """
    body = F.translate(value, "=", "")
    alphabet = F.lit(ENCODINGS[-1][1])
    for test, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(body.rlike(test), F.lit(letters)).otherwise(alphabet)

    def counts(s: Column) -> Column:
        """Length, alphabet, sum of squared symbol counts, values in the upper half, and mean of the values."""
        v, k = s["v"], s["k"].cast("double")
        squares = total(F.transform(F.array_distinct(v), lambda x: F.pow(F.size(F.filter(v, lambda y: y == x)).cast("double"), F.lit(2.0))))
        upper = F.size(F.filter(v, lambda x: x * 2 >= k)).cast("double")
        mean = total(v) / F.size(v)
        return F.struct(v.alias("v"), k.alias("k"), F.size(v).cast("double").alias("n"), squares.alias("squares"), upper.alias("upper"), mean.alias("mean"))

    def sums(s: Column) -> Column:
        """What the tests need besides: changes between the halves, and sums of squares and of lagged products."""
        v, k, mean = s["v"], s["k"], s["mean"]
        after = F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0)))
        turns = total(F.zip_with(v, after, lambda x, y: F.coalesce(((x * 2 >= k) != (y * 2 >= k)).cast("double"), F.lit(0.0))))
        lagged = total(F.zip_with(v, after, lambda x, y: F.coalesce((x - mean) * (y - mean), F.lit(0.0))))
        power = total(F.transform(v, lambda x: (x - mean) * (x - mean)))
        product = 2 * s["upper"] * (s["n"] - s["upper"])
        return F.struct(*[s[c].alias(c) for c in ("k", "n", "squares")], turns.alias("turns"), lagged.alias("lagged"), power.alias("power"), product.alias("product"))

    def scores(s: Column) -> Column:
        k, n = s["k"], s["n"]
        spread = 2 / (9 * (k - 1))
        z_chi = (F.pow((k / n * s["squares"] - n) / (k - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
        variance = s["product"] * (s["product"] - n) / (n * n * (n - 1))
        z_runs = F.when(variance > 0, (s["turns"] - s["product"] / n) / F.sqrt(variance)).otherwise(-F.sqrt(n))
        z_serial = F.when(s["power"] > 0, s["lagged"] / s["power"] * F.sqrt(n)).otherwise(F.sqrt(n))
        random = joint(upper_tail(z_chi), two_sided(z_runs), two_sided(z_serial)) >= LEAST_RANDOM
        expected = n * (n - 1) / 2 * F.greatest(F.lit(PROSE), 2 / k)
        small = let(F.struct(((s["squares"] - n) / 2).alias("x"), expected.alias("mean")), lambda v: poisson_at_most(v["x"], v["mean"]))
        return F.when(random, F.least(F.lit(LEVELS), F.floor(-STEPS * small).cast("int"))).otherwise(0)

    length = F.length(value)
    cls = sum((F.when(length > c, 1).otherwise(0) for c in CLASSES), F.lit(0))
    values = let(alphabet, lambda a: F.struct(F.transform(F.split(body, ""), lambda c: (F.position(c, a) - 1).cast("double")).alias("v"), F.length(a).alias("k")))
    level = F.when(body.rlike("^[0-9]*$"), F.lit(0)).otherwise(let(let(let(values, counts), sums), scores))
    return F.struct(cls.alias("class"), F.greatest(F.lit(0), level).alias("level"))


def candidates(text: Column) -> Column:
    """array<struct<start, end, class, level>> of the battery's candidates."""
    return F.transform(
        matches(text, CANDIDATE),
        lambda m: let(battery(m["value"]), lambda t: F.struct(m["start"].alias("start"), m["end"].alias("end"), t["class"].alias("class"), t["level"].alias("level"))),
    )


def levels(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """One row: ``least``, a map from length class to the least level that counts as a discovery.

    Benjamini-Hochberg in each length class, over the candidates of all texts: the least level at which (number
    of candidates) * (largest p-value of that level) is at most ``false_share`` of those at it or above. Only
    counts by class and level are gathered, of which there are (len(CLASSES) + 1) * (LEVELS + 1) at most.
    """
    counts = docs.select(F.explode(candidates(F.coalesce("text", F.lit("")))).alias("c")).groupBy("c.class", "c.level").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("class")
    summed = counts.withColumn("all", F.sum("n").over(w)).withColumn("above", F.sum("n").over(w.orderBy(F.desc("level"))))
    passing = summed.where((F.col("level") > 0) & (F.col("all") * F.pow(F.lit(10.0), -F.col("level") / STEPS) <= false_share * F.col("above")))
    least = passing.groupBy("class").agg(F.min("level").alias("level"))
    return least.agg(F.map_from_entries(F.collect_list(F.struct("class", "level"))).alias("least"))


def scan(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """row (a struct of the columns of ``docs``), base and spans (arrays of struct<start, kind, end>) of each row.

    base has the matches of the three patterns; spans adds the random strings that no base match overlaps. Both
    are ordered by start, then kind; places are code points, ends exclusive. A null or empty text has none. The
    texts are read twice, for the thresholds and for the spans, and never shuffled.
    """
    least = levels(docs.select("text"), false_share).scalar()
    text = F.coalesce("text", F.lit(""))
    found = docs.select(whole_row(docs), base_spans(text).alias("base"), candidates(text).alias("strings"), least.alias("least"))
    more = F.filter(
        "strings",
        lambda c: (c["level"] >= F.coalesce(F.try_element_at("least", c["class"]), F.lit(LEVELS + 1))) & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    added = _of_kind(more, KINDS.index("random"))
    return found.select("row", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each stretch of overlapping spans replaced by ``mark``."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    joined = F.aggregate(
        spans,
        F.struct(none.alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end")),
        lambda a, s: F.when(s["start"] < a["end"], F.struct(a["done"].alias("done"), a["start"].alias("start"), F.greatest(a["end"], s["end"]).alias("end"))).otherwise(
            F.struct(
                F.when(a["end"] >= 0, F.array_append(a["done"], F.struct(a["start"].alias("start"), a["end"].alias("end")))).otherwise(a["done"]).alias("done"),
                s["start"].alias("start"),
                s["end"].alias("end"),
            )
        ),
        lambda a: F.when(a["end"] >= 0, F.array_append(a["done"], F.struct(a["start"].alias("start"), a["end"].alias("end")))).otherwise(a["done"]),
    )

    def cut_out(at: Column) -> Column:
        n = F.size(at)
        begin = lambda k: F.when(k == 0, 0).otherwise(F.get(at, k - 1)["end"])
        kept = F.transform(F.sequence(F.lit(0), n), lambda k: F.substring(text, begin(k) + 1, F.when(k == n, F.length(text)).otherwise(F.get(at, k)["start"]) - begin(k)))
        return F.array_join(kept, mark)

    return F.when(F.size(spans) > 0, let(joined, cut_out)).otherwise(text)


def redact(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """``docs`` with the secrets of their texts replaced by a mark; n_chars, where it is there, follows the text."""
    return scan(docs, false_share).select(*replaced(docs, redacted(F.col("row.text"), F.col("spans")), F.size("spans") > 0))
