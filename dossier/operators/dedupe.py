"""Removal of repeated and cut-off entries, and merging of a section's bodies."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import text as tx
from dossier.operators.graph import connected_components
from dossier.sources.shared import cut

#: Least length of a cut-off entry, how much longer its whole must be, and prefixes of the merge.
CUT_LEAST, CUT_MORE, RAW_PREFIX, TITLE_PREFIX, TITLE_LEAST = 30, 4, 60, 30, 15
#: Entries of a section that one sequential pass takes at most; in a larger one only those that bear on each other meet.
SECTION_MOST = 2000


def exact(entries: DataFrame, group: list[str], order: str) -> DataFrame:
    """First entry, by ``order``, of those with the same year and normalized raw text in a group."""
    w = Window.partitionBy(*group, "year", F.xxhash64("norm"), "norm").orderBy(order)
    return entries.withColumn("norm", tx.normalize(F.col("raw_text"))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "norm")


def truncated(entries: DataFrame, group: list[str], key: str = "entry_id") -> DataFrame:
    """Without entries that end in a year and are a prefix of a longer entry of the same year in their group.

    The prefix test is an equi-join on group, year and the first CUT_LEAST characters, and then a comparison.
    """
    e = entries.withColumn("norm", tx.normalize(F.col("raw_text"))).withColumn("head", F.substring("norm", 1, CUT_LEAST))
    on = [*group, "year", "head"]
    cut = e.where((F.length("norm") >= CUT_LEAST) & F.col("norm").rlike("(19|20)\\d{2}$"))
    whole = e.select(*on, F.col("norm").alias("whole")).distinct()
    gone = cut.join(whole, on).where((F.length("whole") > F.length("norm") + CUT_MORE) & F.startswith("whole", F.col("norm"))).select(key).distinct()
    return entries.join(gone, key, "left_anti")


def deduped(entries: DataFrame, group: list[str], order: str = "entry_order", key: str = "entry_id") -> DataFrame:
    return truncated(exact(entries, group, order), group, key)


def merge_bodies(entries: DataFrame, group: list[str], body: str = "sec_no", most: int = SECTION_MOST) -> DataFrame:
    """Entries of a section's bodies as one list: a later body adds what the earlier ones lack.

    Bodies are taken in their order; each one is held against what is kept before it. A section of up to ``most`` entries is one
    sequential pass. Of a larger one only entries that bear on each other meet in a pass, see ``related``; both ways
    give the same rows. A section with more than one body is numbered anew from 0; one body keeps its numbers.
    """
    given = entries.columns
    e = entries.withColumns({"_norm": tx.normalize(F.col("raw_text")), "_title": tx.normalize(F.col("title")), "_year": F.col("year").cast("int")})
    e = cut(e.withColumn("_uid", F.monotonically_increasing_id()))
    sizes = e.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), (F.min(body) != F.max(body)).alias("_many"))
    on = [F.col(f"e.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group]
    e = e.alias("e").join(sizes.alias("s"), on).select("e.*", "_n", "_many")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([body, "entry_order", "_uid"])
        return rows.iloc[merged(rows[body].tolist(), list(zip(rows["_norm"], rows["_title"], rows["_year"], strict=True)))]

    small = e.where(F.col("_n") <= most).repartition(*group).sortWithinPartitions(*group, body, "entry_order", "_uid")
    done = small.mapInArrow(lambda batches: section_passes(batches, group, body), e.schema)
    large = e.where(F.col("_n") > most)
    if most < 1 or not large.isEmpty():
        large = cut(large)
        roots = cut(connected_components(related(large, group)).select(F.col("node").alias("_uid"), F.col("root").alias("_root")))
        met = large.join(roots, "_uid").groupBy("_root").applyInPandas(lambda rows: run(rows.drop(columns="_root")), e.schema)
        done = done.unionByName(met).unionByName(large.join(roots, "_uid", "left_anti"))
    place = (F.row_number().over(Window.partitionBy(*group).orderBy(body, "entry_order", "_uid")) - 1).cast(entries.schema["entry_order"].dataType)
    return done.withColumn("entry_order", F.when(F.col("_many"), place).otherwise(F.col("entry_order"))).select(*given)


def merged(bodies: list[int], held: list[tuple[str, str, int]]) -> list[int]:
    """Places of the entries (text, title, year) that stay, of those of a section in the order of their ``bodies``."""
    kept: list[int] = []
    for _, new in groupby(range(len(held)), bodies.__getitem__):
        before = [held[k] for k in kept]
        kept = without_repeats(kept + [k for k in new if not any(same_entry(held[k], old) for old in before)], held)
    return kept


def section_passes(batches: Iterator[pa.RecordBatch], group: list[str], body: str) -> Iterator[pa.RecordBatch]:
    """Rows that stay of sections that come one after the other, each in the order of its bodies; most sections are small, so many share a batch."""

    def passed(rows: pa.Table, keys: list[tuple]) -> Iterator[pa.RecordBatch]:
        bodies, held = rows[body].to_pylist(), list(zip(*(rows[c].to_pylist() for c in ("_norm", "_title", "_year")), strict=True))
        kept, at = [], 0
        for _, same in groupby(keys):
            end = at + sum(1 for _ in same)
            kept += [at + k for k in merged(bodies[at:end], held[at:end])]
            at = end
        yield from rows.take(pa.array(kept, pa.int64())).to_batches()

    rest, rest_keys = None, []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        keys = rest_keys + list(zip(*(rows[c].to_pylist() for c in group), strict=True))
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        whole = len(keys)
        while whole and keys[whole - 1] == keys[-1]:
            whole -= 1
        if whole:
            yield from passed(rows.slice(0, whole), keys[:whole])
        rest, rest_keys = rows.slice(whole), keys[whole:]
    if rest is not None:
        yield from passed(rest, rest_keys)


def windows(text: Column, size: Column | int) -> Column:
    """Hashes of the distinct stretches of ``size`` characters; none if the text is shorter."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda k: F.xxhash64(F.substring(text, k, size)))))


def related(entries: DataFrame, group: list[str]) -> DataFrame:
    """Edges (a, b) of _uid that join any two entries of a section of which one may decide on the other, by equi-joins on hashes.

    Equal texts; a text that ends in a year and the texts of its year that it begins; and two texts of which one holds the first
    RAW_PREFIX characters of the other while one holds the start of the other's title. All that share a key are joined to its
    first one, so that copies give no pairs. A hash that two stretches share joins more than it must, which changes no result.
    """
    e = entries.select("_uid", F.xxhash64(*group).alias("g"), F.col("_norm").alias("n"), F.substring("_title", 1, TITLE_PREFIX).alias("t"), F.col("_year").alias("y"))

    def star(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
        """Joins the rows of ``left`` and ``right`` that share a key, each to the least of ``left``."""
        first = left.groupBy(*on).agg(F.min("_uid").alias("a"))
        both = left.select("_uid", *on).unionByName(right.select("_uid", *on))
        return both.join(first, [*on]).select("a", F.col("_uid").alias("b")).where("a <> b")

    none = e.select("_uid", "g", F.xxhash64("n").alias("k")).where("false")
    equal = star(e.select("_uid", "g", F.xxhash64("n").alias("k")), none, "g", "k")
    short = e.where((F.length("n") >= CUT_LEAST) & F.col("n").rlike("(19|20)\\d{2}$")).select("_uid", "g", "y", F.substring("n", 1, CUT_LEAST).alias("head"), F.length("n").alias("size"), F.xxhash64("n").alias("k"))
    sizes = short.select("g", "y", "head", "size").distinct()
    long = e.select("_uid", "g", "y", "n", F.substring("n", 1, CUT_LEAST).alias("head")).join(sizes, ["g", "y", "head"]).where(F.length("n") > F.col("size"))
    begun = star(short, long.withColumn("k", F.xxhash64(F.substring("n", F.lit(1), F.col("size")))), "g", "y", "size", "k")

    owners = e.where(F.length("n") >= RAW_PREFIX).withColumn("p", F.xxhash64(F.substring("n", 1, RAW_PREFIX)))
    holders = e.select("_uid", "g", "n", "t", F.explode(windows(F.col("n"), RAW_PREFIX)).alias("p")).join(owners.select("g", "p").distinct(), ["g", "p"])
    titled = lambda df: df.where(F.length("t") >= TITLE_LEAST).select("_uid", "g", "p", F.length("t").alias("size"), F.xxhash64("t").alias("k"))

    def in_text(of: DataFrame, titles: DataFrame) -> DataFrame:
        """The stretches of the texts of ``of`` that are as long as a title met under the same prefix."""
        return of.join(titles.select("g", "p", "size").distinct(), ["g", "p"]).select("_uid", "g", "p", "size", F.explode(windows(F.col("n"), F.col("size"))).alias("k"))

    theirs, mine = titled(owners), titled(holders)
    edges = [equal, begun, star(theirs, in_text(holders, theirs), "g", "p", "size", "k"), star(mine, in_text(owners, mine), "g", "p", "size", "k")]
    return reduce(DataFrame.unionByName, edges)


def same_entry(new: tuple[str, str, int], old: tuple[str, str, int]) -> bool:
    """Two entries (text, title, year) of different bodies are one: equal, or a long prefix and a title of one stand in the other."""
    (n, title, _), (o, other, _) = new, old
    if n == o:
        return True
    near = (len(o) >= RAW_PREFIX and o[:RAW_PREFIX] in n) or (len(n) >= RAW_PREFIX and n[:RAW_PREFIX] in o)
    t, u = title[:TITLE_PREFIX], other[:TITLE_PREFIX]
    return near and ((len(u) >= TITLE_LEAST and u in n) or (len(t) >= TITLE_LEAST and t in o))


def without_repeats(places: list[int], held: list[tuple[str, str, int]]) -> list[int]:
    """As ``deduped``, for the entries at ``places`` in their order."""
    first: dict[tuple, int] = {}
    for k in places:
        first.setdefault((held[k][2], held[k][0]), k)
    heads: dict[tuple, list[str]] = {}
    for k in first.values():
        heads.setdefault((held[k][2], held[k][0][:CUT_LEAST]), []).append(held[k][0])

    def is_cut(k: int) -> bool:
        norm, _, year = held[k]
        if len(norm) < CUT_LEAST or not re.search(r"(19|20)\d{2}$", norm):
            return False
        return any(len(x) > len(norm) + CUT_MORE and x.startswith(norm) for x in heads[year, norm[:CUT_LEAST]])

    return [k for k in first.values() if not is_cut(k)]
