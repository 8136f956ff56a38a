"""Quality rules: word and line statistics of a text, and lines that too many documents of a host share."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import map_batches, replaced, stored, whole_row, with_row

SYMBOLS = "#*$%&|<>"
#: A line is boilerplate if over MOST_DOCS distinct documents of its host have it.
MOST_DOCS = 20
#: Boilerplate lines (8 bytes each) that every worker holds at most; more of them are joined with the documents.
MOST_HELD = 1_000_000
#: A document is depleted if less than this share of its words is left.
LEAST_LEFT = 0.3
COUNTS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_words", "removed_words", "removed_lines")


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words and n_words of one text."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), n


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    fresh = count()
    ids = np.fromiter((seen[w] if w in seen else seen.setdefault(w, next(fresh)) for w in words), np.int64, n)
    pair = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(seen) + ids[2:]
    _, at, times = np.unique(window, return_inverse=True, return_counts=True)
    twice = times[at] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def line_hashes(text: Column) -> Column:
    """Hash (0: blank) of each line in order, in lower case, its digits 0, each run of blanks one space, none at the ends."""
    flat = F.translate(F.lower(text), "123456789\t\v\f\r", "0" * 9 + " " * 4)
    tight = F.regexp_replace(flat, " {2,}", " ")
    bare = F.btrim(F.replace(F.replace(tight, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n")))
    return F.transform(F.split(bare, "\n"), lambda x: F.when(x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x)))


def _host() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def host_lines(docs: DataFrame, unit: str = "doc") -> DataFrame:
    """host, digest and lines (distinct hashes, blank ones aside) of each distinct text of a host; with ``unit`` "doc" of each doc_id too."""
    text = F.coalesce("text", F.lit(""))
    lines = F.array_distinct(F.filter(line_hashes(text), lambda h: h != 0))
    found = docs.select(_host().alias("host"), _digest(text).alias("digest"), lines.alias("lines"), *["doc_id"] * (unit == "doc"))
    return found.dropDuplicates(["host", "digest", *["doc_id"] * (unit == "doc")])


def boilerplate(docs: DataFrame, most_docs: int = MOST_DOCS, unit: str = "doc") -> DataFrame:
    """host and line (hash) over the limit, kept in the shared folder.

    Frequency is the number of distinct documents of the host (``source``, null as the empty string) with the
    line; rows that repeat doc_id and text are one. With ``unit`` "text", documents of the same text count once, so exact copies never
    make each other's lines boilerplate. Counts are summed in part before they are shuffled, so one
    line or host of most rows is no hot spot.
    """
    each = host_lines(docs, unit).select("host", F.explode("lines").alias("line"))
    return stored(each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_docs).select("host", "line"))


def quality(docs: DataFrame, most_docs: int = MOST_DOCS, least_left: float = LEAST_LEFT, unit: str = "doc", most_held: int = MOST_HELD) -> DataFrame:
    """row (a struct of the columns of ``docs``), report and left (the text without boilerplate lines).

    report has the base counts, base_failed (under 50 words, or over half of them in repeated windows of three),
    removed_words, removed_lines, depleted and kept. A null text has no words and fails; its ``left`` is null.
    Repeated rows stay and get the same report. Up to ``most_held`` boilerplate lines are sent to every worker, so
    that no text is shuffled; more are joined by host and line with the lines of distinct texts, and what
    a text has of them comes back by its digest. Both ways give the same rows.
    """
    over = boilerplate(docs, most_docs, unit)
    text = F.coalesce("row.text", F.lit(""))
    inner = docs.select(whole_row(docs)).select("row", F.coalesce(F.col("row.source").cast("string"), F.lit("")).alias("host"), F.when(F.col("row.text").isNotNull(), line_hashes(F.col("row.text"))).alias("hashes"))
    held = None
    if over.count() <= most_held:
        found = over.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines")).toArrow()
        lists = dict(zip(found.column("host").to_pylist(), [np.asarray(x.values) for x in found.column("lines")], strict=True))
        held = docs.sparkSession.sparkContext.broadcast(lists)
    else:
        marks = host_lines(docs, "text").select("host", "digest", F.explode("lines").alias("line")).join(over, ["host", "line"]).groupBy("host", "digest").agg(F.collect_list("line").alias("lines"))
        inner = inner.withColumn("digest", _digest(text)).join(marks, ["host", "digest"], "left").select("row", "host", "hashes", "lines")
    none = np.empty(0, np.int64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, hashes = batch.column("row"), batch.column("hashes")
        hosts = batch.column("host").to_pylist() if held else None
        out = []
        for k, text in enumerate(row.field("text").to_pylist()):
            lines = held.value.get(hosts[k], none) if held else np.asarray(batch.column("lines")[k].values) if batch.column("lines")[k].is_valid else none
            out.append((*base_counts(text or ""), *without_lines(text, np.asarray(hashes[k].values) if hashes[k].is_valid else none, lines)))
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([row, *[pa.array(c, pa.int64()) for c in columns[:-1]], pa.array(columns[-1], pa.string())], ["row", *COUNTS, "left"])

    found = map_batches(inner, run, with_row(docs, ", ".join(f"{c} long" for c in COUNTS) + ", left string"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("n_words") - F.col("removed_words") < least_left * F.col("n_words")
    return found.select("row", F.struct(*COUNTS, failed.alias("base_failed"), depleted.alias("depleted"), (~failed & ~depleted).alias("kept")).alias("report"), "left")


def without_lines(text: str | None, hashes: np.ndarray, lines: np.ndarray) -> tuple[int, int, str | None]:
    """Words and lines removed, and the text without the lines whose hashes are among ``lines``."""
    if not len(lines) or not len(hashes):
        return 0, 0, text
    gone = np.isin(hashes, lines) & (hashes != 0)
    if not gone.any():
        return 0, 0, text
    parts = text.split("\n")
    at = np.flatnonzero(gone).tolist()
    words = sum(len(parts[k].encode().split()) for k in at)
    return words, len(at), "\n".join([parts[k] for k in np.flatnonzero(~gone).tolist()])


def keep_quality(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs`` with their boilerplate lines removed; n_chars, where it is there, follows.

    Distinct texts are counted here: a later stage keeps one of a group of copies, which must not have gone by its own copies' count.
    """
    return quality(docs, unit="text").where("report.kept").select(*replaced(docs, F.col("left"), F.col("report.removed_lines") > 0))
