"""Benchmark decontamination with a generalised suffix automaton of the test items' words."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import map_batches, replaced, stored, whole_row, with_row

#: Bytes of words keep their place, in lower case; all others turn to spaces.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
WINDOW = 10
#: UTF-8 bytes of items that one automaton takes (it needs about 90 times as many), and automata of one pass over the rows.
BLOCK_BYTES, PASS_BLOCKS = 1 << 20, 2
#: ranges are word indexes, spans code points of the text; ends are exclusive.
REPORT = "n_words:long,n_hit:long,n_items:long,item_ids:array<string>,ranges:array<struct<start:int,end:int>>,spans:array<struct<start:int,end:int>>,longest:long,leaked:boolean"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


class Found(NamedTuple):
    """Hit word ranges (end exclusive), items found, the longest match, and whether an item was covered."""

    ranges: list[list[int]]
    items: set[str]
    longest: int
    leaked: bool


class SuffixAutomaton:
    """All substrings of all items. ``coverage``: the share of an item that counts as the whole of it."""

    def __init__(self, items: Iterable[tuple[str, Sequence[bytes]]], window: int = WINDOW, coverage: float = 0.5):
        self.window, self.vocab = window, {}
        self.next, self.link, self.size = [{}], [-1], [0]
        self.ids, self.lengths, paths = [], [], []
        for item, words in items:
            if words:
                codes = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
                at = 0
                for c in codes:
                    at = self._extend(at, c)
                self.ids.append(item)
                self.lengths.append(len(codes))
                paths.append(codes)
        self.coverage = coverage
        self.least = min([window, *self.lengths])
        self.holds: list[tuple[int, ...]] = [()] * len(self.next)
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        held: list[list[int]] = [[] for _ in self.next]
        for k, codes in enumerate(paths):
            at = 0
            for c in codes:
                at = u = self.next[at][c]
                while self.size[u] >= window and (not held[u] or held[u][-1] != k):
                    held[u].append(k)
                    u = self.link[u]
            if len(codes) < window:
                while self.size[self.link[at]] >= len(codes):
                    at = self.link[at]
                self.short[at] += ((k, len(codes)),)
        self.holds = [tuple(h) for h in held]
        for u in sorted(range(1, len(self.next)), key=self.size.__getitem__):
            self.short[u] += self.short[self.link[u]]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        if c in nxt[last]:
            q = nxt[last][c]
            return q if size[q] == size[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = copy
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def scan(self, words: Sequence[bytes]) -> Found:
        """Streams a document's words through the automaton; words that no item has set it back at once."""
        n = len(words)
        codes = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, n)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], codes >= 0, [False])).view(np.int8)))
        found = Found([], set(), 0, False)
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= self.least:
                found = self._run(codes[a:b].tolist(), a, found)
        return found

    def _run(self, codes: list[int], at: int, found: Found) -> Found:
        nxt, link, size, window, short = self.next, self.link, self.size, self.window, self.short
        ranges, items, longest, leaked = found
        v = length = 0
        for j, c in enumerate(codes, at + 1):
            while v and c not in nxt[v]:
                v = link[v]
                length = size[v]
            if c not in nxt[v]:
                continue
            v = nxt[v][c]
            length += 1
            hit = window if length >= window else 0
            if hit:
                u = v
                while size[link[u]] >= window:
                    u = link[u]
                items.update(self.ids[k] for k in self.holds[u])
                leaked = leaked or any(length >= self.coverage * self.lengths[k] for k in self.holds[v])
                longest = max(longest, length)
            for k, m in short[v]:
                if m <= length:
                    items.add(self.ids[k])
                    hit, longest, leaked = max(hit, m), max(longest, m), True
            if hit:
                start = j - hit
                while ranges and ranges[-1][1] >= start:
                    start = min(start, ranges.pop()[0])
                ranges.append([start, j])
        return Found(ranges, items, longest, leaked)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items, block by block, so that the driver holds the texts of one block of about BLOCK_BYTES at a time."""
    items = stored(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text")).distinct())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for k in range(n):
        yield [(r.item, words_of(r.text)) for r in items.where(part == k).orderBy("item", "text").collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``) and ``report`` (see REPORT) of every row of ``docs``.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, in lower case. A window is
    ``window`` consecutive words of an item, or a shorter item as a whole; words inside an occurrence are hit.
    spans are code points, end exclusive; leaked: one match covers ``coverage`` of an item or more. Null and
    empty texts have no words and no hits; items without words find nothing; rows of equal item_id count as
    one item; a null item_id reads as the empty string. Items beyond BLOCK_BYTES are matched block by block:
    the driver builds one automaton at a time, PASS_BLOCKS of them make a pass over the rows, and between passes
    rows and reports are a table in the shared folder. No row is shuffled.
    """
    sc = docs.sparkSession.sparkContext
    out = docs.select(whole_row(docs), F.lit(None).cast(STATE).alias("report"))
    for number, block in enumerate(_blocks(benchmark)):
        if number and number % PASS_BLOCKS == 0:
            out = stored(out)
        held = sc.broadcast(SuffixAutomaton(block, window, coverage))

        def run(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            machine, rows = held.value, batch.column("row")
            found = [_report(machine, t or "", was) for t, was in zip(rows.field("text").to_pylist(), batch.column("report").to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([rows, pa.array(found, ARROW_STATE)], ["row", "report"])

        out = map_batches(out, run, with_row(docs, f"report {STATE}"))
    return out


STATE = f"struct<{REPORT}>"
ARROW_STATE = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("n_items", pa.int64()),
        ("item_ids", pa.list_(pa.string())),
        ("ranges", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("longest", pa.int64()),
        ("leaked", pa.bool_()),
    ]
)


def _report(machine: SuffixAutomaton, text: str, was: dict | None) -> dict:
    """The report on one text, joined with the one of the blocks before."""
    words = words_of(text)
    ranges, items, longest, leaked = machine.scan(words)
    if was:
        ranges = _merged([*ranges, *[[r["start"], r["end"]] for r in was["ranges"]]])
        items, longest, leaked = items.union(was["item_ids"]), max(longest, was["longest"]), leaked or was["leaked"]
    at = [m.span() for m in WORD.finditer(text)] if ranges else []
    return {
        "n_words": len(words),
        "n_hit": sum(b - a for a, b in ranges),
        "n_items": len(items),
        "item_ids": sorted(items),
        "ranges": [{"start": a, "end": b} for a, b in ranges],
        "spans": [{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges],
        "longest": longest,
        "leaked": leaked,
    }


def _merged(ranges: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def without_spans(text, spans):
    """Column: ``text`` without the code points of ``spans`` (ordered, apart), each replaced by one space."""
    n = F.size(spans)
    kept = F.transform(
        F.sequence(F.lit(0), n),
        lambda k: F.substring(
            text,
            F.when(k == 0, 1).otherwise(F.get(spans, k - 1)["end"] + 1),
            F.when(k == n, F.length(text)).otherwise(F.get(spans, k)["start"]) - F.when(k == 0, 0).otherwise(F.get(spans, k - 1)["end"]),
        ),
    )
    return F.when(n > 0, F.array_join(kept, " ")).otherwise(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """``docs`` without the hit spans of their texts, and without documents that hold ``coverage`` of an item.

    The columns are those of ``docs``; n_chars, where it is there, follows the text.
    """
    found = contamination(docs, benchmark, window, coverage).where("not report.leaked")
    return found.select(*replaced(docs, without_spans(F.col("row.text"), F.col("report.spans")), F.size("report.spans") > 0))
