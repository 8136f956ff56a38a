"""Product codes of vectors: a codebook for each part of them, learned by Lloyd rounds with Yinyang bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import bound_batches, cut, few, stored_at
from dossier.llm.vectors import embedded, finite_vectors, floored, lists, matrix
from dossier.sources.shared import remove

#: Whole-number components are held at this either way, so that a sum over four billion rows fits a long.
MOST = (1 << 31) - 1
LONG = (1 << 63) - 1
#: Bounds are compared and moved with this much room, far above what doubles lose.
ROOM = 1e-9
STATE = "vec_id long, label long, code array<int>, near binary, low binary"


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and entries: doubles where no sum can pass 2^53, else whole numbers of any size."""
    most = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if (2 * most) ** 2 * x.shape[1] < 1 << 53:
        x, entries = x.astype(np.float64), entries.astype(np.float64)
        return (x * x).sum(1)[:, None] + (entries * entries).sum(1) - 2 * (x @ entries.T)
    x, entries = x.astype(object), entries.astype(object)
    return (x * x).sum(1)[:, None] + (entries * entries).sum(1) - 2 * (x @ entries.T)


def roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def lowered(bounds: np.ndarray) -> np.ndarray:
    """Lower bounds in two bytes each, none above what it was."""
    most = np.finfo(np.float16).max
    small = np.minimum(bounds * (1 - ROOM), most).astype(np.float16)
    over = small.astype(np.float64) > bounds * (1 - ROOM)
    small[over] = np.nextafter(small[over], np.float16(-np.inf))
    return np.maximum(small, np.float16(0))


def grouped(entries: np.ndarray, n: int, rounds: int = 5) -> list[np.ndarray]:
    """The entries' indexes in up to ``n`` groups of near ones; which ones changes the work, never a result."""
    centres = entries[np.linspace(0, len(entries) - 1, min(n, len(entries))).astype(int)].astype(np.float64)
    x = entries.astype(np.float64)
    for _ in range(rounds):
        at = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([x[at == g].mean(0) if (at == g).any() else c for g, c in enumerate(centres)])
    return [np.flatnonzero(at == g) for g in range(len(centres)) if (at == g).any()]


@dataclass(frozen=True)
class Codebook:
    """entries of one part, their groups, and how far each group's entries moved at most since the last round."""

    entries: np.ndarray
    groups: list[np.ndarray]
    drift: np.ndarray

    @classmethod
    def first(cls, entries: np.ndarray, n_groups: int) -> Codebook:
        groups = grouped(entries, n_groups)
        return cls(entries, groups, np.zeros(len(groups)))

    def moved(self, entries: np.ndarray) -> Codebook:
        step = roots(((entries - self.entries).astype(object) ** 2).sum(1))
        return replace(self, entries=entries, drift=np.array([step[g].max() for g in self.groups]) * (1 + ROOM))

    def nearest(self, x: np.ndarray, near: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Nearest entry of each row, its squared distance, the groups' new lower bounds, and the distances computed.

        ``near`` is the entry of the round before, ``low`` a bound below the distances to each group's entries, ``near`` left
        out. A group is read only if its bound, less its drift, does not pass the distance to ``near``; bounds only choose what
        is read, and exact whole numbers decide, so ties go to the lower index however a bound was rounded.
        """
        n, spans = len(x), np.arange(len(x))
        held = self.entries[near]
        most = int(max(np.abs(x).max(initial=0), np.abs(held).max(initial=0)))
        exact = (2 * most) ** 2 * x.shape[1] < 1 << 53
        step = (x - held).astype(np.float64 if exact else object)
        first = (step * step).sum(1)
        best, least, work = near.copy(), first.copy(), n
        low = np.maximum(low.astype(np.float64) * (1 - ROOM) - self.drift, 0)
        read = low <= roots(first)[:, None] * (1 + ROOM)
        one, two, at = (np.full((n, len(self.groups)), fill, kind) for fill, kind in ((0.0, np.float64), (np.inf, np.float64), (-1, np.int64)))
        for g, members in enumerate(self.groups):
            rows = np.flatnonzero(read[:, g])
            if not len(rows):
                continue
            d = distances(x[rows], self.entries[members])
            work += d.size
            k = d.argmin(1)
            near_d = d[np.arange(len(rows)), k]
            better = (near_d < least[rows]) | ((near_d == least[rows]) & (members[k] < best[rows]))
            least[rows[better]], best[rows[better]] = near_d[better], members[k[better]]
            one[rows, g], at[rows, g] = roots(near_d), members[k]
            if len(members) > 1:
                two[rows, g] = roots(np.partition(d, 1, axis=1)[:, 1])
        bounds = np.where(read, np.where(at == best[:, None], two, one), low)
        group_of = np.empty(len(self.entries), np.int64)
        for g, members in enumerate(self.groups):
            group_of[members] = g
        left, g = best != near, group_of[near]
        bounds[spans[left], g[left]] = np.minimum(bounds[spans[left], g[left]], roots(first[left]))
        return best, least, lowered(bounds), work


@dataclass(frozen=True)
class Coded:
    """rows: vec_id, label, code and error (null where a vector can't be cut); books: the final entries of each part."""

    rows: DataFrame
    books: list[np.ndarray]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.books for v in book.ravel().tolist()).encode()).hexdigest()


def whole(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label and code (floor(scale * component)) of the rows whose vector is there and finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in finite_vectors(batch.column(2)):
                if len(rows):
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), lists(floored(x, scale, MOST))], ["vec_id", "label", "code"])

    bound_batches(vectors.sparkSession)
    return vectors.mapInArrow(run, "vec_id long, label long, code array<long>")


def first_entries(rows: DataFrame, size: int) -> list[list[int]]:
    """The vectors of the ``size`` least ids; ids alone are ordered first, so few vectors are."""
    named = rows.where("vec_id is not null")
    last = named.select("vec_id").orderBy("vec_id").limit(size).agg(F.max("vec_id")).first()[0]
    if last is None:
        return []
    return [r.code for r in named.where(F.col("vec_id") <= last).orderBy("vec_id", "code").limit(size).collect()]


def compress(vectors: DataFrame, scale: int = 1024, parts: int = 4, size: int = 256, rounds: int = 4, groups: int = 16) -> Coded:
    """Product codes of ``vectors`` (vec_id, label, embedding).

    Components become floor(scale * x), held at 2^31 - 1 either way, and vectors are cut into ``parts`` equal parts. Each part's
    codebook starts as that part of the ``size`` least vec_ids (all, if fewer; repeated ids by their vector) and goes through
    ``rounds`` of Lloyd: each part to its nearest entry, ties to the lower index, then each entry to the floor of its
    parts' mean; entries without parts stay. Rows without a vector, or with a null or non-finite component, are left out.
    Vectors of another length than the first entry, or of one that ``parts`` does not divide, come back with code and error null.
    A row without vec_id is coded, but is no first entry; repeated rows come back as often as they stand there. Errors are
    held at 64 bits. An empty table gives an empty result.

    Rows and their bounds (two bytes a group and part) are a table in the shared folder, written anew each round. A round adds up
    its parts in each task, so ``parts * size`` rows a task are shuffled; only the sums, of codebook size, reach the driver.
    """
    rows = whole(embedded(vectors), scale)
    first = first_entries(rows, size)
    dim = len(first[0]) if first else 0
    if not dim or dim % parts:
        none = rows.select("vec_id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
        return Coded(none, [])
    sub = dim // parts
    begin = np.array([c for c in first if len(c) == dim], dtype=np.int64)
    books = [Codebook.first(begin[:, p * sub : (p + 1) * sub], groups) for p in range(parts)]
    fits = F.size("code") == dim
    none = rows.where(~fits).select("vec_id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
    state = rows.where(fits).select("vec_id", "label", F.col("code").cast("array<int>").alias("code"), *[F.lit(None).cast("binary").alias(c) for c in ("near", "low")])
    written = None
    for _ in range(rounds):
        before = written
        state, written = stored_at(assigned(state, books, parts))
        books = [b.moved(e) for b, e in zip(books, means(state, books, parts), strict=True)]
        if before:
            remove(vectors.sparkSession, before)
    done = cut(coded(state, books, parts).unionByName(none))
    if written:
        remove(vectors.sparkSession, written)
    return Coded(done, [b.entries for b in books])


def read_state(batch: pa.RecordBatch, books: list[Codebook], parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By part: the rows' whole numbers, their entries and lower bounds (0 before the first round)."""
    n, sub = batch.num_rows, books[0].entries.shape[1]
    x = matrix(batch.column(2), parts * sub).astype(np.int64)
    known = batch.column(3).null_count == 0
    near = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(n, parts).astype(np.int64) if known else np.zeros((n, parts), np.int64)
    low = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float16) if known else None
    at = 0
    for p, book in enumerate(books):
        t = len(book.groups)
        yield x[:, p * sub : (p + 1) * sub], near[:, p], low.reshape(n, -1)[:, at : at + t] if known else np.zeros((n, t), np.float16)
        at += t


def binaries(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as their bytes."""
    raw, width = np.ascontiguousarray(x).tobytes(), x.dtype.itemsize * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * width, width, dtype=np.int32).tobytes()), pa.py_buffer(raw)])


def assigned(state: DataFrame, books: list[Codebook], parts: int) -> DataFrame:
    """``state`` after one more assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, _, low, _ = zip(*(b.nearest(*part) for b, part in zip(books, read_state(batch, books, parts), strict=True)), strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], binaries(np.stack(near, 1).astype(np.uint16)), binaries(np.concatenate(low, 1))], batch.schema.names)

    return state.mapInArrow(run, STATE)


def means(state: DataFrame, books: list[Codebook], parts: int) -> list[np.ndarray]:
    """Each entry's floor(sum / count); entries without parts stay."""
    size, sub = books[0].entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, size), np.int64), np.zeros((parts, size, sub), np.int64)
        for batch in batches:
            for p, (x, near, _) in enumerate(read_state(batch, books, parts) if batch.num_rows else ()):
                n[p] += np.bincount(near, minlength=size)
                np.add.at(sums[p], near, x)
        part, entry = np.nonzero(n)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), lists(sums[part, entry])], ["part", "entry", "n", "s"])

    told = state.mapInArrow(run, "part int, entry int, n long, s array<long>")
    added = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", j)) for j in range(sub)]).alias("s"))
    out = [b.entries.copy() for b in books]
    for r in added.collect():
        out[r.part][r.entry] = [v // r.n for v in r.s]
    return out


def coded(state: DataFrame, books: list[Codebook], parts: int) -> DataFrame:
    """vec_id, label, code and error by the final codebooks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, least, _, _ = zip(*(b.nearest(*part) for b, part in zip(books, read_state(batch, books, parts), strict=True)), strict=True)
                error = [min(int(v), LONG) for v in sum(x.astype(object) for x in least)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], lists(np.stack(near, 1).astype(np.int32)), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return state.mapInArrow(run, "vec_id long, label long, code array<int>, error long")


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with label_error: their errors summed over equal labels, nulls together. Labels are summed in part before a shuffle."""
    label = lambda df: df.withColumns({"no_label": F.col("label").isNull(), "label_key": F.coalesce("label", F.lit(0))})
    sums = few(label(rows.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG)).cast("long").alias("label_error"))).drop("label"))
    return label(rows).join(sums, ["no_label", "label_key"]).drop("no_label", "label_key")


def code_hex(code: Column) -> Column:
    """Two lower-case hexadecimal digits for each part's entry."""
    return F.array_join(F.transform(code, lambda v: F.lpad(F.lower(F.hex(v)), 2, "0")), "")
