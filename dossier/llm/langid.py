"""Language identification with hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import cut, map_batches, once, texts, whole_row, with_row

#: Components of a vector, and trigrams whose vectors a worker remembers.
DIMENSION, CACHED = 1024, 60_000
SEED = 0x5EED
UNKNOWN = "und"


@lru_cache(1)
def letter_codes() -> np.ndarray:
    """By code point: itself for a letter, else 32."""
    codes = np.full(sys.maxunicode + 1, 32, np.int64)
    letters = [c for c in range(sys.maxunicode + 1) if chr(c).isalpha()]
    codes[letters] = letters
    return codes


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams (21 bits a character) of a text's words in lower case, and their counts.

    What is no letter parts words; a word is read with one space before and behind it. No letter: none.
    """
    code = letter_codes()[np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    code = code[np.concatenate(([True], (code[1:] != 32) | (code[:-1] != 32)))]
    if len(code) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique(code[:-2] << 42 | code[1:-1] << 21 | code[2:], return_counts=True)


class Vectors:
    """Random vectors of +1 and -1 of letters, and of trigrams: letters permuted by their place and multiplied.

    The vectors of the first CACHED trigrams that a worker meets are remembered, others are bound anew each time.
    """

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension
        self.letters: dict[int, np.ndarray] = {}
        self.codes, self.places = np.empty(0, np.int64), np.empty(0, np.int64)
        self.rows = np.empty((CACHED, dimension), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= CACHED:
                self.letters.clear()
            self.letters[code] = np.random.default_rng((SEED, code)).integers(0, 2, self.dimension, np.int8) * 2 - 1
        return self.letters[code]

    def bound(self, trigrams: np.ndarray) -> np.ndarray:
        out = np.ones((len(trigrams), self.dimension), np.int8)
        for shift, by in ((42, 2), (21, 1), (0, 0)):
            letters, place = np.unique(trigrams >> shift & 0x1FFFFF, return_inverse=True)
            out *= np.array([np.roll(self.letter(c), by) for c in letters.tolist()], np.int8)[place]
        return out

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of sorted distinct trigrams, a row each."""
        if not len(codes):
            return np.empty((0, self.dimension), np.int8)
        n = len(self.codes)
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, n - 1))
        known = self.codes[at] == codes if n else np.zeros(len(codes), bool)
        if known.all():
            return self.rows[self.places[at]]
        out = np.empty((len(codes), self.dimension), np.int8)
        out[known] = self.rows[self.places[at[known]]] if n else 0
        out[~known] = more = self.bound(codes[~known])
        if (room := min(CACHED - n, len(more))) > 0:
            self.rows[n : n + room] = more[:room]
            merged = np.concatenate((self.codes, codes[~known][:room]))
            order = np.argsort(merged, kind="stable")
            self.codes, self.places = merged[order], np.concatenate((self.places, np.arange(n, n + room)))[order]
        return out

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the vectors, each as often as its trigram stands there (blockwise, so a long text stays small)."""
        out = np.zeros(self.dimension)
        for k in range(0, len(codes), 8192):
            out += counts[k : k + 8192].astype(np.float32) @ self.of(codes[k : k + 8192]).astype(np.float32)
        return out


def prototypes(labelled: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """lang and proto (array<double>): the bundle of all trigrams of all texts of a language.

    A batch bundles its own texts by language, so what is shuffled is one vector for each language and batch,
    whatever the texts' number or length; rows without text or lang teach nothing.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        vectors = once(("vectors", dimension), lambda: Vectors(dimension))
        groups: dict[str, list] = {}
        for text, lang in zip(texts(batch), batch.column("lang").to_pylist(), strict=True):
            groups.setdefault(lang, []).append(trigrams(text))
        rows = []
        for lang, found in groups.items():
            codes, place = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([n for _, n in found]), len(codes))
            rows.append({"lang": lang, "part": vectors.bundle(codes, counts).round().astype(np.int64).tolist()})
        return pa.RecordBatch.from_pylist(rows, pa.schema([("lang", pa.string()), ("part", pa.list_(pa.int64()))]))

    parts = map_batches(labelled.where("text is not null and lang is not null").select("text", "lang"), run, "lang string, part array<long>")
    summed = parts.select("lang", F.posexplode("part").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").cast("double").alias("x"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"])
    return summed.groupBy("lang").agg(vector.alias("proto"))


#: Languages whose prototypes are held in one matrix; more are compared in blocks of so many.
MOST_LANGS = 2000


def predict(docs: DataFrame, protos: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """row (a struct of the columns of ``docs``), lang_pred and score of each row.

    lang_pred is the language of the largest cosine between the text's bundle and a prototype, by name on ties;
    score is that cosine, at least 0. A text that is null or has no letter is ``und`` with score 0, and so are all
    if nothing was learned. Prototypes of more than MOST_LANGS languages are compared in blocks.
    """
    sc = docs.sparkSession.sparkContext
    protos = cut(protos)
    n = protos.count()
    blocks = -(-n // MOST_LANGS) or 1
    out = docs.select(whole_row(docs), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    for k in range(blocks):
        learned = sorted(protos.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == k).collect()) if n else []
        held = sc.broadcast(([r.lang for r in learned], np.array([r.proto for r in learned]).reshape(-1, dimension)))

        def run(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            names, matrix = held.value
            vectors = once(("vectors", dimension), lambda: Vectors(dimension))
            length = np.linalg.norm(matrix, axis=1)
            langs, scores = [], []
            row = batch.column("row")
            for text, lang, score in zip(row.field("text").to_pylist(), batch.column("lang_pred").to_pylist(), batch.column("score").to_pylist(), strict=True):
                codes, counts = trigrams(text or "")
                if len(codes) and names:
                    own = vectors.bundle(codes, counts)
                    cosine = matrix @ own / np.maximum(length * np.linalg.norm(own), 1e-30)
                    best = int(cosine.argmax())
                    found = min(1.0, max(0.0, float(cosine[best])))
                    if lang == UNKNOWN or (-found, names[best]) < (-score, lang):
                        lang, score = names[best], found
                langs.append(lang)
                scores.append(score)
            return pa.RecordBatch.from_arrays([row, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

        out = map_batches(out, run, with_row(docs, "lang_pred string, score double"))
    return out


def held_out(doc_id: Column, folds: int = 3) -> Column:
    """True for the fold that nothing is learned from; a null doc_id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 1, F.lit(False))


def identify(docs: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row: learned from the rows of the other folds alone."""
    out = held_out(F.col("doc_id"))
    protos = prototypes(docs.where(~out).select("text", F.col("lang").cast("string").alias("lang")), dimension)
    found = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), protos, dimension)
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
