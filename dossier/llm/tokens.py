"""Token counts by rank-synchronous merging, and BPE encoding by content-defined chunk reuse."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dossier.llm.common import map_batches, once, texts

#: The split patterns that the two vocabularies state.
BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
LETTERS, MARKS = regex.compile(r"[\p{L}]+"), regex.compile(r"[^\s\p{L}\p{N}]+")
#: Characters before a cut in which what comes after it may change the split.
AHEAD = 3
#: Words a worker remembers, and characters of chunks.
CACHED_WORDS, CACHED_CHARS = 150_000, 6_000_000
#: Texts are split in pieces of about so many characters, so a worker never holds the words of a whole long text.
PIECE = 1 << 20
#: Pre-tokens of more bytes than this are merged one by one, place by place.
LONG = 4096
#: Where a byte-level pre-token always ends: before blanks, and between a letter and a mark.
SAFE = regex.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n\t])|(?<=\p{L})(?=[!-/:-@\[-`{-~\u3001\u3002\uff0c\uff01\uff1f])")
NONE = np.iinfo(np.int64).max


@lru_cache(1)
def unassigned() -> re.Pattern:
    """Characters that this Python's Unicode doesn't know: the library may class and lower them otherwise."""
    ranges, start = [], None
    for c in range(sys.maxunicode + 2):
        odd = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if odd and start is None:
            start = c
        elif not odd and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile(f"[{''.join(ranges)}]")


def known(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not unassigned().search(text)
    return True


@lru_cache(2)
def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if it is one, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class RankMerger:
    """Symbols that survive all merges of a vocabulary, for many pre-tokens at once."""

    def __init__(self, path: str):
        with open(path) as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        self.order = np.argsort(keys).astype(np.int64)
        self.keys = keys[self.order]
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.bytes = np.array([vocab[c] for c in byte_chars()], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.order[at], NONE)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Surviving symbols of each (non-empty) pre-token.

        The pre-tokens are one ragged array: their symbols end to end, with the row of each. A round takes each
        row's lowest rank and merges that pair wherever it stands in the row, from the left where it overlaps
        itself; rows without a rank leave the array. A merged symbol only forms pairs of higher rank than its own,
        so a round does what merging one pair after the other does.
        """
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        symbols = self.bytes[np.frombuffer(b"".join(tokens), np.uint8)]
        row = np.repeat(np.arange(len(tokens)), size)
        result = size.copy()
        rank = np.full(len(symbols), NONE)
        inner = row[:-1] == row[1:]
        rank[:-1][inner] = self.ranks(symbols[:-1][inner], symbols[1:][inner])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            best = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(row)))
            result[row[starts]] = lengths
            live = np.repeat(best != NONE, lengths)
            lowest = np.repeat(best, lengths)
            symbols, row, rank, lowest = symbols[live], row[live], rank[live], lowest[live]
            if not len(symbols):
                break
            hit = rank == lowest
            place = np.arange(len(hit))
            first = hit.copy()
            first[1:] &= ~(hit[:-1] & (row[1:] == row[:-1]))
            hit &= (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0
            symbols[hit] = self.merged[rank[hit]]
            keep = np.ones(len(hit), bool)
            keep[1:] = ~hit[:-1]
            symbols, row, rank, hit = symbols[keep], row[keep], rank[keep], hit[keep]
            fresh = hit.copy()
            fresh[:-1] |= hit[1:]
            fresh = np.flatnonzero(fresh)
            rank[fresh] = NONE
            fresh = fresh[fresh < len(row) - 1]
            fresh = fresh[row[fresh] == row[fresh + 1]]
            rank[fresh] = self.ranks(symbols[fresh], symbols[fresh + 1])
        return result

    def count_long(self, token: bytes) -> int:
        """As ``count`` for one long pre-token: a round costs what it merges, not the length.

        The symbols are a linked list in arrays; the places of each rank wait in one bucket, and a round takes the
        lowest rank's bucket and merges the pairs that are still there, from the left where they overlap.
        """
        n = len(token)
        symbols = np.append(self.bytes[np.frombuffer(token, np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        rank = np.full(n + 1, NONE)
        rank[: n - 1] = self.ranks(symbols[: n - 1], symbols[1:n])
        buckets: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def put(places: np.ndarray) -> None:
            places = places[rank[places] != NONE]
            order = np.argsort(rank[places], kind="stable")
            places = places[order]
            for part in np.split(places, np.flatnonzero(np.diff(rank[places])) + 1):
                if len(part):
                    r = int(rank[part[0]])
                    if r not in buckets:
                        buckets[r] = []
                        heapq.heappush(waiting, r)
                    buckets[r].append(part)

        put(np.arange(n))
        merged = 0
        while waiting:
            r = heapq.heappop(waiting)
            at = np.unique(np.concatenate(buckets.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            goes_on = np.concatenate(([False], after[at[:-1]] == at[1:]))
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(goes_on, 0, place))) % 2 == 0]
            gone = after[at]
            rest = after[gone]
            symbols[at] = self.merged[r]
            rank[gone] = NONE
            after[at] = rest
            before[rest[rest <= n]] = at[rest <= n]
            merged += len(at)
            touched = np.unique(np.concatenate((at, before[at])))
            touched = touched[touched >= 0]
            rank[touched] = NONE
            inner = touched[after[touched] < n]
            rank[inner] = self.ranks(symbols[inner], symbols[after[inner]])
            put(inner)
        return n - merged


def pieces(text: str) -> Iterator[str]:
    """Parts of about PIECE characters, cut where no pre-token goes on."""
    at = 0
    while len(text) - at > 2 * PIECE:
        m = SAFE.search(text, at + PIECE)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class TokenCounter:
    """Token counts of texts as the library gives them for a byte-level vocabulary."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.merger = RankMerger(path)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.seen: dict[str, int] = {}

    def split(self, part: str) -> list[str]:
        if known(part):
            return BYTE_PATTERN.findall(part)
        return [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]

    def count(self, batch: list[str]) -> list[int]:
        out = [0] * len(batch)
        todo: list[tuple[int, list[str]]] = []
        held = 0
        for k, text in enumerate(batch):
            for part in self.special.split(text):
                for piece in pieces(part):
                    todo.append((k, self.split(piece)))
                    held += len(piece)
                    if held > PIECE:
                        self.add(todo, out)
                        todo, held = [], 0
            if "<" in text:
                out[k] += sum(1 for _ in self.special.finditer(text))
        self.add(todo, out)
        return out

    def add(self, todo: list[tuple[int, list[str]]], out: list[int]) -> None:
        seen = self.seen
        if len(seen) > CACHED_WORDS:
            seen.clear()
        new = [w for w in set(chain.from_iterable([words for _, words in todo])) if w not in seen]
        if new:
            data = [w.encode() for w in new]
            short = [k for k, d in enumerate(data) if len(d) <= LONG]
            found = dict(zip(short, self.merger.count([data[k] for k in short]).tolist(), strict=True))
            seen.update((w, found[k] if k in found else self.merger.count_long(data[k])) for k, w in enumerate(new))
        for k, words in todo:
            out[k] += sum(map(seen.__getitem__, words))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row; a null text is empty and has 0 of both.

    ``path`` is a byte-level BPE in the library's format, of which all tasks need a copy. The special strings of
    the vocabulary count as one token each, as the library has it by default. Repeated rows are counted each.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = texts(batch)
        counts = once(("count", path), lambda: TokenCounter(path)).count(rows)
        size = [len(t.encode()) for t in rows]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_bytes long, n_tokens long")


class Chunk:
    """The encoding of a chunk by itself: its first pre-tokens' places, and where its end must be read again.

    starts: by the start of a pre-token, where its ids and its decoded text begin. From ``tail`` on (its ids begin
    at tail_ids, its decoded text at tail_text) what follows the chunk may change the split.
    """

    __slots__ = ("ids", "starts", "tail", "tail_ids", "tail_text", "text")

    def __init__(self, chunk: str, coder: ChunkEncoder):
        words = WORD_PATTERN.findall(chunk)
        ids, text = coder.look_up(words)
        self.ids, self.text = b"".join(ids), "".join(text)
        self.starts, at_ids, at_text = {}, 0, 0
        for k, m in enumerate(islice(WORD_PATTERN.finditer(chunk), 6)):
            self.starts[m.start()] = (at_ids, at_text)
            at_ids += len(ids[k])
            at_text += len(text[k])
        self.tail, self.tail_ids, self.tail_text = len(chunk), len(self.ids), len(self.text)
        for k in range(len(words) - 1, -1, -1):  # only blanks stand between a pre-token and the next
            a = chunk.rindex(words[k], 0, self.tail)
            if a + len(words[k]) <= len(chunk) - AHEAD:
                break
            self.tail, self.tail_ids, self.tail_text = a, self.tail_ids - len(ids[k]), self.tail_text - len(text[k])


class ChunkEncoder:
    """Encodes texts as the library does, each distinct chunk once while it is remembered.

    A text is normalised as a whole and cut where the rolling hash of the last 16 characters has ``bits`` zero
    bits, so equal passages of different texts give equal chunks. A chunk is encoded by itself. At a join, the end
    of the left chunk, from the first pre-token that the join may change, and the start of the right one are split
    again, further and further, until a pre-token starts where one of the right chunk's does. The split reads
    from left to right and looks ahead two characters at most, so from there on the two agree exactly. Where
    they don't, what is settled is written, and the last pre-tokens stay open for the next chunk; a run of
    letters or marks that goes on over whole chunks is not read again. So the work grows with the text alone.
    Texts with characters that this Python doesn't know are split by the library, without chunks.
    """

    def __init__(self, path: str, bits: int = 9):
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        with open(path) as f:
            vocab = json.load(f)["model"]["vocab"]
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = {s: (self.pack([i]), s + " ") for s, i in special.items()}
        self.pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.table = str.maketrans(dict(enumerate(byte_chars())))
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, str] = {}
        self.chunks: dict[str, Chunk] = {}
        self.held = 0
        self.bits = np.uint64(64 - bits)
        self.encoded = 0

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def look_up(self, words: list[str]) -> tuple[list[bytes], list[str]]:
        """Packed ids of each pre-token, and its tokens with a space after each."""
        if len(self.ids) > CACHED_WORDS:
            self.ids.clear()
            self.texts.clear()
        long: dict[str, tuple[bytes, str]] = {}
        for w in set(words):
            if w in self.ids:
                continue
            tokens = self.model.tokenize(w.encode().decode("latin-1").translate(self.table))
            found = self.pack([t.id for t in tokens]), "".join([t.value + " " for t in tokens])
            if len(w) > LONG:
                long[w] = found
            else:
                self.ids[w], self.texts[w] = found
        if long:
            return [long[w][0] if w in long else self.ids[w] for w in words], [long[w][1] if w in long else self.texts[w] for w in words]
        return list(map(self.ids.__getitem__, words)), list(map(self.texts.__getitem__, words))

    def cuts(self, text: str) -> Iterator[int]:
        """Ends of the chunks of a normalised text, found block by block."""
        last = len(text) if len(text) < 64 else 0
        for at in range(0, len(text) - last, PIECE):
            from_ = max(0, at - 15)
            code = np.frombuffer(text[from_ : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            with np.errstate(over="ignore"):
                h = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                factor = np.uint64(0xD6E8FEB86659FD93)
                for step in (1, 2, 4, 8):
                    h[step:] = h[step:] + h[:-step] * factor
                    factor = factor * factor
                ends = np.flatnonzero((h * np.uint64(0xBF58476D1CE4E5B9)) >> self.bits == 0) + 1 + from_
            for last in ends[ends >= max(at + 1, 16)].tolist():
                yield last
        if last < len(text) or len(text) < 64:
            yield len(text)

    def chunk(self, text: str) -> Chunk:
        found = self.chunks.get(text)
        if found is None:
            if self.held > CACHED_CHARS:
                self.chunks.clear()
                self.held = 0
            found = self.chunks[text] = Chunk(text, self)
            self.held += len(text)
            self.encoded += 1
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """Packed ids of a text, and its decoded text."""
        ids: list[bytes] = []
        out: list[str] = []
        for part in self.pattern.split(text) if self.pattern and "<" in text else [text]:
            if part in self.special:
                ids.append(self.special[part][0])
                out.append(self.special[part][1])
            elif part and not known(part):
                part = self.library.normalizer.normalize_str(part)
                self.write([part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)], ids, out)
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                self._encode(part.lower(), ids, out)
        return b"".join(ids), "".join(out)[:-1]

    def write(self, words: list[str], ids: list[bytes], out: list[str]) -> None:
        new_ids, new_text = self.look_up(words)
        ids += new_ids
        out += new_text

    def _encode(self, text: str, ids: list[bytes], out: list[str]) -> None:
        open_, at = 0, 0  # what is written ends at open_, and a pre-token or blanks begin there
        run = None
        for end in self.cuts(text):
            start, at = at, end
            if run and (m := run.match(text, start, end)) and m.end() == end:
                continue
            chunk = self.chunk(text[start:end])
            if open_ < start:
                meet = self.join(text, open_, start, end, chunk)
                if meet is None or meet > chunk.tail:
                    open_, run = self.read(text, open_, end, ids, out)
                    continue
                self.write(WORD_PATTERN.findall(text, open_, start + meet), ids, out)
                from_ids, from_text = (chunk.tail_ids, chunk.tail_text) if meet == chunk.tail else chunk.starts[meet]
            else:
                from_ids = from_text = 0
            ids.append(chunk.ids[from_ids : chunk.tail_ids])
            out.append(chunk.text[from_text : chunk.tail_text])
            open_ = start + chunk.tail
            run = open_run(text, open_, end)
        self.write(WORD_PATTERN.findall(text, open_), ids, out)

    def read(self, text: str, at: int, end: int, ids: list[bytes], out: list[str]) -> tuple[int, regex.Pattern | None]:
        """Writes the pre-tokens from ``at`` on that end AHEAD characters before ``end``; gives where the rest begins."""
        words = []
        for m in WORD_PATTERN.finditer(text, at, end):
            if m.end() > end - AHEAD:
                break
            words.append(m[0])
            at = m.end()
        self.write(words, ids, out)
        return at, open_run(text, at, end)

    def join(self, text: str, open_: int, start: int, end: int, chunk: Chunk) -> int | None:
        """Where in the chunk from ``start`` to ``end`` the split from ``open_`` on and the chunk's own agree."""
        size = 32
        while True:
            stop = min(end, start + size)
            for m in WORD_PATTERN.finditer(text, open_, stop):
                if m.start() >= start and m.start() - start in chunk.starts:
                    return m.start() - start
                if m.end() > stop - AHEAD:
                    break
            else:
                if stop == end and chunk.tail == end - start:
                    return chunk.tail
            if stop == end:
                return None
            size *= 4


def open_run(text: str, at: int, end: int) -> regex.Pattern | None:
    """What goes on with the pre-token from ``at`` to ``end``, if it is one run of letters or of marks."""
    if LETTERS.fullmatch(text, at, end):
        return LETTERS
    return MARKS if MARKS.fullmatch(text, at, end) and end - at > 1 else None


def encoded(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, and ids (array<int>) if asked for.

    ids are those of the library for the vocabulary at ``path`` without added special tokens; decoded is the text
    of its decode(), the tokens with a space between. A null text is empty: no ids, an empty decoded text.
    Chunks are remembered by worker process, bounded by CACHED_CHARS, so nothing is shuffled and no document
    is held back for another; repeated rows come back each.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = once(("encode", path), lambda: ChunkEncoder(path))
        count, sha, text_sha, packed = [], [], [], []
        for t in texts(batch):
            ids, text = coder.encode(t)
            count.append(len(ids) // 4)
            sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(text.encode()).hexdigest())
            if keep_ids:
                packed.append(ids)
        columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(text_sha, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            ends = np.cumsum([0, *count]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)
