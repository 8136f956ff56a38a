"""WARC archives: writing with segmentation, chunked framing and revisits; reading with segment reassembly."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import bound_batches, cut, shared_folder, stored
from dossier.sources.shared import remove

#: Bytes of a record's block before it goes on in continuation records, and of one chunk of the HTTP body.
SEGMENT_BYTES, CHUNK_BYTES = 1 << 14, 1 << 13
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
#: Compressed bytes of records that are written as one row, and such rows of a file: files stay near 32 MB.
ROW_BYTES, ROWS_PER_FILE = 1 << 20, 32
#: Digests of repeated payloads that are sent to all executors at most; more are joined by a shuffle of the payloads.
MOST_DIGESTS = 500_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``payload`` in HTTP's chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped. Damaged framing raises ValueError."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size < 0:
            raise ValueError("a chunk of negative size")
        if not size:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n" or len(parts[-1]) != size:
            raise ValueError("a chunk does not end where its size says")
        at += 2


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def records(record_id: str, uri: str | None, payload: bytes, refers_to: str | None, segment: int = SEGMENT_BYTES, digest_hex: str | None = None) -> Iterator[bytes]:
    """The records of one page without the blank lines that end each: a response in segments, or a revisit."""
    uri = None if uri is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)
    shared = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    kind = ("Content-Type", "application/http;msgtype=response")
    if refers_to is not None:
        known = base64.b32encode(bytes.fromhex(digest_hex)).decode() if digest_hex else digest(payload)
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id}>"), *shared, ("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", profile), ("WARC-Payload-Digest", f"sha1:{known}"), kind], HTTP + b"\r\n")
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), *shared, ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), kind]
    if len(block) <= segment:
        yield _record(first, block)
        return
    yield _record([*first, ("WARC-Segment-Number", "1")], block[:segment])
    for k, at in enumerate(range(segment, len(block), segment), 2):
        total = str(len(block)) if at + segment >= len(block) else None
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:{k}>"), *shared, ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", str(k)), ("WARC-Segment-Total-Length", total)], block[at : at + segment])


def member(record: bytes) -> bytes:
    """A record and the blank lines that end it, as a gzip member of its own."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record + b"\r\n\r\n") + z.flush()


def write_warc(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write record_id, uri, payload (binary) and refers_to (null: a response) of each row as gzipped WARC/1.1 files.

    Each record is a gzip member, so a reader may start at any of them. Spark's text writer puts them down, so the
    folder may be in any store: a row of it is a few members, and its separator, a zero byte, is the last byte of
    the row's last member (the high byte of a length below 16 MB, which segments keep records under). A null
    payload is empty; a null uri leaves its field out; a revisit has its payload's digest in ``payload_digest``.
    """
    if segment_bytes > 15 << 20:
        raise ValueError("segments of more than 15 MB")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["record"])
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                for record in records(r["record_id"], r["uri"], r["payload"] or b"", r["refers_to"], segment_bytes, r["payload_digest"]):
                    held.append(member(record))
                    size += len(held[-1])
                    if size >= ROW_BYTES:
                        yield row()
                        held, size = [], 0
        if held:
            yield row()

    bound_batches(pages.sparkSession)
    digest_ = "payload_digest" if "payload_digest" in pages.columns else F.lit(None).cast("string").alias("payload_digest")
    made = pages.select("record_id", "uri", "payload", "refers_to", digest_).mapInArrow(run, "record binary")
    text = made.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", "\u0000").option("maxRecordsPerFile", ROWS_PER_FILE).text(folder)


HEADER = re.compile(rb"\s*WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.DOTALL)
#: Bytes of an archive that are decompressed at a time, and of the longest header.
STEP, MOST_HEADER = 1 << 16, 1 << 20


class Source:
    """The bytes of an archive, plain or gzipped (in one stream or a member a record), decompressed as they are asked for."""

    def __init__(self, archive: bytes):
        self.archive, self.at = archive, 0
        self.zipped = archive[:2] == b"\x1f\x8b"
        self.z = zlib.decompressobj(31) if self.zipped else None
        self.ready = bytearray()

    def more(self) -> bool:
        """Makes more bytes ready; False at the end. Damaged compression raises zlib.error."""
        if self.at >= len(self.archive):
            return False
        part = self.archive[self.at : self.at + STEP]
        if not self.zipped:
            self.at += len(part)
            self.ready += part
            return True
        if self.z.eof:
            rest = part.lstrip(b"\0")
            self.at += len(part) - len(rest)
            self.z, part = zlib.decompressobj(31), rest
        self.ready += self.z.decompress(part)
        self.at += len(part) - len(self.z.unused_data)
        return True

    def fill(self, size: int) -> bool:
        while len(self.ready) < size:
            if not self.more():
                return False
        return True

    def skip(self) -> bool:
        """Goes on at the next gzip member after a damaged place; False if there is none."""
        self.ready.clear()
        found = self.archive.find(b"\x1f\x8b\x08", self.at + (not self.z.eof)) if self.zipped else -1
        self.at = found if found >= 0 else len(self.archive)
        self.z = zlib.decompressobj(31)
        return found >= 0


def parse(archive: bytes) -> Iterator[dict]:
    """The records of an archive by their Content-Length; a damaged place gives a record of type "damaged"."""
    source = Source(archive)
    while True:
        try:
            found = _next(source)
        except (ValueError, KeyError, zlib.error):
            yield {k: None for k in ("record_id", "origin", "number", "total", "uri", "refers_to", "declared", "block")} | {"type": "damaged"}
            if not source.skip():
                return
            continue
        if found is None:
            return
        yield found


def _next(source: Source) -> dict | None:
    while not (m := HEADER.match(source.ready)):
        if not source.more():
            if source.ready.strip():
                raise ValueError("no record where one should start")
            return None
        if len(source.ready) > MOST_HEADER + STEP and not HEADER.match(source.ready):
            raise ValueError("no end of a header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in m[1].decode(errors="replace").split("\r\n"))}
    start, size = m.end(), int(fields["content-length"])
    if size < 0 or not source.fill(start + size):
        raise ValueError("a record is cut off")
    ident = fields["warc-record-id"].strip("<>")
    record = {
        "type": fields["warc-type"],
        "record_id": ident,
        "origin": fields.get("warc-segment-origin-id", ident).strip("<>"),
        "number": int(fields["warc-segment-number"]) if "warc-segment-number" in fields else None,
        "total": int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None,
        "uri": fields.get("warc-target-uri"),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "declared": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "block": bytes(source.ready[start : start + size]),
    }
    del source.ready[: start + size]
    return record


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block; chunked framing is undone."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")) else body


def reassemble(parts: list[dict]) -> bytes:
    """The block of a segmented record: parts in the order of their numbers, of the stated total length."""
    by = {p["number"]: p for p in sorted(parts, key=lambda p: p["number"])}
    block = b"".join(p["block"] for p in by.values())
    last = by[max(by)]
    if list(by) != list(range(1, len(by) + 1)) or last["total"] != len(block):
        raise ValueError("segments are missing or of another length than stated")
    return block


READ_DDL = "record_id string, type string, uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, intact boolean"
PART_DDL = "origin string, number int, total long, declared string, block binary"
READ = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())])
PARSED = pa.schema([*READ, ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("declared", pa.string()), ("block", pa.binary())])


def _read(record: dict, block: bytes | None, keep: bool) -> dict:
    """A row of READ of a record and its whole block; one that can't be read (null, or bad framing) isn't intact."""
    out = {k: record[k] for k in ("record_id", "type", "uri", "refers_to")} | {"payload": None, "payload_bytes": None, "payload_digest": None}
    if record["type"] == "revisit":
        return out | {"payload_digest": record["declared"], "intact": True}
    try:
        payload = payload_of(block) if block is not None else None
    except ValueError:
        payload = None
    if payload is None:
        return out | {"intact": False}
    found = digest(payload)
    return out | {"payload": payload if keep else None, "payload_bytes": len(payload), "payload_digest": found, "intact": record["declared"] in (None, found)}


def read_warc(spark: SparkSession, folder: str, keep_payload: bool = True) -> DataFrame:
    """The pages in the WARC files of ``folder``: READ_DDL, a row for each response, revisit or damaged place.

    Archives are parsed once, a record at a time, and what they hold is kept in the shared folder: records of one
    segment decoded, segments as they are. Segments, continuation records included, are grouped by their origin's
    identifier, repeated ones as one (rows come back as often as the first segment does), put in order, held
    against the stated total length, and then decoded; so a task gathers one record at a time. A revisit has no
    payload of its own. ``intact`` is false where segments lack, a length or framing is wrong, or the payload has
    not its declared digest. Spark reads a file as one value, so archives are of less than 2 GB.
    """
    bound_batches(spark)
    files = spark.read.format("binaryFile").load(folder).select("content")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for content in batch.column(0):
                for r in parse(content.as_py()):
                    if r["number"] is None:
                        rows.append(_read(r, r["block"], keep_payload))
                    else:
                        rows.append(r | {"intact": True})
                    size += len(r["block"] or b"") if keep_payload or r["number"] is not None else 200
                    if size > ROW_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, PARSED)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, PARSED)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts in batch.column("parts"):
                found = parts.as_py()
                first = next((p for p in found if p["number"] == 1), None)
                try:
                    block = reassemble(found)
                except ValueError:
                    block = None
                record = first or {"record_id": found[0]["origin"], "type": "damaged", "uri": found[0]["uri"], "refers_to": None, "declared": None}
                yield pa.RecordBatch.from_pylist([_read(record, block, keep_payload)] * (first["times"] if first else 1), READ)

    parsed = stored(files.mapInArrow(opened, f"{READ_DDL}, {PART_DDL}"))
    names = [f.name for f in READ]
    fields = ["record_id", "type", "uri", "refers_to", "origin", "declared", "total", "block"]
    each = parsed.where("number is not null").groupBy("origin", "number").agg(F.count(F.lit(1)).alias("times"), *[F.first(c).alias(f"_{c}") for c in fields])
    part = F.struct("number", "times", *[F.col(f"_{c}").alias(c) for c in fields])
    split = each.groupBy("origin").agg(F.collect_list(part).alias("parts")).select("parts")
    return parsed.where("number is null").select(*names).unionByName(split.mapInArrow(joined, READ_DDL))


def archive_round_trip(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, most_digests: int = MOST_DIGESTS) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each row of ``pages``, read from archives.

    Of rows with equal html (null: empty) those with the largest page_id are responses, the others revisits of
    it. A null page_id refers to the largest other one, or is a response if there is none; repeated rows come
    back each. Only digests are grouped, with partial maxima; those of repeated payloads are sent to all
    executors, if they are ``most_digests`` at most, and so payloads stay where they are.
    """
    spark = pages.sparkSession
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("uri"), payload.alias("payload")).withColumn("key", F.unhex(F.sha1("payload")))
    last = stored(rows.groupBy("key").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "last"))
    if last.count() <= most_digests:
        last = F.broadcast(last)
    name = lambda page: F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), F.lower(F.hex("key")))
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("last")) & F.col("last").isNotNull(), F.lit(False))
    named = rows.join(last, "key", "left").select(
        name(F.col("page_id")).alias("record_id"), "uri", F.when(~again, F.col("payload")).alias("payload"), F.when(again, name(F.col("last"))).alias("refers_to"), F.when(again, F.hex("key")).alias("payload_digest")
    )
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(named, folder, segment_bytes)
    read = cut(read_warc(spark, folder, keep_payload=False).drop("payload"))
    remove(spark, folder)
    page = lambda c: F.expr(f"try_cast(split({c}, ':')[2] as bigint)")
    full = read.where("type = 'response'").groupBy("record_id").agg(F.max("payload_bytes").alias("n"))
    referred = read.where("type = 'revisit'").join(full.withColumnRenamed("record_id", "refers_to"), "refers_to", "left")
    columns = lambda n: [page("record_id").alias("page_id"), F.col(n).alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to")]
    return read.where("type = 'response'").select(*columns("payload_bytes")).unionByName(referred.select(*columns("n")))
