"""WARC archives of web pages and a normaliser for monolithic gzip.

A monolithic archive is one gzip stream over all records, so nothing in it can be read without inflating all before.
The normaliser inflates each stream once, in pieces, rewrites every record as a gzip member of its own and writes a
sidecar index of (offset, length) beside it; a reader then inflates exactly the members that it wants.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.store import Workspace, tidy

#: Uncompressed bytes after which an archive is closed (a longer record has an archive of its own).
ARCHIVE_BYTES = 1 << 23
LEVEL = 1
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE = "archive string, n_records long, data binary"
NORMAL = "archive string, data binary, index array<struct<offset:long,length:long,record_id:string,record_type:string,target_uri:string>>"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    name = urn[10:-1] if urn else "none"
    return None if name == "none" else int(name)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, response: bool, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head only, whose Content-Length is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if response else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if not response:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    fields = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def split_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an uncompressed WARC that comes in pieces, each with its whole bytes."""
    held = bytearray()
    need = 0
    fields: dict[str, str] = {}
    for piece in pieces:
        held += piece
        while True:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                fields = parse_head(bytes(held[:end]))
                need = end + 4 + int(fields["content-length"]) + 4
            if len(held) < need:
                break
            yield fields, bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("the archive ends within a record")


def inflate(data: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The contents of gzip data of one or more members, at most `piece` bytes at a time."""
    rest = data
    while rest:
        stream = zlib.decompressobj(31)
        while not stream.eof:
            out = stream.decompress(rest, piece)
            rest = stream.unconsumed_tail
            if out:
                yield out
            elif not stream.eof and not rest:
                raise ValueError("the gzip stream is cut off")
        rest = stream.unused_data


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def normalise(data: bytes) -> tuple[bytes, list[dict]]:
    """(archive with a gzip member for each record, its offset index) from any gzip WARC, monolithic or not."""
    out, index = bytearray(), []
    for fields, record in split_records(inflate(data)):
        member = gzip_member(record)
        index.append({"offset": len(out), "length": len(member), "record_id": fields.get("warc-record-id"), "record_type": fields["warc-type"], "target_uri": fields.get("warc-target-uri")})
        out += member
    return bytes(out), index


def read_record(data: bytes, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of the one member at an index entry."""
    raw = zlib.decompress(data[offset : offset + length], 31)
    head, _, block = raw.partition(b"\r\n\r\n")
    http, _, payload = block[:-4].partition(b"\r\n\r\n")
    return parse_head(head), parse_head(http), payload


def _archives(limit: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, size, records = TaskContext.get().partitionId(), 0, 0, 0
        packer, out = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), []

        def close():
            nonlocal n, size, records, packer, out
            data = b"".join([*out, packer.flush()])
            row = pa.record_batch([pa.array([f"part-{part:06d}-{n:06d}.warc.gz"]), pa.array([records], pa.int64()), pa.array([data], pa.binary())], names=["archive", "n_records", "data"])
            n, size, records, packer, out = n + 1, 0, 0, zlib.compressobj(LEVEL, zlib.DEFLATED, 31), []
            return row

        for batch in batches:
            for page, url, payload, digest, keeper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                record = build_record(page, url, payload, digest, page == keeper, keeper)
                out.append(packer.compress(record))
                size, records = size + len(record), records + 1
                if size >= limit:
                    yield close()
        if records:
            yield close()

    return run


def write_archives(pages: DataFrame, work: Workspace, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Monolithic gzip archives of `pages(page_id, url, html, ...)`, one table row each."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    keepers = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("keeper"))
    own = F.when(F.octet_length("payload") >= min_bytes, F.col("keeper")).otherwise(F.col("page_id"))
    rows = rows.join(keepers.hint("shuffle_hash"), "sha", "left").select("page_id", "url", "payload", "sha", own.alias("keeper"))
    return work.save(rows.mapInArrow(_archives(archive_bytes), ARCHIVE), "monolithic", compression="uncompressed")


@tidy
def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string())]))
    for batch in batches:
        for archive, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            out, index = normalise(data.as_py())
            yield pa.record_batch([pa.array([archive]), pa.array([out], pa.binary()), pa.array([index], kind)], names=["archive", "data", "index"])


def normalise_archives(archives: DataFrame, work: Workspace) -> DataFrame:
    """Archives with a member for each record, and their sidecar indexes."""
    return work.save(archives.select("archive", "data").mapInArrow(_normalise, NORMAL), "normal", compression="uncompressed")


@tidy
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, index in zip(batch.column(0), batch.column(1), strict=True):
            data, rows = data.as_py(), []
            for entry in index.as_py():
                warc, http, payload = read_record(data, entry["offset"], entry["length"])
                digest = warc["warc-payload-digest"].removeprefix("sha1:")
                if warc["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{entry['record_id']}: the payload is not what its digest says")
                rows.append((page_of(warc["warc-record-id"]), int(http["content-length"]), digest, warc["warc-type"], page_of(warc.get("warc-refers-to"))))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(normal: DataFrame) -> DataFrame:
    """Every record of normalised archives, each read by its index entry alone."""
    return normal.select("data", "index").mapInArrow(_read, RECORD)


def archive_records(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages as monolithic WARC, normalise the archives, read them back by index; one row per row of pages.

    Of equal payloads of at least min_bytes that with the largest page_id is the response, others revisit it.

    Defined cases: a null html is an empty payload; a null url has no target URI; rows that repeat the largest page_id
    of a payload are all responses; a null page_id ranks under all others, and where only such rows share a payload
    all of them are responses. Other columns are ignored; an empty table gives no archives and no rows.
    """
    work = Workspace(pages.sparkSession, "warc")
    return read_archives(normalise_archives(write_archives(pages, work, min_bytes, archive_bytes), work))
