"""WARC archives: writer, monolithic gzip normaliser with a sidecar offset index, and reader.

An archive that was compressed as one gzip stream can only be read from its start. The normaliser inflates such a
stream once, in pieces of bounded size, writes every record again as a gzip member of its own, and writes a sidecar
index (``<archive>.idx``: offset, length, type, record id, tab-separated) so that any record can be read by a seek.

Records with equal payloads become one ``response`` and ``revisit`` records that refer to it.

Defined results: a null payload is the empty payload; of equal payloads the largest id is the response (rows that
tie for it, as repeated rows do, all are responses; null ids count as smallest); payloads smaller than ``revisit_from``
bytes are all responses; white space and control characters in a URL are percent-encoded, a null URL is left out; an
empty table gives no archives and no rows; other columns are ignored. A truncated archive is an error.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import common, files

PIECE = 1 << 20
ARCHIVE_BYTES = 1 << 28
GZIP = 31  # zlib's window setting for a gzip wrapper
DATE = "2000-01-01T00:00:00Z"
ID_PREFIX = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = "archive string, offset long, length long, type string, record_id string"


def payload_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: str | None, url: str | None, payload: bytes, length: int, sha1: bytes, refers_to: str | None) -> bytes:
    """One WARC record. A revisit holds the HTTP header of the full payload only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = lambda x: f"<{ID_PREFIX}{urllib.parse.quote(x or '', safe='')}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=''.join(map(chr, range(33, 127))))}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(sha1)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:80]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


# --- writing ---------------------------------------------------------------------------------------------------------


def _write(out_dir: str, archive_bytes: int):
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, k = TaskContext.get().partitionId(), _rows(batches), 0
        row = next(rows, None)
        while row is not None:
            uri, n, size = f"{out_dir}/part-{part:06d}-{k:04d}.warc.gz", 0, 0
            with files.new_file(uri) as out:
                z = zlib.compressobj(6, zlib.DEFLATED, GZIP)  # one stream for the whole archive
                while row is not None and (n == 0 or size < archive_bytes):
                    data = record(*row)
                    out.write(z.compress(data))
                    n, size, row = n + 1, size + len(data), next(rows, None)
                out.write(z.flush())
            k += 1
            yield pa.record_batch([[uri], [n]], schema=schema)

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "sha1", "refers_to"))):
            yield r[0], r[1], r[2], len(r[2]), r[3], r[4]


def revisits(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """pages (id, url, payload) with sha1 and, for those whose payload a row with a larger id has, refers_to."""
    hashed = pages.withColumn("sha1", F.unhex(F.sha1("payload")))
    group = hashed.where(F.length("payload") >= revisit_from).groupBy("sha1").agg(F.max("id").alias("__top"), F.count(F.lit(1)).alias("__n"))
    group = common.stored(group.where("__n > 1 AND __top IS NOT NULL"), common.run_dir(pages.sparkSession, "revisits"))
    heavy = group.where(F.col("__n") > F.lit(pages.count() // common.HEAVY)).select("sha1", "__top")
    later = F.when(F.length("payload") >= revisit_from, F.when(~F.col("id").eqNullSafe(F.col("__top")), F.col("__top")))
    named = common.spread_join(hashed, group.select("sha1", "__top"), ["sha1"], heavy, ["id", "url"])
    return named.withColumn("refers_to", later).select("id", "url", "payload", "sha1", "refers_to")


def write_archives(pages: DataFrame, out_dir: str, revisit_from: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (id, url, payload binary) as archives of one gzip stream each; gives (archive, records)."""
    common.prepare(pages.sparkSession)
    rows = revisits(pages, revisit_from)
    rows = rows.select(F.col("id").cast("string").alias("id"), F.col("url").cast("string").alias("url"), "payload", "sha1", F.col("refers_to").cast("string").alias("refers_to"))
    # a row for each archive: their number follows the partitions, so the driver may hold the list
    done = rows.mapInArrow(_write(f"{out_dir}/raw", archive_bytes), "archive string, records long").toArrow()
    return pages.sparkSession.createDataFrame(done, "archive string, records long")


# --- normalising -----------------------------------------------------------------------------------------------------


def inflate(stream) -> Iterator[bytes]:
    """The inflated bytes of a gzip stream of one or more members, in pieces."""
    z = zlib.decompressobj(GZIP)
    fed = False
    while data := stream.read(PIECE):
        while data:
            if z.eof:
                z, fed = zlib.decompressobj(GZIP), False
            fed = True
            piece = z.decompress(data, PIECE)
            if piece:
                yield piece
            data = z.unused_data if z.eof else z.unconsumed_tail
    while fed and not z.eof and (piece := z.decompress(z.unconsumed_tail, PIECE)):
        yield piece
    if fed and not z.eof:
        raise ValueError("truncated gzip stream")


class _Reader:
    """Exact and delimited reads over pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            piece = next(self.pieces, None)
            if piece is None:
                if self.held.strip(b"\r\n"):
                    raise ValueError("truncated WARC record")
                return None
            self.held += piece
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held:
                self.held = next(self.pieces, None) or b""
                if not self.held:
                    raise ValueError("truncated WARC record")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out


def normalise(source: str, target: str) -> list[tuple[str, int, int, str, str]]:
    """Rewrite one archive with a member for each record; write ``<target>.idx``; give the index rows."""
    index, offset = [], 0
    with files.open_stream(source) as stream, files.new_file(target) as out:
        reader = _Reader(inflate(stream))
        while (head := reader.until(b"\r\n\r\n")) is not None:
            head = head.lstrip(b"\r\n")
            if not head:
                continue
            h = _headers(head)
            z, size = zlib.compressobj(6, zlib.DEFLATED, GZIP), 0
            size += out.write(z.compress(head + b"\r\n\r\n"))
            for piece in reader.exactly(int(h["content-length"])):
                size += out.write(c) if (c := z.compress(piece)) else 0
            size += out.write(z.compress(b"\r\n\r\n") + z.flush())
            index.append((target, offset, size, h.get("warc-type", ""), h.get("warc-record-id", "")))
            offset += size
    with files.new_file(f"{target}.idx") as out:
        out.write("".join(f"{o}\t{n}\t{kind}\t{name}\n" for _, o, n, kind, name in index).encode())
    return index


def normalise_archives(archives: DataFrame, out_dir: str) -> DataFrame:
    """Normalise each ``archive`` (one a task) into ``out_dir``; gives the index table (archive, offset, length, ...)."""
    spark = archives.sparkSession
    common.prepare(spark)
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("record_id", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source in b.column("archive").to_pylist():
                rows = normalise(source, f"{out_dir}/warc/{source.rpartition('/')[2]}")
                yield pa.record_batch([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [[]] * 5, schema.types)], schema=schema)

    n = max(1, archives.count())
    return common.stored(archives.select("archive").repartition(n).mapInArrow(run, INDEX_SCHEMA), f"{out_dir}/index")


# --- reading ---------------------------------------------------------------------------------------------------------


def read_record(data: bytes) -> dict:
    """One member: headers, and for a response its payload, checked against the digest."""
    raw = zlib.decompress(data, GZIP)
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = _headers(head)
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if h["warc-type"] == "response" and (len(payload) != length or payload_digest(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
    return h | {"payload": payload, "payload_bytes": length, "payload_digest": digest}


def _id_of(x: str | None) -> str | None:
    return urllib.parse.unquote(x.strip("<>").removeprefix(ID_PREFIX)) or None if x else None


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    now, handle = None, None
    for b in batches:
        out = []
        for archive, offset, length in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length"))):
            if archive != now:
                if handle:
                    handle.close()
                now, handle = archive, files.open_random(archive)
            handle.seek(offset)
            r = read_record(handle.read(length))
            out.append((_id_of(r["warc-record-id"]), r.get("warc-target-uri"), r["warc-type"], r["payload_bytes"], r["payload_digest"], _id_of(r.get("warc-refers-to")), r["payload"] if with_payload else None))
        names = ("id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 7, types)], names=list(names))
    if handle:
        handle.close()


def read_archives(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that an index lists, each read by its offset."""
    common.prepare(index.sparkSession)
    out = index.select("archive", "offset", "length").mapInArrow(
        lambda it: _read(it, with_payload), "id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"
    )
    return out if with_payload else out.drop("payload")


def archive_round_trip(spark: SparkSession, pages: DataFrame, out_dir: str | None = None, revisit_from: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as monolithic archives, normalise them, and read the records back."""
    base = out_dir or common.run_dir(spark, "warc")
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select(F.col("page_id").alias("id"), "url", F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    index = normalise_archives(write_archives(rows, base, revisit_from), base)
    common.remove(spark, f"{base}/raw")
    back = read_archives(index, with_payload=False)
    return back.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
