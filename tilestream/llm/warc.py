"""WARC archives: writing with segmentation and revisits, and reading with segment reassembly.

A record whose block exceeds the segment size is split: the first part keeps its type and has segment number 1, later parts are
continuation records that name the first as their origin; the last one tells the total length. Archives are tables of gzip members in the
shared folder, so that they can be read wherever Spark reads.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilestream.llm.common import written

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
NOT_CHANGED = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    pass


def chunked(payload: bytes, size: int = 4096) -> bytes:
    """Chunked transfer framing."""
    out = [b"%x\r\n%b\r\n" % (len(part), part) for a in range(0, len(payload), size) if (part := payload[a : a + size])]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Undoes chunked transfer framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise WarcError("a chunk's size is missing")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise WarcError("a chunk is cut off")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise WarcError("no end of the HTTP header")
    return unchunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def segments(record_id: str, headers: list[tuple[str, str]], block: bytes, size: int) -> Iterator[bytes]:
    """The record, split into segments where its block exceeds size."""
    if len(block) <= size:
        yield record([("WARC-Record-ID", record_id), *headers], block)
        return
    last = -(-len(block) // size)
    for n in range(1, last + 1):
        part = block[(n - 1) * size : n * size]
        if n == 1:
            yield record([("WARC-Record-ID", record_id), *headers, ("WARC-Segment-Number", "1")], part)
        else:
            own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{record_id[:-1]}/{n}>"), ("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", str(n))]
            yield record(own + [("WARC-Segment-Total-Length", str(len(block)))] * (n == last), part)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    rest = archive
    while rest:
        z = zlib.decompressobj(31)
        data = z.decompress(rest) + z.flush()
        if not z.eof:
            raise WarcError("an archive ends within a record")
        rest = z.unused_data
        head, mark, body = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not mark or not lines[0].startswith("WARC/"):
            raise WarcError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        yield headers, body[: int(headers["content-length"])]


def reassembled(parts: list[tuple[int, bytes]], total: int | None) -> bytes:
    """The block of parts in order of their segment numbers; they must be 1, 2, ... and have the total length."""
    if [n for n, _ in parts] != list(range(1, len(parts) + 1)):
        raise WarcError("segment numbers have gaps")
    block = b"".join(x for _, x in parts)
    if total is None or total != len(block):
        raise WarcError("the total length differs")
    return block


def _uri(url: str) -> str:
    return "".join(c if c > " " else "%%%02X" % ord(c) for c in url)


def write_archives(pages: DataFrame, segment_bytes: int = 16384, archive_bytes: int = 4 << 20, least: int = 100) -> DataFrame:
    """archive, data: the archives of all pages. Of pages with equal payloads of at least `least` bytes that with the smallest page_id is
    a response, the others revisit it. Rows that repeat the smallest page_id are all responses. A null page_id is the smallest."""
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(-(2**63))).alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    first = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("other")).where("first < other").select(F.col("digest").alias("__d"), "first")
    # only digests that recur are joined; page bodies move once, and skewed digests are split
    decided = rows.join(first, F.col("digest") == F.col("__d"), "left").select("page_id", "url", "html", "digest", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))

    def run(batches):
        part = TaskContext.get().partitionId()
        held: list[bytes] = []
        size = made = row = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{made:05d}.warc.gz"]), pa.array([b"".join(held)], pa.large_binary()).cast(pa.binary())], names=["archive", "data"])

        for b in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = f"<urn:x-page:{page_id}#{part}-{row}>"
                row += 1
                headers = [("WARC-Target-URI", _uri(url))] if url is not None else []
                headers += [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                if refers_to is None:
                    parts = segments(own, [("WARC-Type", "response"), *headers], HTTP + chunked(html.encode()), segment_bytes)
                else:
                    parts = segments(own, [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>"), *headers], NOT_CHANGED, segment_bytes)
                for x in parts:
                    held.append(x)
                    size += len(x)
                    if size >= archive_bytes:
                        yield flush()
                        held, size, made = [], 0, made + 1
        if held:
            yield flush()

    return written(decided.mapInArrow(run, "archive string, data binary"), "warc")


def _id(urn: str) -> int:
    return int(urn.strip("<>").rsplit(":", 1)[-1].split("#")[0])


READ = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest of every record; a revisit's payload is that of its response.

    Whole records are decoded where they are read. Segments are grouped by origin and sorted by number, and a reader joins one record at a
    time; wrong numbers, lengths, framing or digests raise WarcError.
    """
    parsed = "origin string, number int, total long, kind string, refers_to long, digest string, block binary"

    def parse(batches):
        names = [x.split()[0] for x in parsed.split(", ")]
        types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for b in batches:
            for data in b.column(b.schema.get_field_index("data")):
                out: list[list] = [[] for _ in names]
                for h, block in records(data.as_buffer().to_pybytes()):
                    total, refers = h.get("warc-segment-total-length"), h.get("warc-refers-to")
                    number = int(h.get("warc-segment-number", 0))
                    row = (h.get("warc-segment-origin-id", h["warc-record-id"]), number, int(total) if total else None, h["warc-type"], _id(refers) if refers else None, h.get("warc-payload-digest"), block)
                    for to, x in zip(out, row, strict=True):
                        to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)

    def finish(origin: str, kind: str, refers_to: int | None, digest: str | None, block: bytes) -> tuple:
        payload = http_payload(block)
        own = hashlib.sha256(payload).hexdigest()
        told = (digest or "").removeprefix("sha256:")
        if kind == "response" and told != own:
            raise WarcError(f"{origin}: the payload's digest differs")
        return _id(origin), kind, refers_to, len(payload) if kind == "response" else None, told

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        names = [x.split()[0] for x in READ.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def whole(batches):
        for b in batches:
            rows = [finish(r["origin"], r["kind"], r["refers_to"], r["digest"], r["block"]) for r in b.to_pylist()]
            yield batch(rows)

    def joined(batches):
        first: dict = {}
        parts: list[tuple[int, bytes]] = []
        total = None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if parts and r["origin"] != first["origin"]:
                    rows.append(finish(first["origin"], first["kind"], first["refers_to"], first["digest"], reassembled(parts, total)))
                    parts = []
                if not parts:
                    first, total = r, None
                parts.append((r["number"], r["block"]))
                total = r["total"] if r["total"] is not None else total
            yield batch(rows)
        if parts:
            yield batch([finish(first["origin"], first["kind"], first["refers_to"], first["digest"], reassembled(parts, total))])

    rows = archives.mapInArrow(parse, parsed)
    complete = rows.where("number = 0").mapInArrow(whole, READ)
    split = rows.where("number > 0").repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(joined, READ)
    found = written(complete.unionByName(split), "warc-read")
    target = found.where("record_type = 'response'").groupBy(F.col("page_id").alias("__id")).agg(F.min("payload_bytes").alias("__bytes"), F.min("payload_digest").alias("__digest"))
    revisits = found.where("record_type = 'revisit'").join(target, F.col("refers_to") == F.col("__id"), "left")
    checked = F.when(F.col("payload_digest") == F.col("__digest"), F.col("__bytes")).otherwise(F.raise_error(F.lit("a revisit's response is missing or differs")).cast("long"))
    return found.where("record_type = 'response'").unionByName(revisits.withColumn("payload_bytes", checked).drop("__id", "__bytes", "__digest"))


def warc_report(pages: DataFrame, **settings) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, after writing and reading all archives.

    Null html is an empty payload, null url has no target URI; repeated rows are records of their own.
    """
    out = read_archives(write_archives(pages, **settings))
    real = lambda c: F.when(F.col(c) != F.lit(-(2**63)), F.col(c))
    return out.select(real("page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", real("refers_to").alias("refers_to"))
