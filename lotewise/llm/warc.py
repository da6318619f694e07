"""WARC archives: writing captures, reading them back, and assembling transactions.

Each capture becomes three records: request, response (or revisit, when an earlier capture has
the same payload) and metadata. Request and metadata name the response in WARC-Concurrent-To.
Archives are written by Spark's text writer: a row is one record, and the line separator is the
pair of line ends that closes a record, so executors write wherever Spark can. Pages go to files by size
(``TIERS``), so that a file's bytes are bounded or it holds one page. Files are read as binary values,
plain or gzipped in any number of members, inflated piece by piece and cut by Content-Length, so a
reader holds a file's compressed bytes and one record. ``assemble`` joins the three kinds of record through
their concurrent-to identifiers into one nested row a capture.

Deciding revisits takes one small row for each repeated payload (summed before the shuffle), stored;
the join with it is on the payload's digest. Spark broadcasts that table where its size is below
Spark's limit; beyond it, pages are sorted and joined and Spark splits a hot digest's side. No group
of equal payloads is gathered.

Defined cases: null html is an empty payload; payloads below ``SMALL`` bytes are always responses;
of repeated rows with one id, one is the response and the rest revisit it; a null id orders last
and stays null; a null url gives no target; an empty table gives archives without records and an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Payloads with fewer bytes are never revisits.
SMALL = 100
#: Payload bytes of a page up to which a file takes so many records (three a page): bounds what a reader holds.
TIERS = ((64 << 10, 3000), (4 << 20, 48), (1 << 62, 3))
#: Bytes inflated at once.
PIECE = 1 << 20
#: Payload bytes that a reader hands over at once.
YIELD_BYTES = 2 << 20
_END = "\r\n"

_RECORD = "record_id string, kind string, concurrent_to string, refers_to string, target_uri string, warc_date string, declared_digest string, fields map<string,string>, payload binary, payload_bytes bigint, payload_digest string"


def _header(*pairs: tuple[str, Column]) -> Column:
    """WARC header lines; a null value leaves its line out, line ends in values are escaped."""
    clean = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), F.regexp_replace(F.regexp_replace(v, "\r", "%0D"), "\n", "%0A"), F.lit(_END))) for k, v in pairs]
    return F.concat(F.lit(f"WARC/1.1{_END}"), *[F.coalesce(c, F.lit("")) for c in clean], F.lit(_END))


def _record(kind: Column | str, rid: Column, uri: Column, date: str, content: str, block: Column, *more: tuple[str, Column]) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = _header(("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri), *more, ("Content-Type", F.lit(content)), ("Content-Length", F.octet_length(block).cast("string")))
    return F.concat(head, block)


def decide(pages: DataFrame) -> DataFrame:
    """Pages with payload, digest, capture kind and the record ids of capture and original."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"), F.octet_length(html).cast("long").alias("n_bytes"))
    key = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.col("url").isNull().alias("bare"), F.col("url").alias("url"))
    large = rows.where(F.col("n_bytes") >= SMALL)
    equal = large.groupBy("digest", key.alias("key")).agg(F.count(F.lit(1)).alias("same"))
    # stored, so that its size is known: Spark broadcasts it below its own limit and else sorts and joins
    firsts = stored(equal.groupBy("digest").agg(F.min(F.struct("key", "same")).alias("first"), F.sum("same").alias("n")).where("n > 1").select("digest", "n", "first.key", "first.same"), "warc-firsts")
    joined = rows.join(firsts, "digest", "left").withColumn("lead", F.coalesce(key == F.col("key"), F.lit(False)) & (F.col("n_bytes") >= SMALL))
    both = joined.where("NOT lead OR same = 1").drop("key", "same")
    if not firsts.where("same > 1").isEmpty():
        # rows equal in id, url and payload tie: the payload stays with one, the others are made from their number
        tied = firsts.where("same > 1")
        one = rows.join(tied.select("digest", "key"), "digest").where(key == F.col("key")).groupBy("digest", "page_id", "url").agg(F.first("html").alias("html"), F.first("n_bytes").alias("n_bytes"))
        one = one.join(tied.select("digest", "n"), "digest").withColumn("lead", F.lit(True))
        rest = tied.select("digest", F.col("key.id").alias("page_id"), F.col("key.url").alias("url"), F.lit("").alias("html"), F.lit(SMALL).cast("long").alias("n_bytes"), "n", F.lit(False).alias("lead"), F.explode(F.sequence(F.lit(2), F.col("same"))).alias("copy")).drop("copy")
        both = both.unionByName(one).unionByName(rest)
    revisit = F.col("n").isNotNull() & ~F.col("lead") & (F.col("n_bytes") >= SMALL)
    named = F.concat(F.lit("<urn:sha256:"), F.col("digest"), F.lit(">"))
    return both.select("page_id", "url", "html", "digest", "n_bytes", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, named).alias("original"), F.when(F.col("lead"), named).otherwise(F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))).alias("rid"), F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")).alias("request_id"), F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")).alias("metadata_id"))


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one request, response or revisit, and metadata record for each page, gzipped, under ``path``."""
    p = decide(pages)
    uri, rid = F.col("url"), F.col("rid")
    target = F.regexp_replace(F.coalesce(uri, F.lit("/")), "[\r\n ]", "")
    request = _record("request", F.col("request_id"), uri, date, "application/http; msgtype=request", F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{_END}{_END}")), ("WARC-Concurrent-To", rid))
    answer = F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}{_END}")
    is_new = F.col("kind") == "response"
    capture = _record(F.col("kind"), rid, uri, date, "application/http; msgtype=response", F.when(is_new, F.concat(answer, "html")).otherwise(answer), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), ("WARC-Refers-To", F.col("original")), ("WARC-Profile", F.when(~is_new, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
    fields = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(_END)), F.lit("")), F.lit(f"via: table{_END}"))
    metadata = _record("metadata", F.col("metadata_id"), uri, date, "application/warc-fields", fields, ("WARC-Concurrent-To", rid))
    sizes = pages.select(F.coalesce(F.octet_length("html"), F.lit(0)).alias("b"))
    low, used = -1, []
    for i, (most, records) in enumerate(TIERS):
        used.append((i, low, most, records))
        low = most
    counts = sizes.agg(*[F.count_if((F.col("b") > a) & (F.col("b") <= b)).alias(str(i)) for i, a, b, _ in used]).first()
    for i, a, b, records in used:
        if not counts[str(i)] and i:
            continue
        part = p if counts[str(i)] == sum(counts) else p.where((F.col("n_bytes") > a) & (F.col("n_bytes") <= b))
        lines = part.select(F.explode(F.array(request, capture, metadata)).alias("value"))
        lines.write.mode("append").option("lineSep", _END * 2).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def inflated(raw: bytes, piece: int = PIECE) -> Iterator[bytes]:
    """An archive's bytes, some at a time: as they are, or of every member of a gzip file."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    while raw:
        d = zlib.decompressobj(31)
        while not d.eof:
            out = d.decompress(raw, piece)
            raw = d.unconsumed_tail
            if not out and not raw and not d.eof:
                raise ValueError("a gzip member is cut off")
            yield out
        raw = d.unused_data.lstrip(b"\0")


def cut_records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive's bytes, which come in pieces, cut by Content-Length."""
    held, at, parts = bytearray(), 0, iter(parts)

    def more() -> bool:
        nonlocal at
        got = next(parts, None)
        if got is None:
            return False
        if at:
            del held[:at]
            at = 0
        held.extend(got)
        return True

    while True:
        while held[at : at + 2] == b"\r\n":
            at += 2
        stop = held.find(b"\r\n\r\n", at)
        while stop < 0 or held[at : at + 2] == b"\r\n":
            if not more():
                if held[at:].strip(b"\r\n"):
                    raise ValueError("a record's header is cut off")
                return
            while held[at : at + 2] == b"\r\n":
                at += 2
            stop = held.find(b"\r\n\r\n", at)
        first, *lines = bytes(held[at:stop]).decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no record begins where the one before ends")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size, begin = int(head["content-length"]), stop + 4 - at
        while len(held) - at < begin + size:
            if not more():
                raise ValueError("a record's block is cut off")
        yield head, bytes(held[at + begin : at + begin + size])
        at += begin + size


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives under ``path``: headers, warc-fields, and the HTTP payload with its digest.

    Without ``payloads`` their sizes and digests are still taken from them, but they stay with the reader (null).
    """
    kinds = "record_id kind concurrent_to refers_to target_uri warc_date declared_digest".split()
    names = [*kinds, "fields", "payload", "payload_bytes", "payload_digest"]
    types = [pa.string()] * 7 + [pa.map_(pa.string(), pa.string()), pa.binary(), pa.int64(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows, size = [], 0
                for head, block in cut_records(inflated(content.as_py())):
                    kind, fields, payload = head.get("warc-type"), {}, None
                    if head.get("content-type", "").startswith("application/http"):
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    elif head.get("content-type") == "application/warc-fields":
                        fields = {k.strip(): v.strip() for k, s, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if s}
                    rows.append((head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-payload-digest"), list(fields.items()), payload if payloads else None, None if payload is None else len(payload), None if payload is None else hashlib.sha256(payload).hexdigest()))
                    size += len(block)
                    if size > YIELD_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!._]*").load(path)
    return files.select("content").mapInArrow(run, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: capture_id, capture, request, metadata (structs of the records' columns)."""
    cols = [F.col(c) for c in records.columns]
    capture = records.where(F.col("kind").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), F.struct(*cols).alias("capture"))
    request = records.where("kind = 'request'").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "target_uri", "warc_date").alias("request"))
    metadata = records.where("kind = 'metadata'").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "fields").alias("metadata"))
    return capture.join(request, "capture_id", "left").join(metadata, "capture_id", "left")


def resolve(captures: DataFrame) -> DataFrame:
    """Captures with page id, payload size and digest; a revisit takes them from the response it refers to."""
    flat = captures.select("capture_id", F.try_element_at("metadata.fields", F.lit("page-id")).cast("long").alias("page_id"), F.col("capture.kind").alias("record_type"), F.col("capture.refers_to").alias("ref"), F.col("capture.payload_bytes").alias("own_bytes"), F.col("capture.payload_digest").alias("own_digest"))
    first = flat.where("record_type = 'response' AND capture_id LIKE '<urn:sha256:%'").select(F.col("capture_id").alias("ref"), F.col("page_id").alias("first_id"), F.col("own_bytes").alias("first_bytes"), F.col("own_digest").alias("first_digest"))
    null = F.lit(None).cast("long").alias("refers_to")
    own = flat.where("ref IS NULL").select("page_id", F.col("own_bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"), "record_type", null)
    again = flat.where("ref IS NOT NULL").join(first, "ref", "left")  # revisits only: responses have no key to join by
    return own.unionByName(again.select("page_id", F.col("first_bytes").alias("payload_bytes"), F.col("first_digest").alias("payload_digest"), "record_type", F.col("first_id").alias("refers_to")))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives of ``pages`` in the shared folder, read them back, assemble and resolve."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write(pages, path)
    return resolve(stored(assemble(stored(read(spark, path, payloads=False).drop("payload"), "warc-records")), "warc-captures"))
