"""WARC archives with revisit records for repeated payloads.

Only headers (digest, length, page, url) meet in a shuffle by payload digest: of the equal payloads of at least
`least_bytes` bytes, the record with the smallest page_id is the response and the others become revisits of it, which are
written from their headers. Payloads stay where they were read; beyond as many repeated digests as may be broadcast (with a
page_id each), a bit map of them is, and only payloads whose bit is set move. Archives are written by Spark's text writer,
each row one record and the record end of two CRLFs as line separator, so they get Spark's commit protocol and any file
system; compressed, a file is one gzip member, not one a record. Reading passes over records that are neither responses nor
revisits, takes a missing digest from the payload, and parses them by Content-Length, checks every payload against its digest, and joins revisits
to the responses that they refer to.

Nulls: a null payload is empty, a null url is urn:unknown, a null page_id is left out of the record and never a response
that others refer to, if another page has an id. Rows that repeat the smallest page_id are all responses. Payloads may be
text (UTF-8) or binary, of any length and with any content. An empty table gives archives without records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import new_path, staged

LEAST_BYTES, DATE, ARCHIVE_BYTES = 100, "2024-01-01T00:00:00Z", 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: Repeated digests that may be broadcast, 100 bytes each with a page_id; bits of the map beyond that.
REPEATED_ROWS, MAP_BITS = 500_000, 1 << 29
HEADERS = "page_id long, record_type string, record_id string, refers_to_id string, payload_bytes long, payload_digest string, target_uri string"


def record_id(key: Column) -> Column:
    """A name-based URN for a page."""
    h = F.md5(F.concat(F.lit("page "), key).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _digested(pages: DataFrame) -> DataFrame:
    """(page_id, uri, payload: string of its bytes, bytes, digest)."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("urn:unknown")), r"[\x00-\x20\x7F]", "%20").alias("uri"),
        payload.cast("string").alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("digest"),
    )


def _place(digest: Column) -> Column:
    """A digest's bit in the map: its first 29 bits."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(MAP_BITS - 1))


def _may_repeat(own: DataFrame, repeated: DataFrame) -> DataFrame:
    """own with `maybe`: false only if its digest isn't in `repeated`. The map is 64 MB at most, however many digests it holds."""
    maps = repeated.select(_place(F.col("digest")).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("map"))
    at = F.bitmap_bit_position(_place(F.col("digest")))
    byte = F.conv(F.hex(F.substring(F.col("map"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2
    return own.join(F.broadcast(maps), F.bitmap_bucket_number(_place(F.col("digest"))) == F.col("bucket"), "left").withColumn("maybe", F.coalesce(bit == 1, F.lit(False))).drop("bucket", "map")


def resolved(pages: DataFrame, least_bytes: int = LEAST_BYTES, repeated_rows: int = REPEATED_ROWS) -> DataFrame:
    """(page_id, uri, payload, bytes, digest, first: struct(page_id, uri) of the original for revisits, which have no payload)."""
    own = _digested(pages)
    heads = staged(own.drop("payload"), "headers")
    alike = heads.filter(F.col("bytes") >= least_bytes)
    repeated = alike.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "uri"))).alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = staged(repeated.filter("n > 1 AND first IS NOT NULL").drop("n"), "repeated")
    other = ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    revisits = alike.join(repeated, "digest").filter(other).withColumn("payload", F.lit(None).cast("string"))
    # The payloads of all other records, where they were read: only those that may be revisits are looked up.
    of = repeated.select("digest", F.struct(F.col("first.page_id").alias("page_id")).alias("first"))
    stays = F.col("first").isNull() | ~other | (F.col("bytes") < least_bytes)
    if repeated.count() <= repeated_rows:
        responses = own.join(F.broadcast(of), "digest", "left").filter(stays)
    else:
        marked = _may_repeat(own, repeated).withColumn("maybe", F.col("maybe") & (F.col("bytes") >= least_bytes))
        met = marked.filter("maybe").join(of, "digest", "left").filter(stays)
        responses = marked.filter("NOT maybe").withColumn("first", F.lit(None).cast("struct<page_id:long>")).unionByName(met)
    columns = ["page_id", "uri", "payload", "bytes", "digest"]
    return responses.select(*columns, F.lit(None).cast(repeated.schema["first"].dataType).alias("first")).unionByName(revisits.select(*columns, "first"))


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES, date: str = DATE) -> DataFrame:
    """(record string, bytes long): the records without their end."""
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    r = resolved(pages, least_bytes)
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    nothing = F.lit("")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.coalesce(F.col("page_id").cast("string"), F.concat_ws(" ", F.lit("none"), "uri", "digest")))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("first.page_id").cast("string"))), line("WARC-Refers-To-Target-URI", F.col("first.uri")), line("WARC-Refers-To-Date", F.lit(date)))).otherwise(nothing),
        F.coalesce(line("X-Page-Id", F.col("page_id").cast("string")), nothing),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
    )
    whole = F.concat(head, line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)
    return r.select(whole.alias("record"), F.col("bytes"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES, compression: str = "none") -> None:
    """Writes pages (page_id, url, html) as WARC files of about archive_bytes each."""
    n, total = pages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col("html").cast("binary")).cast("long") + 600), F.lit(0))).first()
    per_file = max(1, int(archive_bytes * n / max(1, total, 600 * n)))
    records(pages, least_bytes, date).select("record").write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", per_file).text(path)


def parsed(archive: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers (names in lower case) and block of every record."""
    at, view = 0, memoryview(archive)
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        stop = end + 4 + int(head["content-length"])
        if archive[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} ends badly")
        yield head, view[end + 4 : stop]
        at = stop + 4


def _body(block: memoryview) -> int:
    """Where the payload begins behind the HTTP header, of any length; 0 without one."""
    size = 4096
    while (at := bytes(block[:size]).find(b"\r\n\r\n")) < 0:
        if size >= len(block):
            return 0
        size *= 4
    return at + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The headers of all records; length and digest are those of the payload that was read, and for revisits as told."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for b in batches:
            for content in b.column(0):
                data = content.as_py()
                rows = []
                for head, block in parsed(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    kind = head["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    told = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    start = _body(block)
                    size, digest = len(block) - start, told
                    if kind == "response":
                        digest = hashlib.sha256(block[start:]).hexdigest()
                        if told and digest != told:
                            raise ValueError(f"{head['warc-record-id']}: the payload has changed")
                    page = head.get("x-page-id")
                    rows.append((int(page) if page else None, kind, head["warc-record-id"], head.get("warc-refers-to"), size if kind == "response" else None, digest, head.get("warc-target-uri")))
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000], strict=True), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], [f.split()[0] for f in HEADERS.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(of, HEADERS)


def revisits_resolved(heads: DataFrame) -> DataFrame:
    """heads with refers_to, the page_id of a revisit's response, and that response's payload_bytes."""
    originals = heads.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("of_bytes"), F.min("payload_digest").alias("of_digest"))
    revisits = heads.filter("record_type = 'revisit'").join(originals, "refers_to_id", "left")
    columns = ["page_id", "record_type", "record_id", "target_uri"]
    whole = heads.filter("record_type = 'response'").select(*columns, "payload_bytes", "payload_digest", F.lit(None).cast("long").alias("refers_to"))
    return whole.unionByName(revisits.select(*columns, F.col("of_bytes").alias("payload_bytes"), F.col("of_digest").alias("payload_digest"), "refers_to"))


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes archives of pages into the shared folder and reads them back."""
    spark, path = pages.sparkSession, new_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return revisits_resolved(staged(read_archives(spark, path), "warc-headers"))
