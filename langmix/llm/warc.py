"""WARC archives: write captures, read them back, assemble transactions.

``write_captures`` turns each page into three records (request, response or
revisit, metadata) in WARC/1.1 files under a shared folder, written by Spark's
text writer: the record separator is the line separator, so any file system
Spark knows will do and retried tasks leave nothing behind. ``read_records``
parses the files by Content-Length. ``assemble`` joins the records of a
capture through WARC-Concurrent-To and emits one nested row per capture.

Payloads are the UTF-8 bytes of a text column; null counts as empty. Pages
with equal payloads (none excepted, empty ones included unless
``dedup_min_bytes`` says otherwise) are one response, that with the smallest
page id (null ids last, then the earlier row), and revisits of it. Repeated
page ids, also wholly repeated rows, are captures of their own. Extra input
columns are ignored. An empty table gives an empty archive and no rows."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langmix.llm.common import land, table
from langmix.session import scratch_path, ship_package

# --- Fixed values of the format ------------------------------------------------
CRLF = "\r\n"
SEPARATOR = "\r\n\r\n"
VERSION = "WARC/1.1"
BASE32_HEX = "0123456789abcdefghijklmnopqrstuv"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# -------------------------------------------------------------------------------
FILE_BYTES = 16 << 20  # payload bytes in one file, about: a file is read by one task
CAPTURED = "2024-01-01T00:00:00Z"

RECORD = ("record_id string, type string, concurrent_to string, refers_to string, target_uri string, "
          "digest string, payload_bytes bigint, page_id bigint, payload binary")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 160 bits are four groups of 40 bits, each
    ten hex digits in and eight base-32 digits out."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.lower(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32)), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), BASE32_HEX, BASE32)


def urn(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + ":"), key))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record(kind: Column, rid: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its closing separator; null fields are left out."""
    head = [F.concat(F.lit(f"{VERSION}{CRLF}WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid),
            F.lit(f"WARC-Date: {CAPTURED}")]
    head += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    head.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *head), F.lit(SEPARATOR), block)


def write_captures(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   body_col: str = "html", dedup_min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> str:
    """Write the archive; return its path. Two scans of the pages: digests
    that occur more than once, then the records. The body moves once."""
    src = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"),
                       F.col(f"`{url_col}`").cast("string").alias("url"),
                       F.coalesce(F.col(f"`{body_col}`").cast("string"), F.lit("")).alias("body"),
                       F.monotonically_increasing_id().alias("row"))
    src = src.withColumn("digest", base32_sha1(F.col("body").cast("binary"))) \
        .withColumn("bytes", F.octet_length("body").cast("long"))
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row")
    # a third of all pages may share one payload: partial aggregation leaves one row per task and digest
    groups = land(src.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("first")),
                  "warc-groups")
    size = groups.agg(F.sum(F.col("bytes") * F.col("copies")).alias("b"), F.sum("copies").alias("n")).first()
    per_file = max(1, int(file_bytes * (size["n"] or 0) / max(1, size["b"] or 0)))
    firsts = groups.where((F.col("copies") > 1) & (F.col("bytes") >= dedup_min_bytes)) \
        .select("digest", "bytes", F.col("first.row").alias("first_row"), F.col("first.page_id").alias("first_id"))
    caps = src.join(firsts, ["digest", "bytes"], "left")
    key = lambda page, row: F.concat_ws("/", F.coalesce(page.cast("string"), F.lit("null")), row.cast("string"))
    own = key(F.col("page_id"), F.col("row"))
    again = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
    kind = F.when(again, "revisit").otherwise("response")
    uri = ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A"))
    rid = urn("capture", own)
    status = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: ")
    http = F.concat(status, F.col("bytes").cast("string"), F.lit(SEPARATOR), F.when(again, "").otherwise(F.col("body")))
    path_of = F.coalesce(F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^\s#]*)", 1), F.lit(""))
    ask = F.concat(F.lit("GET "), F.when(path_of == "", "/").otherwise(path_of), F.lit(f" HTTP/1.1{CRLF}Host: "),
                   F.coalesce(F.regexp_extract("url", r"^[a-z]+://([^/\s]*)", 1), F.lit("")), F.lit(SEPARATOR))
    note = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                    F.lit(f"{CRLF}payloadBytes: "), F.col("bytes").cast("string"), F.lit(CRLF))
    to = ("WARC-Concurrent-To", rid)
    records = F.array(
        record(F.lit("request"), urn("request", own),
               [to, uri, ("Content-Type", F.lit("application/http; msgtype=request"))], ask),
        record(kind, rid, [
            uri, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Refers-To", F.when(again, urn("capture", key(F.col("first_id"), F.col("first_row"))))),
            ("WARC-Profile", F.when(again, IDENTICAL)),
            ("Content-Type", F.lit("application/http; msgtype=response"))], http),
        record(F.lit("metadata"), urn("metadata", own),
               [to, uri, ("Content-Type", F.lit("application/warc-fields"))], note))
    (caps.select(F.explode(records).alias("value")).write
         .option("lineSep", SEPARATOR).option("compression", "gzip")
         .option("maxRecordsPerFile", 3 * per_file).text(path))
    return path


def parse_archive(data: bytes, wanted: int | None = None):
    """Records of one archive as dicts of header fields plus ``block``."""
    at, end = 0, len(data)
    while at < end:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            raise ValueError("cut off in a record's header")
        lines = data[at:stop].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        first = stop + 4
        at = first + int(head["content-length"])
        if at > end:
            raise ValueError("cut off in a record's block")
        yield head, data[first:at]
        at += 4 if data[at:at + 4] == b"\r\n\r\n" else 0
        if at < end and data[at:at + 5] != b"WARC/":
            raise ValueError("no separator after a record")


def _unpack(data: bytes) -> bytes:
    if data[:2] != b"\x1f\x8b":
        return data
    parts = []
    while data:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(data))
        data = member.unused_data
    return b"".join(parts)


def _payload_digest(payload: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _parse_files(with_payload: bool):
    def run(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in RECORD.split(", ")]
        types = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in RECORD.split(", ")])
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for head, block in parse_archive(_unpack(content.as_py())):
                    kind, body, size, page, digest = head.get("warc-type"), None, None, None, None
                    if kind in ("response", "revisit"):
                        digest = (head.get("warc-payload-digest") or "").partition(":")[2] or None
                    if kind == "response":
                        body = block.partition(b"\r\n\r\n")[2]
                        if _payload_digest(body) != digest:
                            raise ValueError(f"payload digest of {head['warc-record-id']} doesn't match")
                        size = len(body)
                    elif kind == "metadata":
                        fields = dict(x.split(": ", 1) for x in block.decode().split(CRLF) if ": " in x)
                        page = int(fields["pageId"]) if fields.get("pageId") else None
                        size = int(fields["payloadBytes"])
                    rows.append((head["warc-record-id"], kind, head.get("warc-concurrent-to"),
                                 head.get("warc-refers-to"), head.get("warc-target-uri"), digest, size, page,
                                 body if with_payload else None))
                cols = list(zip(*rows)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)
    return run


def read_records(spark, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of every archive under ``path``; response payloads
    are checked against their digest, and kept only if asked for."""
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")
    return files.mapInArrow(_parse_files(with_payload), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its request, its response or revisit, its
    metadata (joined through concurrent-to), and for a revisit the capture it
    refers to. Captures without request or metadata keep nulls there."""
    caps = records.where(F.col("type").isin("response", "revisit"))
    tied = records.where(F.col("concurrent_to").isNotNull())
    request = tied.where("type = 'request'").select(
        F.col("concurrent_to").alias("record_id"), F.struct("record_id", "target_uri").alias("request"))
    meta = tied.where("type = 'metadata'").select(
        F.col("concurrent_to").alias("record_id"), F.struct("record_id", "page_id", "payload_bytes").alias("metadata"))
    whole = (caps.select("record_id", F.struct("type", "target_uri", "digest", "payload_bytes", "payload",
                                               "refers_to").alias("response"))
             .join(meta, "record_id", "left").join(request, "record_id", "left"))
    originals = whole.where("response.type = 'response'").select(
        F.col("record_id").alias("original_id"), F.struct(F.col("metadata.page_id").alias("page_id"),
                                                          F.col("response.payload_bytes").alias("payload_bytes"),
                                                          F.col("response.digest").alias("digest")).alias("original"))
    # a revisited page may be a third of all captures: the join is a plain one that AQE splits
    return whole.join(originals, whole["response.refers_to"] == originals["original_id"], "left").drop("original_id")


def op9_warc_transactions(spark, sf_dir):
    """Archive every page, read the archive back, one row per page."""
    path = write_captures(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    got = assemble(land(read_records(spark, path).drop("payload").withColumn("payload", F.lit(None).cast("binary")),
                        "warc-records"))
    return got.select(
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("response.payload_bytes", "original.payload_bytes").alias("payload_bytes"),
        F.coalesce("response.digest", "original.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("original.page_id").alias("refers_to"))


QUERIES = {"op9_warc_transactions": op9_warc_transactions}
SQL = {"op9_warc_transactions": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM p),
d AS (SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('{BASE32}',
    (1 + ((('0x' || substr(hex, (1 + 10 * (i // 8))::INT, 10))::UBIGINT >> (35 - 5 * (i % 8))::UBIGINT)
      & 31::UBIGINT))::INT, 1)), 'string_agg', '') AS payload_digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f"""}
