"""WARC archives: writing pages as captures, reading them back, assembling transactions.

A page becomes three records: the response (or a revisit, if another page has the same
payload), its request and a metadata record with the page's id; the latter two name the
first in WARC-Concurrent-To.  Spark's text writer makes the files: a record is one value
and the line separator is the record separator.  Reading takes whole files of bounded
size, plain or gzipped (one member or many), and assembles captures by joining the three
kinds of records through the concurrent-to identifiers.

Edge cases: a null payload is empty; a null url is an empty target; a null page id is left
out of the metadata and read back as null; repeated rows give equal captures each; of
equal payloads all rows with the largest id are responses; an empty table gives an empty
archive and no captures; a payload of any length is one record, which a task holds whole
with the file that it lies in; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import bound_batches, if_small, materialise, new_path, text_or_empty

#: Bytes of records in a file, on average; one record may be larger.
FILE_BYTES = 16 << 20
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("record_id", "type", "concurrent_to", "refers_to", "uri", "date", "digest")]
    + [T.StructField("payload_bytes", T.LongType()), T.StructField("block", T.BinaryType()), T.StructField("payload", T.BinaryType())]
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_name(kind: str, page: str, digest: str, url: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{kind} {page} {digest} {url}'.encode('utf-8', 'replace')).digest(), version=5)}>"


def header_text(value: str) -> str:
    """A header value stays on its line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(fields: list[tuple[str, str]], block: str, size: int | None = None) -> str:
    head = "".join(f"{k}: {header_text(v)}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block.encode()) if size is None else size}\r\n\r\n{block}"


def page_records(page: str | None, url: str, payload: str | None, digest: str, first: tuple[str | None, str] | None) -> list[str]:
    """The three records of a page; `first` is the (page, url) that a revisit refers to."""
    name = record_name("capture", page or "", digest, url)
    common = [("WARC-Target-URI", url), ("WARC-Date", DATE)]
    host, _, rest = url.partition("://")[2].partition("/")
    if first is None:
        size = len(payload.encode())
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
        main = record([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")], head + payload, len(head) + size)
    else:
        to = record_name("capture", first[0] or "", digest, first[1])
        main = record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Refers-To", to), ("WARC-Refers-To-Target-URI", first[1]), ("WARC-Profile", REVISIT_PROFILE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")], "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    ask = record([("WARC-Type", "request"), ("WARC-Record-ID", record_name("request", page or "", digest, url)), *common, ("WARC-Concurrent-To", name), ("Content-Type", "application/http;msgtype=request")], f"GET /{header_text(rest)} HTTP/1.1\r\nHost: {header_text(host)}\r\n\r\n")
    about = record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_name("metadata", page or "", digest, url)), *common, ("WARC-Concurrent-To", name), ("Content-Type", "application/warc-fields")], "" if page is None else f"page-id: {page}\r\n")
    return [main, ask, about]


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_bytes: int = FILE_BYTES) -> None:
    """Write one capture per row of `pages` into gzipped WARC files under `path`.

    Of equal payloads of at least `min_bytes` bytes the one with the largest id is a
    response and the others are revisits of it; smaller ones are all responses.  The
    pages are not shuffled, only their digests are.
    """
    rows = pages.select(F.col(id_col).alias("id"), text_or_empty(url_col).alias("url"), text_or_empty(payload_col).alias("payload")).withColumn("sha", F.sha1("payload"))
    digests = rows.groupBy("sha").agg(F.max(F.struct("id", "url")).alias("first"), F.count("*").alias("n"), F.max(F.octet_length("payload")).alias("size"))
    digests = materialise(digests, "digests")
    n, size = digests.agg(F.sum("n"), F.sum(F.col("size") * F.col("n"))).first()
    shared = digests.where((F.col("n") > 1) & (F.col("size") >= min_bytes)).select("sha", "first")
    if shared.isEmpty():
        marked = rows.withColumn("first", F.lit(None).cast(digests.schema["first"].dataType))
    else:
        shared = materialise(shared, "shared")
        marked = rows.join(if_small(shared), "sha", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first.id").eqNullSafe(F.col("id"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, url, payload, sha, again, first_id, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                yield pa.RecordBatch.from_arrays([pa.array(page_records(page, url, payload, digest, (first_id, first_url) if again else None), pa.string())], names=["value"])

    narrow = marked.select(F.col("id").cast("string"), "url", F.when(~revisit, F.col("payload")).alias("payload"), "sha", revisit.alias("again"), F.col("first.id").cast("string").alias("first_id"), F.col("first.url").alias("first_url"))
    per_file = max(3, int(3 * file_bytes / (max(1, (size or 0) / max(1, n or 0)) + 1500)))
    bound_batches(pages.sparkSession)
    narrow.mapInArrow(records, "value string").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def inflated(data: bytes) -> bytes:
    """Gzipped bytes of one or more members, or plain bytes as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        out.append(one.decompress(data))
        data = one.unused_data
    return b"".join(out)


def parse_records(data: bytes, payloads: bool) -> Iterator[dict]:
    """The records of an archive's bytes; what is not a record ends the archive with an error."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.partition(b":")[::2] for line in data[at:end].split(b"\r\n")[1:])
        fields = {k.decode().lower(): v.strip().decode("utf-8", "replace") for k, v in fields.items()}
        begin = end + 4
        size = int(fields["content-length"])
        block = data[begin : begin + size]
        if len(block) < size:
            raise ValueError(f"the record at byte {at} is cut short")
        at = begin + size
        while data.startswith(b"\r\n", at):
            at += 2
        kind, payload = fields.get("warc-type"), None
        if kind == "response":
            payload = block[block.find(b"\r\n\r\n") + 4 :]
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if payload is not None and digest != base32_sha1(payload):
            digest = None  # the payload is not what was captured
        yield {
            "record_id": fields.get("warc-record-id"), "type": kind, "concurrent_to": fields.get("warc-concurrent-to"), "refers_to": fields.get("warc-refers-to"),
            "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "digest": digest,
            "payload_bytes": None if payload is None else len(payload), "block": None if kind == "response" else block, "payload": payload if payloads else None,
        }


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under `path` (schema RECORD), payloads on demand."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(RECORD)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                part: list[dict] = []
                for one in parse_records(inflated(content.as_py()), payloads):
                    part.append(one)
                    if len(part) == 500:
                        yield pa.RecordBatch.from_pylist(part, schema)
                        part = []
                yield pa.RecordBatch.from_pylist(part, schema)

    bound_batches(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit record.

    record_id, type, uri, date, digest, payload_bytes, refers_to, payload, and the structs
    `request` and `metadata` of the records concurrent to it (null where there is none).
    """
    main = records.where(F.col("type").isin("response", "revisit"))
    out = main.select("record_id", "type", "uri", "date", "digest", "payload_bytes", "refers_to", "payload")
    for kind in ("request", "metadata"):
        # of several such records to one capture the first by id counts
        side = records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min(F.struct(F.col("record_id").alias("id"), "uri", "date", "block")).alias(kind))
        out = out.join(side, "record_id", "left")
    return out


def warc_round_trip(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write `pages` as WARC, read the archives back, and return a row per capture:
    id, payload_bytes, payload_digest, record_type, refers_to (the response's id).

    A revisit holds no payload; its size comes from the response that it refers to.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path, min_bytes, id_col, url_col, payload_col)
    rows = captures(materialise(read_warc(spark, path, payloads=False), "records"))
    page = F.regexp_extract(F.decode("metadata.block", "UTF-8"), r"page-id: (.*)\r\n", 1)
    rows = rows.withColumn("page", F.when(page != "", page).cast(pages.schema[id_col].dataType))
    main = materialise(rows.select("record_id", "type", "digest", "payload_bytes", "refers_to", "page"), "captures")
    targets = main.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("page").alias("target"), F.max("payload_bytes").alias("target_bytes"))
    named = main.where("type = 'revisit'").select("refers_to").distinct()
    targets = materialise(targets.join(named, "refers_to", "left_semi"), "targets")
    return main.join(if_small(targets), "refers_to", "left").select(
        F.col("page").alias(id_col),
        F.coalesce("payload_bytes", "target_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(F.col("type") == "revisit", F.col("target")).alias("refers_to"),
    )
