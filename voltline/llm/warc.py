"""WARC archives: captures written as transactions of records, read back and assembled.

A capture is three records: the response (or a revisit of an equal payload), the request and the metadata, of which the last two
name the first by WARC-Concurrent-To. Archives are written by Spark's own text writer, whose line separator is the blank line that
ends a record, so a lost task leaves no half file. Payloads are never grouped: of equal payloads one copy for each task
moves, revisits are made from narrow rows. Reading streams the gzip files line by line and cuts records by
their Content-Length, so a worker holds one record and one batch, however long the file is. Records are then
joined by their identifiers; nothing relies on their order in the archives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# fixed values of WARC 1.1 and HTTP
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"

LEAST_REVISITED = 100  # bytes; shorter payloads are stored each time
DATE = "2024-01-01T00:00:00Z"
ROWS_AT_ONCE = 512

RECORD_SCHEMA = """type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string,
content_type string, payload_digest string, http_head string, payload_bytes bigint, payload_sha256 string, payload binary"""


def _record_id(*parts: F.Column) -> F.Column:
    """A URN that depends on ``parts`` alone, so that a repeated task names its records alike."""
    h = F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts], *[p.isNull().cast("string") for p in parts])), 256)
    version = F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
    return F.concat(F.lit("<urn:uuid:"), version, F.lit(">"))


def _header_value(column: F.Column) -> F.Column:
    """``column`` fit for one header line: blanks and control characters percent-encoded."""
    plain = F.regexp_replace(column, r"[^\x20-\x7E]| ", "_")
    return F.when(column == plain, column).otherwise(F.regexp_replace(F.regexp_replace(F.url_encode(column), "%2F", "/"), "%3A", ":"))


def _record(kind: str, headers: list[tuple[str, F.Column | str | None]], block: F.Column) -> F.Column:
    """A record's bytes without the blank lines that end it; headers whose value is null are left out."""
    lines = [F.lit(f"{VERSION}{EOL}WARC-Type: {kind}{EOL}")]
    for name, value in headers:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(EOL)), F.lit("")))
    block = block.cast("binary")
    head = F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(EOL + EOL))
    return F.concat(head.cast("binary"), block)


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """(stored, revisits): captures that carry their payload (id, url, digest, n, copy, payload) and those that name another (with first_id, first_url)."""
    payload = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload").cast("bigint")})
    long = F.col("n") >= LEAST_REVISITED
    place = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("id"), F.col("url").isNull().alias("b"), F.col("url").alias("url"))
    first = F.min(place).alias("first")
    # the digest, not the payload, is the key: equal payloads meet once for each task before they move
    stored = rows.where(long).groupBy("digest").agg(first, F.any_value("payload").alias("payload"))
    stored = stored.select("first.id", "first.url", "digest", F.octet_length("payload").cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("copy"), "payload")
    narrow = rows.where(long).groupBy("id", "url", "digest").count()
    firsts, _ = common.written(rows.where(long).groupBy("digest").agg(first), "first-captures")
    again = narrow.join(firsts, "digest")
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & F.col("url").eqNullSafe(F.col("first.url"))
    revisits = again.withColumn("from", is_first.cast("bigint")).where(F.col("from") < F.col("count"))
    revisits = revisits.select("id", "url", "digest", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"), F.explode(F.sequence("from", F.col("count") - 1)).alias("copy"))
    short = rows.where(~long).groupBy("id", "url", "digest", "n", "payload").count()
    short = short.select("id", "url", "digest", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1)).alias("copy"), "payload")
    return stored.unionByName(short), revisits


def records(stored: DataFrame, revisits: DataFrame) -> DataFrame:
    """One row per record, ``record`` its bytes: three for each capture."""
    key = [F.col("digest"), F.col("id"), F.col("url"), F.col("copy")]
    main, asked, about = (_record_id(F.lit(kind), *key) for kind in ("capture", "request", "metadata"))
    uri = _header_value(F.col("url"))
    host = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    request = F.concat(F.lit("GET "), F.coalesce(F.when(path == "", F.lit("/")).otherwise(path), F.lit("/")), F.lit(f" HTTP/1.1{EOL}Host: "), F.coalesce(host, F.lit("")), F.lit(EOL + EOL))
    fields = F.concat(F.coalesce(F.concat(F.lit("capture-id: "), F.url_encode(F.col("id").cast("string")), F.lit(EOL)), F.lit("")), F.lit("copy: "), F.col("copy").cast("string"), F.lit(EOL))
    common_headers = [("WARC-Target-URI", uri), ("WARC-Date", DATE)]
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}"), F.lit(EOL))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    answer = [("WARC-Record-ID", main), *common_headers, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    others = [
        _record("request", [("WARC-Record-ID", asked), *common_headers, ("WARC-Concurrent-To", main), ("Content-Type", "application/http; msgtype=request")], request),
        _record("metadata", [("WARC-Record-ID", about), *common_headers, ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")], fields),
    ]
    response = _record("response", answer, F.concat(http.cast("binary"), F.col("payload")))
    first = _record_id(F.lit("capture"), F.col("digest"), F.col("first_id"), F.col("first_url"), F.lit(0).cast("bigint"))
    revisit = _record("revisit", [*answer, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", first), ("WARC-Refers-To-Target-URI", _header_value(F.col("first_url"))), ("WARC-Refers-To-Date", DATE)], http)
    return stored.select(F.explode(F.array(response, *others)).alias("record")).unionByName(revisits.select(F.explode(F.array(revisit, *others)).alias("record")))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> str:
    """Write ``pages`` as gzip WARC files under ``folder``; returns it. Each file is one gzip stream."""
    rows = records(*captures(pages, id_col, url_col, body_col))
    rows.select(F.col("record").cast("string")).write.option("lineSep", EOL + EOL).option("compression", "gzip").text(folder)
    return folder


class Parser:
    """Cuts a stream of lines into records by their Content-Length; bytes between records are skipped up to the next version line."""

    def __init__(self):
        self.head, self.block, self.missing = None, [], 0

    def feed(self, line: bytes) -> dict | None:
        """A finished record, if ``line`` (with its end) ends one."""
        if self.missing:
            self.block.append(line[: self.missing])
            self.missing -= len(self.block[-1])
            return self._finished() if not self.missing else None
        if self.head is None:
            if line.startswith(b"WARC/"):
                self.head = {}
            return None
        line = line.rstrip(b"\r\n")
        if line:
            name, _, value = line.partition(b":")
            self.head.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
            return None
        length = self.head.get("content-length", "")
        self.missing = int(length) if length.isdigit() else 0
        return self._finished() if not self.missing else None

    def _finished(self) -> dict:
        head, block = self.head, b"".join(self.block)
        self.head, self.block = None, []
        http, payload = None, block
        if head.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
            top, end, rest = block.partition(b"\r\n\r\n")
            http, payload = (top + end).decode("latin-1"), rest
        return {
            "type": head.get("warc-type"),
            "record_id": head.get("warc-record-id"),
            "concurrent_to": head.get("warc-concurrent-to"),
            "refers_to": head.get("warc-refers-to"),
            "target_uri": head.get("warc-target-uri"),
            "date": head.get("warc-date"),
            "content_type": head.get("content-type"),
            "payload_digest": head.get("warc-payload-digest"),
            "http_head": http,
            "payload_bytes": len(payload),
            "payload_sha256": hashlib.sha256(payload).hexdigest(),
            "payload": payload,
        }


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the gzip archives in ``folder``. A record that its file cuts short is left out; a folder without files gives an empty table.

    A gzip file is read by one task from start to end, so the lines of a file arrive in order; others may follow in the same task.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(common.BYTES_AT_ONCE))
    schema = "value string"
    lines = spark.read.schema(schema).option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(folder)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    names = [part.split()[0] for part in RECORD_SCHEMA.replace("\n", " ").split(", ")]
    types = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, parser, found, held = None, Parser(), [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, types)], names)

        for lines in batches:
            for name, line in zip(lines.column(0), lines.column(1)):
                if (name := name.as_py()) != file:
                    file, parser = name, Parser()
                record = parser.feed(line.as_py() + b"\n")
                if record is not None:
                    found.append(record)
                    held += record["payload_bytes"]
                    if len(found) >= ROWS_AT_ONCE or held >= common.BYTES_AT_ONCE:
                        yield batch()
                        found, held = [], 0
        if found:
            yield batch()

    return lines.mapInArrow(run, RECORD_SCHEMA)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id (its record's), capture, request, metadata, n_requests, n_metadata.

    Requests and metadata are joined through the identifier in their WARC-Concurrent-To. Of several of one kind
    the one with the least record id is nested and their number is stated; a capture without any has null there. Records of
    other kinds, and such as are concurrent to no capture of the table, have no row here. Records that repeat an
    identifier, as when an archive is listed twice, stay as they are. An empty table gives an empty table.
    """
    columns = [c for c in records.columns if c not in ("type", "record_id", "concurrent_to")]
    nested = F.struct("record_id", *columns)
    captures = records.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), F.struct("type", *columns).alias("capture"))

    def of(kind: str, count: str) -> DataFrame:
        mine = records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        return mine.groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min(nested).alias(kind), F.count("*").alias(count))

    found = captures.join(of("request", "n_requests"), "capture_id", "left").join(of("metadata", "n_metadata"), "capture_id", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ("n_requests", "n_metadata")}
    return found.withColumns(zero)


def _field(block: F.Column, name: str) -> F.Column:
    """A field of a block of ``name: value`` lines, null if it is missing."""
    found = F.regexp_extract(block.cast("string"), rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(block.cast("string").rlike(rf"(?m)^{name}: "), found)


def archived_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``pages`` written to WARC archives under ``folder`` and read back, a row each:

    id, payload_bytes and payload_digest (of the full payload, for a revisit of the one that it refers to), record_type, refers_to, request.
    Null bodies are empty payloads; bytes are kept as they are. Of payloads equal in at least LEAST_REVISITED bytes the row with the least
    id (null last, then the least url) is the response, one of them where rows repeat both; the rest are revisits. Null ids
    come back as null, null urls leave their header out, blanks and control characters of a url are percent-encoded.
    Further columns are ignored; an empty table gives an empty table.
    """
    spark = pages.sparkSession
    id_type = pages.select(F.col(id_col)).schema[0].dataType.simpleString()
    write_archives(pages, folder, id_col, url_col, body_col)
    thin = read_archives(spark, folder).where(F.col("type").isin("response", "revisit", "request", "metadata"))
    # only metadata needs its block here; what was measured while reading stands for the payloads
    thin = thin.withColumn("payload", F.when(F.col("type") == "metadata", F.col("payload")))
    table, _ = common.written(thin, "records")
    found = transactions(table).select(
        "capture_id",
        F.url_decode(_field(F.col("metadata.payload"), "capture-id")).cast(id_type).alias("id"),
        F.col("capture.type").alias("record_type"),
        F.col("capture.refers_to").alias("target"),
        F.col("capture.payload_bytes").alias("own_bytes"),
        F.col("capture.payload_sha256").alias("own_digest"),
        F.substring_index("request.http_head", EOL, 1).alias("request"),
    )
    found, _ = common.written(found, "transactions")
    responses = found.where("record_type = 'response'").select(F.col("capture_id").alias("target"), F.col("id").alias("first_id"), F.col("own_bytes").alias("first_bytes"), F.col("own_digest").alias("first_digest"))
    revisit = F.col("record_type") == "revisit"
    return found.join(responses, "target", "left").select(
        "id",
        F.when(revisit, F.col("first_bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("first_digest")).otherwise(F.col("own_digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit, F.col("first_id")).alias("refers_to"),
        "request",
    )


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), common.fresh_path(spark, "warc")).withColumnRenamed("id", "page_id")


OP12_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
     r AS (SELECT *, strlen(body) AS n,
                  CASE WHEN strlen(body) >= 100 THEN row_number() OVER (PARTITION BY body ORDER BY page_id, url) ELSE 1 END AS k,
                  first_value(page_id) OVER (PARTITION BY body ORDER BY page_id, url) AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(body) AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 THEN first_id END AS refers_to,
       'GET ' || CASE WHEN regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '') = '' THEN '/'
                      ELSE coalesce(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '/') END || ' HTTP/1.1' AS request
FROM r
"""
