"""Content-addressed WARC archive.

An archive is a folder with two tables. ``payloads`` holds every distinct payload
once, under its SHA-256. ``records`` holds the exact header bytes of one WARC/1.1
record for each page: the WARC header and that of the HTTP message. The original records
come back by a join on the digest.

Of pages with equal payloads of at least ``revisit_bytes`` the one with the smallest
page_id is written as ``response``; the others are ``revisit`` records, whose block is the HTTP header
only and which refer to it. Smaller payloads are always ``response``.

Payload bytes are shuffled only for digests that may occur more than once, and then after each task has
reduced its own copies to one. Which these are, each task knows from a list of slots of digests, of which there
are SLOTS at most; with many more shared digests than slots, single payloads are shuffled too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemosea.llm._common import materialise, read_table, shared_folder

#: Fixed values of the WARC/1.1 format.
VERSION = "WARC/1.1"
HTTP_STATUS = "HTTP/1.1 200 OK"
MEDIA_TYPE = "application/http; msgtype=response"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of records whose pages say none.
DATE = "2024-01-01T00:00:00Z"
#: Slots of digests that may occur more than once: at most so many numbers are broadcast.
SLOTS = 1 << 18


def _payload() -> Column:
    return F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))


def _record_id(page_id: Column, row: Column) -> Column:
    """An id for each record, also for rows that repeat a page_id."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), row.cast("string"), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """One header line, none for a null; line breaks in a value are percent-encoded."""
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def write_archive(pages: DataFrame, path: str, *, revisit_bytes: int = 100, date: str = DATE) -> str:
    """Write the archive of ``pages`` (page_id, url, html; other columns don't matter).

    A null html is an empty payload, a null url leaves out its header line. Rows that
    repeat the smallest page_id with the same payload are all responses; so are the
    copies of a payload all of whose page_ids are null. A null page_id beside others
    revisits. An empty table gives an archive without records.
    """
    narrow = pages.select("page_id", "url", F.sha2(_payload(), 256).alias("digest"), F.octet_length(_payload()).cast("long").alias("n"), F.monotonically_increasing_id().alias("row"))
    narrow = materialise(narrow, "warc-pages")
    owner = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row")))
    groups = narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), owner.alias("owner"), F.max("n").alias("most"), F.min("n").alias("least"))
    shared = groups.filter("copies > 1").select(F.col("digest").alias("twin"), "owner", F.assert_true(F.col("most") == F.col("least"), "two payload lengths under one digest").isNull().alias("sound"))
    shared = materialise(shared, "warc-shared")

    rows = narrow.join(shared, narrow["digest"] == shared["twin"], "left")
    revisit = (F.col("n") >= revisit_bytes) & F.col("owner.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner.page_id"))
    http = F.concat(F.lit(f"{HTTP_STATUS}\r\n"), _field("Content-Type", F.lit("text/html; charset=utf-8")), _field("Content-Length", F.col("n").cast("string")), F.lit("\r\n"))
    common = [
        _field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("row"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _field("Content-Type", F.lit(MEDIA_TYPE)),
    ]
    length = lambda n: _field("Content-Length", n.cast("string"))
    kept = F.concat(F.lit(f"{VERSION}\r\n"), _field("WARC-Type", F.lit("response")), *common, length(F.length("http") + F.col("n")))
    again = F.concat(
        F.lit(f"{VERSION}\r\n"), _field("WARC-Type", F.lit("revisit")), *common, _field("WARC-Profile", F.lit(REVISIT_PROFILE)),
        _field("WARC-Refers-To", _record_id(F.col("owner.page_id"), F.col("owner.row"))), length(F.length("http")),
    )
    rows = rows.withColumn("http", http)
    header = F.encode(F.concat(F.when(revisit, again).otherwise(kept), F.lit("\r\n"), F.col("http")), "UTF-8")
    rows.select("page_id", header.alias("header"), "digest").write.parquet(f"{path}/records")

    slots = F.broadcast(shared.select(slot_of(F.col("twin")).alias("slot")).distinct())  # SLOTS rows at most
    stored = pages.select(F.sha2(_payload(), 256).alias("digest"), _payload().alias("payload")).withColumn("slot", slot_of(F.col("digest")))
    single = stored.join(slots, "slot", "left_anti").select("digest", "payload")
    several = stored.join(slots, "slot", "left_semi").groupBy("digest").agg(F.first("payload").alias("payload"))
    single.unionByName(several).write.parquet(f"{path}/payloads")
    return path


def slot_of(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(SLOTS))


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header rows with the fields read from the header bytes, and payloads whose bytes
    still have their digest; others end the job."""
    text = F.decode(F.col("header"), "UTF-8")
    field = lambda name: F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))
    page = lambda name: F.try_to_number(F.nullif(F.regexp_extract(text, rf"\r\n{name}: <urn:page:([^:>]*):[0-9]+>\r\n", 1), F.lit("none")), F.lit("S9999999999999999999")).cast("long")
    records = spark.read.schema("page_id long, header binary, digest string").parquet(f"{path}/records")
    records = records.select(
        page("WARC-Record-ID").alias("page_id"), field("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("digest"), "header",
    )
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    seen = F.sha2("payload", 256)
    payloads = payloads.select(F.when(seen == F.col("digest"), seen).otherwise(F.raise_error(F.lit("a stored payload does not have its digest"))).alias("stored_digest"), "payload")
    return records, payloads


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record,
    the first two figures taken from the stored payload. Payloads stay where they are read."""
    records, payloads = _tables(spark, path)
    found = payloads.select("stored_digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    rows = records.drop("header").join(found, F.col("digest") == F.col("stored_digest"))
    return rows.select("page_id", "payload_bytes", F.col("stored_digest").alias("payload_digest"), "record_type", "refers_to")


def reconstruct(spark: SparkSession, path: str, *, full: bool = False) -> DataFrame:
    """page_id and the record's bytes as a WARC file holds them. With ``full`` a revisit
    too comes with the payload that it refers to."""
    records, payloads = _tables(spark, path)
    rows = records.join(payloads, F.col("digest") == F.col("stored_digest"))
    block = F.col("payload") if full else F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return rows.select("page_id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def op10_warc(spark, sf_dir):
    """All pages archived, then read back."""
    import uuid

    path = f"{shared_folder(spark)}/llm-warc-{uuid.uuid4().hex}"
    return read_index(spark, write_archive(read_table(spark, sf_dir, "pages"), path))


SQL_OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS owner FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM owner AND owner IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM m
"""
