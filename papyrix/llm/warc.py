"""A content-addressed WARC archive: payload bytes once by digest, exact record headers apart, records by joins.

The archive is two tables: ``payloads`` (digest, payload, parts) and ``records`` (the record's exact header block, digest,
part). A record is its header block, its payload (none for a revisit) and two line ends. Reading verifies every stored
payload against its digest before it is joined to the headers, and takes all else out of the header blocks. A payload
that very many records share is joined in ``parts``, of PART_ROWS records or so each.

Defined results: a null html is an empty payload, a null url an empty target; control characters and spaces of
a url are percent-encoded in the target, each as itself, as a header line can't hold them; of several rows with the smallest page_id and equal payloads (repeated rows) each is a response, their payload stored once; a
null page_id comes after all others; an empty table gives an empty archive; other columns of pages are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 100  # bytes of a payload that a revisit record can stand for
UNFIT = (*range(33), 127)  # characters that a target is without
DATE = "2024-01-01T00:00:00Z"  # pages have no date of their own
SMALL_IDS = 100_000  # digests in a broadcast, at most: about 15 MB
PART_ROWS = 50_000  # records, about, that meet a shared payload in one place


def digests(pages: DataFrame) -> DataFrame:
    """pages with payload, bytes and digest; payload and digest are computed by the scan."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select("page_id", "url", body.alias("payload")).select("*", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def headers(rows: DataFrame) -> DataFrame:
    """The exact WARC and HTTP header block of each row of page_id, url, bytes, digest, part, record_type, refers_to."""
    clean = F.coalesce("url", F.lit(""))
    for c in UNFIT:
        clean = F.replace(clean, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    block = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", name(F.col("page_id"))), _line("WARC-Target-URI", clean),
        _line("WARC-Date", F.lit(DATE)), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), F.lit("Content-Type: application/http; msgtype=response\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), _line("WARC-Refers-To", name(F.col("refers_to"))))).otherwise(""),
        _line("Content-Length", length.cast("string")), F.lit("\r\n"), http,
    )
    return rows.select(F.encode(block, "UTF-8").alias("header"), "digest", "part")


def write(pages: DataFrame, out: str) -> None:
    """Write the archive of a table with page_id, url and html. Only digests are shuffled while repeated payloads are few."""
    whole = digests(pages)
    slim, at = common.stage(whole.select("page_id", "url", "bytes", "digest"), "digests")
    groups = slim.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"), F.first("bytes").alias("length"), F.min("bytes").alias("least"), F.max("bytes").alias("most"))
    shared, shared_at = common.stage(groups.where("n > 1"), "shared")
    shared = shared.withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int"))
    few = shared.count() <= SMALL_IDS
    shared_side = F.broadcast(shared) if few else shared
    if shared.where("least <> most").limit(1).count():
        raise ValueError("payloads of different lengths have one digest")
    typed = slim.join(shared_side.select("digest", "first_page", "parts"), "digest", "left").withColumn("_again", (F.col("bytes") >= LEAST) & F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page")))
    part = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1))).cast("int")
    typed = typed.select("page_id", "url", "bytes", "digest", part.alias("part"), F.when(F.col("_again"), "revisit").otherwise("response").alias("record_type"), F.when(F.col("_again"), F.col("first_page")).alias("refers_to"))
    headers(typed).write.option("compression", "zstd").parquet(f"{out}/records")
    alone = whole.select("digest", "payload").join(shared_side.select("digest"), "digest", "left_anti").withColumn("parts", F.lit(1))
    alone.write.option("compression", "zstd").parquet(f"{out}/payloads")
    again = whole.join(shared_side.select("digest", "first_page", "parts"), "digest").where(F.col("first_page").isNull() | (F.col("page_id") == F.col("first_page")))
    again.select("digest", "payload", "parts").dropDuplicates(["digest"]).write.mode("append").option("compression", "zstd").parquet(f"{out}/payloads")
    common.remove(pages.sparkSession, at)
    common.remove(pages.sparkSession, shared_at)


def read(spark, path: str) -> DataFrame:
    """The records: page_id, url, record_type, refers_to, digest, payload, payload_bytes, payload_digest, record (its bytes).

    payload_digest and payload_bytes are of the stored bytes, computed where they are scanned; a stored payload that
    does not have the digest it is stored under, or a header whose payload is missing, fails the read. A revisit's payload
    is null and its record the header block alone, so of a payload only the verified digest and length are sent to revisits:
    the bytes go to the one response, or to the parts of those of fewer than LEAST bytes.
    """
    kept = spark.read.parquet(f"{path}/payloads").select("digest", "payload", "parts", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    kept = kept.withColumn("payload_digest", F.when(F.col("payload_digest") == F.col("digest"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("payload damaged: "), "digest"))))
    text = F.decode("header", "UTF-8")
    of = lambda name: F.regexp_extract("text", rf"(?dm)^{name}: ([^\r\n]*)", 1)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    said = spark.read.parquet(f"{path}/records").withColumn("text", text).select(
        number(of("WARC-Record-ID")).alias("page_id"), of("WARC-Target-URI").alias("url"), of("WARC-Type").alias("record_type"), number(of("WARC-Refers-To")).alias("refers_to"),
        F.regexp_extract(of("WARC-Payload-Digest"), "^sha256:(.*)$", 1).alias("digest"), "header", "part",
    )
    # places: (digest, part, whether the bytes go there); a response of LEAST bytes or more is one, so it has part -1 of its own
    small = F.col("payload_bytes") < LEAST
    bodies = kept.select("digest", F.explode(F.when(small, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(-1)))).alias("at"), "payload", "payload_digest", "payload_bytes")
    slim = kept.where(~small).select("digest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("at"), F.lit(None).cast("binary").alias("payload"), "payload_digest", "payload_bytes")
    length = F.regexp_extract("header_text", r"Content-Length: (\d+)\r\n\r\n$", 1).cast("long")
    at = F.when((F.col("record_type") == "revisit") | (length < LEAST), F.col("part")).otherwise(-1)
    placed = said.withColumn("header_text", F.decode("header", "UTF-8")).withColumn("at", at).drop("header_text", "part")
    joined = placed.join(bodies.unionByName(slim), ["digest", "at"], "left")
    joined = joined.withColumn("payload_digest", F.when(F.col("payload_digest").isNotNull(), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("payload missing: "), "digest"))))
    record = F.concat("header", F.coalesce(F.col("payload"), F.encode(F.lit(""), "UTF-8")), F.encode(F.lit("\r\n\r\n"), "UTF-8"))
    return joined.select("page_id", "url", "record_type", "refers_to", "digest", "payload", "payload_bytes", "payload_digest", record.alias("record"))


def op5_warc_archive(spark, sf_dir: str) -> DataFrame:
    """The contract's columns and, of every record rebuilt by the joins, its number of bytes and its digest."""
    out = f"{common.shared_dir(spark)}/papyrix/warc-{uuid.uuid4().hex}"
    write(common.table(spark, sf_dir, "pages"), out)
    rows = read(spark, out)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_digest"))


_target = "coalesce(url, '')"
for _c in UNFIT[1:]:
    _target = f"replace({_target}, chr({_c}), '%{_c:02X}')"

ORACLE = rf"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, {_target} AS target FROM pages),
t AS (SELECT *, payload_bytes >= {LEAST} AND page_id <> min(page_id) OVER w AS again, min(page_id) OVER w AS first_page FROM p WINDOW w AS (PARTITION BY body)),
h AS (SELECT *, E'HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ' || payload_bytes || E'\r\n\r\n' AS http FROM t),
r AS (SELECT *, E'WARC/1.1\r\nWARC-Type: ' || CASE WHEN again THEN 'revisit' ELSE 'response' END || E'\r\nWARC-Record-ID: <urn:page:' || page_id || E'>\r\nWARC-Target-URI: ' || target || E'\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha256:' || payload_digest
  || E'\r\nContent-Type: application/http; msgtype=response\r\n' || CASE WHEN again THEN E'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:' || first_page || E'>\r\n' ELSE '' END
  || 'Content-Length: ' || (octet_length(encode(http)) + CASE WHEN again THEN 0 ELSE payload_bytes END) || E'\r\n\r\n' || http || CASE WHEN again THEN '' ELSE body END || E'\r\n\r\n' AS record FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_page END AS refers_to, octet_length(encode(record))::BIGINT AS record_bytes, sha256(record) AS record_digest FROM r
"""
