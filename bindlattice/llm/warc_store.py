"""A content-addressed web archive: payloads once by digest, record headers apart.

Writing
    1. Every page gets the SHA-256 of its payload, which is its address, the SHA-1
       that its record states, and its length; the narrow table of these is written.
    2. Per payload, the copies are counted and the largest id found: first per payload
       and salt, then per payload over at most SALTS partial rows.  A payload of at
       least ``least_bytes`` makes that id's record a response and the others revisits
       of it; shorter ones are responses all.
    3. ``records`` holds the exact header of each WARC record, its payload's address
       and a share: records of a payload with many copies are dealt to shares of about
       SHARE records.  ``payloads`` holds the bytes of each distinct payload once.
Reading
    Payloads are hashed anew and must have their address; records take them, or what
    was found of them, by an equi-join on address and share, so copies of one payload
    never meet in one task.  What a record is comes from its header.

Payloads of one SHA-256 must agree in SHA-1 and length when they are written, and
every payload's bytes must give its address when they are read; anything else stops
the job.

Defined results: a null payload counts as empty; a null id is the smallest, and its
record's name ends in "null"; all records of the largest id of a payload are
responses; rows repeat as often as the table holds them; a null address is left out of
the header, and line ends in one are percent-encoded; payloads of any length are
kept whole; an empty table gives an empty archive; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindlattice.llm.common import new_folder, quoted, read, stage

LEAST_BYTES = 1000
#: Partial rows of one payload, at most, and records of one payload in one share, about.
SALTS, SHARE = 256, 1000

# Names of the WARC format.
_VERSION = "WARC/1.1"
_PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
_NAME = "urn:x-page:"

_RECORDS = "page_id long, header binary, http binary, address binary, share long"
_PAYLOADS = "address binary, copies long, payload binary"


def _named(column: Column) -> Column:
    return F.concat(F.lit(f"<{_NAME}"), F.coalesce(column.cast("string"), F.lit("null")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, null where the value is."""
    return F.concat(F.lit(f"{name}: "), value)


def _headers(kind: Column, date: str) -> tuple[Column, Column]:
    """The header of a WARC record, the empty line after it included, and that of the HTTP message in it."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    revisit = kind == "revisit"
    size = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat_ws(
        "\r\n", F.lit(_VERSION), _line("WARC-Type", kind), _line("WARC-Record-ID", _named(F.col("page_id"))), F.lit(f"WARC-Date: {date}"), _line("WARC-Target-URI", uri),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), F.when(revisit, F.lit(f"WARC-Profile: {_PROFILE}")),
        F.when(revisit, _line("WARC-Refers-To", _named(F.col("largest")))), F.lit("Content-Type: application/http;msgtype=response"), _line("Content-Length", size.cast("string")), F.lit("\r\n"),
    )
    return header.cast("binary"), http.cast("binary")


def _share(copies: Column) -> Column:
    return F.ceil(copies / SHARE)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the tables records and payloads of an archive under ``path``."""
    payload = F.coalesce(quoted(payload_col).cast("binary"), F.lit(b""))
    address = F.unhex(F.sha2(payload, 256)).alias("address")
    facts = [address, F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes")]
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).alias("salt")
    rows = stage(pages.select(quoted(id_col).cast("long").alias("page_id"), quoted(url_col).cast("string").alias("url"), *facts, salt), "pages")
    some = rows.groupBy("address", "salt").agg(F.count("*").alias("n"), F.max("page_id").alias("most"))
    alike = Window.partitionBy("address")
    whole = some.select("address", "salt", F.sum("n").over(alike).alias("copies"), F.max("most").over(alike).alias("largest"))
    told = rows.join(whole, ["address", "salt"])
    follows = (F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("largest"))
    header, http = _headers(F.when(follows, "revisit").otherwise("response"), date)
    share = F.pmod(F.xxhash64(F.monotonically_increasing_id()), _share(F.col("copies"))).alias("share")
    told.select("page_id", header.alias("header"), http.alias("http"), "address", share).write.option("compression", "zstd").parquet(f"{path}/records")

    # Equal payloads meet in one task only as one row of each task that read some.
    once = pages.select(*facts, payload.alias("payload")).groupBy("address").agg(
        F.count("*").alias("copies"), F.first("payload").alias("payload"), F.min(F.struct("sha1", "bytes")).alias("low"), F.max(F.struct("sha1", "bytes")).alias("high")
    )
    sound = F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(F.raise_error(F.lit("payloads of one SHA-256 differ")).cast("binary"))
    once.select("address", "copies", sound.alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records, and payloads whose bytes gave their address."""
    stored = spark.read.schema(_PAYLOADS).parquet(f"{path}/payloads")
    found = F.unhex(F.sha2("payload", 256)) == F.col("address")
    checked = F.when(found, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.hex("address"))).cast("binary"))
    return spark.read.schema(_RECORDS).parquet(f"{path}/records"), stored.select("address", "copies", checked.alias("payload"))


def _joined(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """Each record with its payload's row; a payload is sent once to every share of its records."""
    shares = F.explode(F.sequence(F.lit(0).cast("long"), _share(F.col("copies")) - 1)).alias("share")
    return records.join(payloads.select("*", shares).drop("copies"), ["address", "share"]).drop("address", "share")


def _field(name: str) -> Column:
    """A field of the header; null where the header has none."""
    value = F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(value != "", value)


def _page(name: str) -> Column:
    return F.regexp_extract(_field(name), rf"{_NAME}(-?\d+)>", 1).try_cast("long")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record, from its header and its payload's bytes."""
    records, payloads = _tables(spark, path)
    facts = payloads.select("address", "copies", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    stated = F.substring_index(_field("WARC-Payload-Digest"), ":", -1)
    digest = F.when(stated == F.col("payload_digest"), stated).otherwise(F.raise_error(F.lit("a record states another digest than its payload has")).cast("string"))
    return _joined(records, facts).select(
        _page("WARC-Record-ID").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), _field("WARC-Type").alias("record_type"), _page("WARC-Refers-To").alias("refers_to"),
        _field("WARC-Target-URI").alias("target_uri"),
    )


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record (the exact bytes of the WARC record, without the two line ends after it) and payload (a revisit's too)."""
    record = F.concat("header", "http", F.when(_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload")))
    return _joined(*_tables(spark, path)).select("page_id", record.alias("record"), "payload")


def export_warc(spark: SparkSession, path: str, to: str) -> None:
    """Write the records as gzip-compressed WARC files, a file a task; payloads must be UTF-8."""
    lines = reconstruct(spark, path).select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(to)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    write_archive(read(spark, sf_dir, "pages"), f"{path}/archive")
    return read_archive(spark, f"{path}/archive").drop("target_uri")


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, html, CAST(strlen(html) AS BIGINT) AS size, max(page_id) OVER (PARTITION BY html) AS largest FROM p)
SELECT page_id, size AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN size >= 1000 AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= 1000 AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM r
"""
