"""Content-addressed WARC archive.

An archive is a folder of two Parquet tables: ``records`` has the exact header block of each record, and
``payloads`` has every distinct payload once under its SHA-256. Records are put together again by a join on
the digest; the digest and length of each stored payload are verified on the way.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.settings import materialize

#: Smaller payloads are never replaced by a reference.
MIN_REVISIT_BYTES = 100

# Fixed values of the format (ISO 28500).
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
END = "\r\n"


def _line(name: str, value: Column) -> Column:
    """A header line; line ends inside a value would end the header, so they are percent-encoded. No line for null."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(F.lit(f"{name}: "), safe, F.lit(END))


def _record_uri(row: Column) -> Column:
    """A stable URN of the row number, in the form of a UUID."""
    h = F.md5(row.cast("string"))
    parts = [F.substring(h, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(record: DataFrame) -> DataFrame:
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + END + "Content-Type: text/html; charset=utf-8" + END),
        _line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(END),
    )
    stored = F.length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    lines = [
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _record_uri(F.col("row"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, _record_uri(F.col("first.row")))),
        _line("X-Page-ID", F.col("page_id").cast("string")),
        _line("X-Refers-To-Page-ID", F.when(revisit, F.col("first.id").cast("string"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", stored.cast("string")),
    ]
    block = F.concat(F.lit(VERSION + END), *(F.coalesce(line, F.lit("")) for line in lines), F.lit(END), http)
    return record.withColumn("header", F.encode(block, "UTF-8"))


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES
) -> None:
    """Writes one record for each row of ``pages`` below ``path``.

    Of records with equal payloads of at least ``min_revisit_bytes`` the one with the smallest id (a null id comes
    last, repeated ids by position) is a response and the others revisit it. A null payload is empty, a null url
    leaves its header line out. Other columns are not read; an empty table gives an empty archive.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    rows = materialize(
        base.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "digest", F.octet_length("payload").cast("long").alias("payload_bytes")),
        "warc-rows",
    )
    order = F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id").alias("id"), F.col("row"))
    firsts = rows.filter(F.col("payload_bytes") >= min_revisit_bytes).groupBy("digest").agg(F.min(order).alias("first"))
    record = rows.join(firsts, "digest", "left").withColumn(
        "record_type", F.when(F.col("first.row") != F.col("row"), "revisit").otherwise("response")
    )
    _header(record).select("header", "digest", "payload_bytes", "record_type").write.option("compression", "zstd").parquet(os.path.join(path, "records"))
    # Equal bytes are combined in each task before the shuffle; grouping compares the bytes, not only the digest.
    base.groupBy("digest", "payload").agg(F.lit(1).alias("one")).select("digest", "payload").write.option("compression", "zstd").parquet(os.path.join(path, "payloads"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive: header (exact bytes), payload (whole, also for a revisit), and digest.

    Fails if a stored payload does not have its digest and length, if a payload is missing, or if two stored
    payloads share a digest.
    """
    records = spark.read.parquet(os.path.join(path, "records"))
    payloads = spark.read.parquet(os.path.join(path, "payloads"))
    if not payloads.groupBy("digest").count().filter("count > 1").isEmpty():
        raise ValueError("Two stored payloads have the same digest.")
    verified = payloads.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")))
    joined = records.join(verified, "digest", "left")
    whole = F.col("payload").isNotNull() & (F.octet_length("payload") == F.col("payload_bytes"))
    return joined.withColumn("payload", F.when(whole, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("Damaged payload "), F.col("digest"))).cast("binary")))


def record_bytes(records: DataFrame) -> DataFrame:
    """Adds ``record``: the bytes of the WARC record as it stands in a file."""
    body = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return records.withColumn("record", F.concat(F.col("header"), body, F.lit(END + END).cast("binary")))


def header_value(header: Column, name: str) -> Column:
    """Value of a line of the header block; null if there is none."""
    found = F.regexp_extract(F.decode(header, "UTF-8"), f"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def parsed(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """What the records of ``read_archive`` say of themselves; the payload is measured and hashed anew."""
    header = F.col("header")
    return records.select(
        header_value(header, "X-Page-ID").cast(id_type).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        header_value(header, "WARC-Type").alias("record_type"),
        header_value(header, "X-Refers-To-Page-ID").cast(id_type).alias("refers_to"),
        header_value(header, "WARC-Target-URI").alias("url"),
    )
