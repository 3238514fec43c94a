"""Content-addressed WARC archive.

Two tables make an archive: ``payloads`` holds each distinct payload once, under its SHA-256, and ``headers`` holds the
exact header block of every record. Records are rebuilt by joining both on the digest; digests are verified on reading.

Of records with equal payloads of at least MIN_REVISIT bytes, the one with the smallest page_id is the response and the
others revisit it; smaller payloads are all responses.

Defined cases: a null html is an empty payload; a null url is an empty target; line breaks in a url are percent-encoded;
rows that repeat the response's page_id and payload are responses too; null page_ids are never responses to others unless
no other has the payload; an empty table gives an empty archive; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fewer, new_path

MIN_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def _header(date: str) -> Column:
    """The exact header block of a record, from page_id, url, digest, n and first."""
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("revisit")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _id(F.col("page_id"))),
        line("WARC-Target-URI", url),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", _id(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit(CRLF),
    )


def write(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, date: str = DATE) -> None:
    """Write the archive of pages (page_id, url, html) as the tables headers and payloads under path."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    narrow = pages.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n"))
    # pre-aggregated before the shuffle, however many copies a payload has; the join's hot keys can be split
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"))
    revisit = (F.col("n") >= min_revisit) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    fewer(narrow.join(first, "digest").withColumn("revisit", revisit).select("page_id", "digest", _header(date).alias("header"))).write.parquet(f"{path}/headers")
    # the page that stands for a payload is known before payloads move: each goes to its own key, however many copies there are
    known, page = F.col("page_id").isNotNull(), F.coalesce("page_id", F.lit(0).cast("long"))
    whole = pages.select(F.sha2("payload", 256).alias("digest"), known.alias("known"), page.alias("page"), "payload")
    elected = first.select("digest", F.col("first").isNotNull().alias("known"), F.coalesce("first", F.lit(0).cast("long")).alias("page"))
    keys = ["digest", "known", "page"]
    # rows that repeat a page_id and its payload stay together, and one of them is kept
    once = F.row_number().over(Window.partitionBy(*keys).orderBy("digest"))
    whole.join(elected, keys).withColumn("once", once).where("once = 1").select("digest", "payload").write.parquet(f"{path}/payloads")


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    headers = spark.read.schema("page_id bigint, digest string, header string").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    # the digest of what is read must be the key it is stored under
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "digest")))
    return headers, payloads.select("digest", checked.alias("payload"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """page_id and the exact bytes of each record, rebuilt: header, block (none for revisits) and two line ends."""
    headers, payloads = _tables(spark, path)
    block = F.when(_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return headers.join(payloads, "digest").select("page_id", F.concat(F.encode("header", "UTF-8"), block, F.lit((CRLF * 2).encode())).alias("record"))


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def _page(value: Column) -> Column:
    return F.regexp_extract(value, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per record, from its header and the payload it stands for: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest are taken from each stored payload before the join, which so moves no payload.
    """
    headers, payloads = _tables(spark, path)
    measured = payloads.select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    parsed = headers.select(
        _page(_field("WARC-Record-ID")).alias("page_id"), _field("WARC-Type").alias("record_type"),
        _page(_field("WARC-Refers-To")).alias("refers_to"), F.regexp_extract(_field("WARC-Payload-Digest"), "^sha256:(.*)$", 1).alias("digest"),
    )
    return fewer(parsed.join(measured, "digest").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write an archive of pages to the shared folder and read it back."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)


def export(spark: SparkSession, path: str, out: str) -> None:
    """Plain WARC files: one record after another, each closed by the two line ends of the format."""
    headers, payloads = _tables(spark, path)
    block = F.when(_field("WARC-Type") == "revisit", F.lit("")).otherwise(F.decode("payload", "UTF-8"))
    headers.join(payloads, "digest").select(F.concat("header", block).alias("value")).write.option("lineSep", CRLF * 2).text(out)
