"""A content-addressed archive of WARC records.

Payload bytes are stored once under their SHA-256; the exact header of each record stands in a table of its own, and the original
record is made again by a join. The digest is verified when an archive is written (all payloads under one digest have one SHA-1
and one length) and when it is read (the stored bytes hash to their name).

Of records with equal payloads of at least ``REVISIT_FROM`` bytes, that with the largest page_id is the response and the others
revisit it; smaller payloads are always responses, stored once all the same.

A record's block is a plain HTTP head and, unless it revisits, the payload. Pages have no time of their own: all records of an
archive bear the date it is written with.

Defined results: a null html is an empty payload; a null url has no target header; white space and control characters in an address
are percent-encoded, since they would end its line; a null page_id is never the one that is
referred to, unless the payload is in no other record; rows with one page_id and payload are all responses if one is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm._spark import checkpoint_dir

REVISIT_FROM = 1000
CRLF = "\r\n"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html;charset=utf-8{CRLF * 2}"
EPOCH = "1970-01-01T00:00:00Z"


def _address(url: Column) -> Column:
    plain = url
    for i in (*range(33), 127):
        plain = F.replace(plain, F.lit(chr(i)), F.lit(f"%{i:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7f]"), plain).otherwise(url)


def _header(kind: Column, date: str) -> Column:
    """The record's header with the empty line that ends it, and the HTTP head."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    ident = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", ident),
        line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", _address(F.col("url")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("X-Payload-SHA256", F.col("sha256")),
        line("X-Payload-Length", F.col("n_bytes").cast("string")),
        F.when(kind == "revisit", line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers").cast("string"), F.lit(">")))).otherwise(F.lit("")),
        F.when(kind == "revisit", line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.when(kind == "revisit", F.lit(0)).otherwise(F.col("n_bytes")) + len(HTTP)).cast("string")),
        F.lit(CRLF + HTTP),
    )


def write_archive(pages: DataFrame, path: str, date: str = EPOCH) -> None:
    """Writes ``path``/payloads (sha256, body) and ``path``/headers (page_id, sha256, header)."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), body.alias("body"))
    named = named.withColumns({"sha256": F.sha2("body", 256), "sha1": F.sha1("body"), "n_bytes": F.octet_length("body").cast("long")})
    records = named.select("page_id", "url", "sha256", "sha1", "n_bytes")
    best = records.groupBy("sha256").agg(
        F.max("page_id").alias("best"), F.min("sha1").alias("_s0"), F.max("sha1").alias("_s1"), F.min("n_bytes").alias("_n0"), F.max("n_bytes").alias("_n1")
    )
    best = best.select("sha256", F.when((F.col("_s0") == F.col("_s1")) & (F.col("_n0") == F.col("_n1")), F.col("best")).otherwise(F.raise_error(F.lit("two payloads under one digest"))).alias("best"))
    again = (F.col("n_bytes") >= REVISIT_FROM) & F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    headers = records.join(best, "sha256").withColumn("refers", F.when(again, F.col("best"))).withColumn("kind", kind)
    headers.select("page_id", "sha256", _header(F.col("kind"), date).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    payloads = named.groupBy("sha256").agg(F.first("body").alias("body"))
    payloads.write.option("compression", "zstd").parquet(f"{path}/payloads")


def _field(name: str) -> Column:
    found = F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The header table with record_type and sha256, parsed from the headers themselves."""
    out = spark.read.schema("page_id long, sha256 string, header string").parquet(f"{path}/headers")
    return out.select("header", _field("WARC-Type").alias("record_type"), _field("X-Payload-SHA256").alias("sha256"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, body) with each body held against its name."""
    out = spark.read.schema("sha256 string, body binary").parquet(f"{path}/payloads")
    return out.select("sha256", F.when(F.sha2("body", 256) == F.col("sha256"), F.col("body")).otherwise(F.raise_error(F.lit("payload does not match its digest"))).alias("body"))


def reconstruct(spark: SparkSession, path: str, full: bool = False) -> DataFrame:
    """(header, record binary): the original records; a revisit's has no payload, unless ``full``."""
    headers = read_headers(spark, path)
    has = F.lit(True) if full else F.col("record_type") == "response"
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    with_body = headers.where(has).join(read_payloads(spark, path), "sha256").select("header", F.concat(F.encode("header", "UTF-8"), "body", end).alias("record"))
    without = headers.where(~has).select("header", F.concat(F.encode("header", "UTF-8"), end).alias("record"))
    return with_body.unionByName(without)


def parse(records: DataFrame) -> DataFrame:
    """(page_id, record_type, refers_to, sha256, named_bytes, named_sha1, payload) from the bytes of records."""
    text = records.select(F.col("record"), F.substring_index(F.decode("record", "UTF-8"), CRLF * 2, 1).alias("block"))
    out = text.select("record", F.concat("block", F.lit(CRLF)).alias("header"))
    start = F.octet_length("header") + 2 + len(HTTP)
    length = _field("Content-Length").cast("int") - len(HTTP)
    page = lambda name: F.expr("try_cast(nullif(regexp_extract(header, '(?m)^" + name + r": <urn:page:(-?[0-9]*)>', 1), '') AS bigint)")
    return out.select(
        page("WARC-Record-ID").alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        _field("X-Payload-SHA256").alias("sha256"),
        _field("X-Payload-Length").cast("long").alias("named_bytes"),
        F.regexp_extract("header", r"(?m)^WARC-Payload-Digest: sha1:([0-9a-f]+)", 1).alias("named_sha1"),
        F.substring(F.col("record"), start + 1, length).alias("payload"),
    )


def archive(pages: DataFrame) -> DataFrame:
    """Writes the archive in the shared folder, reads it back. Per page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Lengths and digests of responses are those of the payloads in the records made again; a revisit's are its response's, which its
    header must name.
    """
    import uuid

    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    parsed = parse(reconstruct(spark, path))
    sound = lambda n, d: F.when((n == F.col("named_bytes")) & (d == F.col("named_sha1")), True).otherwise(F.raise_error(F.lit("record does not match its header")))
    stored = read_payloads(spark, path).select("sha256", F.octet_length("body").cast("long").alias("n"), F.sha1("body").alias("d"))
    own = parsed.where("record_type = 'response'").select("*", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("d"))
    other = parsed.where("record_type = 'revisit'").join(stored, "sha256")
    names = ["page_id", "named_bytes", "named_sha1", "record_type", "refers_to", "n", "d"]
    every = own.select(*names).unionByName(other.select(*names))
    return every.where(sound(F.col("n"), F.col("d"))).select("page_id", F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to")


ORACLE = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, n AS payload_bytes, s AS payload_digest,
  CASE WHEN n >= {REVISIT_FROM} AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {REVISIT_FROM} AND page_id <> best THEN best END AS refers_to FROM d"""
