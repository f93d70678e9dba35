"""Content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256; the exact record headers are
kept apart, one row per record. Original records come back by joining the two.
The digest is verified when the archive is read: payloads are hashed again and must
match their address, and a record's Content-Length must be that of its block.

Layout of an archive folder: ``payloads/`` (digest, n_bytes, payload) and
``headers/`` (page_id, digest, head), both Parquet.

Edge cases: null or empty html is an empty payload (its records are all
responses); a null url gives no WARC-Target-URI line, line breaks in a url are
percent-encoded; a null page_id is written as ``<urn:page:none>`` and never chosen
while another id has the payload; rows that repeat the smallest page_id are all
responses; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.llm.common import staged
from tillpoint.operators.rank import keep_first

CRLF = "\r\n"
LANE_RECORDS = 4096  # records of one payload that are rebuilt side by side
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """``Name: value`` CRLF, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _head(date: str) -> Column:
    """The exact header block of a record, up to and including its empty line."""
    revisit = F.col("record_type") == "revisit"
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to")))),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes")).cast("string")),
        F.lit(CRLF))


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 100,
                  date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id",
                  url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per row of ``pages`` to the archive folder ``path``.

    Payload store: the row with the smallest id of each digest is kept by a window
    whose partial top-1 runs before the shuffle, so a payload that a third of all
    pages share reaches its owner once per map task. Headers: the first id per
    digest is a map-side aggregate; header rows carry no payload."""
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    src = (src.withColumn("digest", F.sha2("payload", 256))
              .withColumn("n_bytes", F.octet_length("payload").cast("long")))
    payloads = keep_first(src.select("digest", "n_bytes", "payload", "page_id"), ["digest"],
                          [F.col("page_id").asc_nulls_last()])
    payloads.drop("page_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")
    rows = src.select("page_id", "url", "digest", "n_bytes")
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    repeats = ((F.col("n_bytes") >= min_revisit_bytes) & F.col("first_id").isNotNull()
               & ~F.col("page_id").eqNullSafe(F.col("first_id")))
    heads = (rows.join(first, "digest")
             .withColumn("record_type", F.when(repeats, "revisit").otherwise("response"))
             .withColumn("refers_to", F.when(repeats, F.col("first_id")))
             .select("page_id", "digest", F.encode(_head(date), "UTF-8").alias("head")))
    heads.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")


def _field(name: str) -> Column:
    found = F.regexp_extract(F.col("head_text"), f"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    heads = spark.read.parquet(f"{path}/headers").select("head", F.decode("head", "UTF-8").alias("head_text"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return heads.select(
        "head", number(_field("WARC-Record-ID")).alias("page_id"), _field("WARC-Type").alias("record_type"),
        number(_field("WARC-Refers-To")).alias("refers_to"), _field("WARC-Target-URI").alias("url"),
        _field("Content-Length").try_cast("long").alias("content_length"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha256:", "").alias("digest"))


def _verified(value: Column, found_digest: Column, payload_bytes: Column) -> Column:
    """``value`` of a record whose payload has the digest its header names and whose
    Content-Length is that of its block (empty for revisits); any other fails the read."""
    block = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(payload_bytes)
    name = F.coalesce("digest", F.lit("(none)"))
    return (F.when(F.coalesce(found_digest != F.col("digest"), F.lit(True)),
                   F.raise_error(F.concat(F.lit("payload does not match its digest "), name)))
            .when(F.coalesce(F.col("content_length") != block, F.lit(True)),
                  F.raise_error(F.concat(F.lit("Content-Length does not match the block of "), name)))
            .otherwise(value))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record without its bytes: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest. Each stored payload is hashed again; a payload
    that does not match its address, or is missing, or whose size is not the record's
    Content-Length fails the read."""
    stored = spark.read.parquet(f"{path}/payloads").select(
        F.col("digest").alias("_address"), F.sha2("payload", 256).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"))
    parsed = _parsed(spark, path).drop("head")
    joined = parsed.join(stored, parsed["digest"] == stored["_address"], "left")
    checked = _verified(F.col("payload_digest"), F.col("payload_digest"), F.col("payload_bytes"))
    return joined.select("page_id", "url", "record_type", "refers_to", "payload_bytes",
                         checked.alias("payload_digest"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The reconstructed records: page_id, record_type, refers_to, payload (resolved for
    revisits too), its payload_digest and ``record``, the exact bytes of the WARC record.
    Checked as in ``read_index``; a stored payload is hashed once, however many records it has.
    The records of a digest are dealt over lanes of about ``LANE_RECORDS``, with a copy of the
    payload for each: no task rebuilds all records of one payload."""
    parsed = _parsed(spark, path)
    counts = parsed.groupBy("digest").agg(F.ceil(F.count(F.lit(1)) / LANE_RECORDS).cast("int").alias("lanes"))
    # Payloads with several lanes, at most one in LANE_RECORDS records. Written, so its size is known:
    # Catalyst broadcasts it if small, and payloads are then exchanged once.
    hot = staged(counts.filter("lanes > 1"), "hot-payloads")
    stored = spark.read.parquet(f"{path}/payloads").select(
        "digest", "payload", F.sha2("payload", 256).alias("found"), F.octet_length("payload").cast("long").alias("n_bytes"))
    lanes = F.coalesce("lanes", F.lit(1))
    copies = (stored.join(hot, "digest", "left")
              .withColumn("lane", F.explode(F.sequence(F.lit(0), lanes - 1))).drop("lanes"))
    dealt = (parsed.join(hot, "digest", "left")
             .withColumn("lane", F.pmod(F.xxhash64("page_id", "url"), lanes).cast("int")).drop("lanes"))
    end = F.encode(F.lit(CRLF + CRLF), "UTF-8")
    body = F.when(F.col("record_type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    checked = _verified(F.col("digest"), F.col("found"), F.col("n_bytes"))
    return (dealt.join(copies, ["digest", "lane"], "left")
            .select("page_id", "record_type", "refers_to", "payload", checked.alias("payload_digest"),
                    F.concat("head", body, end).alias("record")))
