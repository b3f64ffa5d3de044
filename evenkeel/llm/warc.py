"""Content-addressed WARC archive.

Payload bytes are stored once by SHA-256 digest; the exact header of every record (WARC fields and HTTP head) is
kept in a table of its own; records are put together again by joins on the digest. Of records with
equal payloads of at least `least_revisit` bytes, the one with the least key is a response, the others
revisit it; shorter payloads are responses always.

An archive is a folder with `payloads` (digest, n_bytes, first, copies, payload) and `headers` (key, header, copies), both Parquet, and
`layout`, which says in how many buckets by digest the payloads lie. Readers shuffle headers to the buckets, so that a
payload is not moved again; records of a payload with more than `_HOT` of them are dealt over parts.

Null payloads are empty. A null URL leaves its field out; white space and control characters in URLs become
%20, so that no URL can forge a field. A null key is never referred to while the payload has
another. Rows that repeat the least key of a payload are all responses.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm.common import col

_LINE = "\r\n"
_HOT = 1024
_STORED = "digest string, n_bytes bigint, first bigint, copies bigint, payload binary"


@dataclass(frozen=True)
class WarcRules:
    least_revisit: int = 100
    date: str = "1970-01-01T00:00:00Z"


def _rows(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    body = F.coalesce(col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(col(key).cast("long").alias("key"), col(url).cast("string").alias("url"), body.alias("payload"))
    return rows.withColumn("digest", F.sha2("payload", 256))


def _header(rules: WarcRules) -> Column:
    revisit = F.col("first").isNotNull()
    http = F.concat_ws(
        _LINE, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.col("n_bytes")), F.lit(""), F.lit(""),
    )
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)  # null without a value, which concat_ws leaves out

    def urn(key: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), key, F.lit(">"))

    profile = F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return F.concat(
        F.concat_ws(
            _LINE,
            F.lit("WARC/1.1"),
            field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            field("WARC-Record-ID", urn(F.coalesce(F.col("key").cast("string"), F.lit("none")))),
            field("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")),
            field("WARC-Date", F.lit(rules.date)),
            field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            F.when(revisit, field("WARC-Refers-To", urn(F.col("first").cast("string")))),
            F.when(revisit, field("WARC-Profile", profile)),
            field("Content-Type", F.lit("application/http; msgtype=response")),
            field("Content-Length", block.cast("string")),
            F.lit(""),
            F.lit(""),
        ),
        http,
    )


def write(pages: DataFrame, path: str, rules: WarcRules = WarcRules(), key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write an archive of one record per row to the folder `path`, which must be new."""
    rows = _rows(pages, key, url, payload)
    # Copies meet map-side first, so that a payload of many rows is sent once per task at most. A second hash
    # tells payloads apart should their digests ever agree.
    stored = rows.groupBy("digest").agg(
        F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("payload").alias("payload"),
        F.min(F.xxhash64("payload")).alias("low"), F.max(F.xxhash64("payload")).alias("high"),
    )
    sound = F.assert_true(F.col("low") == F.col("high"), F.lit("two payloads have one digest"))
    stored = stored.select("digest", F.octet_length("payload").cast("long").alias("n_bytes"), "first", "copies", F.when(sound.isNull(), F.col("payload")).alias("payload"))
    spark = pages.sparkSession
    # As many buckets as the aggregate has partitions: its rows are where they belong, a file per bucket.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/layout")
    name = f"archive_{uuid.uuid4().hex}"
    stored.write.bucketBy(buckets, "digest").format("parquet").option("path", f"{path}/payloads").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files are the archive; the catalog forgets them
    index = spark.read.schema(_STORED).parquet(f"{path}/payloads").select("digest", "n_bytes", "first", "copies")
    records = rows.select("key", "url", "digest").join(index, "digest")
    target = F.when((F.col("n_bytes") >= rules.least_revisit) & ~F.col("key").eqNullSafe(F.col("first")), F.col("first"))
    records.withColumn("first", target).select("key", _header(rules).alias("header"), "copies").write.parquet(f"{path}/headers")


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"(?m)^{name}: (.*)$", 1), F.lit(""))


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/headers").select(
        "key",
        "header",
        "copies",
        _field("WARC-Type").alias("record_type"),
        F.regexp_extract(_field("WARC-Refers-To"), r"^<urn:page:(-?\d+)>$", 1).cast("long").alias("refers_to"),
        F.regexp_extract(_field("WARC-Payload-Digest"), r"^sha256:([0-9a-f]{64})$", 1).alias("digest"),
    )


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads as a table in buckets by digest."""
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    name = f"archive_{uuid.uuid4().hex}"
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({_STORED}) USING parquet CLUSTERED BY (digest) INTO {buckets} BUCKETS LOCATION '{place}/payloads'")
    stored = spark.table(name)
    stored.schema  # resolved, so that the name can go
    spark.sql(f"DROP TABLE {name}")
    return stored


def _verified(stored: DataFrame) -> DataFrame:
    """The payloads, each digest computed again from the bytes; bytes that don't match fail the job."""
    sound = F.assert_true(F.sha2("payload", 256) == F.col("digest"), F.lit("a stored payload doesn't match its digest"))
    return stored.select("digest", "copies", F.when(sound.isNull(), F.col("payload")).alias("payload"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """(key, record_type, refers_to, payload_digest, payload_bytes) of every record, from the header
    and the verified payload that its digest names. Only lengths cross the join."""
    sizes = _verified(_payloads(spark, path)).select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    return _parsed(spark, path).join(sizes, "digest").select("key", "record_type", "refers_to", F.col("digest").alias("payload_digest"), "payload_bytes")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(key, record_type, refers_to, payload, record, header_bytes): every record's full payload, its exact
    bytes as in a WARC file, without the blank lines that end it, and how many of them are its header."""
    heads, stored = _parsed(spark, path), _verified(_payloads(spark, path))
    few = heads.where(F.col("copies") <= _HOT).join(stored.drop("copies").hint("merge"), "digest")
    # A payload of many records goes to as many tasks as it has parts of `_HOT`.
    parts = F.ceil(F.col("copies") / _HOT).cast("int")
    dealt = heads.where(F.col("copies") > _HOT).withColumn("part", F.pmod(F.xxhash64("key", "header"), parts).cast("int"))
    spread = stored.where(F.col("copies") > _HOT).select("digest", "payload", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    many = dealt.join(spread, ["digest", "part"])

    def whole(joined: DataFrame) -> DataFrame:
        body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
        record = F.concat(F.col("header").cast("binary"), body)
        return joined.select("key", "record_type", "refers_to", "payload", record.alias("record"), F.octet_length("header").alias("header_bytes"))

    return whole(few).union(whole(many))


def export(spark: SparkSession, path: str, out: str) -> None:
    """Write the records of an archive as gzipped WARC files."""
    # The writer passes the bytes of strings on as they are; the separator is what ends a record.
    rows = records(spark, path).select(F.col("record").cast("string").alias("value"))
    rows.write.option("lineSep", _LINE * 2).option("compression", "gzip").text(out)


def parse(spark: SparkSession, files: str) -> DataFrame:
    """(file, position, header, payload) of the records in uncompressed or gzipped WARC files; the
    header includes the HTTP head. A file is read by one task."""
    rows = spark.read.format("binaryFile").load(files).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                found, at = [], 0
                while at < len(data):
                    head = data.index(b"\r\n\r\n", at) + 4
                    fields = dict(line.split(b": ", 1) for line in data[at:head].split(b"\r\n")[1:] if line)
                    end = head + int(fields[b"Content-Length"])
                    split = data.index(b"\r\n\r\n", head, end) + 4 if b"application/http" in fields.get(b"Content-Type", b"") else head
                    found.append((data[at:split].decode(), data[split:end]))
                    at = end + 4
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array([h for h, _ in found], pa.string()), pa.array([p for _, p in found], pa.binary())],
                    ["file", "position", "header", "payload"],
                )

    return rows.mapInArrow(run, "file string, position long, header string, payload binary")
