"""Sharding by extendible hashing.

Each row has a pseudo-key of 60 bits. The directory starts as one bucket; a bucket of more than
`limit` bytes is split on its next bit, and only such a bucket. Sizes are counted for `_BLOCK` bits
at once, so that the usual table takes one pass over (pseudo-key, bytes); what is still too large goes on.
The directory is a table of one row per shard; rows find their shard in it by their own bits, one join per
depth that the directory has, and move once, to be written.

Rows that agree in all bits, such as very many rows of one key, go on by the bits of a second pseudo-key, made
from their place in a landed table of their own, so that no hot key exceeds a shard. A single row larger than
the limit is a shard of its own.

Null keys count as one key, null texts as no bytes. Rows that share a key are separate rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.common import col, free_name, landed

_BITS = 60
_BLOCK = 12
_FOUND = "struct<depth:int,prefix:bigint,shard_bytes:bigint,shard_rows:bigint>"


@dataclass(frozen=True)
class ShardRules:
    """A directory of at most `most_shipped` shards travels to the executors; a larger one is joined by shuffles."""

    limit: int = 1 << 20
    most_shipped: int = 1 << 18


def pseudo_key(value: Column) -> Column:
    """The first 60 bits of the MD5 of the value as text."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(key: str, depth: int) -> Column:
    return F.shiftright(key, _BITS - depth)


def _split(rows: DataFrame, rules: ShardRules, base: int, roots: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One block of bits of `key` below `base`, within each `group`.

    Gives the shards (group, depth, prefix, shard_bytes, shard_rows), the prefixes (group, prefix) of `base + _BLOCK` bits
    that are still too large, and the keys (group, key) that more bits can't split."""
    end = base + _BLOCK
    cells = rows.groupBy("group", _prefix("key", end).alias("cell")).agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")
    )
    depths = range(base if roots else base + 1, end + 1)
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("cell", end - d).alias("prefix")) for d in depths]))
    each = landed(cells, "shard-cells").select("group", at.alias("node"), "bytes", "n", "low", "high").select("group", "node.*", "bytes", "n", "low", "high")
    nodes = each.groupBy("group", "depth", "prefix").agg(
        F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    nodes = landed(nodes.withColumn("fits", (F.col("shard_bytes") <= rules.limit) | (F.col("shard_rows") == 1)), "shard-nodes")
    # A node that fits is a shard if the one above has been split; above the first bits of a later block all have.
    fit = nodes.where("fits").select("group", "depth", "prefix", "shard_bytes", "shard_rows")
    split = nodes.where("not fits").select("group", (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
    below = fit.withColumn("up", F.shiftright("prefix", 1)).join(split, ["group", "depth", "up"], "left_semi").drop("up")
    shards = landed(below.union(fit.where(F.col("depth") == depths[0])), "shards")
    large = nodes.where((F.col("depth") == end) & ~F.col("fits"))
    return shards, large.where("low < high").select("group", "prefix"), large.where("low = high").select("group", F.col("low").alias("key"))


def _directory(rows: DataFrame, rules: ShardRules, roots: bool) -> tuple[DataFrame, DataFrame | None]:
    """The shards of rows (group, key, bytes), and the keys whose rows are too large together."""
    shards, stuck, base = [], [], 0
    while True:
        found, open_, same = _split(rows, rules, base, roots and base == 0)
        shards.append(found)
        if not same.isEmpty():
            stuck.append(same)
        base += _BLOCK
        if base == _BITS or open_.isEmpty():
            return reduce(DataFrame.union, shards), reduce(DataFrame.union, stuck) if stuck else None
        rows = rows.withColumn("prefix", _prefix("key", base)).join(open_, ["group", "prefix"], "left_semi").drop("prefix")


def _placed(rows: DataFrame, directory: DataFrame, rules: ShardRules) -> DataFrame:
    """Adds `found`, the shard of each row (group, key, ...), null where the directory has none."""
    directory = landed(directory, "shard-directory")
    depths = {d: n for d, n in directory.groupBy("depth").count().collect()}  # 61 at most
    small = sum(depths.values()) <= rules.most_shipped
    found = []
    for d in sorted(depths):
        own = directory.where(F.col("depth") == d).select("group", F.col("prefix").alias("_prefix"), F.struct("depth", "prefix", "shard_bytes", "shard_rows").alias(f"_at{d}"))
        found.append(F.col(f"_at{d}"))
        # At most `most_shipped` rows of 40 bytes in all joins together.
        rows = rows.withColumn("_prefix", _prefix("key", d)).join(F.broadcast(own) if small else own, ["group", "_prefix"], "left").drop("_prefix")
    return rows.withColumn("found", F.coalesce(*found, F.lit(None).cast(_FOUND))).drop(*[f"_at{d}" for d in depths])


def _bits(prefix: Column, depth: Column) -> Column:
    text = F.lpad(F.conv(prefix.cast("string"), 10, 2), _BITS, "0")
    return F.substr(text, F.lit(_BITS + 1) - depth, depth)


def _assigned(docs: DataFrame, rules: ShardRules, key: str, text: str, whole: bool) -> list[DataFrame]:
    """(row, shard, depth, shard_bytes, shard_rows) for every row of `docs` in one or two parts; `row` is the row as a
    struct, or only its key."""
    size = F.coalesce(F.octet_length(col(text).cast("string")), F.lit(0)).cast("long")
    kept = F.struct("*") if whole else F.struct(col(key).alias("id"))
    rows = docs.select(kept.alias("row"), pseudo_key(col(key)).alias("key"), size.alias("bytes"), F.lit(0).cast("long").alias("group"))
    directory, stuck = _directory(rows.select("group", "key", "bytes"), rules, True)
    details = [F.col(f"found.{c}").alias(c) for c in ("depth", "shard_bytes", "shard_rows")]
    placed = _placed(rows.drop("bytes"), directory, rules).where("found is not null")
    parts = [placed.select("row", _bits(F.col("found.prefix"), F.col("found.depth")).alias("shard"), *details)]
    if stuck is not None:
        # Rows of the keys that are too large alone, in a table of their own, which gives each a place.
        rest = landed(rows.join(landed(stuck, "shard-stuck"), ["group", "key"], "left_semi"), "shard-rest")
        rest = rest.select("row", "bytes", F.col("key").alias("group"), pseudo_key(F.monotonically_increasing_id()).alias("key"))
        rest = landed(rest, "shard-second")
        directory, _ = _directory(rest.select("group", "key", "bytes"), rules, False)
        placed = _placed(rest.drop("bytes"), directory, rules)
        full = F.lpad(F.conv(F.col("group").cast("string"), 10, 2), _BITS, "0")
        shard = F.concat(full, F.lit("+"), _bits(F.col("found.prefix"), F.col("found.depth")))
        parts.append(placed.select("row", shard.alias("shard"), (details[0] + _BITS).alias("depth"), *details[1:]))
    return parts


def assigned(docs: DataFrame, rules: ShardRules, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, shard, depth, shard_bytes, shard_rows) for every row. `shard` is the prefix in binary
    digits; a plus parts the first pseudo-key's bits from the second's."""
    return reduce(DataFrame.union, _assigned(docs, rules, key, text, False)).select("row.id", "shard", "depth", "shard_bytes", "shard_rows")


def write(docs: DataFrame, path: str, rules: ShardRules, key: str = "doc_id", text: str = "text") -> None:
    """Write every row of `docs` as Parquet to the new folder `path`, a folder per shard."""
    name = free_name(docs, "shard")
    for part in _assigned(docs, rules, key, text, True):
        part.select("row.*", F.col("shard").alias(name)).repartition(name).write.mode("append").partitionBy(name).parquet(path)


def read(docs: DataFrame, path: str) -> DataFrame:
    """The rows that `write` has written of `docs`, with their shard as the last column."""
    name = free_name(docs, "shard")
    # The schema keeps shards strings; the empty one is a folder of its own kind, read as null.
    columns = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())])
    stored = docs.sparkSession.read.schema(columns).parquet(path)
    return stored.withColumn(name, F.coalesce(name, F.lit("")))
