"""One query per operator, over whole tables, and SQL for those that DuckDB can check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import alignment, centroids, decontaminate, licenses, pieces, quality, secrets, sharding, simhash, toxicity, urls, vectors, warc
from evenkeel.llm.common import new_folder, table


def piece_model() -> str:
    """The public 32k BPE model that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_model() -> str:
    """The public byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt without the held-out third."""
    rules, docs = toxicity.ToxicityRules(), table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    scored = toxicity.scored(docs, toxicity.fit(docs, labels, rules), rules).withColumnRenamed("id", "doc_id")
    return scored.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= rules.threshold).cast("int").alias("predicted"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, and read back from the archive."""
    path = new_folder(spark, "archive")
    warc.write(table(spark, sf_dir, "pages"), path)
    # A response's payload is what follows its header; a revisit's is that of the record it refers to.
    own = F.substr("record", F.col("header_bytes") + 1)
    payload = F.when(F.col("record_type") == "response", own).otherwise(F.col("payload"))
    return warc.records(spark, path).select(
        F.col("key").alias("page_id"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"), "record_type", "refers_to"
    )


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest,
         octet_length(encode(coalesce(html, ''))) AS payload_bytes
  FROM pages
), q AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
"""


SHARDS = sharding.ShardRules(limit=1 << 20)


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to its shard; shards and their sizes as read back."""
    docs, path = table(spark, sf_dir, "documents"), new_folder(spark, "shards")
    sharding.write(docs, path, SHARDS)
    stored = sharding.read(docs, path).select("doc_id", "shard", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    sizes = stored.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
    depth = F.length(F.replace("shard", F.lit("+"), F.lit("")))
    return stored.join(sizes, "shard").select("doc_id", "shard", depth.alias("depth"), "shard_bytes", "shard_rows")


# Ids are unique in the given tables, so that no shard needs the second pseudo-key.
OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, octet_length(encode(text)) AS bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS key
  FROM documents
), each AS (
  SELECT doc_id, bytes, depth, key >> (60 - depth) AS prefix FROM d, (SELECT unnest(range(0, 31)) AS depth)
), sizes AS (
  SELECT depth, prefix, sum(bytes) AS shard_bytes, count(*) AS shard_rows FROM each GROUP BY depth, prefix
), fit AS (
  SELECT e.doc_id, e.depth, e.prefix, s.shard_bytes, s.shard_rows,
         row_number() OVER (PARTITION BY e.doc_id ORDER BY e.depth) AS k
  FROM each e JOIN sizes s USING (depth, prefix) WHERE s.shard_bytes <= {SHARDS.limit} OR s.shard_rows = 1
)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 60, '0'), depth) END AS shard,
       CAST(depth AS INTEGER) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows
FROM fit WHERE k = 1
"""


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: those of the patterns counted, all listed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit(docs, secrets.SecretRules()))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        F.col("id").alias("doc_id"),
        *[count(kind) for kind in ("assign", "access", "hex")],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("markov"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph that names a licence, with its family."""
    docs, rules = table(spark, sf_dir, "documents").select("doc_id", "text"), licenses.LicenseRules()
    return licenses.scan(docs, licenses.fit(docs, rules), rules).withColumnRenamed("id", "doc_id")


URL_RULES = urls.UrlRules(
    (
        urls.Rule("block", "net", "/"),
        urls.Rule("allow", "example.net", "/en/"),
        urls.Rule("block", "example.com", "/de/"),
        urls.Rule("allow", "org", "/fr/"),
    )
)


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    found = urls.judged(table(spark, sf_dir, "pages"), URL_RULES)
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text decoded from them, as digests."""
    name = pieces.ship(spark, piece_model())
    encoded = pieces.encode(table(spark, sf_dir, "documents").fillna("", "text"), name, decoded=True)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and the near-duplicate group of every document."""
    found = simhash.clusters(table(spark, sf_dir, "documents"), words=4, bits=4)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, with its best window."""
    docs, items = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return decontaminate.matches(docs, items, decontaminate.Decontamination()).withColumnRenamed("id", "doc_id")


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the labels call good."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, likelihood ratio and verdict of every document."""
    docs, rules = table(spark, sf_dir, "documents").select("doc_id", "text"), quality.QualityRules()
    weights = quality.fit(docs, trusted(spark, sf_dir), rules)
    return quality.measured(docs, weights, rules).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr",
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every kept vector after five rounds and a last assignment."""
    assigned, final = centroids.clustered(table(spark, sf_dir, "embeddings"))
    return centroids.described(assigned, final).withColumnRenamed("id", "vec_id")


def _centroid_sql(rounds: int, count: int) -> str:
    """Lloyd's rounds in exact integers, each an assignment and a mean."""
    parts = [
        """kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""",
        f"""c0 AS MATERIALIZED (
  SELECT k, x AS c FROM (SELECT x, row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS k FROM kept) WHERE k < {count}
)""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, min({{'d': d, 'k': k}}) AS best FROM (
    SELECT vec_id, k, CAST(list_sum(list_transform(range(1, 65), lambda j: (x[j] - c[j]) * (x[j] - c[j]))) AS BIGINT) AS d FROM kept, c{r}
  ) GROUP BY vec_id
)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.k, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT k, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY j) AS c FROM (
      SELECT best.k AS k, j, sum(x[j]) AS s, count(*) AS n FROM a{r} JOIN kept USING (vec_id), (SELECT unnest(range(1, 65)) AS j) GROUP BY best.k, j
    ) GROUP BY k
  ) m ON m.k = c{r}.k
)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.k = best.k
"""


OP11_SQL = _centroid_sql(5, 40)


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every embedding within its label."""
    return vectors.near_copies(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(u, w) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.w FROM reach r JOIN links l ON l.u = r.w
), least AS (
  SELECT u, min(w) AS component_id FROM reach GROUP BY u
), degree AS (
  SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.u = e.vec_id LEFT JOIN degree ON degree.u = e.vec_id
"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of every document under two tokenizers, scored by corpus-wide counts."""
    names = [pieces.ship(spark, path) for path in (byte_model(), piece_model())]
    return alignment.scored(table(spark, sf_dir, "documents"), *names).withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_warc": op2_warc,
    "op3_shards": op3_shards,
    "op4_secrets": op4_secrets,
    "op5_licenses": op5_licenses,
    "op6_urls": op6_urls,
    "op7_pieces": op7_pieces,
    "op8_decontaminate": op8_decontaminate,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
    "op11_centroids": op11_centroids,
    "op12_near_vectors": op12_near_vectors,
    "op13_alignment": op13_alignment,
}
ORACLES: dict[str, str] = {
    "op2_warc": OP2_SQL,
    "op3_shards": OP3_SQL,
    "op11_centroids": OP11_SQL,
    "op12_near_vectors": OP12_SQL,
}
