"""Documents to training tokens in five stages. Each stage works on all rows that the one before it
kept, written as Parquet in the shared folder and read again.

1. quality rules: documents that fail go; 2. SimHash near-dedup: of each group that links of
5-word Jaccard similarity 0.8 or more join, the least id stays;
3. benchmark decontamination: documents that hold a benchmark item go; 4. secret scans: secrets are
masked in the text, every document stays; 5. SentencePiece: ids, and the text that they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import decontaminate, pieces, quality, secrets, similar
from evenkeel.llm.common import landed, table
from evenkeel.llm.queries import piece_model, trusted


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = quality.QualityRules()
    return quality.kept(docs, quality.fit(docs, trusted(spark, sf_dir), rules), rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.one_per_group(docs, similar.Similar())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), decontaminate.Decontamination())


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redacted(docs, secrets.fit(docs, secrets.SecretRules()))
    # A second projection, so that the scan runs once.
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    encoded = pieces.encode(docs, pieces.ship(spark, piece_model()), keep, decoded=True)
    return encoded.select(*keep, F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece", tokens),
]

#: No stage's decisions are SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
