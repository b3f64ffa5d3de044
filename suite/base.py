"""How the queries get their inputs: driver tables and recipes written as SQL.

A recipe is one SELECT that both engines understand. `{orders}` and the like stand for
driver tables; other recipes are referred to by name and become common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

RECIPES: dict[str, str] = {}


def recipe(name: str, text: str) -> None:
    RECIPES[name] = text.strip()


def _needed(text: str, seen: list[str]) -> list[str]:
    for name in RECIPES:
        if name not in seen and re.search(rf"(?i)\b{name}\b", text):
            _needed(RECIPES[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_recipes(body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Put the recipes that `body` mentions, and `extra` steps, in front of it as CTEs."""
    extra = extra or {}
    names = _needed(body + " " + " ".join(extra.values()), [])
    ctes = [f"{n} AS (\n{RECIPES[n]}\n)" for n in names if n not in extra]
    ctes += [f"{n} AS (\n{t.strip()}\n)" for n, t in extra.items()]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(ctes) + "\n" if ctes else "") + body.strip()


_PLANS: dict = {}


def once(spark: SparkSession, key: tuple, make):
    """Keep what `make` gives for the session: a lazy plan, so that many queries need not
    analyse it again, or a frame landed in the checkpoint folder."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _PLANS:
        _PLANS[full] = make()
    return _PLANS[full]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return once(spark, ("table", sf_dir, name), lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def load(spark: SparkSession, sf_dir: str, name_or_sql: str) -> DataFrame:
    """The rows of a recipe, or of SQL over recipes, in Spark."""
    return once(spark, ("recipe", sf_dir, name_or_sql), lambda: _load(spark, sf_dir, name_or_sql))


def _load(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    if re.fullmatch(r"\w+", text):
        text = f"SELECT * FROM {text}"
    text = with_recipes(text)
    used = {n: table(spark, sf_dir, n) for n in TABLES if "{" + n + "}" in text}
    return spark.sql(text, **used) if used else spark.sql(text)


def oracle(body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """The same for DuckDB, where driver tables are views with their own names."""
    text = with_recipes(body, extra, recursive)
    for n in TABLES:
        text = text.replace("{" + n + "}", n)
    return text
