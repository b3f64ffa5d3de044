"""Write scripts and synced tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_script(lines: DataFrame, order: Sequence[str], path: str, text: str = "text") -> None:
    """Save script lines in order. One sort by ranges: part files in name order are the script."""
    lines.orderBy(*order).select(text).write.mode("errorifexists").text(path)


def write_scripts_by_pair(plan: DataFrame, order: Sequence[str], path: str) -> None:
    """Save one script per database pair under pair_id=…, each in order over its part files."""
    sorted_rows = plan.orderBy("pair_id", *order).select("pair_id", "text")
    sorted_rows.write.mode("errorifexists").partitionBy("pair_id").text(path)


def write_synced(table: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Save a synced table to a new place. An existing one is never overwritten, since it
    may be the very table the plan still reads."""
    table.write.mode("errorifexists").format(fmt).save(path)
