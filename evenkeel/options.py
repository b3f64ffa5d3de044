"""Settings of the three jobs: schema compare, row compare, deployment plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CompareOptions:
    ignore_case: bool = True
    ignore_whitespace_in_modules: bool = True
    ignore_collation: bool = True

    def fold(self, name: Column) -> Column:
        """Join and sort key of a name."""
        return F.upper(name) if self.ignore_case else name


@dataclass(frozen=True)
class RowDiffOptions:
    include_deletes: bool = True
    max_sample_rows: int = 100
    # Match NULL keys to NULL keys. Declared primary keys hold none, and a plain
    # equality keeps bucketed tables free of an exchange.
    null_safe_keys: bool = False
    # Pair rows that share a key by their position in value order. Needed only where
    # the key is not unique on both sides.
    pair_duplicates: bool = False


@dataclass(frozen=True)
class ScriptOptions:
    include_drops: bool = True
    use_transaction: bool = True
