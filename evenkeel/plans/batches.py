"""Cut scripts into the batches a server runs one by one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.dialect import Dialect
from evenkeel.functions.text import WHITESPACE

# Fixed value: a line that holds nothing but GO and perhaps a comment.
_GO_LINE = r"(?imdU)^[^\S\n]*GO[^\S\n]*(?:--.*)?$"


def split_batches(scripts: DataFrame, dialect: Dialect, keys: Sequence[str], script: str = "script") -> DataFrame:
    """One row per batch: keys, batch_no from 0, batch. Batches without a statement go.

    PostgreSQL takes a whole script as one batch.
    """
    blank = F.lit(WHITESPACE)
    if dialect.name == "PostgreSQL":
        whole = scripts.filter(F.trim(F.coalesce(script, F.lit("")), blank) != "")
        return whole.select(*keys, F.lit(0).alias("batch_no"), F.col(script).alias("batch"))
    unix = F.replace(F.col(script), F.lit("\r\n"), F.lit("\n"))
    pieces = F.transform(F.split(unix, _GO_LINE, -1), lambda b: F.trim(b, blank))

    def has_statement(batch):
        lines = F.transform(F.split(batch, "\n", -1), lambda line: F.trim(line, blank))
        return F.exists(lines, lambda line: (line != "") & ~line.startswith("--"))

    return scripts.select(*keys, F.posexplode(F.filter(pieces, has_statement)).alias("batch_no", "batch"))
