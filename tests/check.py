"""Run queries next to their DuckDB counterparts and compare whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from suite.base import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in value.items())
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else a short description of the first difference."""
    got_cols, got = canonical(df.columns, df.collect())
    result = con.execute(sql)
    want_cols, want = canonical([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; {list(set(map(repr, got)) ^ set(map(repr, want)))[:2]}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tests.session import build

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build("local[8]")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                n = ""
            else:
                n, problem = df.count(), None
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
            n = ""
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {n} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)
