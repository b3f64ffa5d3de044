"""Queries over pairs of data tables: row compare, change feed, statements."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evenkeel.functions import literals
from evenkeel.functions.dialect import POSTGRESQL, SQL_SERVER
from evenkeel.operators import digests, dml, rowdiff
from evenkeel.options import RowDiffOptions
from evenkeel.plans.lineage import shared_folder
from evenkeel.sources import versions
from suite.base import load, oracle, recipe, table

QUERIES = {}
ORACLES = {}


def query(name):
    def add(fn):
        QUERIES[name] = fn
        return fn

    return add


# Inputs ---------------------------------------------------------------------
recipe(
    "orders_t",
    """
select o_orderkey, o_custkey, o_orderstatus,
       case when o_orderkey % 13 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice,
       o_orderdate,
       case when o_orderkey % 29 = 0 then null else o_orderpriority end as o_orderpriority
from {orders} where o_orderkey % 17 <> 0
union all
select o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
from {orders} where o_orderkey % 19 = 0
""",
)
recipe(
    "conversations_t",
    """
select conv_id, turn, role,
       case when turn = 1 and conv_id % 3 = 0 then text || '!' else text end as text
from {conversations} where (conv_id + turn) % 11 <> 0
""",
)
recipe(
    "events_s",
    """
select event_id, ts, user_id, event_type, value,
       case when event_id % 2 = 0 then replace(props, '"', '''') else props end as props
from {events}
""",
)
recipe(
    "events_t",
    """
select event_id, ts, user_id,
       case when event_id % 7 = 0 then 'it''s' else event_type end as event_type,
       case when event_id % 11 = 0 then null else value end as value, props
from events_s where event_id % 5 <> 0
""",
)
# The target has a column of its own and lacks one of the source.
recipe(
    "customer_t",
    """
select c_custkey, c_name, c_nationkey,
       case when c_custkey % 10 = 3 then c_acctbal + 0.5 else c_acctbal end as c_acctbal,
       c_custkey % 7 as legacy_code
from {customer} where c_custkey % 8 <> 0
union all
select c_custkey + 10000000, c_name, c_nationkey, c_acctbal, 1 from {customer} where c_custkey % 21 = 0
""",
)

_ORDER_COLS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def orders_pair(spark, sf):
    return table(spark, sf, "orders"), load(spark, sf, "orders_t")


def orders_diff(spark, sf, **options):
    return rowdiff.diff_rows(*orders_pair(spark, sf), ["o_orderkey"], RowDiffOptions(**options))


def joined(source: str, target: str, keys: list[str], values: list[str], sel: str = "") -> str:
    """DuckDB full outer join of two relations with a status per row."""
    differs = " or ".join(f"s.{v} is distinct from t.{v}" for v in values) or "false"
    on = " and ".join(f"s.{k} = t.{k}" for k in keys)
    cols = ", ".join(f"coalesce(s.{k}, t.{k}) as {k}" for k in keys)
    both = "".join(f", s.{v} as s_{v}, t.{v} as t_{v}, s.{v} is distinct from t.{v} as d_{v}" for v in values)
    return f"""
select {cols}{both},
       case when t.{keys[0]} is null then 'missing' when s.{keys[0]} is null then 'extra'
            when {differs} then 'different' else 'equal' end as status
from {source} s full outer join {target} t on {on}
"""


_ORDERS_J = {"j": joined("orders", "orders_t", ["o_orderkey"], _ORDER_COLS)}


def counts(table_name: str, rel: str) -> str:
    return f"""
select '{table_name}' as table_name,
       count(*) filter (status = 'missing') as missing, count(*) filter (status = 'extra') as extra,
       count(*) filter (status = 'different') as different, count(*) filter (status = 'equal') as "equal",
       count(*) filter (status <> 'equal') > 0 as has_changes
from {rel}
"""


# Row compare -----------------------------------------------------------------
@query("diff_summary")
def _(spark, sf):
    return rowdiff.summarize(orders_diff(spark, sf), "orders")


ORACLES["diff_summary"] = oracle(counts("orders", "j"), _ORDERS_J)


@query("row_status")
def _(spark, sf):
    return rowdiff.row_status(orders_diff(spark, sf))


ORACLES["row_status"] = oracle("select o_orderkey, status from j", _ORDERS_J)


@query("changed_columns")
def _(spark, sf):
    return rowdiff.changed_columns(orders_diff(spark, sf))


_CHANGED = "concat_ws(',', " + ", ".join(f"case when d_{c} then '{c}' end" for c in _ORDER_COLS) + ")"
ORACLES["changed_columns"] = oracle(
    f"select o_orderkey, {_CHANGED} as changed from j where status = 'different'", _ORDERS_J
)


@query("rows_missing")
def _(spark, sf):
    return rowdiff.missing_rows(*orders_pair(spark, sf), ["o_orderkey"])


ORACLES["rows_missing"] = oracle(
    "select * from orders s where not exists (select 1 from orders_t t where t.o_orderkey = s.o_orderkey)"
)


@query("rows_extra")
def _(spark, sf):
    return rowdiff.extra_rows(*orders_pair(spark, sf), ["o_orderkey"])


ORACLES["rows_extra"] = oracle(
    "select * from orders_t t where not exists (select 1 from orders s where t.o_orderkey = s.o_orderkey)"
)


@query("rows_semi")
def _(spark, sf):
    return rowdiff.shared_rows(*orders_pair(spark, sf), ["o_orderkey"])


ORACLES["rows_semi"] = oracle(
    "select * from orders s where exists (select 1 from orders_t t where t.o_orderkey = s.o_orderkey)"
)


@query("rows_matched")
def _(spark, sf):
    return rowdiff.matched_rows(*orders_pair(spark, sf), ["o_orderkey"])


ORACLES["rows_matched"] = oracle(
    "select o_orderkey, "
    + ", ".join(f"s_{c} as source_{c}, t_{c} as target_{c}" for c in _ORDER_COLS)
    + ", status from j where status in ('different', 'equal')",
    _ORDERS_J,
)


def flat_feed(feed, keys, values):
    return feed.select(
        "op",
        *keys,
        *[F.col(f"before.{v}").alias(f"before_{v}") for v in values],
        *[F.col(f"after.{v}").alias(f"after_{v}") for v in values],
        F.array_join("changed", ",").alias("changed"),
    )


_FEED = (
    "select case status when 'missing' then 'insert' when 'extra' then 'delete' else 'update' end as op, o_orderkey, "
    + ", ".join(f"t_{c} as before_{c}, s_{c} as after_{c}" for c in _ORDER_COLS)
    + f", case when status = 'different' then {_CHANGED} else '' end as changed from j where "
)


@query("change_feed")
def _(spark, sf):
    return flat_feed(rowdiff.change_feed(orders_diff(spark, sf)), ["o_orderkey"], _ORDER_COLS)


ORACLES["change_feed"] = oracle(_FEED + "status <> 'equal'", _ORDERS_J)


@query("changes_no_deletes")
def _(spark, sf):
    return flat_feed(
        rowdiff.change_feed(orders_diff(spark, sf, include_deletes=False)), ["o_orderkey"], _ORDER_COLS
    )


ORACLES["changes_no_deletes"] = oracle(_FEED + "status in ('missing', 'different')", _ORDERS_J)


def _customer_apply(spark, sf, **options):
    return rowdiff.apply_changes(
        table(spark, sf, "customer"), load(spark, sf, "customer_t"), ["c_custkey"], RowDiffOptions(**options)
    )


@query("apply_sync")
def _(spark, sf):
    return _customer_apply(spark, sf)


_APPLIED = """
select s.c_custkey, s.c_name, s.c_nationkey, s.c_acctbal, t.legacy_code
from customer s left join customer_t t on t.c_custkey = s.c_custkey
"""
ORACLES["apply_sync"] = oracle(_APPLIED)


@query("apply_sync_keep_extra")
def _(spark, sf):
    return _customer_apply(spark, sf, include_deletes=False)


ORACLES["apply_sync_keep_extra"] = oracle(
    _APPLIED
    + " union all select * from customer_t t where not exists (select 1 from customer s where s.c_custkey = t.c_custkey)"
)


@query("apply_feed")
def _(spark, sf):
    """The target of orders after its change feed."""
    source, target = orders_pair(spark, sf)
    diff = rowdiff.diff_rows(source, target, ["o_orderkey"])
    return rowdiff.apply_feed(target, rowdiff.change_feed(diff), diff)


ORACLES["apply_feed"] = oracle("select o_orderkey, " + ", ".join(_ORDER_COLS) + " from orders")


@query("apply_partitions")
def _(spark, sf):
    """The target of customers in 64 buckets by key, and the version that its change feed makes of it."""
    source, target, path = table(spark, sf, "customer"), load(spark, sf, "customer_t"), f"{shared_folder(spark)}/customers-{uuid.uuid4().hex}"
    versions.create(target, path, ["c_custkey"], 64)
    diff = rowdiff.diff_rows(source, target, ["c_custkey"])
    versions.apply(path, rowdiff.change_feed(diff), diff)
    return versions.read(spark, path)


ORACLES["apply_partitions"] = oracle(_APPLIED)

# A column computed from another one. Its values in the target are those of the target's own rows.
recipe("customer_c", "select c_custkey, c_acctbal, c_acctbal * 2 as twice from {customer}")
recipe(
    "customer_ct",
    """
select c_custkey, case when c_custkey % 10 = 3 then c_acctbal + 1 else c_acctbal end as c_acctbal,
       case when c_custkey % 10 = 3 then (c_acctbal + 1) * 2 else c_acctbal * 2 end as twice
from {customer} where c_custkey % 8 <> 0
""",
)


@query("apply_computed")
def _(spark, sf):
    source, target = load(spark, sf, "customer_c"), load(spark, sf, "customer_ct")
    return rowdiff.apply_changes(source, target, ["c_custkey"], computed=["twice"])


ORACLES["apply_computed"] = oracle("select * from customer_c")

# Types between which no type holds all values: integers, decimals and doubles, beyond 2^53 too.
recipe(
    "typed_s",
    """
select o_orderkey as k, o_orderkey + 9007199254740992 as whole, cast(o_orderkey as decimal(38, 0)) as wide,
       cast(o_orderkey as decimal(12, 2)) as narrow
from {orders}
""",
)
recipe(
    "typed_t",
    """
select o_orderkey as k, cast(o_orderkey + 9007199254740992 as double) as whole,
       cast(o_orderkey as decimal(38, 18)) + cast(case when o_orderkey % 5 = 0 then 0.5 else 0 end as decimal(38, 18)) as wide,
       cast(o_orderkey as double) + case when o_orderkey % 7 = 0 then 0.25 else 0 end as narrow
from {orders}
""",
)


@query("row_status_types")
def _(spark, sf):
    diff = rowdiff.diff_rows(load(spark, sf, "typed_s"), load(spark, sf, "typed_t"), ["k"])
    return diff.df.select("k", "status", F.array_join("changed", ",").alias("changed"))


# A long plus 2^53 is a double exactly if it is even.
ORACLES["row_status_types"] = oracle(
    """
select k, case when odd or half or part then 'different' else 'equal' end as status,
       concat_ws(',', case when odd then 'whole' end, case when half then 'wide' end, case when part then 'narrow' end) as changed
from (select o_orderkey as k, o_orderkey % 2 = 1 as odd, o_orderkey % 5 = 0 as half, o_orderkey % 7 = 0 as part from orders)
"""
)


@query("roundtrip_zero")
def _(spark, sf):
    """Compare again after the sync, for two tables: nothing may be left to change."""
    orders, orders_t = orders_pair(spark, sf)
    customer = table(spark, sf, "customer")
    pairs = [
        rowdiff.TablePair("orders", orders, rowdiff.apply_changes(orders, orders_t, ["o_orderkey"]), ["o_orderkey"]),
        rowdiff.TablePair("customer", customer, _customer_apply(spark, sf), ["c_custkey"]),
    ]
    return rowdiff.diff_tables(pairs).drop("note")


ORACLES["roundtrip_zero"] = "\nunion all\n".join(
    f"select '{t}' as table_name, cast(0 as bigint) as missing, cast(0 as bigint) as extra, "
    f"cast(0 as bigint) as different, count(*) as \"equal\", false as has_changes from {t}"
    for t in ("orders", "customer")
)


recipe("nameless_s", "select case when o_orderkey % 50 = 0 then null else o_orderkey end as k, o_custkey as v from {orders}")
recipe(
    "nameless_t",
    "select case when o_orderkey % 30 = 0 then null else o_orderkey end as k, o_custkey + case when o_orderkey % 4 = 0 then 1 else 0 end as v "
    "from {orders} where o_orderkey % 9 <> 0",
)


@query("apply_null_keys")
def _(spark, sf):
    """Rows without a key on both sides, each of its own: the sync replaces them all."""
    return rowdiff.apply_changes(load(spark, sf, "nameless_s"), load(spark, sf, "nameless_t"), ["k"])


ORACLES["apply_null_keys"] = oracle("select k, v from nameless_s")


@query("row_status_composite")
def _(spark, sf):
    diff = rowdiff.diff_rows(
        table(spark, sf, "conversations"), load(spark, sf, "conversations_t"), ["conv_id", "turn"]
    )
    return rowdiff.row_status(diff)


ORACLES["row_status_composite"] = oracle(
    "select conv_id, turn, status from j",
    {"j": joined("conversations", "conversations_t", ["conv_id", "turn"], ["role", "text"])},
)


_LINE_KEYS = ["l_orderkey", "l_linenumber"]


#: All columns of lineitem but its keys, in table order, which is the order of the pairing.
_LINE_VALUES = (
    "l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
).split()


@query("row_status_dups")
def _(spark, sf):
    """All columns are compared; orders have several lines of one number."""
    source = table(spark, sf, "lineitem")
    target = source.filter("l_partkey % 7 <> 0")
    return rowdiff.row_status(rowdiff.diff_rows(source, target, _LINE_KEYS, RowDiffOptions(pair_duplicates=True)))


@query("row_status_hot_key")
def _(spark, sf):
    """Three quarters of the rows share one key; all columns are compared."""
    source = load(spark, sf, "lineitem_hot")
    diff = rowdiff.diff_rows(source, source.filter("l_partkey % 7 <> 0"), ["k"], RowDiffOptions(pair_duplicates=True))
    return diff.df.groupBy("k", "status").agg(
        F.count(F.lit(1)).alias("n"), F.max("occ").alias("last_occ"), F.sum("occ").alias("sum_occ")
    )


def _occ(of: str, keys: list[str], values: list[str], where: str = "") -> str:
    """SQL that numbers the rows of each key in the order of their values."""
    order = ", ".join(f"{v} nulls first" for v in values)
    return f"select *, row_number() over (partition by {', '.join(keys)} order by {order}) as occ from {of} {where}"


ORACLES["row_status_dups"] = oracle(
    "select l_orderkey, l_linenumber, occ, status from j",
    {
        "ls": _occ("lineitem", _LINE_KEYS, _LINE_VALUES),
        "lt": _occ("lineitem", _LINE_KEYS, _LINE_VALUES, "where l_partkey % 7 <> 0"),
        "j": joined("ls", "lt", [*_LINE_KEYS, "occ"], _LINE_VALUES),
    },
)
recipe("lineitem_hot", "select case when l_orderkey % 4 <> 0 then 0 else l_orderkey end as k, * from {lineitem}")
_HOT_VALUES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *_LINE_VALUES[2:]]
ORACLES["row_status_hot_key"] = oracle(
    "select k, status, count(*) as n, max(occ) as last_occ, cast(sum(occ) as bigint) as sum_occ from j group by all",
    {
        "hs": _occ("lineitem_hot", ["k"], _HOT_VALUES),
        "ht": _occ("lineitem_hot", ["k"], _HOT_VALUES, "where l_partkey % 7 <> 0"),
        "j": joined("hs", "ht", ["k", "occ"], _HOT_VALUES),
    },
)

recipe(
    "supplier_t",
    """
select s_suppkey, s_name, case when s_suppkey % 4 = 1 then s_nationkey + 1 else s_nationkey end as s_nationkey, s_acctbal
from {supplier} where s_suppkey % 9 <> 0
""",
)
recipe(
    "part_t",
    """
select p_partkey, upper(p_name) as p_name, p_brand, p_type, cast(p_size as bigint) as p_size, p_retailprice
from {part} where p_partkey % 6 <> 0
union all
select p_partkey + 10000000, p_name, p_brand, p_type, p_size, p_retailprice from {part} where p_partkey % 33 = 0
""",
)


def _pairs(spark, sf):
    embeddings = table(spark, sf, "embeddings")
    reversed_ = embeddings.withColumn(
        "embedding", F.when(F.col("vec_id") % 10 == 0, F.reverse("embedding")).otherwise(F.col("embedding"))
    )
    region = table(spark, sf, "region")
    pair = rowdiff.TablePair
    return [
        pair("customer", table(spark, sf, "customer"), load(spark, sf, "customer_t"), ["c_custkey"]),
        pair("supplier", table(spark, sf, "supplier"), load(spark, sf, "supplier_t"), ["s_suppkey"]),
        pair("part", table(spark, sf, "part"), load(spark, sf, "part_t"), ["p_partkey"]),
        pair("orders", *orders_pair(spark, sf), ["o_orderkey"]),
        pair(
            "conversations", table(spark, sf, "conversations"), load(spark, sf, "conversations_t"), ["conv_id", "turn"]
        ),
        pair("embeddings", embeddings, reversed_, ["vec_id"]),
        pair("region", region, region, ["r_regionkey"]),
        pair("nation", table(spark, sf, "nation"), table(spark, sf, "nation").drop("n_nationkey"), ["n_nationkey"]),
        pair("events", table(spark, sf, "events"), load(spark, sf, "events_t"), []),
    ]


@query("diff_all_tables")
def _(spark, sf):
    """Eight tables in one job, one of them in step, one with no usable key, one of arrays."""
    return rowdiff.diff_tables(_pairs(spark, sf))


@query("diff_tables_digests")
def _(spark, sf):
    """The same tables, digests first, and only what differs joined."""
    return digests.diff_tables(_pairs(spark, sf))


def _with_note(name, rel):
    return counts(name, rel).replace(
        "as has_changes", "as has_changes, case when count(*) filter (status <> 'equal') > 0 then '' else 'in sync' end as note"
    )


def _error(name, note):
    return (
        f"select '{name}' as table_name, cast(0 as bigint) as missing, cast(0 as bigint) as extra, cast(0 as bigint) as "
        f"different, cast(0 as bigint) as \"equal\", false as has_changes, '{note}' as note"
    )


ORACLES["diff_all_tables"] = oracle(
    "\nunion all\n".join(
        [_with_note(n, "j_" + n) for n in "customer supplier part orders conversations embeddings region".split()]
        + [_error("nation", rowdiff.KEY_NOT_IN_TARGET), _error("events", rowdiff.NO_KEY)]
    ),
    {
        "embeddings_t": "select vec_id, case when vec_id % 10 = 0 then list_reverse(embedding) else embedding end as "
        "embedding, label from embeddings",
        "j_customer": joined("customer", "customer_t", ["c_custkey"], ["c_name", "c_nationkey", "c_acctbal"]),
        "j_supplier": joined("supplier", "supplier_t", ["s_suppkey"], ["s_name", "s_nationkey", "s_acctbal"]),
        "j_part": joined(
            "part", "part_t", ["p_partkey"], ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
        ),
        "j_orders": _ORDERS_J["j"],
        "j_conversations": joined("conversations", "conversations_t", ["conv_id", "turn"], ["role", "text"]),
        "j_embeddings": joined("embeddings", "embeddings_t", ["vec_id"], ["embedding", "label"]),
        "j_region": joined("region", "region", ["r_regionkey"], ["r_name"]),
    },
)

ORACLES["diff_tables_digests"] = ORACLES["diff_all_tables"]


# Statements ----------------------------------------------------------------------
_EVENT_COLS = ["ts", "user_id", "event_type", "value", "props"]
_ORDERS_REF = dml.TableRef("sales", "or]der\"s")
_EVENTS_REF = dml.TableRef("app", "events", identity={"event_id": "GENERATED ALWAYS AS IDENTITY"})


def events_diff(spark, sf, **options):
    return rowdiff.diff_rows(
        load(spark, sf, "events_s"), load(spark, sf, "events_t"), ["event_id"], RowDiffOptions(**options)
    )


def _num(c):
    return f"coalesce(regexp_replace(cast({c} as varchar), '\\.0$', ''), 'NULL')"


def _txt(c, prefix):
    return f"coalesce('{prefix}''' || replace({c}, '''', '''''') || '''', 'NULL')"


def _ts(c, dialect):
    if dialect == "pg":
        return f"coalesce('''' || strftime({c}, '%Y-%m-%d %H:%M:%S.%f') || '''', 'NULL')"
    return f"coalesce('''' || regexp_replace(strftime({c}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || '''', 'NULL')"


def _sql_literal(col, kind, dialect):
    return {
        "n": _num(col),
        "s": _txt(col, "N" if dialect == "mssql" else ""),
        "t": _ts(col, dialect),
    }[kind]


_ORDER_KIND = dict(zip(_ORDER_COLS, "nsnts"))
_EVENT_KIND = dict(zip(_EVENT_COLS, "tnsns"))
_REF_SQL = {"mssql": '[sales].[or]]der"s]', "pg": '"sales"."or]der""s"'}


def _q(name, dialect):
    return f"[{name}]" if dialect == "mssql" else f'"{name}"'


def _insert_sql(table_sql, key, kinds, dialect, overriding=""):
    cols = ", ".join(_q(c, dialect) for c in [key, *kinds])
    values = " || ', ' || ".join([_num(key)] + [_sql_literal("s_" + c, k, dialect) for c, k in kinds.items()])
    return f"'INSERT INTO {table_sql} ({cols}) {overriding}VALUES (' || {values} || ');'"


def _update_sql(table_sql, key, kinds, dialect):
    sets = ", ".join(
        f"case when d_{c} then '{_q(c, dialect)} = ' || {_sql_literal('s_' + c, k, dialect)} end" for c, k in kinds.items()
    )
    return f"'UPDATE {table_sql} SET ' || concat_ws(', ', {sets}) || ' WHERE {_q(key, dialect)} = ' || {_num(key)} || ';'"


def _delete_sql(table_sql, key, dialect):
    return f"'DELETE FROM {table_sql} WHERE {_q(key, dialect)} = ' || {_num(key)} || ';'"


@query("dml_insert_mssql")
def _(spark, sf):
    diff = orders_diff(spark, sf)
    rows = diff.df.filter("status = 'missing'")
    return rows.select("o_orderkey", dml.insert_text(diff, _ORDERS_REF, SQL_SERVER).alias("statement"))


ORACLES["dml_insert_mssql"] = oracle(
    f"select o_orderkey, {_insert_sql(_REF_SQL['mssql'], 'o_orderkey', _ORDER_KIND, 'mssql')} as statement "
    "from j where status = 'missing'",
    _ORDERS_J,
)

_EVENTS_J = {"j": joined("events_s", "events_t", ["event_id"], _EVENT_COLS)}


@query("dml_insert_pg")
def _(spark, sf):
    diff = events_diff(spark, sf)
    rows = diff.df.filter("status = 'missing'")
    return rows.select("event_id", dml.insert_text(diff, _EVENTS_REF, POSTGRESQL).alias("statement"))


_EV = '"app"."events"'
ORACLES["dml_insert_pg"] = oracle(
    f"select event_id, {_insert_sql(_EV, 'event_id', _EVENT_KIND, 'pg', 'OVERRIDING SYSTEM VALUE ')} as statement "
    "from j where status = 'missing'",
    _EVENTS_J,
)


@query("dml_update")
def _(spark, sf):
    diff = events_diff(spark, sf)
    rows = diff.df.filter("status = 'different'")
    return rows.select("event_id", dml.update_text(diff, _EVENTS_REF, POSTGRESQL).alias("statement"))


ORACLES["dml_update"] = oracle(
    f"select event_id, {_update_sql(_EV, 'event_id', _EVENT_KIND, 'pg')} as statement from j where status = 'different'",
    _EVENTS_J,
)


@query("dml_delete")
def _(spark, sf):
    diff = orders_diff(spark, sf)
    rows = diff.df.filter("status = 'extra'")
    return rows.select("o_orderkey", dml.delete_text(diff, _ORDERS_REF, SQL_SERVER).alias("statement"))


ORACLES["dml_delete"] = oracle(
    f"select o_orderkey, {_delete_sql(_REF_SQL['mssql'], 'o_orderkey', 'mssql')} as statement from j where status = 'extra'",
    _ORDERS_J,
)


def _statement_case(table_sql, key, kinds, dialect, overriding=""):
    return (
        f"case status when 'missing' then {_insert_sql(table_sql, key, kinds, dialect, overriding)} "
        f"when 'different' then {_update_sql(table_sql, key, kinds, dialect)} "
        f"else {_delete_sql(table_sql, key, dialect)} end"
    )


@query("diff_samples")
def _(spark, sf):
    return dml.samples(orders_diff(spark, sf), _ORDERS_REF, SQL_SERVER)


_OP = "case status when 'missing' then 'insert' when 'extra' then 'delete' else 'update' end"
ORACLES["diff_samples"] = oracle(
    f"select o_orderkey, {_OP} as op, {_statement_case(_REF_SQL['mssql'], 'o_orderkey', _ORDER_KIND, 'mssql')} as statement "
    "from j where status <> 'equal' order by o_orderkey limit 100",
    _ORDERS_J,
)

_IDENTITY = {"o_orderkey": "IDENTITY(1,1)"}


def _orders_script(spark, sf, table_ord=0):
    ref = dml.TableRef("sales", "orders", identity=_IDENTITY)
    return dml.table_script(orders_diff(spark, sf), ref, SQL_SERVER, table_ord)


@query("dml_script")
def _(spark, sf):
    return _orders_script(spark, sf)


def _script_sql(table_sql, full, key, kinds, dialect, table_ord, before, after, overriding=""):
    def line(ord_, text, condition):
        return (
            f"select {table_ord}, {ord_}, null, '{text}' from j_{key} group by all having count(*) filter ({condition}) > 0"
            if text
            else f"select {table_ord}, 0, null, '' where false"
        )

    return f"""
select {table_ord} as table_ord, case status when 'extra' then 1 when 'different' then 2 else 4 end as line_ord, {key},
       {_statement_case(table_sql, key, kinds, dialect, overriding)} as statement
from j_{key} where status <> 'equal'
union all {line(0, f'-- ==== Data changes for {full} ====', "status <> 'equal'")}
union all {line(3, before, "status = 'missing'")}
union all {line(5, after, "status = 'missing'")}
"""


_ORDERS_SCRIPT = _script_sql(
    "[sales].[orders]", "sales.orders", "o_orderkey", _ORDER_KIND, "mssql", 0,
    "SET IDENTITY_INSERT [sales].[orders] ON;", "SET IDENTITY_INSERT [sales].[orders] OFF;",
)
ORACLES["dml_script"] = oracle(_ORDERS_SCRIPT, {"j_o_orderkey": _ORDERS_J["j"]})


@query("data_script")
def _(spark, sf):
    """One transaction over three tables, one of them in step and therefore absent."""
    orders = dml.TableRef("sales", "orders")
    events = _EVENTS_REF
    region = table(spark, sf, "region")
    same = rowdiff.diff_rows(region, region, ["r_regionkey"])
    return dml.data_script(
        [
            dml.table_script(orders_diff(spark, sf), orders, POSTGRESQL, 0),
            dml.table_script(same, dml.TableRef("ref", "region"), POSTGRESQL, 1),
            dml.table_script(events_diff(spark, sf), events, POSTGRESQL, 2),
        ],
        POSTGRESQL,
    )


_NOTE = (
    "-- NOTE: resync the sequence for app.events if needed, e.g. setval(pg_get_serial_sequence(...), max(id))."
)
ORACLES["data_script"] = oracle(
    f"""
select table_ord, line_ord, cast(key as decimal(38,10)) as num_1, cast(null as varchar) as text_1, statement from (
  select table_ord, line_ord, o_orderkey as key, statement from ({_script_sql('"sales"."orders"', 'sales.orders', 'o_orderkey', _ORDER_KIND, 'pg', 0, '', '')})
  union all
  select table_ord, line_ord, event_id, statement from ({_script_sql(_EV, 'app.events', 'event_id', _EVENT_KIND, 'pg', 2, '', _NOTE, 'OVERRIDING SYSTEM VALUE ')})
  union all select -1, 0, null, 'BEGIN;'
  union all select 3, 0, null, 'COMMIT;'
)
""",
    {"j_o_orderkey": _ORDERS_J["j"], "j_event_id": _EVENTS_J["j"]},
)


# Literals and names ------------------------------------------------------------------
recipe(
    "typed_values",
    """
select event_id, ts, cast(ts as date) as day, user_id, nullif(event_type, 'click') as event_type, value,
       value > 50 as flag, cast(round(value) as decimal(12,4)) as amount, event_type || '''' || props as quoted
from {events}
""",
)


def _literals(fn):
    def run(spark, sf):
        df = load(spark, sf, "typed_values").withColumn("raw", F.encode("event_type", "UTF-8"))
        return df.select(
            "event_id",
            *[fn(F.col(f.name), f.dataType).alias(f.name + "_sql") for f in df.schema.fields if f.name != "event_id"],
        )

    return run


QUERIES["literal_mssql"] = _literals(literals.mssql_literal)
QUERIES["literal_pg"] = _literals(literals.pg_literal)


def _literal_oracle(dialect):
    prefix = "N" if dialect == "mssql" else ""
    true, false = ("1", "0") if dialect == "mssql" else ("TRUE", "FALSE")
    raw = "'0x' || hex(event_type)" if dialect == "mssql" else "'''\\x' || hex(event_type) || ''''"
    return oracle(
        f"""
select event_id, {_ts('ts', dialect)} as ts_sql, '''' || strftime(day, '%Y-%m-%d') || '''' as day_sql,
       {_num('user_id')} as user_id_sql, {_txt('event_type', prefix)} as event_type_sql, {_num('value')} as value_sql,
       case when flag then '{true}' when not flag then '{false}' else 'NULL' end as flag_sql,
       coalesce(cast(amount as varchar), 'NULL') as amount_sql, {_txt('quoted', prefix)} as quoted_sql,
       coalesce({raw}, 'NULL') as raw_sql
from typed_values
"""
    )


ORACLES["literal_mssql"] = _literal_oracle("mssql")
ORACLES["literal_pg"] = _literal_oracle("pg")


@query("quote_ident")
def _(spark, sf):
    names = load(spark, sf, "odd_names")
    return names.select(
        "event_id", SQL_SERVER.quote(F.col("name")).alias("mssql"), POSTGRESQL.quote(F.col("name")).alias("pg")
    )


recipe("odd_names", "select event_id, event_type || ']' || props as name from {events}")
ORACLES["quote_ident"] = oracle(
    "select event_id, '[' || replace(name, ']', ']]') || ']' as mssql, '\"' || replace(name, '\"', '\"\"') || '\"' as pg "
    "from odd_names"
)
