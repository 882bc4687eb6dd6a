"""The registered queries of the engine and the SQL that checks them.

Each query runs an operator over whole tables; ``SQL`` holds the same rows in
DuckDB's dialect.  Time is pinned, so buckets and schedules are reproducible.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import convert
from .functions.expressions import conditional, parse, truth, value
from .operators import buckets, documents, mutate, stats
from .operators.query import SORT_VALUE, page, sort_value
from .plans.ast import And, Clause, Cursor, Eq, Gt, Gte, In, IsNotNull, IsNull, Lt, Lte, Not, NotEq, NotIn, Or, Query, Sort
from .plans.compile import Prefilters, matching
from .plans.parsers import standard_registry
from .sources import dump, ndjson
from .sources.store import overlaid
from .sources.tables import flagged, op, pairs_to_ops, rows_to_ops
from .spec import BucketSpec, FieldSpec, IndexSpec, TimeSpec
from .streaming import changes
from .streaming import ops as op_batches
from .streaming.runs import reconciled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = 1_706_659_200  # 2024-01-31 00:00:00 UTC

ORDERS = IndexSpec(
    name="orders",
    fields=(
        FieldSpec("status", filter="single_value", value_type="low_cardinality_string"),
        FieldSpec("cust", filter="single_value"),
        FieldSpec("price", filter="single_value", sort=True, default=0),
        FieldSpec("prio", filter="single_value", value_type="low_cardinality_string", nullable=True),
        FieldSpec("prio2", filter="single_value", value_type="low_cardinality_string"),
        FieldSpec("ts", filter="single_value", sort=True),
    ),
)
BASKETS = IndexSpec(name="baskets", fields=(FieldSpec("supps", filter="multi_value", value_type="integer_array", filter_only=True), FieldSpec("qty", filter="single_value", sort=True)))
EVENTS = IndexSpec(
    name="events",
    fields=(FieldSpec("ts", filter="single_value", sort=True), FieldSpec("user", filter="single_value"), FieldSpec("kind", filter="single_value", value_type="low_cardinality_string"), FieldSpec("cents", sort=True)),
    time=TimeSpec(field="ts", buckets=(BucketSpec("24h", 86_400), BucketSpec("7d", 604_800), BucketSpec("14d", 1_209_600), BucketSpec("30d", 2_592_000)), deferred=None),
)

O_SQL = """(SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey AS cust, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS price,
 nullif(o_orderpriority, '5-LOW') AS prio, nullif(o_orderpriority, '5-LOW') AS prio2, CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM orders)"""
B_SQL = """(SELECT l_orderkey AS id, list_sort(list_distinct(list(l_suppkey))) AS supps, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY 1)"""
E_SQL = """(SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, user_id AS "user", event_type AS kind, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents FROM events)"""


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _cents(c: str):
    return F.floor(F.col(c) * 100 + 0.5).cast("long")


def _seconds(c: str):
    return F.unix_seconds(F.col(c).cast("timestamp"))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    prio = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    return _read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"), _cents("o_totalprice").alias("price"), prio.alias("prio"), prio.alias("prio2"), _seconds("o_orderdate").alias("ts"))


def baskets(spark: SparkSession, sf: str) -> DataFrame:
    lines = _read(spark, sf, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("supps"), F.sum("l_quantity").cast("long").alias("qty"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events").select(F.col("event_id").alias("id"), _seconds("ts").alias("ts"), F.col("user_id").alias("user"), F.col("event_type").alias("kind"), _cents("value").alias("cents"))


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf) and its SQL."""

    def note(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return note


# --- filters ---------------------------------------------------------------------------------------

_SOURCES = {"orders": (orders, ORDERS, O_SQL), "baskets": (baskets, BASKETS, B_SQL), "events": (events, EVENTS, E_SQL)}


def _filter(name: str, source: str, clauses: tuple[Clause, ...], where: str, columns: str = "id", now: int | None = None) -> None:
    frame, spec, sql = _SOURCES[source]

    @query(name, f"SELECT {columns} FROM {sql} t WHERE {where}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return matching(frame(spark, sf), clauses, spec, now).select(*[c.strip() for c in columns.split(",")])


_filter("filter_eq", "orders", (Eq("cust", 5),), "cust = 5", "id, cust")
_filter("filter_eq_id", "orders", (Eq("id", 77),), "id = 77")
_filter("filter_in_id", "orders", (In("id", (3, 5, "x", 900)),), "id IN (3, 5, 900)")
_filter("filter_not_eq", "orders", (NotEq("cust", 5),), "cust IS DISTINCT FROM 5")
_filter("filter_in", "orders", (In("cust", (1, 2, 3, 4, 400)),), "cust IN (1, 2, 3, 4, 400)", "id, cust")
_filter("filter_not_in", "orders", (NotIn("cust", (1, 2, 3, 4, 400)),), "cust NOT IN (1, 2, 3, 4, 400)")
_filter("filter_range", "orders", (Gt("price", 10_000_000), Lte("price", 30_000_000)), "price > 10000000 AND price <= 30000000", "id, price")
_filter("filter_and_or_nested", "orders", (Or((And((Eq("status", "F"), Gte("price", 20_000_000))), And((Eq("status", "O"), Not(In("cust", (1, 2, 3))))))),), "(status = 'F' AND price >= 20000000) OR (status = 'O' AND NOT cust IN (1, 2, 3))")
_filter("filter_empty_and", "orders", (Or((Eq("status", "P"), And(()))),), "status = 'P'")
_filter("filter_empty_or", "orders", (Not(Or((Or(()), In("cust", ())))), Eq("status", "P")), "status = 'P'")
_filter("filter_top_empty", "orders", (), "true")
_filter("filter_not_two_valued", "orders", (Not(Eq("prio", "1-URGENT")),), "NOT coalesce(prio = '1-URGENT', false)", "id, prio")
_filter("filter_is_null", "orders", (IsNull("prio"),), "prio IS NULL")
_filter("filter_is_not_null", "orders", (IsNotNull("prio"),), "prio IS NOT NULL")
_filter("filter_ci_string", "orders", (Eq("status", "f"), In("prio", ("1-urgent", "2-High"))), "lower(status) = 'f' AND lower(prio) IN ('1-urgent', '2-high')")
_filter("filter_multi_eq", "baskets", (Eq("supps", 7),), "list_contains(supps, 7)", "id")
_filter("filter_multi_in", "baskets", (In("supps", (7, 9, 11)),), "list_has_any(supps, [7, 9, 11])")
_filter("filter_multi_not_eq", "baskets", (NotEq("supps", 7),), "NOT list_contains(supps, 7)")
_filter("filter_multi_not_in", "baskets", (NotIn("supps", (7, 9, 11)),), "NOT list_has_any(supps, [7, 9, 11])")
_filter("filter_multi_range", "baskets", (Gt("supps", 95),), "list_max(supps) > 95")
_filter("filter_multi_all", "baskets", (And((Eq("supps", 7), Eq("supps", 9))),), "list_has_all(supps, [7, 9])")

_MATRIX = {
    "eq": (Eq("{f}", "1-URGENT"), "coalesce({f} = '1-URGENT', false)", "coalesce({f} = '1-URGENT', false)"),
    "not_eq": (NotEq("{f}", "1-URGENT"), "coalesce({f} <> '1-URGENT', false)", "{f} IS DISTINCT FROM '1-URGENT'"),
    "not_in": (NotIn("{f}", ("1-URGENT", "2-HIGH")), "coalesce({f} NOT IN ('1-URGENT', '2-HIGH'), false)", "coalesce({f} NOT IN ('1-URGENT', '2-HIGH'), true)"),
    "not_in_nothing": (NotIn("{f}", ()), "{f} IS NOT NULL", "true"),
    "negated_not_eq": (Not(NotEq("{f}", "1-URGENT")), "coalesce({f} = '1-URGENT', true)", "coalesce({f} = '1-URGENT', false)"),
    "is_null": (IsNull("{f}"), "{f} IS NULL", "{f} IS NULL"),
}


def _on(clause: Clause, field: str) -> Clause:
    return Not(_on(clause.clause, field)) if isinstance(clause, Not) else type(clause)(field, *[getattr(clause, a) for a in ("value", "values") if hasattr(clause, a)])


@query(
    "filter_null_matrix",
    "SELECT id, " + ", ".join(f"{sql.replace('{f}', f)} AS {name}_{f}" for name, (_, a, b) in _MATRIX.items() for f, sql in (("prio", a), ("prio2", b))) + f" FROM {O_SQL} t",
)
def filter_null_matrix(spark: SparkSession, sf: str) -> DataFrame:
    from .plans.compile import Compiler

    compiler = Compiler(ORDERS)
    return orders(spark, sf).select("id", *[F.coalesce(compiler.clause(_on(c, f)), F.lit(False)).alias(f"{name}_{f}") for name, (c, _, _) in _MATRIX.items() for f in ("prio", "prio2")])


# --- query languages -------------------------------------------------------------------------------

_TEXTS = {
    "typed": {"filters": [{"And": [{"In": ["status", [{"String": "F"}, {"String": "O"}]]}, {"Gte": ["price", {"Integer": 15_000_000}]}, {"Not": {"Eq": ["prio", {"String": "3-MEDIUM"}]}}]}], "sort": {"field": "price", "direction": "Desc"}},
    "json": {"filters": {"AND": [{"field": "status", "op": "in", "value": ["F", "O"]}, {"field": "price", "op": "gte", "value": 15_000_000}, {"NOT": {"field": "prio", "op": "eq", "value": "3-MEDIUM"}}]}, "sort": {"field": "price", "direction": "desc"}},
    "compact": {"filter": {"status": ["F", "O"], "price": {"$gte": 15_000_000}, "$not": {"prio": "3-MEDIUM"}}, "sort": "-price"},
    "search": {"filter": "status IN [F, O] AND price >= 15000000 AND NOT prio = '3-MEDIUM'", "sort": ["price:desc"]},
}


def _language(name: str) -> None:
    @query(f"parse_{name}", f"SELECT id, price FROM {O_SQL} t WHERE status IN ('F', 'O') AND price >= 15000000 AND NOT coalesce(prio = '3-MEDIUM', false)")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return matching(orders(spark, sf), standard_registry().parse(_TEXTS[name], name).filters, ORDERS).select("id", "price")


for _name in _TEXTS:
    _language(_name)


@query("parse_search_range", f"SELECT id FROM {O_SQL} t WHERE (price BETWEEN 5000000 AND 9000000 OR prio IS NULL) AND status NOT IN ('P')")
def parse_search_range(spark: SparkSession, sf: str) -> DataFrame:
    q = standard_registry().parse({"filter": [["price 5000000 TO 9000000", "prio IS NULL"], "status NOT IN [P]"]}, "search")
    return matching(orders(spark, sf), q.filters, ORDERS).select("id")


# --- order and pages -------------------------------------------------------------------------------


def _page(name: str, q: Query, where: str, order: str, limit: str, source: str = "orders", value_sql: str = "price") -> None:
    frame, spec, sql = _SOURCES[source]

    @query(name, f"SELECT id, {value_sql} AS sort_value, row_number() OVER (ORDER BY {order}) AS rank FROM (SELECT * FROM {sql} t WHERE {where} ORDER BY {order} {limit}) p")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = page(frame(spark, sf), q, spec)
        down = q.sort is None or q.sort.descending
        keys = [F.col(SORT_VALUE).desc(), F.col("id").desc()] if down else [F.col(SORT_VALUE).asc(), F.col("id").asc()]
        return rows.select("id", F.col(SORT_VALUE).alias("sort_value"), F.row_number().over(Window.orderBy(*keys)).cast("long").alias("rank"))  # a page is at most max_page_size rows


_DOWN, _UP = "price DESC, id DESC", "price, id"
_page("topk_desc", Query((Eq("status", "F"),), Sort("price"), 50), "status = 'F'", _DOWN, "LIMIT 50")
_page("topk_asc", Query((Eq("status", "F"),), Sort("price", False), 50), "status = 'F'", _UP, "LIMIT 50")
_page("topk_id_asc", Query((Eq("status", "F"),), Sort("id", False), 50), "status = 'F'", "id", "LIMIT 50", value_sql="id")
_page("no_sort_newest", Query((In("cust", tuple(range(1, 60))),), None, 50), "cust BETWEEN 1 AND 59", "id DESC", "LIMIT 50", value_sql="id")
_page("cursor_desc", Query((Eq("status", "O"),), Sort("price"), 40, Cursor(30_000_000, 9_000)), "status = 'O' AND (price < 30000000 OR (price = 30000000 AND id < 9000))", _DOWN, "LIMIT 40")
_page("cursor_asc", Query((Eq("status", "O"),), Sort("price", False), 40, Cursor(30_000_000, 9_000)), "status = 'O' AND (price > 30000000 OR (price = 30000000 AND id > 9000))", _UP, "LIMIT 40")
_page("cursor_no_sort", Query((Eq("status", "O"),), None, 40, Cursor(5_000, 5_000)), "status = 'O' AND id < 5000", "id DESC", "LIMIT 40", value_sql="id")
_page("cursor_beats_offset", Query((), Sort("price"), 20, Cursor(30_000_000, 9_000), 500), "price < 30000000 OR (price = 30000000 AND id < 9000)", _DOWN, "LIMIT 20")
_page("offset_page", Query((Eq("status", "F"),), Sort("price"), 30, None, 60), "status = 'F'", _DOWN, "LIMIT 30 OFFSET 60")
_page("page_cap", Query((), Sort("price"), 5_000), "true", _DOWN, "LIMIT 100")
_page("cursor_over_ties", Query((), Sort("qty"), 60, Cursor(100, 12_000)), "qty < 100 OR (qty = 100 AND id < 12000)", "qty DESC, id DESC", "LIMIT 60", "baskets", "qty")


@query("sort_missing_as_zero", f"SELECT id, greatest(coalesce(v, 0), 0) AS sort_value, row_number() OVER (ORDER BY greatest(coalesce(v, 0), 0), id) AS rank FROM (SELECT *, CASE WHEN cust % 3 = 0 THEN NULL WHEN cust % 3 = 1 THEN -price ELSE price END AS v FROM {O_SQL} t ORDER BY greatest(coalesce(v, 0), 0), id LIMIT 80) p")
def sort_missing_as_zero(spark: SparkSession, sf: str) -> DataFrame:
    rows = orders(spark, sf).withColumn("price", F.when(F.col("cust") % 3 == 0, F.lit(None)).when(F.col("cust") % 3 == 1, -F.col("price")).otherwise(F.col("price")))
    found = page(rows, Query((), Sort("price", False), 80), ORDERS)
    return found.select("id", F.col(SORT_VALUE).alias("sort_value"), F.row_number().over(Window.orderBy(SORT_VALUE, "id")).cast("long").alias("rank"))


@query("total_matched", f"SELECT count(*) AS total_matched FROM {O_SQL} t WHERE status = 'F' AND price > 10000000")
def total_matched(spark: SparkSession, sf: str) -> DataFrame:
    return matching(orders(spark, sf), (Eq("status", "F"), Gt("price", 10_000_000)), ORDERS).agg(F.count("*").alias("total_matched"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of one status above a price, dearest first: a page of ids with their sort values."""
    found = page(orders(spark, sf), standard_registry().parse({"filter": {"status": "F", "price": {"$gt": 10_000_000}}, "sort": "-price", "limit": 50}, "compact"), ORDERS)
    return found.select("id", "price", SORT_VALUE)


# --- documents -------------------------------------------------------------------------------------


@query("ids_to_docs", f"SELECT i.id, i.position, t.cust, t.price FROM (SELECT event_id * 3 AS id, event_id AS position FROM events) i LEFT JOIN {O_SQL} t ON t.id = i.id")
def ids_to_docs(spark: SparkSession, sf: str) -> DataFrame:
    wanted = _read(spark, sf, "events").select((F.col("event_id") * 3).alias("id"), F.col("event_id").alias("position"))
    return documents.by_ids(orders(spark, sf).select("id", "cust", "price"), wanted, ORDERS)


@query("doc_fields", f"SELECT id, status, price FROM {O_SQL} t WHERE status = 'P'")
def doc_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = matching(orders(spark, sf), (Eq("status", "P"),), ORDERS)
    return documents.shown(rows, ORDERS, ("status", "price"))


@query("default_fill", f"SELECT id, coalesce(CASE WHEN cust % 2 = 0 THEN price END, 0) AS price, coalesce(CASE WHEN cust % 3 = 0 THEN ts END, 0) AS ts, prio FROM {O_SQL} t")
def default_fill(spark: SparkSession, sf: str) -> DataFrame:
    rows = orders(spark, sf).withColumns({"price": F.when(F.col("cust") % 2 == 0, F.col("price")), "ts": F.when(F.col("cust") % 3 == 0, F.col("ts"))})
    return documents.shown(rows, ORDERS, ("price", "ts", "prio"))


_VERSIONED = ORDERS.replace(schema_version=3, defaults={1: {"price": -1}, 2: {"price": -2}})


@query("versioned_defaults", f"SELECT id, coalesce(CASE WHEN cust % 2 = 0 THEN price END, CASE 1 + cust % 3 WHEN 1 THEN -1 WHEN 2 THEN -2 ELSE 0 END) AS price FROM {O_SQL} t")
def versioned_defaults(spark: SparkSession, sf: str) -> DataFrame:
    rows = orders(spark, sf).withColumns({"price": F.when(F.col("cust") % 2 == 0, F.col("price")), documents.VERSION: (1 + F.col("cust") % 3).cast("int")})
    return documents.shown(rows, _VERSIONED, ("price",), documents.VERSION)


_STATUS = FieldSpec("status", filter="single_value", value_type="mapped_string", string_map={"F": 1, "O": 2})


@query("mapped_string", f"SELECT id, CASE status WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code, CASE status WHEN 'F' THEN 'F' WHEN 'O' THEN 'O' END AS shown FROM {O_SQL} t")
def mapped_string(spark: SparkSession, sf: str) -> DataFrame:
    rows = orders(spark, sf).select("id", convert.mapped(F.lower("status"), _STATUS).alias("code"))
    return rows.select("id", "code", documents.reversed_map(_STATUS, F.col("code")).alias("shown"))


# --- counts ----------------------------------------------------------------------------------------


@query("value_cardinality", f"SELECT status AS value, count(*) AS n FROM {O_SQL} t GROUP BY 1")
def value_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    return stats.value_counts(orders(spark, sf), "status", ORDERS)


@query("value_cardinality_multi", f"SELECT v AS value, count(*) AS n FROM (SELECT unnest(supps) AS v FROM {B_SQL} t) u GROUP BY 1")
def value_cardinality_multi(spark: SparkSession, sf: str) -> DataFrame:
    return stats.value_counts(baskets(spark, sf), "supps", BASKETS)


@query("distinct_values", f"SELECT count(DISTINCT status) AS status, count(DISTINCT cust) AS cust, count(DISTINCT prio) AS prio FROM {O_SQL} t")
def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return stats.distinct_values(orders(spark, sf), ["status", "cust", "prio"], ORDERS)


@query("slot_counts", "SELECT count(*) FILTER (WHERE o_custkey % 4 <> 0) AS alive, count(*) FILTER (WHERE o_custkey % 8 = 0) AS clean, max(o_orderkey) + 1 - count(*) FILTER (WHERE o_custkey % 4 <> 0) - count(*) FILTER (WHERE o_custkey % 8 = 0) AS dead FROM orders")
def slot_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = orders(spark, sf).select("id", (F.col("cust") % 4 != 0).alias("alive"), (F.col("cust") % 8 == 0).alias("cleaned"))
    return stats.slot_counts(rows, "alive", "cleaned")


@query("cond_sums", f"SELECT \"user\", sum(CASE WHEN kind IN ('click', 'view') THEN cents ELSE 0 END)::BIGINT AS seen, sum(CASE WHEN kind = 'purchase' THEN cents ELSE 0 END)::BIGINT AS bought FROM {E_SQL} t GROUP BY 1")
def cond_sums(spark: SparkSession, sf: str) -> DataFrame:
    return stats.conditional_sums(events(spark, sf), "user", "cents", "kind", {"seen": ["click", "view"], "bought": ["purchase"]})


@query("semi_window", f"SELECT \"user\", sum(cents)::BIGINT AS total FROM {E_SQL} t WHERE \"user\" IN (SELECT \"user\" FROM {E_SQL} w WHERE ts >= {NOW - 3 * 86400}) GROUP BY 1")
def semi_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf)
    active = rows.where(F.col("ts") >= NOW - 3 * 86_400).select("user").distinct()
    return rows.join(active, "user", "left_semi").groupBy("user").agg(F.sum("cents").alias("total"))


@query("dictionary", "SELECT lower(c_mktsegment) AS folded, arg_min(c_mktsegment, c_custkey) AS value, count(*) AS n FROM customer GROUP BY 1")
def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    spec = IndexSpec("customers", (FieldSpec("segment", filter="single_value", value_type="low_cardinality_string"),))
    return stats.dictionary(_read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), "segment", spec)


@query("collect_values", f"SELECT id, supps FROM {B_SQL} t")
def collect_values(spark: SparkSession, sf: str) -> DataFrame:
    return stats.collected(_read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_suppkey"), "id", "l_suppkey", "supps")


@query("page_overlap", f"WITH a AS (SELECT id FROM {O_SQL} t ORDER BY price DESC, id DESC LIMIT 100), b AS (SELECT id FROM {O_SQL} t WHERE status <> 'P' ORDER BY price DESC, id DESC LIMIT 100) SELECT (SELECT count(*) FROM a JOIN b USING (id)) / (SELECT count(*) FROM (SELECT id FROM a UNION SELECT id FROM b) u)::DOUBLE AS jaccard")
def page_overlap(spark: SparkSession, sf: str) -> DataFrame:
    rows = orders(spark, sf)
    pages = [page(rows, Query(filters, Sort("price"), 100), ORDERS) for filters in ((), (NotEq("status", "P"),))]
    return stats.first_page_overlap(*pages)


# --- lookups and phases ----------------------------------------------------------------------------


def _chain(spark: SparkSession, sf: str, where: str | None, nested_where: str | None) -> DataFrame:
    customers = _read(spark, sf, "customer").select(*[F.col(c).cast("string").alias(c) for c in ("c_custkey", "c_nationkey")])
    nation = _read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("__key"), *[F.col(c).cast("string").alias(c) for c in ("n_name", "n_regionkey")])
    region = _read(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("__key"), F.col("r_name").cast("string").alias("r_name"))
    inner = dump.Lookup("region", "r_regionkey", "n_regionkey", fields={"r_name": "region"}, where=nested_where)
    outer = dump.Lookup("nation", "n_nationkey", "c_nationkey", fields={"n_name": "nation"}, computed={"low": "n_regionkey == 0 || n_regionkey == 1"}, where=where, nested=(inner,))
    found = dump.enriched(customers, outer, nation, {"region": region})
    return found.select(F.col("c_custkey").cast("long").alias("id"), "nation", "low", "region")


_CHAIN_SQL = """SELECT c_custkey AS id, CASE WHEN {p} THEN n_name END AS nation, CASE WHEN {p} THEN n_regionkey IN (0, 1) END AS low,
 CASE WHEN {p} AND {q} THEN r_name END AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey"""
query("enrich_left", _CHAIN_SQL.format(p="true", q="true"))(lambda spark, sf: _chain(spark, sf, None, None))
query("enrich_filtered", _CHAIN_SQL.format(p="n_regionkey <> 2", q="true"))(lambda spark, sf: _chain(spark, sf, "n_regionkey != 2", None))
query("enrich_chain", _CHAIN_SQL.format(p="n_regionkey <> 2", q="r_name <> 'AFRICA'"))(lambda spark, sf: _chain(spark, sf, "n_regionkey != 2", "r_name != 'AFRICA'"))


@query("merge_phases", f"SELECT coalesce(a.id, b.id) AS id, a.price, b.qty, len(b.supps)::BIGINT AS n FROM (SELECT * FROM {O_SQL} t WHERE id % 5 <> 0) a FULL JOIN (SELECT * FROM {B_SQL} t WHERE id % 7 <> 0) b ON a.id = b.id")
def merge_phases(spark: SparkSession, sf: str) -> DataFrame:
    first = orders(spark, sf).where("id % 5 <> 0").select("id", "price")
    second = baskets(spark, sf).where("id % 7 <> 0").select("id", "qty", F.size("supps").cast("long").alias("n"))
    return dump.merged([first, second])


# --- expressions -----------------------------------------------------------------------------------


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    part = _read(spark, sf, "part")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("k"), F.when(F.col("p_size") > 10, F.col("p_size").cast("string")).alias("size"), F.when(F.col("p_partkey") % 3 > 0, (F.col("p_partkey") % 50).cast("string")).alias("b"), F.col("p_brand").alias("brand"))


P_SQL = "(SELECT p_partkey AS id, p_partkey AS k, CASE WHEN p_size > 10 THEN p_size END AS size, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 50 END AS b, p_brand AS brand FROM part)"


@query("expr_bitfield", f"SELECT id, (k >> 3) & 1 AS bit, ((k >> 2) & 1) = 1 AND ((k >> 4) & 3) <> 2 AS both, size & 7 AS low FROM {P_SQL} t")
def expr_bitfield(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("id", value(parse("(k >> 3) & 1")).alias("bit"), truth(parse("(k >> 2) & 1 == 1 && (k >> 4) & 3 != 2")).alias("both"), value(parse("size & 7")).alias("low"))


@query("expr_eq_null", f"SELECT id, size IS NOT DISTINCT FROM b AS same, size IS NULL AS missing, size IS NOT NULL AS there, b IS DISTINCT FROM 7 AS other, brand IS NOT DISTINCT FROM 'Brand#13' AS brand13 FROM {P_SQL} t")
def expr_eq_null(spark: SparkSession, sf: str) -> DataFrame:
    e = {"same": "size == b", "missing": "size = null", "there": "size != null", "other": "b != 7", "brand13": "brand = 'Brand#13'"}
    return _parts(spark, sf).select("id", *[truth(parse(t)).alias(n) for n, t in e.items()])


@query("expr_max", f"SELECT id, greatest(size, b) AS top, greatest(size, b, k) AS all3 FROM {P_SQL} t")
def expr_max(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("id", value(parse("max(size, b)")).alias("top"), value(parse("max(size, b, k)")).alias("all3"))


@query("expr_cond_value", f"SELECT id, CASE WHEN coalesce(size & 1, 0) = 1 OR brand = 'Brand#13' THEN b END AS v FROM {P_SQL} t")
def expr_cond_value(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("id", conditional(parse("size & 1 == 1 || brand = 'Brand#13'"), "b").alias("v"))


@query("row_flags", "SELECT p_partkey AS id, (p_partkey >> 3) & 1 = 1 AND (p_partkey >> 2) & 1 = 0 AS meta, (p_partkey >> 4) & 1 = 1 AS site FROM part")
def row_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return flagged(rows, "id", {"meta": ((3,), (2,)), "site": ((4,), ())})


_COMPUTED = IndexSpec("computed", (FieldSpec("a", sort=True), FieldSpec("b", sort=True), FieldSpec("hi", sort=True, computed="greatest", sources=("a", "b")), FieldSpec("lo", sort=True, computed="least", sources=("a", "b"))))


@query("computed_fields", f"SELECT id, greatest(a, b) AS hi, least(a, b) AS lo FROM (SELECT id, CASE WHEN cust % 2 = 0 THEN price END AS a, CASE WHEN cust % 3 = 0 THEN ts END AS b FROM {O_SQL} t) u")
def computed_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = orders(spark, sf).select("id", F.when(F.col("cust") % 2 == 0, F.col("price")).alias("a"), F.when(F.col("cust") % 3 == 0, F.col("ts")).alias("b"))
    return convert.with_computed(rows, _COMPUTED).select("id", "hi", "lo")


_LOADED = IndexSpec(
    "loaded",
    (
        FieldSpec("at", sort=True, source="at_ms", fallback="at_s", ms_to_seconds=True),
        FieldSpec("paid", filter="boolean", value_type="exists_boolean", source="at_ms"),
        FieldSpec("amount", value_type="integer", source="amount_text", default=7),
        FieldSpec("kind", filter="single_value", value_type="mapped_string", string_map={"View": 1, "click": 2}, source="kind"),
        FieldSpec("tags", filter="multi_value", value_type="integer_array", source="tags"),
    ),
)


@query(
    "load_conversions",
    f"""SELECT id, CASE WHEN id % 2 = 0 THEN ts ELSE ts + 5 END AS at, id % 2 = 0 AS paid, CASE WHEN id % 4 = 0 THEN 7 ELSE cents END AS amount,
 CASE kind WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END AS kind, CASE WHEN id % 3 > 0 THEN CASE WHEN id % 10 = id % 3 THEN [id % 10] ELSE list_sort([id % 10, id % 3]) END END AS tags FROM {E_SQL} t""",
)
def load_conversions(spark: SparkSession, sf: str) -> DataFrame:
    raw = events(spark, sf).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 2 == 0, (F.col("ts") * 1000 + 999).cast("string")).alias("at_ms"),
        (F.col("ts") + 5).cast("string").alias("at_s"),
        F.when(F.col("id") % 4 == 0, F.lit("n/a")).otherwise(F.concat(F.col("cents").cast("string"), F.lit(".0"))).alias("amount_text"),
        F.upper("kind").alias("kind"),
        F.when(F.col("id") % 3 > 0, F.array((F.col("id") % 10).cast("string"), F.lit("x"), (F.col("id") % 3).cast("string"))).otherwise(F.array(F.lit("y"))).alias("tags"),
    )
    return ndjson.documents(raw, _LOADED).withColumn("tags", F.sort_array("tags"))


@query("snap_grid", f"SELECT id, ts // 3600 * 3600 AS hour, ts AS same FROM {E_SQL} t")
def snap_grid(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("id", convert.snapped(F.col("ts"), 3600).alias("hour"), convert.snapped(F.col("ts"), 0).alias("same"))


@query("array_add_remove", f"SELECT id, list_sort(list_distinct(list_concat(supps, [7::BIGINT, 8::BIGINT]))) AS added, list_sort(list_filter(supps, lambda x: x NOT IN (7, 8))) AS removed FROM {B_SQL} t")
def array_add_remove(spark: SparkSession, sf: str) -> DataFrame:
    pair = F.array(F.lit(7).cast("long"), F.lit(8).cast("long"))
    return baskets(spark, sf).select("id", F.sort_array(convert.array_added(F.col("supps"), pair)).alias("added"), F.sort_array(convert.array_removed(F.col("supps"), pair)).alias("removed"))


# --- time ------------------------------------------------------------------------------------------

_filter("bucket_24h", "events", (Gte("ts", NOW - 86_400),), f"ts BETWEEN {NOW - 86400} AND {NOW}", now=NOW)
_filter("bucket_7d_ms", "events", (Gt("ts", (NOW - 604_800) * 1000),), f"ts BETWEEN {NOW - 604800} AND {NOW}", now=NOW)
_filter("snap_within", "events", (Gte("ts", NOW - 640_000),), f"ts BETWEEN {NOW - 604800} AND {NOW}", now=NOW)
_filter("snap_always", "events", (Or((Gte("ts", NOW - 300_000), Eq("user", 1))),), f"ts BETWEEN {NOW - 604800} AND {NOW} OR \"user\" = 1", now=NOW)
_filter("lt_snap", "events", (Lt("ts", NOW - 600_000),), f"NOT (ts BETWEEN {NOW - 604800} AND {NOW})", now=NOW)
_filter("lt_future", "events", (Lte("ts", NOW + 5), Eq("user", 3)), "\"user\" = 3", now=NOW)
_filter("lt_plain", "events", (Lt("ts", NOW - 300_000),), f"ts < {NOW - 300000}", now=NOW)


@query("bucket_members", f"SELECT b AS bucket, id FROM {E_SQL} t JOIN (VALUES ('24h', 86400), ('7d', 604800), ('14d', 1209600), ('30d', 2592000)) v(b, d) ON ts BETWEEN {NOW} - d AND {NOW}")
def bucket_members(spark: SparkSession, sf: str) -> DataFrame:
    return buckets.memberships(events(spark, sf), EVENTS, NOW)


@query("bucket_refresh", f"SELECT id FROM {E_SQL} t WHERE ts BETWEEN {NOW - 5 * 86400 - 604800} AND {NOW - 5 * 86400}")
def bucket_refresh(spark: SparkSession, sf: str) -> DataFrame:
    rows, then, now = events(spark, sf), NOW - 10 * 86_400, NOW - 5 * 86_400
    seven = EVENTS.time.buckets[1]
    old = rows.where(buckets.member(EVENTS, seven, then)).select("id")
    return buckets.refreshed(old, rows, EVENTS, "7d", then - seven.duration, now, then)


@query(
    "bucket_audit",
    f"""WITH tr AS (SELECT b AS bucket, id FROM {E_SQL} t JOIN (VALUES ('24h', 86400), ('7d', 604800), ('14d', 1209600), ('30d', 2592000)) v(b, d) ON ts BETWEEN {NOW - 86400} - d AND {NOW - 86400}),
 k AS (SELECT b AS bucket, id FROM {E_SQL} t JOIN (VALUES ('24h', 86400), ('7d', 604800), ('14d', 1209600), ('30d', 2592000)) v(b, d) ON ts BETWEEN {NOW - 2 * 86400} - d AND {NOW - 2 * 86400})
 SELECT bucket, count(*) FILTER (WHERE k.id IS NOT NULL) AS n, count(*) FILTER (WHERE k.id IS NULL) AS n_missing, count(*) FILTER (WHERE tr.id IS NULL) AS n_stale,
 min(tr.id) FILTER (WHERE k.id IS NULL) AS first_missing FROM tr FULL JOIN k USING (bucket, id) GROUP BY 1""",
)
def bucket_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf)
    kept = buckets.memberships(rows, EVENTS, NOW - 2 * 86_400)
    found = buckets.audit(rows, kept, EVENTS, NOW - 86_400, 10)
    return found.select("bucket", "n", "n_missing", "n_stale", F.get("missing", F.lit(0)).alias("first_missing"))


_DEFERRED = EVENTS.replace(time=TimeSpec(deferred="ts"))


@query("deferred_visible", f"SELECT id FROM {E_SQL} t WHERE kind = 'click' AND ts <= {NOW - 15 * 86400}")
def deferred_visible(spark: SparkSession, sf: str) -> DataFrame:
    return matching(events(spark, sf), (Eq("kind", "click"),), _DEFERRED, NOW - 15 * 86_400).select("id")


@query("deferred_due", f"SELECT id FROM {E_SQL} t WHERE ts > {NOW - 86400 * 16} AND ts <= {NOW - 86400 * 15}")
def deferred_due(spark: SparkSession, sf: str) -> DataFrame:
    return buckets.due(events(spark, sf), _DEFERRED, NOW - 16 * 86_400, NOW - 15 * 86_400).select("id")


# --- writes ----------------------------------------------------------------------------------------

_ROW = "id, status, cust, price, prio, prio2, ts"


@query("upsert", f"SELECT {_ROW} FROM {O_SQL} t WHERE id % 4 <> 0 UNION ALL SELECT id, status, NULL, price + 1, NULL, NULL, NULL FROM {O_SQL} t WHERE id % 4 = 0 OR false")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = orders(spark, sf)
    return mutate.put(rows.where("id % 8 <> 0"), rows.where("id % 4 = 0").select("id", "status", (F.col("price") + 1).alias("price")), ORDERS)


@query("patch", f"SELECT id, status, CASE WHEN id % 3 = 0 THEN -cust ELSE cust END AS cust, CASE WHEN id % 3 = 0 THEN NULL ELSE price END AS price, prio, prio2, ts FROM {O_SQL} t")
def patch(spark: SparkSession, sf: str) -> DataFrame:
    rows = orders(spark, sf)
    return mutate.patch(rows, rows.where("id % 3 = 0").select("id", (-F.col("cust")).alias("cust"), F.lit(None).cast("long").alias("price")), ORDERS)


@query("delete_ids", f"SELECT {_ROW} FROM {O_SQL} t WHERE id % 3 <> 0")
def delete_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = orders(spark, sf)
    return mutate.delete(rows, rows.where("id % 3 = 0").select("id"), ORDERS)


@query("delete_where", f"SELECT {_ROW} FROM {O_SQL} t WHERE NOT coalesce(prio = '1-URGENT' AND price < 20000000, false)")
def delete_where(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.delete_where(orders(spark, sf), (Eq("prio", "1-URGENT"), Lt("price", 20_000_000)), ORDERS)


@query("filter_sync", f"SELECT id, CASE WHEN id % 2 = 0 THEN [id % 9, 100 + id % 9] ELSE supps END AS supps, qty FROM {B_SQL} t")
def filter_sync(spark: SparkSession, sf: str) -> DataFrame:
    rows = baskets(spark, sf)
    sets = rows.where("id % 2 = 0").select("id", F.array(F.col("id") % 9, 100 + F.col("id") % 9).alias("supps"))
    return mutate.filter_sync(rows, sets, "supps", BASKETS)


@query("backfill", f"SELECT o.id, o.price, coalesce(b.supps, []) AS supps FROM {O_SQL} o LEFT JOIN {B_SQL} b ON o.id = b.id")
def backfill(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_suppkey")
    return dump.backfill(orders(spark, sf).select("id", "price"), pairs, "supps", "l_suppkey")


@query("store_overlay", f"SELECT id, CASE WHEN id % 6 = 0 THEN price + 2 WHEN id % 2 = 0 THEN price + 1 ELSE price END AS price FROM {O_SQL} t WHERE id % 10 <> 0")
def store_overlay(spark: SparkSession, sf: str) -> DataFrame:
    rows = orders(spark, sf).select("id", "price")
    keep = F.lit(False).alias("_deleted")
    one = rows.where("id % 2 = 0").select("id", (F.col("price") + 1).alias("price"), keep)
    two = rows.where("id % 6 = 0").select("id", (F.col("price") + 2).alias("price"), keep)
    gone = rows.where("id % 10 = 0").select("id", "price", F.lit(True).alias("_deleted"))
    return overlaid(rows, [one, two, gone], ORDERS)


@query("prefilter", f"SELECT id FROM {O_SQL} t WHERE status = 'F' AND price > 10000000 AND cust < 700")
def prefilter(spark: SparkSession, sf: str) -> DataFrame:
    rows, sets = orders(spark, sf), Prefilters()
    sets.register("dear", (Gt("price", 10_000_000), Eq("status", "F")), rows, ORDERS)
    table, rest = sets.apply(rows, (And((Eq("status", "F"), Gt("price", 10_000_000))), Lt("cust", 700)), ORDERS)
    return matching(table, rest, ORDERS).select("id")


# --- operations ------------------------------------------------------------------------------------

_OPS = IndexSpec("users", (FieldSpec("score", sort=True, filter="single_value"), FieldSpec("kind", filter="single_value", value_type="low_cardinality_string", nullable=True), FieldSpec("tags", filter="multi_value", value_type="integer_array")))


def _op_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Events as operations on their users: clicks set the score, views add a tag, other kinds remove it; some delete."""
    e = events(spark, sf)
    tag = (F.col("cents") % 5).alias("tag")
    ops = (
        F.when(F.col("kind") == "click", F.array(op("set", "score", F.col("cents")), op("set", "kind", F.col("kind"))))
        .when((F.col("id") % 997) == 0, F.array(op("delete")))
        .when(F.col("kind") == "view", F.array(op("add", "tags", tag)))
        .otherwise(F.array(op("remove", "tags", tag)))
    )
    return e.select(F.col("user").alias("entity_id"), F.col("id").alias("seq"), F.lit(True).alias("creates_slot"), ops.alias("ops"))


_FLAT_SQL = f"""fl AS (SELECT "user" AS u, id AS seq, CASE WHEN kind = 'click' THEN 'c' WHEN id % 997 = 0 THEN 'd' WHEN kind = 'view' THEN 'a' ELSE 'r' END AS k, cents, cents % 5 AS tag FROM {E_SQL} t),
 dead AS (SELECT DISTINCT u FROM fl WHERE k = 'd'), li AS (SELECT * FROM fl WHERE u NOT IN (SELECT u FROM dead)),
 sc AS (SELECT u, arg_max(cents, seq) AS score FROM li WHERE k = 'c' GROUP BY 1),
 tg AS (SELECT u, tag, sum(CASE k WHEN 'a' THEN 1 ELSE -1 END) AS net FROM li WHERE k IN ('a', 'r') GROUP BY 1, 2 HAVING sum(CASE k WHEN 'a' THEN 1 ELSE -1 END) <> 0)"""


@query(
    "ops_dedup",
    f"""WITH {_FLAT_SQL} SELECT u AS entity_id, 'set' AS op, 'score' AS field, score::VARCHAR AS value FROM sc UNION ALL SELECT u, 'set', 'kind', '"click"' FROM sc
 UNION ALL SELECT u, CASE WHEN net > 0 THEN 'add' ELSE 'remove' END, 'tags', tag::VARCHAR FROM tg UNION ALL SELECT u, 'delete', NULL, NULL FROM dead""",
)
def ops_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return op_batches.dedup(op_batches.flat(_op_batch(spark, sf)), _OPS).select("entity_id", "op", "field", "value")


def _user_table(spark: SparkSession, sf: str) -> DataFrame:
    users = _read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(5).cast("long").alias("score"), F.lit(None).cast("string").alias("kind"), F.array((F.col("c_custkey") % 5)).alias("tags"))
    return users


_FOLD_SQL = f"""{_FLAT_SQL}, ids AS (SELECT c_custkey AS u FROM customer UNION SELECT u FROM li),
 fo AS (SELECT i.u AS id, coalesce(sc.score, CASE WHEN c_custkey IS NOT NULL THEN 5 END) AS score, CASE WHEN sc.u IS NOT NULL THEN 'click' END AS kind,
 list_sort(list_distinct(list_concat(list_filter(CASE WHEN c_custkey IS NOT NULL THEN [c_custkey % 5] ELSE [] END, lambda x: NOT list_contains(coalesce(rm, []), x)), coalesce(ad, [])))) AS tags
 FROM ids i LEFT JOIN customer ON c_custkey = i.u LEFT JOIN sc ON sc.u = i.u LEFT JOIN (SELECT u, list(tag) FILTER (WHERE net > 0) AS ad, list(tag) FILTER (WHERE net < 0) AS rm FROM tg GROUP BY 1) g ON g.u = i.u
 WHERE i.u NOT IN (SELECT u FROM dead))"""


@query("ops_fold", f"WITH {_FOLD_SQL} SELECT id, score, kind, tags FROM fo")
def ops_fold(spark: SparkSession, sf: str) -> DataFrame:
    return op_batches.apply(_user_table(spark, sf), _op_batch(spark, sf), _OPS)


@query("ops_fanout", f"WITH {_FOLD_SQL} SELECT id, CASE WHEN kind = 'click' AND list_has_any(tags, [3, 4]) THEN -1 ELSE score END AS score, kind, CASE WHEN list_contains(tags, 2) THEN list_sort(list_distinct(list_append(tags, 77))) ELSE tags END AS tags FROM fo")
def ops_fanout(spark: SparkSession, sf: str) -> DataFrame:
    def fan(seq: int, text: str, ops: str) -> DataFrame:
        one = op("queryOpSet", query=F.lit(text), ops=F.lit(ops))
        return spark.range(1).select(F.lit(1_000_000_000 + seq).cast("long").alias("entity_id"), F.lit(1_000_000_000 + seq).cast("long").alias("seq"), F.lit(False).alias("creates_slot"), F.array(one).alias("ops"))

    batch = _op_batch(spark, sf)
    batch = batch.union(fan(1, "kind eq Click AND tags in [3, 4]", '[{"op":"set","field":"score","value":"9"},{"op":"set","field":"score","value":"-1"}]')).union(fan(2, "tags eq 2", '[{"op":"add","field":"tags","value":"77"}]'))
    return op_batches.apply(_user_table(spark, sf), batch, _OPS)


@query(
    "ops_multi_set",
    f"""WITH e AS (SELECT "user" AS u, id, cents % 5 AS tag, CASE WHEN kind = 'click' THEN 's' WHEN kind = 'view' THEN 'a' ELSE 'r' END AS k FROM {E_SQL} t),
 ls AS (SELECT u, max(id) AS at, arg_max(tag, id) AS tag FROM e WHERE k = 's' GROUP BY 1),
 af AS (SELECT e.u, e.tag, arg_max(e.k, e.id) AS last, sum(CASE e.k WHEN 'a' THEN 1 ELSE -1 END) AS net, ls.u IS NOT NULL AS was FROM e LEFT JOIN ls USING (u) WHERE k <> 's' AND (ls.at IS NULL OR e.id > ls.at) GROUP BY 1, 2, 5),
 g AS (SELECT u, coalesce(list(tag) FILTER (WHERE CASE WHEN was THEN last = 'a' ELSE net > 0 END), []) AS ad, coalesce(list(tag) FILTER (WHERE CASE WHEN was THEN last = 'r' ELSE net < 0 END), []) AS rm FROM af GROUP BY 1),
 ids AS (SELECT c_custkey AS u FROM customer UNION SELECT u FROM e)
 SELECT i.u AS id, list_sort(list_distinct(list_concat(list_filter(CASE WHEN ls.u IS NOT NULL THEN [ls.tag, 10 + ls.tag] WHEN c_custkey IS NOT NULL THEN [c_custkey % 5] ELSE [] END, lambda x: NOT list_contains(coalesce(rm, []), x)), coalesce(ad, [])))) AS tags
 FROM ids i LEFT JOIN customer ON c_custkey = i.u LEFT JOIN ls ON ls.u = i.u LEFT JOIN g ON g.u = i.u""",
)
def ops_multi_set(spark: SparkSession, sf: str) -> DataFrame:
    """Sets, adds and removes of one field of several values: what comes after the last set applies to it."""
    e = events(spark, sf)
    tag = (F.col("cents") % 5).alias("tag")
    ops = F.when(F.col("kind") == "click", F.array(op("set", "tags", F.array(tag, tag + 10)))).when(F.col("kind") == "view", F.array(op("add", "tags", tag))).otherwise(F.array(op("remove", "tags", tag)))
    batch = e.select(F.col("user").alias("entity_id"), F.col("id").alias("seq"), F.lit(True).alias("creates_slot"), ops.alias("ops"))
    return op_batches.apply(_user_table(spark, sf), batch, _OPS).select("id", "tags")


@query("ops_invalid", f"SELECT id AS seq, CASE WHEN id % 5 = 0 THEN 'unknown operation' WHEN id % 5 = 1 THEN 'id out of range' WHEN id % 5 = 2 THEN 'unknown field' ELSE 'add on a field of one value' END AS error FROM {E_SQL} t WHERE id % 5 <> 4")
def ops_invalid(spark: SparkSession, sf: str) -> DataFrame:
    """Operations that can't apply, each with its error."""
    e, k = events(spark, sf), F.col("id") % 5
    one = op("set", "score", F.col("cents"))
    ops = F.when(k == 0, F.array(op("odd", "score", F.col("cents")))).when(k == 2, F.array(op("set", "nope", F.col("cents")))).when(k == 3, F.array(op("add", "score", F.col("cents")))).otherwise(F.array(one))
    batch = e.select(F.when(k == 1, -F.col("user") - 1).otherwise(F.col("user")).alias("entity_id"), F.col("id").alias("seq"), F.lit(True).alias("creates_slot"), ops.alias("ops"))
    return op_batches.invalid(op_batches.flat(batch), _OPS).select("seq", "error")


@query("patch_pairs", f"SELECT id, CASE WHEN id % 3 = 0 THEN cust + 1 ELSE cust END AS cust, price FROM {O_SQL} t")
def patch_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Old and new values; every third old value is the row's own, and only there the new one applies."""
    rows = orders(spark, sf)
    pairs = rows.where("id % 2 = 0 OR id % 3 = 0").select("id", F.when(F.col("id") % 3 == 0, F.col("cust")).otherwise(F.col("cust") + 5).alias("old_cust"), (F.col("cust") + 1).alias("new_cust"))
    return mutate.patch_pairs(rows, pairs, ORDERS).select("id", "cust", "price")


@query("load_phases_keep", f"SELECT o.id, o.cust, coalesce(p.price, o.price) AS price FROM (SELECT id, cust, CASE WHEN id % 4 = 0 THEN cust ELSE price END AS price FROM {O_SQL} t) o LEFT JOIN (SELECT id, 7 AS price FROM {O_SQL} t WHERE id % 5 = 0) p ON o.id = p.id")
def load_phases_keep(spark: SparkSession, sf: str) -> DataFrame:
    """Two phases over a table: a phase without a value for a field leaves it as it was."""
    rows = orders(spark, sf).select("id", "cust", "price")
    one = rows.where("id % 4 = 0").select("id", F.col("cust").alias("price"))
    two = rows.where("id % 5 = 0").select("id", F.lit(7).cast("long").alias("price"))
    three = rows.where("id % 2 = 0").select("id", F.col("cust").alias("cust"))
    return mutate.patch(rows, dump.kept(dump.merged([one, two, three], "id"), "id"), ORDERS, insert=True).select("id", "cust", "price")


@query(
    "cdc_diff",
    f"""WITH a AS (SELECT * FROM {O_SQL} t WHERE id % 11 <> 0), b AS (SELECT id, status, CASE WHEN id % 3 = 0 THEN cust + 1 ELSE cust END AS cust, CASE WHEN id % 5 = 0 THEN NULL ELSE price END AS price FROM {O_SQL} t WHERE id % 13 <> 0)
 SELECT coalesce(a.id, b.id) AS entity_id, a.id IS NULL AS creates_slot, CASE WHEN b.id IS NULL THEN 1 WHEN a.id IS NULL THEN 2 + 1 + (b.price IS NOT NULL)::INT ELSE 2 * (a.cust <> b.cust)::INT + (b.price IS NULL)::INT END::INT AS n_ops
 FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.cust <> b.cust OR b.price IS NULL""",
)
def cdc_diff(spark: SparkSession, sf: str) -> DataFrame:
    old = orders(spark, sf).where("id % 11 <> 0").select("id", "status", "cust", "price")
    new = orders(spark, sf).where("id % 13 <> 0").select("id", "status", F.when(F.col("id") % 3 == 0, F.col("cust") + 1).otherwise(F.col("cust")).alias("cust"), F.when(F.col("id") % 5 != 0, F.col("price")).alias("price"))
    return changes.diff(old, new, ORDERS).select("entity_id", "creates_slot", F.size("ops").alias("n_ops"))


@query("cdc_round_trip", f"SELECT id, status, CASE WHEN id % 3 = 0 THEN cust + 1 ELSE cust END AS cust, price, prio, prio2, ts FROM {O_SQL} t WHERE id % 13 <> 0")
def cdc_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    rows = orders(spark, sf)
    old = rows.where("id % 11 <> 0")
    new = rows.where("id % 13 <> 0").withColumn("cust", F.when(F.col("id") % 3 == 0, F.col("cust") + 1).otherwise(F.col("cust")))
    batch = changes.diff(old, new, ORDERS).withColumn("seq", F.col("entity_id"))
    return op_batches.apply(old, batch.select("entity_id", "seq", "creates_slot", "ops"), ORDERS)


@query("rows_as_ops", f"SELECT id AS entity_id, 2 AS n_ops FROM {O_SQL} t UNION ALL SELECT l_orderkey, 1 FROM lineitem")
def rows_as_ops(spark: SparkSession, sf: str) -> DataFrame:
    a = rows_to_ops(orders(spark, sf), "id", {"price": "price", "cust": "cust"})
    b = pairs_to_ops(_read(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", "supps")
    return a.union(b).select("entity_id", F.size("ops").alias("n_ops"))


@query("parent_to_children", "SELECT o_orderkey AS entity_id, c_acctbal > 0 AS rich FROM orders JOIN customer ON c_custkey = o_custkey")
def parent_to_children(spark: SparkSession, sf: str) -> DataFrame:
    parents = _read(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("rich"))
    found = changes.parent_to_children(parents, "c_custkey", _read(spark, sf, "orders"), "o_custkey", "o_orderkey", {"rich": "rich"})
    return found.select("entity_id", (F.col("ops")[0]["value"] == "true").alias("rich"))


@query(
    "metrics_changed_only",
    f"""WITH a AS (SELECT "user", sum(CASE WHEN kind = 'click' THEN cents ELSE 0 END)::BIGINT AS clicks FROM {E_SQL} t WHERE ts < {NOW - 10 * 86400} GROUP BY 1),
 b AS (SELECT "user", sum(CASE WHEN kind = 'click' THEN cents ELSE 0 END)::BIGINT AS clicks FROM {E_SQL} t WHERE "user" IN (SELECT "user" FROM {E_SQL} w WHERE ts >= {NOW - 12 * 86400} AND ts < {NOW}) GROUP BY 1)
 SELECT b."user", b.clicks FROM b LEFT JOIN a ON a."user" = b."user" WHERE a.clicks IS DISTINCT FROM b.clicks""",
)
def metrics_changed_only(spark: SparkSession, sf: str) -> DataFrame:
    rows, sums = events(spark, sf), {"clicks": ["click"]}
    state = stats.conditional_sums(rows.where(F.col("ts") < NOW - 10 * 86_400), "user", "cents", "kind", sums)
    return reconciled(rows, state, "user", "ts", NOW - 12 * 86_400, NOW, "cents", "kind", sums)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["flagship", "oracle_sql", "queries", "sort_value"]
