"""Clauses against a row-at-a-time oracle, the truth table of nulls, and random queries."""

import random

import pytest
from pyspark.sql import functions as F

from siftwell.errors import FieldNotFound, InvalidValue, QueryTooExpensive
from siftwell.operators.query import Result, page
from siftwell.plans.ast import And, Cursor, Eq, Everything, Gt, Gte, In, InBucket, IsNotNull, IsNull, Lt, Lte, Not, NotEq, NotIn, Or, Query, Sort, canonical
from siftwell.plans.compile import Prefilters, guard_ranges, matches, matching, snap, validate
from siftwell.spec import BucketSpec, FieldSpec, IndexSpec, TimeSpec

SPEC = IndexSpec(
    "t",
    (
        FieldSpec("category", filter="single_value", nullable=True),
        FieldSpec("plain", filter="single_value"),
        FieldSpec("tags", filter="multi_value", value_type="integer_array"),
        FieldSpec("active", filter="boolean", value_type="boolean"),
        FieldSpec("kind", filter="single_value", value_type="low_cardinality_string"),
        FieldSpec("code", filter="single_value", value_type="mapped_string", string_map={"Image": 1, "video": 2}),
        FieldSpec("score", filter="single_value", sort=True),
    ),
    max_page_size=1000,
)
SCHEMA = "id long, category long, plain long, tags array<bigint>, active boolean, kind string, code long, score long"


def rows(seed=1, n=300):
    r = random.Random(seed)
    maybe = lambda v: None if r.random() < 0.2 else v
    return [(i, maybe(r.randint(1, 10)), maybe(r.randint(1, 5)), maybe([r.randint(1, 9) for _ in range(r.randint(0, 4))]), maybe(r.random() < 0.5), maybe(r.choice(["Ab", "aB", "cd"])), maybe(r.randint(0, 2)), maybe(r.randint(-2, 8))) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


NAMES = [s.split()[0] for s in SCHEMA.split(", ")]


def holds(c, row) -> bool:
    """The meaning of a clause for one row."""
    v = dict(zip(NAMES, row))
    if isinstance(c, And):
        return bool(c.clauses) and all(holds(x, row) for x in c.clauses)
    if isinstance(c, Or):
        return any(holds(x, row) for x in c.clauses)
    if isinstance(c, Not):
        return not holds(c.clause, row)
    x = v[c.field]
    if isinstance(c, IsNull):
        return x is None
    if isinstance(c, IsNotNull):
        return x is not None

    def has(w):
        if c.field == "tags":
            return w in (x or [])
        if c.field == "kind":
            return x is not None and isinstance(w, str) and x.lower() == w.lower()
        if c.field == "code" and isinstance(w, str):
            return x is not None and x == {"image": 1, "video": 2}.get(w.lower())
        if c.field == "active":
            return x is not None and w in (0, 1) and x == bool(w)
        return x is not None and not isinstance(w, (str, float)) and x == w

    nullable = c.field == "category"
    if isinstance(c, Eq):
        return has(c.value)
    if isinstance(c, In):
        return any(has(w) for w in c.values)
    if isinstance(c, NotEq):
        return not has(c.value) and not (nullable and x is None)
    if isinstance(c, NotIn):
        return not any(has(w) for w in c.values) and not (nullable and x is None)
    test = {Gt: lambda a, b: a > b, Gte: lambda a, b: a >= b, Lt: lambda a, b: a < b, Lte: lambda a, b: a <= b}[type(c)]
    return any(test(w, c.value) for w in x or []) if c.field == "tags" else x is not None and test(x, c.value)


def ids(frame):
    return sorted(r.id for r in frame.select("id").collect())


@pytest.mark.parametrize("field", ["category", "plain", "kind", "tags", "active", "code"])
def test_truth_table(table, field):
    literal = {"kind": "AB", "active": True, "code": "IMAGE"}.get(field, 3)
    clauses = [Eq(field, literal), NotEq(field, literal), In(field, (literal, 7)), NotIn(field, (literal,)), NotIn(field, ()), In(field, ()), IsNull(field), IsNotNull(field)]
    clauses += [Not(c) for c in clauses]
    compiled = table.select("id", *[F.coalesce(_predicate(c), F.lit(False)).alias(f"c{k}") for k, c in enumerate(clauses)]).orderBy("id").collect()
    for got, row in zip(compiled, rows()):
        assert [got[f"c{k}"] for k in range(len(clauses))] == [holds(c, row) for c in clauses], row


def _predicate(c):
    from siftwell.plans.compile import Compiler

    return Compiler(SPEC).clause(c)


def random_clause(r, depth=0):
    k = r.randrange(12 if depth < 3 else 9)
    if k >= 9:
        inner = tuple(random_clause(r, depth + 1) for _ in range(r.randint(0, 3)))
        return And(inner) if k == 9 else Or(inner) if k == 10 else Not(random_clause(r, depth + 1))
    field = r.choice(["category", "plain", "tags", "score"])
    v = r.randint(-1, 10)
    return [Eq(field, v), NotEq(field, v), In(field, (v, v + 1)), NotIn(field, (v, v + 2)), Gt(field, v), Gte(field, v), Lt(field, v), Lte(field, v), IsNull(field)][k]


def test_random_clauses(table):
    r = random.Random(7)
    clauses = [random_clause(r) for _ in range(60)]
    got = table.select("id", *[F.coalesce(_predicate(c), F.lit(False)).alias(f"c{k}") for k, c in enumerate(clauses)]).orderBy("id").collect()
    for k, c in enumerate(clauses):
        assert [g[f"c{k}"] for g in got] == [holds(c, row) for row in rows()], c


def test_pages_cover_everything_once(table):
    for sort in (Sort("score"), Sort("score", False), None, Sort("id", False)):
        seen, cursor = [], None
        while True:
            result = Result(table, Query((NotEq("plain", 2),), sort, 37, cursor), SPEC)
            if not result.ids:
                assert result.cursor is None
                break
            seen += result.ids
            cursor = result.cursor
        down = sort is None or sort.descending
        key = (lambda row: (row[0],)) if sort is None or sort.field == "id" else (lambda row: (max(row[7] or 0, 0), row[0]))
        want = [row[0] for row in sorted((x for x in rows() if holds(NotEq("plain", 2), x)), key=key, reverse=down)]
        assert seen == want


def test_offset_total_and_caps(table):
    q = Query((Gte("score", 0),), Sort("score"), 20, None, 15)
    first = Result(table, Query((Gte("score", 0),), Sort("score"), 35), SPEC)
    second = Result(table, q, SPEC)
    assert second.ids == first.ids[15:] and second.total_matched == first.total_matched == sum(holds(Gte("score", 0), x) for x in rows())
    small = SPEC.replace(max_page_size=10)
    assert page(table, Query(limit=50), small).count() == 10
    assert page(table, Query(limit=50, offset=20), small, clamp_total=True).count() == 0
    assert Result(table, Query((), None, 5, Cursor(0, 3), 2), SPEC).ids == [2, 1, 0]


def test_errors(table):
    with pytest.raises(FieldNotFound):
        validate(Query((Or((Eq("nope", 1),)),)), SPEC)
    with pytest.raises(InvalidValue):
        matching(table, (Gt("score", 1.5),), SPEC)
    with pytest.raises(InvalidValue):
        matching(table, (Eq("id", "x"),), SPEC)
    with pytest.raises(InvalidValue):
        validate(Query(sort=Sort("plain")), SPEC)
    with pytest.raises(QueryTooExpensive):
        guard_ranges(table, (Not(Gt("score", 1)),), SPEC.replace(max_range_values=3))
    narrow, query = SPEC.replace(max_range_values=3), Query((Not(Gt("score", 1)),))
    for ask in (lambda: page(table, query, narrow), lambda: Result(table, query, narrow).total_matched):
        with pytest.raises(QueryTooExpensive):
            ask()
    sets = Prefilters()  # a range that a stored set stands for costs nothing
    sets.register("s", query.filters, table, SPEC)
    assert Result(table, query, narrow, prefilters=sets).total_matched == Result(table, query, SPEC).total_matched
    assert ids(matching(table, (Eq("plain", 1.0),), SPEC)) == [] and matches(table, 5, (Everything(),), SPEC) and not matches(table, 5_000, (), SPEC)


def test_predicates_reach_the_source(spark, table, tmp_path):
    path = str(tmp_path / "t")
    table.write.parquet(path)
    stored = spark.read.parquet(path)
    for clauses in ((Eq("plain", 3),), (NotEq("plain", 3),), (In("plain", (1, 2)),), (Gt("score", 2),), (NotEq("category", 3),)):
        plan = matching(stored, clauses, SPEC).select("id")._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: [")[1].split("]")[0]
        assert clauses[0].field in pushed and "tags" not in plan.split("ReadSchema")[1]
    plan = page(stored, Query((Eq("plain", 3),), Sort("score"), 20, None, 40), SPEC)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


NOW = 1_000_000_000
TIMED = IndexSpec("e", (FieldSpec("ts", filter="single_value", sort=True), FieldSpec("at", filter="single_value")), time=TimeSpec("ts", (BucketSpec("day", 86_400), BucketSpec("week", 604_800)), deferred="at"))


def test_snapping():
    ago = lambda s: NOW - s
    assert snap(Gte("ts", ago(86_400)), TIMED, NOW) == InBucket("ts", "day")
    assert snap(Gt("ts", ago(90_000) * 1000), TIMED, NOW) == InBucket("ts", "day")
    assert snap(Gte("ts", ago(200_000)), TIMED, NOW) == InBucket("ts", "week")
    assert snap(Gte("ts", ago(9_000_000)), TIMED, NOW) == InBucket("ts", "week")
    strict = TIMED.replace(time=TimeSpec("ts", TIMED.time.buckets, always_snap=False))
    assert snap(Gte("ts", ago(200_000)), strict, NOW) == InBucket("ts", None)
    assert snap(Lt("ts", NOW + 1), TIMED, NOW) == Everything()
    assert snap(Lte("ts", ago(600_000)), TIMED, NOW) == Not(InBucket("ts", "week"))
    assert snap(Lt("ts", ago(200_000)), TIMED, NOW) == Lt("ts", ago(200_000))
    assert snap(Not(Gte("ts", 5)), TIMED, NOW) == Not(Gte("ts", 5))
    assert snap(Or((Gte("ts", ago(86_400)), Eq("at", 1))), TIMED, NOW) == Or((InBucket("ts", "day"), Eq("at", 1)))


def test_schedule_hides_rows(spark):
    t = spark.createDataFrame([(1, 5, NOW + 5), (2, 5, NOW), (3, 5, None)], "id long, ts long, at long")
    assert ids(matching(t, (), TIMED, NOW)) == [2, 3] and ids(matching(t, (), TIMED, NOW + 5)) == [1, 2, 3]


def test_prefilters(table):
    sets = Prefilters()
    sets.register("a", (Eq("plain", 1), Gt("score", 0)), table, SPEC)
    sets.register("b", (Eq("plain", 1),), table, SPEC)
    filters = (And((Gt("score", 0), Eq("plain", 1))), NotEq("category", 2))
    left, rest = sets.apply(table, filters, SPEC)
    assert rest == (NotEq("category", 2),)
    assert ids(matching(left, rest, SPEC)) == ids(matching(table, filters, SPEC))
    with pytest.raises(InvalidValue):
        sets.register("c", (), table, SPEC)
    # ids are those of the last refresh, and a total goes through them as a page does
    query, fewer = Query((Eq("plain", 1),)), table.where("id % 2 = 0")
    whole = Result(table, query, SPEC).total_matched
    sets = Prefilters()
    sets.register("b", query.filters, fewer, SPEC, 100)
    stale = Result(table, query, SPEC, prefilters=sets)
    assert stale.total_matched == Result(fewer, query, SPEC).total_matched < whole
    assert sets.refresh_due(60, table, SPEC, 159) == [] and sets.refresh_due(60, table, SPEC, 160) == ["b"]
    assert Result(table, query, SPEC, prefilters=sets).total_matched == whole
    sets.remove("b")
    assert sets.list() == [] and sets.refresh_due(0, table, SPEC, 500) == []


def test_canonical_text():
    assert canonical(And((Eq("a", 1), And((In("b", (2, 1)), Eq("a", 1)))))) == canonical(And((In("b", (1, 2)), Eq("a", 1))))
    assert canonical(Not(Not(IsNull("x")))) == "x IS NULL"
