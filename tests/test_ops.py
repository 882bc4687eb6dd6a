"""Operation batches against a sequential oracle, fan-outs, schedules, change capture and streams."""

import json
import random

from pyspark.sql import functions as F

from siftwell.sources.store import Cursors, TableStore
from siftwell.sources.tables import OPS_SCHEMA, append_log, read_log
from siftwell.spec import FieldSpec, IndexSpec, TimeSpec
from siftwell.streaming import changes
from siftwell.streaming import ops as op_batches
from siftwell.streaming.runs import OpsRunner, lag, windows

SPEC = IndexSpec("t", (FieldSpec("v", sort=True, filter="single_value"), FieldSpec("k", filter="single_value", value_type="low_cardinality_string", nullable=True), FieldSpec("tags", filter="multi_value", value_type="integer_array"), FieldSpec("at", filter="single_value", nullable=True), FieldSpec("hi", sort=True, computed="greatest", sources=("v", "at"))), time=TimeSpec(deferred="at"))
COLUMNS = "id long, v long, k string, tags array<bigint>, at long, hi long"


def batch(spark, *rows):
    """rows: (entity, [(op, field, value, query, nested)])"""
    flat = [(k, e, True, [{"op": o[0], "field": o[1] if len(o) > 1 else None, "value": None if len(o) < 3 else json.dumps(o[2]), "query": o[3] if len(o) > 3 else None, "ops": json.dumps([{"op": n[0], "field": n[1], "value": json.dumps(n[2])} for n in o[4]]) if len(o) > 4 else None} for o in ops]) for k, (e, ops) in enumerate(rows)]
    return spark.createDataFrame(flat, OPS_SCHEMA)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMNS)


def state(frame):
    return {r.id: (r.v, r.k, sorted(r.tags or []), r.at) for r in frame.collect()}


def test_dedup_rules(spark):
    b = batch(
        spark,
        (1, [("set", "v", 1), ("remove", "v", 0), ("set", "v", 2)]),
        (2, [("set", "v", 1), ("remove", "v", 1)]),
        (3, [("add", "tags", 1), ("add", "tags", 2), ("remove", "tags", 1)]),
        (4, [("set", "v", 1)]),
        (4, [("delete",), ("set", "v", 3)]),
        (5, [("queryOpSet", None, None, "v eq 1", [("set", "k", "a")]), ("queryOpSet", None, None, "v eq 1", [("set", "k", "b")])]),
    )
    got = sorted((r.entity_id, r.phase, r.op, r.field or "", r.value or "", r.nested or "") for r in op_batches.dedup(op_batches.flat(b), SPEC).collect())
    assert got == [
        (1, 0, "remove", "v", "0", ""),
        (1, 1, "set", "v", "2", ""),
        (2, 0, "remove", "v", "1", ""),
        (3, 2, "add", "tags", "2", ""),
        (4, 0, "delete", "", "", ""),
        (5, 3, "queryOpSet", "", "", '[{"op":"set","field":"k","value":"\\"b\\""}]'),
    ]


def test_fold_like_one_by_one(spark):
    r = random.Random(11)
    start = {i: (i, "a", [i % 3], None) for i in range(12)}
    rows, want = [], dict(start)
    for _ in range(80):
        e = r.randrange(15)
        kind = r.choice(["v", "tags", "tags", "k"])
        if kind == "v":
            rows.append((e, [("set", "v", r.randrange(9))]))
        elif kind == "k":
            rows.append((e, [("set", "k", r.choice(["a", "b", None]))]))
        else:
            rows.append((e, [("add", "tags", r.randrange(4))]))
    for e, ((o, f, v),) in rows:
        v0, k0, t0, a0 = want.get(e, (None, None, [], None))
        want[e] = (v if f == "v" else v0, v if f == "k" else k0, sorted({*t0, v}) if f == "tags" else sorted(t0), a0)
    got = op_batches.apply(table(spark, *[(i, *s, None) for i, s in start.items()]), batch(spark, *rows), SPEC)
    assert state(got) == {i: (a, b, sorted(c), d) for i, (a, b, c, d) in want.items()}


def test_sets_adds_and_removes_of_several_values(spark):
    t = table(spark, *[(i, 1, None, [9], None, 1) for i in range(1, 6)])
    b = batch(
        spark,
        (1, [("set", "tags", [1, 2]), ("add", "tags", 5)]),
        (2, [("remove", "tags", 2), ("set", "tags", [1, 2])]),
        (3, [("set", "tags", [1, 2, 3]), ("remove", "tags", 1), ("remove", "tags", 2)]),
        (4, [("add", "tags", 4), ("set", "tags", [7]), ("add", "tags", 8), ("remove", "tags", 8), ("add", "tags", 8)]),
        (5, [("set", "tags", [1]), ("add", "tags", 2), ("set", "tags", [])]),
    )
    assert {k: v[2] for k, v in state(op_batches.apply(t, b, SPEC)).items()} == {1: [1, 2, 5], 2: [1, 2], 3: [3], 4: [7, 8], 5: []}


def test_batches_like_one_by_one(spark):
    """Sets of all fields, adds and removes after a set, deletes: as if each operation was applied by itself."""
    r = random.Random(17)
    start = {i: (i, "a", [i % 3], None) for i in range(14)}
    rows, want, fresh, gone = [], {k: list(v) for k, v in start.items()}, set(), set()
    for _ in range(150):
        e = r.randrange(14)
        kind = r.choice(["v", "k", "set", "add", "add", "remove", "remove", "delete"]) if r.random() < 0.97 else "delete"
        if kind == "delete":
            if r.random() < 0.8:
                continue
            rows.append((e, [("delete",)]))
            gone.add(e)
            continue
        if kind in ("add", "remove") and e not in fresh:  # before a set, adds and removes of a value cancel; after it they follow each other
            kind = "set"
        value = r.randrange(5) if kind != "set" else sorted({r.randrange(5) for _ in range(2)})
        field = kind if kind in ("v", "k") else "tags"
        value = r.choice(["a", "b", None]) if kind == "k" else value
        rows.append((e, [("set" if kind in ("v", "k") else kind, field, value)]))
        now = want[e]
        if kind == "v":
            now[0] = value
        elif kind == "k":
            now[1] = value
        elif kind == "set":
            now[2] = value
            fresh.add(e)
        elif kind == "add":
            now[2] = sorted({*now[2], value})
        else:
            now[2] = [x for x in now[2] if x != value]
    got = state(op_batches.apply(table(spark, *[(i, *s, None) for i, s in start.items()]), batch(spark, *rows), SPEC))
    assert got == {i: (a, b, sorted(c), d) for i, (a, b, c, d) in want.items() if i not in gone}


def test_a_batch_that_was_saved_is_not_applied_again(spark, tmp_path):
    """The writer dies after the table is saved and before the cursor is."""
    store, cursors = TableStore(spark, f"file://{tmp_path}/t"), Cursors(spark, f"file://{tmp_path}/c")
    store.save(table(spark, (1, 5, None, [], None, 5)))
    runner = OpsRunner(store, SPEC, cursors)
    runner.batch(batch(spark, (1, [("add", "tags", 3)])), 7)
    again = OpsRunner(store, SPEC, Cursors(spark, f"file://{tmp_path}/lost"))
    again.batch(batch(spark, (1, [("add", "tags", 4)])), 7)
    assert state(store.load(SPEC)) == {1: (5, None, [3], None)} and store.versions() == [1, 2]


def test_removes_nulls_and_computed(spark):
    t = table(spark, (1, 5, "a", [1, 2], 9, 9), (2, 5, "a", [], None, 5), (3, 1, None, [], None, 1))
    b = batch(spark, (1, [("remove", "k", "a"), ("remove", "tags", 1)]), (2, [("remove", "k", "zzz"), ("set", "v", None)]), (3, [("set", "at", 50), ("set", "tags", [4, 4])]), (77, [("remove", "tags", 1)]), (-3, [("set", "v", 1)]), (2**33, [("set", "v", 1)]))
    got = op_batches.apply(t, b, SPEC)
    assert state(got) == {1: (5, None, [2], 9), 2: (0, "a", [], None), 3: (1, None, [4], 50), 77: (None, None, [], None)}
    assert {r.id: r.hi for r in got.collect()}[3] == 50


def test_fan_out_sees_direct_writes(spark):
    t = table(spark, (1, 5, "Aa", [1], None, 5), (2, 5, "b", [2], None, 5), (3, 6, None, [2, 3], None, 6))
    b = batch(spark, (3, [("set", "v", 5)]), (900, [("queryOpSet", None, None, "v eq 5 AND tags in [2, 9]", [("set", "k", "hit"), ("add", "tags", 8)])]), (901, [("queryOpSet", None, None, "k eq aa", [("set", "v", 1)])]), (902, [("queryOpSet", None, None, None, [("set", "v", 1)]), ("queryOpSet", None, None, "nonsense", [("set", "v", 1)])]))
    got = state(op_batches.apply(t, b, SPEC))
    assert got == {1: (1, "Aa", [1], None), 2: (5, "hit", [2, 8], None), 3: (5, "hit", [2, 3, 8], None)}
    few = state(op_batches.apply(t, b, SPEC, most=1))
    assert few[2][1] == "b" and few[1][0] == 1
    sizes = op_batches.fan_sizes(t, op_batches.dedup(op_batches.flat(b), SPEC), SPEC)
    assert {r["query"]: r.n for r in sizes.collect()}["k eq aa"] == 1


def test_future_remove_reschedules(spark):
    t = table(spark, (1, 5, None, [], 10, 10))
    got = op_batches.apply(t, batch(spark, (1, [("remove", "at", 500)])), SPEC, now=100)
    assert state(got)[1][3] == 500
    got = op_batches.apply(t, batch(spark, (1, [("remove", "at", 10)])), SPEC, now=100)
    assert state(got)[1][3] is None


def test_invalid_operations(spark):
    b = batch(spark, (1, [("add", "v", 1), ("set", "nope", 1), ("odd", "v", 1)]), (-1, [("set", "v", 1)]), (2, [("set", "v", 3)]))
    assert sorted(r.error for r in op_batches.invalid(op_batches.flat(b), SPEC).collect()) == ["add on a field of one value", "id out of range", "unknown field", "unknown operation"]


def test_diff_applies(spark):
    old = table(spark, (1, 5, "a", [1, 2], None, 5), (2, 6, "b", [], 3, 6), (3, 7, "c", [1], None, 7))
    new = table(spark, (1, 5, None, [2, 3], None, 5), (2, 6, "b", [], 3, 6), (4, 8, "d", [9], 1, 8))
    ops = changes.diff(old, new, SPEC).withColumn("seq", F.col("entity_id"))
    assert {r.entity_id for r in ops.collect()} == {1, 3, 4}
    assert state(op_batches.apply(old, ops.select("entity_id", "seq", "creates_slot", "ops"), SPEC)) == state(new)
    part = changes.diff(old, spark.createDataFrame([(1, "z")], "id long, k string"), SPEC, patch=True).collect()
    assert [(o.op, o.field) for o in part[0].ops] == [("remove", "k"), ("set", "k")]
    fans = changes.parent_to_query(spark.createDataFrame([(5, "x")], "pid long, name string"), "pid", "v", {"name": "k"}).withColumn("seq", F.lit(1).cast("long"))
    assert state(op_batches.apply(old, fans.select("entity_id", "seq", "creates_slot", "ops"), SPEC))[1][1] == "x"


def test_stream_applies_each_batch_once(spark, tmp_path):
    store, cursors = TableStore(spark, f"file://{tmp_path}/t"), Cursors(spark, f"file://{tmp_path}/c")
    store.save(table(spark, (1, 5, None, [], None, 5)))
    log = f"file://{tmp_path}/log"
    append_log(batch(spark, (1, [("set", "v", 8)]), (2, [("add", "tags", 3)])), log)
    runner = OpsRunner(store, SPEC, cursors)
    runner.start(spark, log, f"file://{tmp_path}/k", once=True).awaitTermination(120)
    assert state(store.load(SPEC)) == {1: (8, None, [], None), 2: (None, None, [3], None)}
    append_log(batch(spark, (1, [("delete",)])), log)
    runner.start(spark, log, f"file://{tmp_path}/k", once=True).awaitTermination(120)
    assert set(state(store.load(SPEC))) == {2}
    versions = store.versions()
    runner.batch(read_log(spark, log), int(cursors.get("ops")))
    assert store.versions() == versions
    assert lag(read_log(spark, log), 0).first().n == 1 and windows(0, 100, 10, 40) == [(-10, 30), (30, 70), (70, 100)]
