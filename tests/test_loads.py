"""Specifications, expressions, NDJSON, dumps with lookup chains, stores, and the engine's verbs."""

import json

import pytest
from pyspark.sql import functions as F

from siftwell.engine import Engine
from siftwell.errors import ConfigError, Conflict, FieldNotFound, InvalidValue, ParseError, RowNotFound
from siftwell.functions.expressions import conditional, parse, substituted, truth, value
from siftwell.operators import buckets, documents, mutate, stats
from siftwell.plans.ast import Eq, Gt
from siftwell.sources import dump, ndjson
from siftwell.sources.store import Cursors, TableStore
from siftwell.spec import BucketSpec, FieldSpec, IndexSpec, TimeSpec

SPEC = IndexSpec(
    "images",
    (
        FieldSpec("user", filter="single_value", source="userId"),
        FieldSpec("kind", filter="single_value", value_type="mapped_string", string_map={"image": 1, "video": 2}, source="type"),
        FieldSpec("base", filter="single_value", value_type="low_cardinality_string", nullable=True),
        FieldSpec("tags", filter="multi_value", value_type="integer_array"),
        FieldSpec("public", filter="boolean", value_type="exists_boolean", source="publishedMs"),
        FieldSpec("published", sort=True, filter="single_value", source="publishedMs", fallback="published", ms_to_seconds=True),
        FieldSpec("likes", sort=True, default=0),
        FieldSpec("existed", sort=True),
        FieldSpec("sortAt", sort=True, computed="greatest", sources=("published", "existed")),
        FieldSpec("tools", filter="multi_value", value_type="integer_array", filter_only=True),
    ),
    time=TimeSpec("sortAt", (BucketSpec("day", 86_400),), deferred=None),
)


@pytest.mark.parametrize(
    "bad",
    [
        {"name": ""}, {"name": "x", "fields": [{"name": "a"}, {"name": "a"}]}, {"name": "x", "fields": [{"name": "id"}]}, {"name": "x", "fields": [{"name": "a", "bits": 65}]}, {"name": "x", "fields": [{"name": "a", "filter": "odd"}]},
        {"name": "x", "fields": [{"name": "a", "doc_only": True, "filter_only": True}]}, {"name": "x", "fields": [{"name": "a", "computed": "sum", "sources": ["a"]}]}, {"name": "x", "fields": [{"name": "a"}], "time": {"field": "a", "buckets": [{"name": "d", "duration": 0}]}},
        {"name": "x", "max_page_size": 0}, {"name": "x", "odd": 1},
    ],
)
def test_specs_refused(bad):
    with pytest.raises(ConfigError):
        IndexSpec.from_dict(bad)


def test_spec_texts():
    text = json.dumps(SPEC.to_dict())
    assert IndexSpec.from_text(text) == SPEC and IndexSpec.from_text(text, "yaml") == SPEC
    assert IndexSpec.from_text('name = "x"\n[[fields]]\nname = "a"\nsort = true\n', "toml").field("a").sort
    with pytest.raises(FieldNotFound):
        SPEC.field("nope")


def test_expressions(spark):
    t = spark.createDataFrame([("9", "x", None, "t", ""), ("4", "7", "7", "f", "image"), (None, None, "3", "yes", "Image")], "flags string, a string, b string, c string, k string")
    cases = {
        "(flags >> 3) & 1 == 1": [True, False, False],
        "flags & 1": [1, 0, None],
        "a == b": [False, True, False],
        "a != null && b != null": [False, True, False],
        "a = null": [False, False, True],
        "k = 'image' || flags >> 3 & 1 = 1": [True, True, False],
        "c": ["t", "f", "yes"],
        "max(a, b)": [None, 7, 3],
        "c == true": [True, False, False],
        "k": [None, "image", "Image"],
    }
    for text, want in cases.items():
        assert [r[0] for r in t.select(value(parse(text))).collect()] == want, text
    assert [r[0] for r in t.select(truth(parse("c && a"))).collect()] == [True, False, False]
    assert [r[0] for r in t.select(conditional(parse("k = 'image'"), "a")).collect()] == [None, 7, None]
    for bad in ("a ==", "(a", "a >> b", "max(1)", "a b", "@"):
        with pytest.raises(ParseError):
            parse(bad)
    pair = t.alias("old").join(t.alias("new"), F.lit(True)).limit(1)
    assert pair.select(substituted("p eq {NEW.flags}/{OLD.c}")).first()[0].startswith("p eq ")


def test_ndjson(spark, tmp_path):
    lines = [
        {"id": 1, "userId": "5", "type": "IMAGE", "tags": [1, "x", 2], "publishedMs": 5999, "base": None, "likes": 3.7},
        {"id": 2, "userId": 6, "type": "other", "tags": [], "published": 9, "existed": 20},
        {"userId": 1},
        {"id": -4},
        {"id": 3},
    ]
    path = tmp_path / "in.json"
    path.write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    rows, failed = ndjson.load(spark, str(path), SPEC)
    got = {r["id"]: r.asDict() for r in rows.collect()}
    assert set(got) == {1, 2, 3} and sorted(r["problem"] for r in failed.collect()) == ["id out of range", "no id", "not JSON"]
    assert (got[1]["user"], got[1]["kind"], got[1]["tags"], got[1]["public"], got[1]["published"], got[1]["likes"], got[1]["sortAt"]) == (5, 1, [1, 2], True, 5, 3, 5)
    assert (got[2]["kind"], got[2]["tags"], got[2]["public"], got[2]["published"], got[2]["sortAt"], got[2]["likes"]) == (0, None, False, 9, 20, 0)
    raw = ndjson.read_raw(spark, str(path), SPEC).cache()
    assert tuple(ndjson.load_stats(raw, SPEC).first()) == (3, 3)


def test_dumps(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    images = put("images.csv", 'id,flags,post,url\n1,8,10,"a,b"\n2,0,11,\n3,8,x,c\nbad,1,1,1\n2,4,12,z\n')
    posts = put("posts.csv", "10,100,1\n11,101,2\n12,102,1\n12,103,2\n")
    versions = put("versions.csv", "1,SD\n2,XL\n")
    tags = put("tags.tsv", "7\t1\n7\t1\n9\t1\n8\t2\n")
    inner = dump.Lookup(versions, "vid", "version", {"base": "base"}, columns=("vid", "base"))
    outer = dump.Lookup(posts, "pid", "post", {"at": "published"}, {"old": "at == 100"}, "version = 1", ("pid", "at", "version"), nested=(inner,))
    first = dump.DumpRequest("images", images, "id", ("id", "flags", "post", "url"), fields={"url": "url"}, computed={"meta": "(flags >> 3) & 1 == 1"}, conditional={"f": ("flags != 0", "flags")}, lookups=(outer,))
    second = dump.DumpRequest("tags", tags, "image", ("tag", "image"), "tsv", collect={"tags": "tag"})
    got = {r["id"]: r.asDict() for r in dump.merged([dump.phase(spark, first), dump.phase(spark, second)]).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1]["url"], got[1]["meta"], got[1]["f"], got[1]["published"], got[1]["old"], got[1]["base"], got[1]["tags"]) == ("a,b", True, 8, "100", True, "SD", [7, 9])
    assert (got[2]["url"], got[2]["published"], got[2]["base"], got[2]["tags"]) == ("z", None, None, [8])  # the last row of key 12 fails the filter
    assert got[3]["published"] is None and got[3]["tags"] is None
    for bad in (dump.DumpRequest("", "p", "id", fields={"a": "a"}), dump.DumpRequest("x", "p", "id"), dump.DumpRequest("x", "p", "id", format="xml", fields={"a": "a"})):
        with pytest.raises(ConfigError):
            bad.validate()
    with pytest.raises(ParseError):
        dump.DumpRequest("x", "p", "id", computed={"a": "b =="}).validate()
    manifest = dump.Manifest()
    manifest.loaded(first)
    assert not manifest.changed(first) and manifest.changed(second)


def test_store(spark, tmp_path):
    spec = IndexSpec("t", (FieldSpec("v", sort=True),))
    store = TableStore(spark, f"file://{tmp_path}/t")
    rows = lambda *r: spark.createDataFrame(list(r), "id long, v long")
    assert store.versions() == [] and store.save(rows((1, 1), (2, 2), (3, 3))) == 1
    store.append(rows((2, 20), (4, 4)))
    store.append(rows((3, 0)).withColumn("_deleted", F.lit(True)))
    want = {1: 1, 2: 20, 4: 4}
    assert {r.id: r.v for r in store.load(spec).collect()} == want
    assert store.compact(spec) == 2 and {r.id: r.v for r in store.load(spec, 2).collect()} == want
    assert {r.id: r.v for r in store.load(spec, 1).collect()} == want
    cursors = Cursors(spark, f"file://{tmp_path}/c")
    assert cursors.get("a") is None
    cursors.set("a", "1")
    cursors.set("a", "2")
    assert cursors.get("a") == "2"


def test_engine(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}", clock=lambda: 1_000)
    index = engine.create(SPEC)
    with pytest.raises(Conflict):
        engine.create(SPEC)
    rows = spark.createDataFrame([(1, 5, 1, "A", [1, 2], True, 10, 7, 3), (2, 6, 2, None, [2], False, 20, 1, None), (2**40, 1, 1, "A", [], False, 1, 1, 1)], "id long, user long, kind long, base string, tags array<bigint>, public boolean, published long, likes long, existed long")
    assert [r.error for r in index.upsert(rows, cursor=("load", "7")).collect()] == ["id out of range"] and index.cursors.get("load") == "7"
    result = index.query({"filter": "tags = 2", "sort": ["likes:desc"], "include_docs": ["kind", "likes"]}, "search")
    assert result.ids == [1, 2] and result.total_matched == 2
    assert [(r.id, r.kind, r.likes) for r in result.documents.orderBy("id").collect()] == [(1, "image", 7), (2, "video", 1)]
    assert [r.user for r in index.get([2, 9, 1]).collect()] == [6, None, 5]
    index.patch(spark.createDataFrame([(1, 99)], "id long, existed long"))
    assert index.table.where("id = 1").first().sortAt == 99
    index.filter_sync(spark.createDataFrame([(1, [5, 5, 4])], "id long, tools array<bigint>"), "tools")
    assert index.table.where("id = 1").first().tools == [4, 5]
    with pytest.raises(InvalidValue):
        index.filter_sync(index.table, "tags")
    assert index.stats()["alive"] == 2 and index.matches(1, (Eq("user", 5),))
    version = index.snapshot()
    assert index.delete_where((Gt("likes", 3),)) == 1
    index.restore(version)
    assert index.table.count() == 2
    with pytest.raises(RowNotFound):
        index.delete(spark.createDataFrame([(77,)], "id long"), strict=True)
    index.delete(spark.createDataFrame([(2,)], "id long"))
    index.add_field(FieldSpec("extra", sort=True), F.col("likes") + 1)
    assert index.table.first().extra == 8
    with pytest.raises(Conflict):
        index.add_field(FieldSpec("extra"))
    index.remove_field("extra")
    index.register_prefilter("p", (Eq("user", 5),))
    assert index.query({"filter": {"user": 5}}, "compact").ids == [1]
    index.rebuild()
    assert index.bucket_rows().collect()[0][0] == "day"
    assert index.audit_buckets(index.bucket_rows()).first().n_missing == 0
    assert [r.value for r in index.dictionary("base").collect()] == ["A"]
    assert engine.list() == ["images"] and engine.formats()["default"] == "typed"
    engine.drop("images")
    with pytest.raises(FieldNotFound):
        engine.get("images")


def test_defaults_and_patches(spark):
    spec = IndexSpec("t", (FieldSpec("a", sort=True, default=5), FieldSpec("b", filter="single_value", value_type="low_cardinality_string")))
    t = spark.createDataFrame([(1, 5, "x"), (2, 6, None)], "id long, a long, b string")
    small = documents.compacted(t, spec)
    assert [r.a for r in small.orderBy("id").collect()] == [None, 6]
    assert [r.a for r in documents.shown(small, spec, None, documents.VERSION).orderBy("id").collect()] == [5, 6]
    patch = spark.createDataFrame([(1, None, "y", ["b"]), (3, 1, "z", ["a", "b"])], "id long, a long, b string, _present array<string>")
    assert sorted(tuple(r) for r in mutate.patch(t, patch, spec).collect()) == [(1, 5, "y"), (2, 6, None)]
    assert mutate.patch(t, patch, spec, insert=True).count() == 3
    pairs = spark.createDataFrame([(1, 5, 9), (2, 7, 9)], "id long, old_a long, new_a long")
    assert [r.a for r in mutate.patch_pairs(t, pairs, spec).orderBy("id").collect()] == [9, 6]
    ordered = spark.createDataFrame([(1, 1, "p", 1), (1, 2, "q", 2)], "id long, a long, b string, n long")
    assert mutate.put(t, ordered, spec, "n").where("id = 1").first().b == "q"
    assert tuple(mutate.next_ids(t, spec, t.where("id = 2")).first()) == (3, 2)
    assert stats.percentiles(t, "a").first().p50 == 5
    assert buckets.cutoff_grid(SPEC, "day", 1_000_000) == 913_500
