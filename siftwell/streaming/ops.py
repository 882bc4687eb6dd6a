"""Operation batches: validity, dedup, fold into the table, query-resolved fan-out.

A batch is a frame of ``entity_id``, ``seq``, ``creates_slot`` and ``ops`` (an array
of op, field, value, query, ops; values and nested ops are JSON text).  All steps
are aggregations that combine before they shuffle, so an entity with very many
operations needs no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.convert import mapped, valid_id, with_computed
from ..plans.lineage import cut
from ..spec import FieldSpec, IndexSpec

KINDS = ("set", "remove", "add", "delete", "alive", "queryOpSet")
_NESTED = "array<struct<op:string,field:string,value:string>>"


def flat(batch: DataFrame) -> DataFrame:
    """One row for each operation, in arrival order by (``seq``, ``pos``)."""
    return batch.select("entity_id", "seq", F.coalesce("creates_slot", F.lit(False)).alias("creates_slot"), F.posexplode("ops").alias("pos", "o")).select(
        "entity_id", "seq", "pos", "creates_slot", "o.op", "o.field", "o.value", "o.query", F.col("o.ops").alias("nested")
    )


def rescheduled(ops: DataFrame, spec: IndexSpec, now: int | None) -> DataFrame:
    """A remove of the schedule field with a value in the future is a set of that value."""
    if not spec.time.deferred or now is None:
        return ops
    future = (F.col("op") == "remove") & (F.col("field") == spec.time.deferred) & (F.col("value").try_cast("long") > now)
    return ops.withColumn("op", F.when(future, "set").otherwise(F.col("op")))


def _error(spec: IndexSpec) -> Column:
    """Why an operation can't apply, or null: unknown kind or field, add on a field of one value, id out of range."""
    names = [f.name for f in spec.fields]
    single = [f.name for f in spec.fields if not f.multi]
    on_field = F.col("op").isin("set", "remove", "add")
    error = F.when(~F.coalesce(F.col("op").isin(*KINDS), F.lit(False)), "unknown operation").when(~F.coalesce(valid_id(F.col("entity_id")), F.lit(False)), "id out of range")
    error = error.when(on_field & ~F.coalesce(F.col("field").isin(names), F.lit(False)), "unknown field").when((F.col("op") == "add") & F.col("field").isin(single), "add on a field of one value")
    return error.when((F.col("op") == "queryOpSet") & F.col("query").isNull(), "no query")


def invalid(ops: DataFrame, spec: IndexSpec) -> DataFrame:
    """Operations that can't apply, with an ``error``."""
    return ops.withColumn("error", _error(spec)).where("error IS NOT NULL")


def valid(ops: DataFrame, spec: IndexSpec) -> DataFrame:
    return ops.where(_error(spec).isNull())


def _net(ops: DataFrame, keys: list[str], multi: list[str]) -> DataFrame:
    """Field operations of each key reduced: ``op``, ``field``, ``value``, ``phase`` and ``at`` (order within the phase).

    A field of one value keeps its last set and the remove before it; after a
    last remove nothing is set.  A field of several values (``multi``) keeps its last set, and of each value what is
    left of the adds and removes after it: they apply in the order of arrival.
    """
    at = F.struct("seq", "pos")
    several = F.col("field").isin(multi)
    is_set = F.col("op") == "set"
    by_field = ops.groupBy(*keys, "field").agg(
        F.max(is_set).alias("was_set"),
        F.max(F.when(is_set, at)).alias("set_at"),
        F.max_by(F.when(is_set, F.col("value")), F.when(is_set, at)).alias("last_set"),
        F.max_by("value", F.when(F.col("op") == "remove", at)).alias("last_remove"),
        F.max(F.col("op") == "remove").alias("removes"),
        F.max_by("op", F.when(F.col("op") != "add", at)).alias("last_op"),
        F.min(at).alias("at"),
    )
    single = by_field.where(~several)
    removed = single.where("removes").select(*keys, F.lit("remove").alias("op"), "field", F.col("last_remove").alias("value"), F.lit(0).alias("phase"), "at")
    kept = by_field.where("was_set").where(several | (F.col("last_op") == "set"))
    was_set = kept.select(*keys, F.lit("set").alias("op"), "field", F.col("last_set").alias("value"), F.lit(1).alias("phase"), "at")
    # of each value the adds and removes after the field's last set: the net, which after a set is the last of them
    step = F.when(F.col("op") == "add", 1).otherwise(-1)
    sets = by_field.where("was_set").where(several).select(*keys, "field", "set_at")
    own = ops.where(~is_set & several).join(sets, [*keys, "field"], "left").where(F.col("set_at").isNull() | (at > F.col("set_at")))
    each = own.groupBy(*keys, "field", "value").agg(F.sum(step).alias("net"), F.max_by("op", at).alias("last"), F.max(at).alias("at"), F.max(F.col("set_at").isNotNull()).alias("after"))
    left = F.when(F.col("after"), F.col("last")).when(F.col("net") > 0, "add").when(F.col("net") < 0, "remove")
    many = each.select(*keys, left.alias("op"), "field", "value", F.lit(2).alias("phase"), "at").where("op IS NOT NULL")
    return removed.unionByName(was_set).unionByName(many)


def dedup(ops: DataFrame, spec: IndexSpec) -> DataFrame:
    """The batch reduced: a delete absorbs all else; of a field of one value the last operation wins, its remove first;
    of a field of several the last set and what comes after it, adds and removes of one value cancel; fan-outs of one
    query are joined and reduced in themselves."""
    multi = [f.name for f in spec.fields if f.multi]
    at = F.struct("seq", "pos")
    gone = ops.where("op = 'delete'").select("entity_id").distinct()
    rest = ops.join(gone, "entity_id", "left_anti")
    fields = _net(rest.where("op IN ('set', 'remove', 'add')"), ["entity_id"], multi)
    nothing = F.lit(None).cast("string")
    deletes = gone.select("entity_id", F.lit("delete").alias("op"), nothing.alias("field"), nothing.alias("value"), F.lit(0).alias("phase"), F.struct(F.lit(0).cast("long").alias("seq"), F.lit(0).alias("pos")).alias("at"))
    plain = fields.unionByName(deletes).withColumns({"query": nothing, "nested": nothing})
    inner = rest.where("op = 'queryOpSet' AND query IS NOT NULL").select("entity_id", "query", F.struct(F.col("seq").alias("s"), F.col("pos").alias("p")).alias("outer"), F.posexplode(F.from_json("nested", _NESTED)).alias("n", "o"))
    ordered = inner.select("entity_id", "query", F.col("outer.s").alias("seq"), F.struct(F.col("outer.p").alias("p"), F.col("n")).alias("pos"), "o.op", "o.field", "o.value")
    reduced = _net(ordered, ["entity_id", "query"], multi).withColumn("at", F.struct(F.col("at.seq").alias("seq"), F.col("at.pos.p").alias("pos"), F.col("at.pos.n").alias("n")))
    joined = reduced.groupBy("entity_id", "query").agg(F.sort_array(F.collect_list(F.struct("phase", "at", F.struct("op", "field", "value").alias("o")))).alias("all"), F.min("at").alias("at"))
    fans = joined.select("entity_id", F.lit("queryOpSet").alias("op"), nothing.alias("field"), nothing.alias("value"), F.lit(3).alias("phase"), "at", "query", F.to_json(F.transform("all", lambda x: x["o"])).alias("nested"))
    fans = fans.withColumn("at", F.struct(F.col("at.seq").alias("seq"), F.col("at.pos").alias("pos")))
    alive = ops.groupBy("entity_id").agg(F.max("creates_slot").alias("creates_slot"), F.min(at).alias("first"))
    return plain.unionByName(fans).join(alive, "entity_id")


def typed_value(value: Column, f: FieldSpec) -> Column:
    """A JSON value as the field stores it; null on a field that has no nulls is its zero."""
    null = value.isNull() | (value == "null")
    text = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"), F.lit(None))
    if f.multi:
        many = F.from_json(value, "array<bigint>")
        return F.when(value.startswith("["), F.array_distinct(many)).otherwise(F.array(text.try_cast("long")))
    if f.value_type == "exists_boolean":
        return ~null
    if f.boolean:
        return F.when(null, F.lit(None if f.nullable else False)).otherwise(text.try_cast("boolean"))
    if f.text:
        return F.when(~null, text)
    number = text.try_cast("double").try_cast("long") if f.string_map is None else F.coalesce(text.try_cast("long"), mapped(text, f))
    number = F.coalesce(text.try_cast("long"), number)
    return F.when(null, F.lit(None if f.nullable else 0).cast("long")).otherwise(number)


def fold(table: DataFrame, reduced: DataFrame, spec: IndexSpec, create: bool = True) -> DataFrame:
    """Reduced field operations and deletes applied to the table.

    Ids that aren't there become rows with ``create``, unless all they have is removes.
    """
    ops = reduced.where("op <> 'queryOpSet'")
    columns = []
    for f in spec.fields:
        if f.computed or f.name not in table.columns:
            continue
        mine = F.col("field") == f.name
        was_set = mine & (F.col("op") == "set")
        columns.append(F.max(was_set).alias(f"_set_{f.name}"))
        columns.append(F.max(F.when(was_set, F.struct("value"))).alias(f"_val_{f.name}"))
        if f.multi:
            for kind in ("add", "remove"):
                columns.append(F.collect_set(F.when(mine & (F.col("op") == kind), F.col("value").try_cast("long"))).alias(f"_{kind}_{f.name}"))
        else:
            columns.append(F.max(F.when(mine & (F.col("op") == "remove"), F.struct("value"))).alias(f"_rem_{f.name}"))
    grows = F.max(F.col("op").isin("set", "add") | F.col("creates_slot")).alias("_grows")
    changes = ops.where(valid_id(F.col("entity_id"))).groupBy("entity_id").agg(F.max(F.col("op") == "delete").alias("_gone"), grows, *columns)
    joined = table.join(changes, F.col(spec.id) == F.col("entity_id"), "full" if create else "left")
    joined = joined.where(~F.coalesce("_gone", F.lit(False)) & (F.col(spec.id).isNotNull() | F.coalesce("_grows", F.lit(False))))

    def value(name: str) -> Column:
        if name == spec.id:
            return F.coalesce(spec.id, "entity_id").alias(name)
        f = spec.field(name) if spec.has(name) else None
        if f is None or f.computed:
            return F.col(name)
        now = F.col(name)
        if f.multi:
            base = F.when(F.col(f"_set_{name}"), typed_value(F.col(f"_val_{name}.value"), f)).otherwise(now)
            empty = F.array().cast("array<bigint>")
            new = F.array_union(F.array_except(F.coalesce(base, empty), F.coalesce(f"_remove_{name}", empty)), F.coalesce(f"_add_{name}", empty))
            return F.when(F.col("entity_id").isNull(), now).otherwise(F.sort_array(new)).alias(name)
        old = typed_value(F.col(f"_rem_{name}.value"), f)
        cleared = F.col(f"_rem_{name}").isNotNull() & (now.eqNullSafe(old) if f.value_type != "exists_boolean" else F.lit(True))
        none = F.lit(False) if f.value_type == "exists_boolean" else F.lit(None)
        return F.when(F.col(f"_set_{name}"), typed_value(F.col(f"_val_{name}.value"), f)).when(cleared, none.cast(f.data_type())).otherwise(now).cast(f.data_type()).alias(name)

    return with_computed(joined.select(*map(value, table.columns)), spec)


_CONDITION = r"^\s*(\w+)\s+(eq|in)\s+(.+?)\s*$"
#: Distinct lists of (field, operator) that fan-outs of one batch may have; each is a join of its own.
MOST_SHAPES = 256


def fan_matches(table: DataFrame, fans: DataFrame, spec: IndexSpec, most: int | None = None) -> DataFrame:
    """(``fan``, ``id``): the rows that each fan-out's query reaches.

    ``fans`` has ``fan`` (a unique number) and ``query``.  Queries are taken apart in
    the plan; fan-outs with the same fields share one equi join.  Queries that
    aren't in the grammar reach nothing; with ``most``, neither do those that reach
    more rows.
    """
    parts = fans.select("fan", F.posexplode(F.split("query", " AND ")).alias("k", "c"))
    terms = parts.select("fan", "k", F.regexp_extract("c", _CONDITION, 1).alias("f"), F.regexp_extract("c", _CONDITION, 2).alias("o"), F.regexp_extract("c", _CONDITION, 3).alias("v"))
    inside = F.regexp_replace("v", r"^\[|\]$", "")
    values = F.when(F.col("o") == "in", F.filter(F.transform(F.split(inside, ","), lambda x: F.trim(x)), lambda x: x != "")).otherwise(F.array("v"))
    bare = F.transform(values, lambda x: F.regexp_replace(x, r"""^['"]|['"]$""", ""))
    lists = terms.withColumn("values", bare).groupBy("fan").agg(F.sort_array(F.collect_list(F.struct("k", "f", "values"))).alias("terms"), F.max(F.col("f") == "").alias("bad"))
    lists = lists.where("NOT bad").withColumn("shape", F.array_join(F.transform("terms", lambda t: t["f"]), ","))
    shapes = [r[0] for r in lists.select("shape").distinct().limit(MOST_SHAPES + 1).collect()]
    if len(shapes) > MOST_SHAPES:
        raise ValueError(f"more than {MOST_SHAPES} kinds of fan-out queries in one batch")
    found = None
    for shape in shapes:
        names = shape.split(",")
        if any(n != spec.id and not spec.has(n) for n in names):
            continue
        mine = lists.where(F.col("shape") == shape)
        key = names[0]

        def text(name: str, column: Column) -> Column:
            f = spec.field(name) if spec.has(name) else None
            folded = f is not None and f.text and not f.case_sensitive
            return F.lower(column) if folded else column.cast("string")

        def literals(name: str, column: Column) -> Column:
            f = spec.field(name) if spec.has(name) else None
            if f is not None and f.string_map is not None:
                return F.transform(column, lambda x: F.coalesce(x.try_cast("long"), mapped(x, f)).cast("string"))
            return F.transform(column, lambda x: F.lower(x)) if f is not None and f.text and not f.case_sensitive else column

        left = mine.select("fan", "terms", F.explode(literals(key, F.col("terms")[0]["values"])).alias("_key"))
        many = spec.has(key) and spec.field(key).multi
        wide = table.withColumn("_key", F.explode(key)).withColumn("_key", F.col("_key").cast("string")) if many else table.withColumn("_key", text(key, F.col(key)))
        hit = left.join(wide, "_key")
        for k, name in enumerate(names[1:], 1):
            wanted = literals(name, F.col("terms")[k]["values"])
            if spec.has(name) and spec.field(name).multi:
                hit = hit.where(F.arrays_overlap(F.transform(F.coalesce(F.col(name), F.array().cast("array<bigint>")), lambda x: x.cast("string")), wanted))
            else:
                hit = hit.where(F.array_contains(wanted, text(name, F.col(name))))
        one = hit.select("fan", F.col(spec.id).alias("id")).distinct()
        found = one if found is None else found.union(one)
    if found is None:
        return table.sparkSession.createDataFrame([], "fan long, id long")
    if most is not None:
        small = found.groupBy("fan").count().where(F.col("count") <= most).select("fan")
        found = found.join(small, "fan", "left_semi")
    return found


def fan_out(table: DataFrame, reduced: DataFrame, spec: IndexSpec, most: int | None = None) -> DataFrame:
    """The operations that fan-outs give to the rows they reach, as a flat batch; resolve it after direct writes are in ``table``."""
    fans = reduced.where("op = 'queryOpSet'").select(F.monotonically_increasing_id().alias("fan"), "query", "nested", F.col("at.seq").alias("seq"), F.col("at.pos").alias("at_pos"))
    pairs = fan_matches(table, fans.select("fan", "query"), spec, most)
    each = fans.select("fan", "seq", "at_pos", F.posexplode(F.from_json("nested", _NESTED)).alias("n", "o"))
    return pairs.join(each, "fan").select(
        F.col("id").alias("entity_id"), "seq", (F.col("at_pos").cast("long") * F.lit(1 << 32) + F.col("n")).alias("pos"), F.lit(False).alias("creates_slot"), "o.op", "o.field", "o.value", F.lit(None).cast("string").alias("query"), F.lit(None).cast("string").alias("nested")
    )


def apply(table: DataFrame, batch: DataFrame, spec: IndexSpec, now: int | None = None, most: int | None = None, create: bool = True) -> DataFrame:
    """One batch: direct operations first, then fan-outs against the table that these gave."""
    ops = valid(rescheduled(flat(batch), spec, now), spec)
    reduced = cut(dedup(ops, spec))  # read by several branches below
    direct = fold(table, reduced, spec, create)
    if not reduced.where("op = 'queryOpSet'").limit(1).count():
        return direct
    spread = rescheduled(fan_out(direct, reduced, spec, most), spec, now)
    return fold(direct, cut(dedup(spread, spec)), spec, create=False)


def fan_sizes(table: DataFrame, reduced: DataFrame, spec: IndexSpec) -> DataFrame:
    """``query`` and ``n``, the rows that each fan-out reaches."""
    fans = reduced.where("op = 'queryOpSet'").select(F.monotonically_increasing_id().alias("fan"), "query")
    counts = fan_matches(table, fans, spec).groupBy("fan").count()
    return fans.join(counts, "fan", "left").select("query", F.coalesce("count", F.lit(0)).alias("n"))

