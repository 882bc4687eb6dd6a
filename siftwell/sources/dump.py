"""Bulk loads from delimited files: scan, filter, lookup chains, expressions, phases.

A request describes one file and what it adds to the rows; a load runs several
requests, each a phase, and merges them on the id.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, ParseError
from ..functions.convert import valid_id
from ..functions.expressions import conditional, parse, truth, value

SEPARATORS = {"csv": ",", "tsv": "\t"}


@dataclass(frozen=True)
class Lookup:
    """A table looked up by one key; ``nested`` lookups are keyed by a column of this one.

    ``fields`` maps columns to targets, ``computed`` targets to expressions.  A row
    that fails ``where`` adds nothing, and neither do the lookups nested in it.
    """

    path: str
    key: str
    on: str
    fields: dict[str, str] = field(default_factory=dict)
    computed: dict[str, str] = field(default_factory=dict)
    where: str | None = None
    columns: tuple[str, ...] = ()
    format: str = "csv"
    nested: tuple["Lookup", ...] = ()


@dataclass(frozen=True)
class DumpRequest:
    """One file: ``fields`` maps columns to targets, ``computed`` targets to expressions,
    ``conditional`` targets to (expression, column); ``collect`` targets to columns gathered per id."""

    name: str
    path: str
    slot_field: str
    columns: tuple[str, ...] = ()
    format: str = "csv"
    fields: dict[str, str] = field(default_factory=dict)
    computed: dict[str, str] = field(default_factory=dict)
    conditional: dict[str, tuple[str, str]] = field(default_factory=dict)
    collect: dict[str, str] = field(default_factory=dict)
    where: str | None = None
    lookups: tuple[Lookup, ...] = ()

    def validate(self) -> None:
        """Raises ConfigError or ParseError for a request that can't run."""
        if not self.name or not self.slot_field:
            raise ConfigError("a dump needs a name and a slot field")
        if self.format not in SEPARATORS:
            raise ConfigError(f"unknown format {self.format}")
        if not (self.fields or self.computed or self.conditional or self.collect or self.lookups):
            raise ConfigError(f"{self.name}: nothing to load")
        texts = [self.where, *self.computed.values(), *[e for e, _ in self.conditional.values()]]
        todo = list(self.lookups)
        while todo:
            lookup = todo.pop()
            texts += [lookup.where, *lookup.computed.values()]
            todo += lookup.nested
        for text in texts:
            if text:
                try:
                    parse(text)
                except ParseError as e:
                    raise ParseError(f"{self.name}: {e}") from None


def scan(spark: SparkSession, path: str, columns: tuple[str, ...] = (), format: str = "csv") -> DataFrame:
    """All columns as text; empty is null.  Without ``columns`` the first line names them; with them, a line equal to them is dropped."""
    reader = spark.read.option("sep", SEPARATORS[format]).option("quote", '"').option("escape", '"').option("emptyValue", None).option("nullValue", "")
    if not columns:
        return reader.option("header", True).csv(path)
    rows = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path)
    header = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.lit(c)) for c in columns])
    return rows.where(~header)


def _integer(name: str) -> Column:
    return F.col(f"`{name}`").cast("string").try_cast("long")


def lookup_table(spark: SparkSession, lookup: Lookup) -> DataFrame:
    """One row for each key, the last in the file; with all of the file's columns as text."""
    rows = scan(spark, lookup.path, lookup.columns, lookup.format)
    rows = rows.withColumn("__key", _integer(lookup.key)).where("__key IS NOT NULL")
    order = F.monotonically_increasing_id()
    names = [c for c in rows.columns if c != "__key"]
    last = rows.withColumn("__at", order).groupBy("__key").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in names]), "__at").alias("row"))
    return last.select("__key", "row.*")


def enriched(table: DataFrame, lookup: Lookup, rows: DataFrame, nested: dict[str, DataFrame] | None = None, gate: Column | None = None, prefix: str = "") -> DataFrame:
    """``table`` with the lookup's targets, from ``rows`` (one for each ``__key``); nulls where the lookup adds nothing."""
    columns = [c for c in rows.columns if c != "__key"]
    tag = f"{prefix}{lookup.key}@{lookup.on}."
    right = rows.select(F.col("__key").alias(f"{tag}key"), *[F.col(f"`{c}`").alias(f"{tag}{c}") for c in columns])
    on = _integer(lookup.on) if gate is None else F.when(gate, _integer(lookup.on))
    joined = table.withColumn(f"{tag}on", on).join(right, F.col(f"`{tag}on`") == F.col(f"`{tag}key`"), "left")
    # expressions see the lookup's own columns by their names
    found = F.col(f"`{tag}key`").isNotNull()
    own = {c: f"{tag}{c}" for c in columns}

    def renamed(text: str):
        e = parse(text)
        return _rename(e, own)

    passed = found if lookup.where is None else found & truth(renamed(lookup.where))
    passed_name = f"{tag}passed"
    joined = joined.withColumn(passed_name, F.coalesce(passed, F.lit(False)))
    ok = F.col(f"`{passed_name}`")
    new = {target: F.when(ok, F.col(f"`{tag}{c}`")) for c, target in lookup.fields.items()}
    new |= {target: F.when(ok, value(renamed(text))) for target, text in lookup.computed.items()}
    out = joined.withColumns(new) if new else joined
    for child in lookup.nested:
        inner = Lookup(**{**child.__dict__, "on": f"{tag}{child.on}"})
        out = enriched(out, inner, (nested or {})[child.path], nested, ok, tag)
    return out.drop(*[c for c in out.columns if c.startswith(tag)])


def _rename(e, own: dict[str, str]):
    from ..functions.expressions import Expr

    if e.kind == "column":
        return Expr("column", (own.get(e.args[0], e.args[0]),))
    return Expr(e.kind, tuple(_rename(a, own) if isinstance(a, Expr) else a for a in e.args))


def phase(spark: SparkSession, request: DumpRequest, id: str = "id") -> DataFrame:
    """One phase: the id and the request's targets, one row for each id (the last line of an id counts; collected values are gathered)."""
    request.validate()
    rows = scan(spark, request.path, request.columns, request.format)
    return phase_of(spark, rows, request, id)


def phase_of(spark: SparkSession, rows: DataFrame, request: DumpRequest, id: str = "id") -> DataFrame:
    if request.where:
        rows = rows.where(truth(parse(request.where)))
    rows = rows.withColumn("__id", _integer(request.slot_field)).where(valid_id(F.col("__id")))
    for lookup in request.lookups:
        tables, todo = {}, [lookup]
        while todo:
            one = todo.pop()
            tables[one.path] = lookup_table(spark, one)
            todo += one.nested
        rows = enriched(rows, lookup, tables[lookup.path], tables)
    targets: dict[str, Column] = {t: F.col(f"`{c}`") for c, t in request.fields.items()}
    targets |= {t: value(parse(e)) for t, e in request.computed.items()}
    targets |= {t: conditional(parse(e), c) for t, (e, c) in request.conditional.items()}
    todo = list(request.lookups)
    while todo:
        one = todo.pop(0)
        targets |= {t: F.col(f"`{t}`") for t in [*one.fields.values(), *one.computed]}
        todo += one.nested
    collect = {t: _integer(c) for t, c in request.collect.items()}
    flat = rows.select(F.col("__id").alias(id), *[c.alias(t) for t, c in targets.items()], *[c.alias(t) for t, c in collect.items()], F.monotonically_increasing_id().alias("__at"))
    aggregates = [F.max_by(F.col(t), "__at").alias(t) for t in targets] + [F.sort_array(F.collect_set(t)).alias(t) for t in collect]
    return flat.groupBy(id).agg(*aggregates)


def merged(phases: list[DataFrame], id: str = "id") -> DataFrame:
    """All phases on their ids; of a target in several phases the later one that has a value counts."""
    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        left, right = a.alias("l"), b.alias("r")
        names = [c for c in dict.fromkeys([*a.columns, *b.columns]) if c != id]
        pick = []
        for c in names:
            sides = [F.col(f"{side}.`{c}`") for side, frame in (("r", b), ("l", a)) if c in frame.columns]
            pick.append(F.coalesce(*sides).alias(c) if len(sides) > 1 else sides[0].alias(c))
        return left.join(right, F.col(f"l.{id}") == F.col(f"r.{id}"), "full").select(F.coalesce(f"l.{id}", f"r.{id}").alias(id), *pick)

    return reduce(two, phases)


def kept(rows: DataFrame, id: str = "id") -> DataFrame:
    """Merged phases as a patch: a field that no phase has a value for stays as it was (``_present`` names the others)."""
    names = [c for c in rows.columns if c != id]
    present = F.filter(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in names]), lambda c: c.isNotNull())
    return rows.withColumn("_present", present)


def backfill(table: DataFrame, pairs: DataFrame, target: str, value_column: str, id: str = "id") -> DataFrame:
    """A filter-only multi-value field from (id, value) pairs."""
    sets = pairs.groupBy(id).agg(F.sort_array(F.collect_set(value_column)).alias(target))
    return table.drop(target).join(sets, id, "left").withColumn(target, F.coalesce(target, F.array().cast("array<bigint>")))


@dataclass
class Manifest:
    """Loads that have run, by name and a hash of their request: unchanged ones needn't run again."""

    done: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def digest(request: DumpRequest) -> str:
        import hashlib

        return hashlib.sha256(repr(request).encode()).hexdigest()

    def changed(self, request: DumpRequest) -> bool:
        return self.done.get(request.name) != self.digest(request)

    def loaded(self, request: DumpRequest) -> None:
        self.done[request.name] = self.digest(request)

    def remove(self, name: str) -> None:
        self.done.pop(name, None)
