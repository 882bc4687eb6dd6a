"""Index specifications: which fields a table has, how they are filtered, sorted, filled and loaded.

A specification is plain data (``IndexSpec.from_dict``; also from JSON, YAML and
TOML text) and is validated as a whole.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from .errors import ConfigError, FieldNotFound

FILTERS = ("single_value", "multi_value", "boolean", None)
VALUE_TYPES = ("integer", "boolean", "string", "mapped_string", "low_cardinality_string", "integer_array", "exists_boolean")
COMPUTED = ("greatest", "least")
MAX_ID = (1 << 32) - 1


@dataclass(frozen=True)
class FieldSpec:
    """One target column.

    ``filter`` is how queries match it, ``sort`` whether they order by it.
    ``computed`` with ``sources`` makes it the greatest or least of other columns.
    """

    name: str
    filter: str | None = None
    sort: bool = False
    bits: int = 32
    value_type: str = "integer"
    source: str | None = None
    fallback: str | None = None
    string_map: dict[str, int] | None = None
    case_sensitive: bool = False
    nullable: bool = False
    doc_only: bool = False
    filter_only: bool = False
    ms_to_seconds: bool = False
    default: Any = None
    computed: str | None = None
    sources: tuple[str, ...] = ()
    since_version: int = 1

    @property
    def multi(self) -> bool:
        return self.filter == "multi_value" or self.value_type == "integer_array"

    @property
    def boolean(self) -> bool:
        return self.filter == "boolean" or self.value_type in ("boolean", "exists_boolean")

    @property
    def text(self) -> bool:
        return self.value_type in ("string", "low_cardinality_string")

    def data_type(self) -> T.DataType:
        if self.multi:
            return T.ArrayType(T.LongType())
        return T.BooleanType() if self.boolean else T.StringType() if self.text else T.LongType()

    def type_default(self) -> Any:
        """What a missing value is shown as when the field has no default of its own."""
        if self.multi:
            return []
        if self.boolean:
            return False
        return None if self.value_type in ("mapped_string", "low_cardinality_string") else "" if self.text else 0


@dataclass(frozen=True)
class BucketSpec:
    """A sliding window: rows whose time lies in the last ``duration`` seconds."""

    name: str
    duration: int
    refresh: int = 300


@dataclass(frozen=True)
class TimeSpec:
    """The field that buckets are over; ``deferred`` is the field that schedules visibility."""

    field: str | None = None
    buckets: tuple[BucketSpec, ...] = ()
    tolerance: float = 0.10
    always_snap: bool = True
    deferred: str | None = None


@dataclass(frozen=True)
class IndexSpec:
    name: str
    fields: tuple[FieldSpec, ...]
    id: str = "id"
    time: TimeSpec = field(default_factory=TimeSpec)
    max_page_size: int = 100
    max_range_values: int | None = None
    schema_version: int = 1
    #: Defaults of older schema versions: version -> field -> default.
    defaults: dict[int, dict[str, Any]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.validate()

    def validate(self) -> None:
        """Raises ConfigError on the first rule that is broken."""
        names = [f.name for f in self.fields]
        if not self.name:
            raise ConfigError("the index has no name")
        if any(not n for n in names) or len({*names, self.id}) != len(names) + 1:
            raise ConfigError("field names must be there and differ")
        for f in self.fields:
            if f.filter not in FILTERS:
                raise ConfigError(f"{f.name}: unknown filter kind {f.filter}")
            if f.value_type not in VALUE_TYPES:
                raise ConfigError(f"{f.name}: unknown value type {f.value_type}")
            if not 1 <= f.bits <= 64:
                raise ConfigError(f"{f.name}: bits must be 1 to 64")
            if f.doc_only and f.filter_only:
                raise ConfigError(f"{f.name}: doc_only and filter_only exclude each other")
            if f.computed and (f.computed not in COMPUTED or not f.sources):
                raise ConfigError(f"{f.name}: computed must be greatest or least of some sources")
            if f.computed and not set(f.sources) <= set(names):
                raise ConfigError(f"{f.name}: unknown source field")
            if f.string_map is None and f.value_type == "mapped_string":
                raise ConfigError(f"{f.name}: a mapped string needs a map")
        buckets = self.time.buckets
        if len({b.name for b in buckets}) != len(buckets):
            raise ConfigError("bucket names must differ")
        if any(b.duration <= 0 or b.refresh <= 0 for b in buckets):
            raise ConfigError("bucket durations must be positive")
        if buckets and self.time.field not in names:
            raise ConfigError("buckets need a field")
        if self.time.deferred and self.time.deferred not in names:
            raise ConfigError("the schedule field is unknown")
        if self.max_page_size <= 0 or self.schema_version < 1:
            raise ConfigError("the page size must be positive and the schema version at least 1")

    def field(self, name: str) -> FieldSpec:
        for f in self.fields:
            if f.name == name:
                return f
        raise FieldNotFound(name)

    def has(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    def schema(self) -> T.StructType:
        """The columns of the stored table."""
        return T.StructType([T.StructField(self.id, T.LongType(), False), *[T.StructField(f.name, f.data_type()) for f in self.fields]])

    def replace(self, **changes: Any) -> "IndexSpec":
        """A changed copy, validated."""
        return replace(self, **changes)

    def with_field(self, f: FieldSpec) -> "IndexSpec":
        return self.replace(fields=(*self.fields, f))

    def without_field(self, name: str) -> "IndexSpec":
        self.field(name)
        return self.replace(fields=tuple(f for f in self.fields if f.name != name))

    def default_of(self, name: str, version: int | None = None) -> Any:
        """The default of the field under a schema version; None if it has none there."""
        f = self.field(name)
        if version is not None and version != self.schema_version:
            for v in sorted(self.defaults):
                if v >= version and name in self.defaults[v]:
                    return self.defaults[v][name]
        return f.default

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, raw: dict) -> "IndexSpec":
        raw = dict(raw)
        try:
            fields = tuple(FieldSpec(**{k: tuple(v) if k == "sources" else v for k, v in f.items()}) for f in raw.pop("fields", ()))
            time = dict(raw.pop("time", None) or {})
            buckets = tuple(BucketSpec(**b) for b in time.pop("buckets", ()))
            defaults = {int(v): dict(d) for v, d in (raw.pop("defaults", None) or {}).items()}
            return cls(fields=fields, time=TimeSpec(buckets=buckets, **time), defaults=defaults, **raw)
        except TypeError as e:
            raise ConfigError(str(e)) from None

    @classmethod
    def from_text(cls, text: str, format: str = "json") -> "IndexSpec":
        if format == "json":
            return cls.from_dict(json.loads(text))
        if format == "yaml":
            import yaml

            return cls.from_dict(yaml.safe_load(text))
        if format == "toml":
            import tomllib

            return cls.from_dict(tomllib.loads(text))
        raise ConfigError(f"unknown format {format}")
