"""Filter, order, page: the read path."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ast import Cursor, Query, Sort
from ..plans.compile import Prefilters, guard_ranges, matching, validate
from ..spec import IndexSpec
from .documents import shown

SORT_VALUE = "_sort_value"


def sort_value(sort: Sort | None, spec: IndexSpec) -> Column:
    """What rows are ordered by: the field, 0 where it is missing or negative; without a sort the id."""
    if sort is None or sort.field == spec.id:
        return F.col(spec.id)
    return F.greatest(F.coalesce(F.col(sort.field), F.lit(0)), F.lit(0)).cast("long")


def _after(cursor: Cursor, sort: Sort | None, spec: IndexSpec) -> Column:
    """Rows that come after the cursor, in the form that reaches the source where the order is by one plain column."""
    down = sort is None or sort.descending
    key = F.col(spec.id)
    beyond = (lambda c, v: c < v) if down else (lambda c, v: c > v)
    if sort is None or sort.field == spec.id:
        return beyond(key, cursor.id)
    value = sort_value(sort, spec)
    if down and cursor.sort_value > 0:  # no value of the field that sorts as 0 ties: missing and negative ones follow
        plain = F.col(sort.field)
        rest = plain.isNull() | (plain < cursor.sort_value)
        return rest | ((plain == cursor.sort_value) & beyond(key, cursor.id))
    if not down and cursor.sort_value > 0:
        plain = F.col(sort.field)
        return (plain > cursor.sort_value) | ((plain == cursor.sort_value) & beyond(key, cursor.id))
    return beyond(value, cursor.sort_value) | ((value == cursor.sort_value) & beyond(key, cursor.id))


def ordered(rows: DataFrame, sort: Sort | None, spec: IndexSpec) -> DataFrame:
    """Rows in order, ids breaking ties in the same direction; newest ids first without a sort."""
    down = sort is None or sort.descending
    value, key = sort_value(sort, spec), F.col(spec.id)
    return rows.orderBy(*([value.desc(), key.desc()] if down else [value.asc(), key.asc()]))


def page(table: DataFrame, query: Query, spec: IndexSpec, now: int | None = None, prefilters: Prefilters | None = None, clamp_total: bool = False) -> DataFrame:
    """One page of rows, with the table's columns and ``_sort_value``.

    The limit is capped by the index's page size.  An offset counts only without a
    cursor.  ``clamp_total`` caps limit and offset together, as older engines do.
    Ranges that no prefilter stands for are guarded as the index says.
    """
    validate(query, spec)
    filters = query.filters
    if prefilters:
        table, filters = prefilters.apply(table, filters, spec)
    guard_ranges(table, filters, spec)
    rows = matching(table, filters, spec, now)
    limit, offset = min(query.limit, spec.max_page_size), query.offset or 0
    if query.cursor:
        rows, offset = rows.where(_after(query.cursor, query.sort, spec)), 0
    if clamp_total:
        limit = max(0, min(query.limit + offset, spec.max_page_size) - offset)
    rows = ordered(rows, query.sort, spec)
    if offset:
        rows = rows.offset(offset)
    return rows.limit(limit).withColumn(SORT_VALUE, sort_value(query.sort, spec))


@dataclass
class Result:
    """A page; every part is computed when it is asked for."""

    table: DataFrame
    query: Query
    spec: IndexSpec
    now: int | None = None
    prefilters: Prefilters | None = None
    versions: str | None = None
    _notes: dict = field(default_factory=dict)

    @cached_property
    def rows(self) -> DataFrame:
        return page(self.table, self.query, self.spec, self.now, self.prefilters)

    @cached_property
    def _page(self) -> list[tuple[int, int]]:
        found = ordered(self.rows, self.query.sort, self.spec).select(self.spec.id, SORT_VALUE)
        return [(r[0], r[1]) for r in found.collect()]  # a page: at most max_page_size rows

    @property
    def ids(self) -> list[int]:
        return [i for i, _ in self._page]

    @property
    def cursor(self) -> Cursor | None:
        """Where the next page begins; None after an empty page."""
        return Cursor(self._page[-1][1], self._page[-1][0]) if self._page else None

    @cached_property
    def total_matched(self) -> int:
        """Rows that the filters match, whatever the page."""
        return total(self.table, self.query, self.spec, self.now, self.prefilters)

    @cached_property
    def documents(self) -> DataFrame | None:
        """The page's rows as documents, or None if only ids are asked for."""
        wanted = self.query.include_docs
        if not wanted:
            return None
        return shown(self.rows, self.spec, None if wanted is True else wanted, self.versions)


def total(table: DataFrame, query: Query, spec: IndexSpec, now: int | None = None, prefilters: Prefilters | None = None) -> int:
    validate(query, spec)
    filters = query.filters
    if prefilters:
        table, filters = prefilters.apply(table, filters, spec)
    guard_ranges(table, filters, spec)
    return matching(table, filters, spec, now).count()
