"""The same query in every syntax, and texts that must be refused."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.errors import ParseError
from siftwell.plans.ast import And, Cursor, Eq, Gte, In, IsNotNull, IsNull, Lte, Not, NotEq, NotIn, Or, Sort
from siftwell.plans.parsers import parse_compact, parse_conditions, parse_json, parse_search, parse_typed, standard_registry

SAME = {
    "typed": [
        {"filters": [{"Eq": ["a", {"Integer": 1}]}, {"NotEq": ["b", {"String": "x"}]}], "limit": 5},
        {"filters": [{"Or": [{"In": ["t", [{"Integer": 1}, {"Integer": 2}]]}, {"Not": {"IsNull": "c"}}]}], "sort": {"field": "s", "direction": "Asc"}},
    ],
    "json": [
        {"filters": {"AND": [{"field": "a", "op": "eq", "value": 1}, {"field": "b", "op": "not_eq", "value": "x"}]}, "limit": 5},
        {"filters": {"or": [{"field": "t", "op": "in", "value": [1, 2]}, {"not": {"field": "c", "op": "eq", "value": None}}]}, "sort": {"field": "s", "direction": "asc"}},
    ],
    "compact": [{"filter": {"a": 1, "b": {"$ne": "x"}}, "limit": 5}, {"filter": {"$or": [{"t": [1, 2]}, {"$not": {"c": None}}]}, "sort": "s"}],
    "search": [{"filter": "a = 1 AND b != x", "limit": 5}, {"filter": "t IN [1, 2] OR NOT c IS NULL", "sort": ["s:asc"], "limit": 50}],
}


@pytest.mark.parametrize("k", [0, 1])
def test_equal_queries(k):
    from siftwell.plans.ast import conjuncts

    parsed = [standard_registry().parse(SAME[f][k], f) for f in SAME]
    assert len({conjuncts(q.filters) for q in parsed}) == 1 and len({(q.sort, q.limit) for q in parsed}) == 1


def test_search_grammar():
    one = lambda text: parse_search({"filter": text}).filters[0]
    assert one("a = 1 OR b = 2 AND NOT c = 3") == Or((Eq("a", 1), And((Eq("b", 2), Not(Eq("c", 3))))))
    assert one("a 1 TO 5") == And((Gte("a", 1), Lte("a", 5)))
    assert one('name = "Tim B" AND x NOT IN [1, two, ]') == And((Eq("name", "Tim B"), NotIn("x", (1, "two"))))
    assert one("a IS NOT NULL") == IsNotNull("a") and one("a = NULL") == IsNull("a") and one("a != null") == IsNotNull("a")
    assert one("a = true") == Eq("a", True) and one("a = -5") == Eq("a", -5) and one("a = 1.5") == Eq("a", 1.5)
    assert parse_search({"filter": [["a = 1", "a = 2"], "b = 3"]}).filters == (Or((Eq("a", 1), Eq("a", 2))), Eq("b", 3))
    paged = parse_search({"page": 3, "hitsPerPage": 20})
    assert (paged.limit, paged.offset) == (20, 40) and parse_search({}).limit == 20


def test_compact_shapes():
    q = parse_compact({"filter": {"a": {"$gte": 1, "$lte": 5}, "b": None, "c": {"$exists": True}, "d": {"$nin": [1]}}, "sort": "-s", "cursor": "34:7", "include_docs": ["a"]})
    assert q.filters == (Gte("a", 1), Lte("a", 5), IsNull("b"), IsNotNull("c"), NotIn("d", (1,)))
    assert q.sort == Sort("s") and q.cursor == Cursor(34, 7) and q.include_docs == ("a",)


@pytest.mark.parametrize(
    "format, text",
    [
        ("json", "{"), ("json", {"filters": {"AND": []}}), ("json", {"limit": 0}), ("json", {"filters": {"field": "a", "op": "not_in", "value": [1]}}), ("compact", {"filter": {"a": {"$foo": 1}}}), ("compact", {"filter": {"$or": []}}),
        ("compact", {"cursor": "x"}), ("search", {"filter": "a ="}), ("search", {"filter": "(a = 1"}), ("search", {"filter": "a = 1 b = 2"}), ("search", {"page": 0}), ("search", {"sort": ["a"]}), ("typed", {"filters": [{"Eq": ["a", 1]}]}), ("typed", {"filters": [{"Nope": []}]}), ("other", {}),
    ],
)
def test_refused(format, text):
    with pytest.raises(ParseError):
        standard_registry().parse(text, format)


def test_depth_is_bounded():
    deep = {"field": "a", "op": "eq", "value": 1}
    for _ in range(20):
        deep = {"NOT": deep}
    with pytest.raises(ParseError):
        parse_json({"filters": deep})


def test_conditions():
    assert parse_conditions("postId eq 5 AND t in [1, x]") == (Eq("postId", 5), In("t", (1, "x")))
    with pytest.raises(ParseError):
        parse_conditions("a gt 5")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab =!<>()[],'\"1AND OR NOT IN TO ", max_size=40))
def test_search_never_breaks(text):
    try:
        parse_search({"filter": text})
    except ParseError:
        pass


def test_typed_values_and_limits():
    q = parse_typed({"filters": [{"NotEq": ["a", {"Bool": True}]}], "limit": 1_000_000, "cursor": {"sort_value": 3, "slot_id": 4}})
    assert q.filters == (NotEq("a", True),) and q.limit == 10_000 and q.cursor == Cursor(3, 4)
