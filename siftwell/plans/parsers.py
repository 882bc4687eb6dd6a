"""Four query syntaxes and their registry; all give ``ast.Query``.

``typed``: clauses as tagged JSON, ``{"Eq": ["f", {"Integer": 1}]}``.
``json``: ``{"field": "f", "op": "eq", "value": 1}`` with AND, OR, NOT.
``compact``: field names as keys, operators by the shape of the value.
``search``: a filter string with AND, OR, NOT, IN, TO and IS NULL.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from ..errors import ParseError
from .ast import And, Clause, Cursor, Eq, Gt, Gte, In, IsNotNull, IsNull, Lt, Lte, Not, NotEq, NotIn, Or, Query, Sort, Value

DEFAULT_LIMIT, SEARCH_LIMIT, MAX_LIMIT, MAX_DEPTH = 50, 20, 10_000, 16

Parser = Callable[[str], Query]


def _load(text: str | bytes | dict) -> dict:
    if isinstance(text, dict):
        return text
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise ParseError(f"not JSON: {e}") from None
    if not isinstance(raw, dict):
        raise ParseError("a query is a JSON object")
    return raw


def _limit(raw: Any, default: int) -> int:
    if raw is None:
        return default
    if isinstance(raw, bool) or not isinstance(raw, int) or raw <= 0:
        raise ParseError("limit must be a positive integer")
    return min(raw, MAX_LIMIT)


def _offset(raw: Any) -> int | None:
    if raw is not None and (isinstance(raw, bool) or not isinstance(raw, int) or raw < 0):
        raise ParseError("offset must be a whole number")
    return raw


def _docs(raw: Any) -> bool | tuple[str, ...]:
    if raw is None or raw is False or raw == []:
        return False
    if raw is True or raw == ["*"]:
        return True
    if isinstance(raw, list) and all(isinstance(f, str) for f in raw):
        return tuple(raw)
    raise ParseError("include_docs must be true, false or a list of fields")


def _scalar(raw: Any) -> Value:
    if isinstance(raw, (bool, int, float, str)):
        return raw
    raise ParseError(f"not a value: {raw!r}")


def _values(raw: Any) -> tuple[Value, ...]:
    if not isinstance(raw, list):
        raise ParseError("a list of values is needed")
    return tuple(map(_scalar, raw))


def _eq(field: str, raw: Any) -> Clause:
    return IsNull(field) if raw is None else Eq(field, _scalar(raw))


def _not_eq(field: str, raw: Any) -> Clause:
    return IsNotNull(field) if raw is None else NotEq(field, _scalar(raw))


def _direction(raw: Any) -> bool:
    if str(raw).lower() not in ("asc", "desc"):
        raise ParseError(f"unknown direction {raw!r}")
    return str(raw).lower() == "desc"


def _sort_object(raw: Any) -> Sort | None:
    if raw is None:
        return None
    if not isinstance(raw, dict) or not isinstance(raw.get("field"), str):
        raise ParseError("sort needs a field")
    return Sort(raw["field"], _direction(raw.get("direction", "desc")))


def _cursor_object(raw: Any) -> Cursor | None:
    if raw is None:
        return None
    try:
        return Cursor(int(raw["sort_value"]), int(raw["slot_id"] if "slot_id" in raw else raw["id"]))
    except (KeyError, TypeError, ValueError):
        raise ParseError("a cursor needs sort_value and slot_id") from None


# --- typed ---------------------------------------------------------------------------------------

_TYPED = {"Eq": Eq, "NotEq": NotEq, "Gt": Gt, "Gte": Gte, "Lt": Lt, "Lte": Lte}
_TAGS = {"Integer": int, "Float": (int, float), "Bool": bool, "String": str}


def _typed_value(raw: Any) -> Value:
    if isinstance(raw, dict) and len(raw) == 1:
        (tag, value), = raw.items()
        kind = _TAGS.get(tag)
        if kind and isinstance(value, kind) and (tag == "Bool") == isinstance(value, bool):
            return float(value) if tag == "Float" else value
    raise ParseError(f"not a typed value: {raw!r}")


def _typed_clause(raw: Any) -> Clause:
    if not isinstance(raw, dict) or len(raw) != 1:
        raise ParseError(f"not a clause: {raw!r}")
    (tag, body), = raw.items()
    try:
        if tag in _TYPED:
            field, value = body
            return _TYPED[tag](field, _typed_value(value))
        if tag in ("In", "NotIn"):
            field, values = body
            return (In if tag == "In" else NotIn)(field, tuple(map(_typed_value, values)))
        if tag in ("And", "Or"):
            return (And if tag == "And" else Or)(tuple(map(_typed_clause, body)))
        if tag == "Not":
            return Not(_typed_clause(body))
        if tag in ("IsNull", "IsNotNull"):
            return (IsNull if tag == "IsNull" else IsNotNull)(str(body))
    except (TypeError, ValueError):
        raise ParseError(f"malformed {tag}") from None
    raise ParseError(f"unknown clause {tag}")


def parse_typed(text: str | bytes | dict) -> Query:
    raw = _load(text)
    filters = raw.get("filters") or []
    if not isinstance(filters, list):
        raise ParseError("filters must be a list")
    return Query(tuple(map(_typed_clause, filters)), _sort_object(raw.get("sort")), _limit(raw.get("limit"), DEFAULT_LIMIT), _cursor_object(raw.get("cursor")), _offset(raw.get("offset")), _docs(raw.get("include_docs")))


# --- json ----------------------------------------------------------------------------------------

_OPS: dict[str, Callable[[str, Any], Clause]] = {
    "eq": _eq,
    "not_eq": _not_eq,
    "in": lambda f, v: In(f, _values(v)),
    "gt": lambda f, v: Gt(f, _scalar(v)),
    "gte": lambda f, v: Gte(f, _scalar(v)),
    "lt": lambda f, v: Lt(f, _scalar(v)),
    "lte": lambda f, v: Lte(f, _scalar(v)),
    "is_null": lambda f, v: IsNull(f),
    "is_not_null": lambda f, v: IsNotNull(f),
}


def _json_clause(raw: Any, depth: int = 0) -> Clause:
    if depth > MAX_DEPTH:
        raise ParseError(f"nested deeper than {MAX_DEPTH}")
    if not isinstance(raw, dict):
        raise ParseError(f"not a clause: {raw!r}")
    for name, kind in (("AND", And), ("OR", Or)):
        for key in (name, name.lower()):
            if key in raw:
                if not isinstance(raw[key], list) or not raw[key]:
                    raise ParseError(f"{name} needs a list of clauses")
                return kind(tuple(_json_clause(c, depth + 1) for c in raw[key]))
    for key in ("NOT", "not"):
        if key in raw:
            return Not(_json_clause(raw[key], depth + 1))
    field, op = raw.get("field"), raw.get("op")
    if not isinstance(field, str) or op not in _OPS:
        raise ParseError(f"unknown operator {op!r} or no field")
    if "value" not in raw and op not in ("is_null", "is_not_null"):
        raise ParseError(f"{op} needs a value")
    return _OPS[op](field, raw.get("value"))


def parse_json(text: str | bytes | dict) -> Query:
    raw = _load(text)
    filters = raw.get("filters")
    return Query(() if filters is None else (_json_clause(filters),), _sort_object(raw.get("sort")), _limit(raw.get("limit"), DEFAULT_LIMIT), _cursor_object(raw.get("cursor")), _offset(raw.get("offset")), _docs(raw.get("include_docs")))


# --- compact -------------------------------------------------------------------------------------

_DOLLAR: dict[str, Callable[[str, Any], Clause]] = {
    "$eq": _eq,
    "$ne": _not_eq,
    "$gt": _OPS["gt"],
    "$gte": _OPS["gte"],
    "$lt": _OPS["lt"],
    "$lte": _OPS["lte"],
    "$in": _OPS["in"],
    "$nin": lambda f, v: NotIn(f, _values(v)),
    "$exists": lambda f, v: IsNotNull(f) if v else IsNull(f),
}


def _compact_filter(raw: Any, depth: int = 0) -> tuple[Clause, ...]:
    if depth > MAX_DEPTH:
        raise ParseError(f"nested deeper than {MAX_DEPTH}")
    if not isinstance(raw, dict):
        raise ParseError("a filter is an object")
    out: list[Clause] = []
    for key, value in raw.items():
        if key in ("$or", "$and"):
            if not isinstance(value, list) or not value:
                raise ParseError(f"{key} needs a list")
            parts = tuple(_joined(_compact_filter(v, depth + 1)) for v in value)
            out.append((Or if key == "$or" else And)(parts))
        elif key == "$not":
            out.append(Not(_joined(_compact_filter(value, depth + 1))))
        elif key.startswith("$"):
            raise ParseError(f"unknown operator {key}")
        elif isinstance(value, dict):
            if not value:
                raise ParseError(f"{key} has no operator")
            for op, v in value.items():
                if op == "$not":
                    out.append(Not(_joined(_compact_filter({key: v}, depth + 1))))
                elif op not in _DOLLAR:
                    raise ParseError(f"unknown operator {op}")
                else:
                    out.append(_DOLLAR[op](key, v))
        elif isinstance(value, list):
            out.append(In(key, _values(value)))
        else:
            out.append(_eq(key, value))
    return tuple(out)


def _joined(clauses: tuple[Clause, ...]) -> Clause:
    return clauses[0] if len(clauses) == 1 else And(clauses)


def parse_compact(text: str | bytes | dict) -> Query:
    raw = _load(text)
    sort, cursor = raw.get("sort"), raw.get("cursor")
    if sort is not None:
        if not isinstance(sort, str) or not sort.lstrip("-"):
            raise ParseError("sort is a field name")
        sort = Sort(sort.lstrip("-"), sort.startswith("-"))
    if cursor is not None:
        m = re.fullmatch(r"(-?\d+):(\d+)", str(cursor))
        if not m:
            raise ParseError("a cursor is sort_value:id")
        cursor = Cursor(int(m[1]), int(m[2]))
    return Query(_compact_filter(raw.get("filter") or {}), sort, _limit(raw.get("limit"), DEFAULT_LIMIT), cursor, _offset(raw.get("offset")), _docs(raw.get("include_docs")))


# --- search --------------------------------------------------------------------------------------

_WORDS = {"AND", "OR", "NOT", "IN", "TO", "IS", "NULL", "and", "or", "not", "in", "to", "is", "null"}
_TOKEN = re.compile(r"""\s*(?:(?P<op>!=|>=|<=|[=<>()\[\],])|'(?P<s>(?:[^'\\]|\\.)*)'|"(?P<d>(?:[^"\\]|\\.)*)"|(?P<w>[^\s=<>!()\[\],'"]+))""")
_COMPARE = {"=": Eq, "!=": NotEq, ">": Gt, ">=": Gte, "<": Lt, "<=": Lte}


class _Search:
    """Recursive descent over the tokens of one filter string."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise ParseError(f"unexpected character at {at}")
            kind = m.lastgroup
            body = m[kind]
            if kind in "sd":
                kind, body = "s", re.sub(r"\\(.)", r"\1", body)
            elif kind == "w" and body in _WORDS:
                kind, body = "k", body.upper()
            self.tokens.append((kind, body))
            at = m.end()
        self.at = 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("", "")

    def take(self, *wanted: tuple[str, str]) -> tuple[str, str] | None:
        if not wanted or self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ("", "")
        return None

    def need(self, kind: str, body: str) -> None:
        if not self.take((kind, body)):
            raise ParseError(f"{body} expected, {self.peek()[1] or 'end'} found")

    def whole(self) -> Clause:
        clause = self.either()
        if self.at < len(self.tokens):
            raise ParseError(f"unexpected {self.peek()[1]}")
        return clause

    def either(self, depth: int = 0) -> Clause:
        parts = [self.both(depth)]
        while self.take(("k", "OR")):
            parts.append(self.both(depth))
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def both(self, depth: int) -> Clause:
        parts = [self.negated(depth)]
        while self.take(("k", "AND")):
            parts.append(self.negated(depth))
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def negated(self, depth: int) -> Clause:
        if depth > 4 * MAX_DEPTH:
            raise ParseError("nested too deeply")
        if self.take(("k", "NOT")):
            return Not(self.negated(depth + 1))
        if self.take(("op", "(")):
            clause = self.either(depth + 1)
            self.need("op", ")")
            return clause
        return self.condition()

    def condition(self) -> Clause:
        kind, field = self.take()
        if kind not in ("w", "s"):
            raise ParseError(f"a field was expected, {field or 'end'} found")
        kind, body = self.peek()
        if kind == "op" and body in _COMPARE:
            self.take()
            if body in ("=", "!=") and self.take(("k", "NULL")):
                return IsNull(field) if body == "=" else IsNotNull(field)
            return _COMPARE[body](field, self.value())
        if self.take(("k", "IN")):
            return In(field, self.listed())
        if (kind, body) == ("k", "NOT") and self.peek(1) == ("k", "IN"):
            self.at += 2
            return NotIn(field, self.listed())
        if self.take(("k", "IS")):
            negate = bool(self.take(("k", "NOT")))
            self.need("k", "NULL")
            return IsNotNull(field) if negate else IsNull(field)
        low = self.value()
        self.need("k", "TO")
        return And((Gte(field, low), Lte(field, self.value())))

    def value(self) -> Value:
        kind, body = self.take()
        if kind == "s":
            return body
        if kind != "w":
            raise ParseError(f"a value was expected, {body or 'end'} found")
        if body in ("true", "false"):
            return body == "true"
        if re.fullmatch(r"-?\d+", body):
            return int(body)
        if re.fullmatch(r"-?\d+\.\d+", body):
            return float(body)
        return body

    def listed(self) -> tuple[Value, ...]:
        self.need("op", "[")
        out: list[Value] = []
        while not self.take(("op", "]")):
            out.append(self.value())
            if not self.take(("op", ",")):
                self.need("op", "]")
                break
        return tuple(out)


def _search_filter(raw: Any) -> tuple[Clause, ...]:
    if raw is None or raw == "" or raw == []:
        return ()
    if isinstance(raw, str):
        return (_Search(raw).whole(),)
    if not isinstance(raw, list):
        raise ParseError("a filter is a string or a list")
    parts: list[Clause] = []
    for part in raw:
        if isinstance(part, str):
            parts.append(_Search(part).whole())
        elif isinstance(part, list) and part and all(isinstance(p, str) for p in part):
            inner = tuple(_Search(p).whole() for p in part)
            parts.append(inner[0] if len(inner) == 1 else Or(inner))
        else:
            raise ParseError("a filter list holds strings and lists of strings")
    return tuple(parts)


def parse_search(text: str | bytes | dict) -> Query:
    raw = _load(text)
    sort = raw.get("sort") or []
    if not isinstance(sort, list) or any(not isinstance(s, str) for s in sort):
        raise ParseError("sort is a list of field:direction")
    order = None
    if sort:
        field, colon, direction = sort[0].rpartition(":")
        if not colon or not field:
            raise ParseError("sort is field:direction")
        order = Sort(field, _direction(direction))
    limit, offset = _limit(raw.get("limit"), SEARCH_LIMIT), _offset(raw.get("offset"))
    if raw.get("page") is not None or raw.get("hitsPerPage") is not None:
        page, hits = raw.get("page", 1), _limit(raw.get("hitsPerPage"), SEARCH_LIMIT)
        if isinstance(page, bool) or not isinstance(page, int) or page < 1:
            raise ParseError("page counts from 1")
        limit, offset = hits, (page - 1) * hits
    return Query(_search_filter(raw.get("filter")), order, limit, None, offset, _docs(raw.get("include_docs")))


# --- condition lists of fan-outs -----------------------------------------------------------------

_PART = re.compile(r"^\s*(\w+)\s+(eq|in)\s+(.+?)\s*$")


def _bare(text: str) -> Value:
    text = text.strip()
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if re.fullmatch(r"-?\d+\.\d+", text):
        return float(text)
    if text in ("true", "false"):
        return text == "true"
    return text.strip("'\"")


def parse_conditions(text: str) -> tuple[Clause, ...]:
    """``f eq v AND f in [v, v]``: the conditions by which one change reaches many rows."""
    out: list[Clause] = []
    for part in text.split(" AND "):
        m = _PART.match(part)
        if not m:
            raise ParseError(f"not a condition: {part!r}")
        if m[2] == "eq":
            out.append(Eq(m[1], _bare(m[3])))
        else:
            if not (m[3].startswith("[") and m[3].endswith("]")):
                raise ParseError("in needs [values]")
            out.append(In(m[1], tuple(_bare(v) for v in m[3][1:-1].split(",") if v.strip())))
    return tuple(out)


class Registry:
    """Named parsers with a default."""

    def __init__(self) -> None:
        self.parsers: dict[str, Parser] = {}
        self.default = ""

    def register(self, name: str, parser: Parser) -> None:
        self.parsers[name] = parser
        self.default = self.default or name

    def set_default(self, name: str) -> None:
        self._find(name)
        self.default = name

    def formats(self) -> list[str]:
        return sorted(self.parsers)

    def _find(self, name: str) -> Parser:
        if name not in self.parsers:
            raise ParseError(f"unknown format {name}")
        return self.parsers[name]

    def parse(self, text: str | bytes | dict, format: str | None = None) -> Query:
        return self._find(format or self.default)(text)


def standard_registry() -> Registry:
    registry = Registry()
    for name, parser in (("typed", parse_typed), ("json", parse_json), ("compact", parse_compact), ("search", parse_search)):
        registry.register(name, parser)
    return registry
