"""The expression language of bulk loads, compiled to columns.

``a && (flags >> 13) & 1 == 1``, ``kind = 'image' || x != null``, ``max(a, b)``.
Precedence, loosest first: ``||``, ``&&``, comparison, ``&``, ``>>``.  Values come
from text columns: whole numbers, then true and false, else strings; empty is
null.  Equality is null-safe, truth is two-valued.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ParseError

_TOKEN = re.compile(r"\s*(?:(?P<op>\|\||&&|==|!=|>>|[=&(),])|(?P<int>\d+)|'(?P<str>[^']*)'|(?P<name>[A-Za-z_][A-Za-z0-9_.]*))")


@dataclass(frozen=True)
class Expr:
    """``kind`` is column, int, str, bool, null, shift, mask, eq, ne, and, or, max."""

    kind: str
    args: tuple = ()

    def columns(self) -> set[str]:
        if self.kind == "column":
            return {self.args[0]}
        return set().union(*[a.columns() for a in self.args if isinstance(a, Expr)], set())


def parse(text: str) -> Expr:
    tokens: list[tuple[str, str]] = []
    at, text = 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected character at {at} of {text!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    pos = 0

    def take(*ops: str) -> str | None:
        nonlocal pos
        if pos < len(tokens) and tokens[pos][0] == "op" and tokens[pos][1] in ops:
            pos += 1
            return tokens[pos - 1][1]
        return None

    def either() -> Expr:
        parts = [both()]
        while take("||"):
            parts.append(both())
        return parts[0] if len(parts) == 1 else Expr("or", tuple(parts))

    def both() -> Expr:
        parts = [compared()]
        while take("&&"):
            parts.append(compared())
        return parts[0] if len(parts) == 1 else Expr("and", tuple(parts))

    def compared() -> Expr:
        left = masked()
        op = take("==", "=", "!=")
        return Expr("ne" if op == "!=" else "eq", (left, masked())) if op else left

    def constant() -> int:
        nonlocal pos
        if pos < len(tokens) and tokens[pos][0] == "int":
            pos += 1
            return int(tokens[pos - 1][1])
        raise ParseError("shifts and masks need a whole number")

    def masked() -> Expr:
        e = shifted()
        while take("&"):
            e = Expr("mask", (e, constant()))
        return e

    def shifted() -> Expr:
        e = atom()
        while take(">>"):
            e = Expr("shift", (e, constant()))
        return e

    def atom() -> Expr:
        nonlocal pos
        if take("("):
            e = either()
            if not take(")"):
                raise ParseError("a parenthesis isn't closed")
            return e
        if pos >= len(tokens) or tokens[pos][0] == "op":
            raise ParseError(f"a value was expected in {text!r}")
        kind, body = tokens[pos]
        pos += 1
        if kind == "int":
            return Expr("int", (int(body),))
        if kind == "str":
            return Expr("str", (body,))
        if body in ("true", "false"):
            return Expr("bool", (body == "true",))
        if body == "null":
            return Expr("null")
        if body == "max" and take("("):
            names = []
            while True:
                if pos >= len(tokens) or tokens[pos][0] != "name":
                    raise ParseError("max takes column names")
                names.append(Expr("column", (tokens[pos][1],)))
                pos += 1
                if take(")"):
                    return Expr("max", tuple(names))
                if not take(","):
                    raise ParseError("max takes column names")
        return Expr("column", (body,))

    found = either()
    if pos < len(tokens):
        raise ParseError(f"unexpected {tokens[pos][1]!r} in {text!r}")
    return found


def _text(name: str) -> Column:
    c = F.col(f"`{name}`").cast("string")
    return F.when(c != "", c)


def _integer(e: Expr) -> Column:
    """The value as an integer: booleans are 0 and 1, strings that are no numbers null."""
    if e.kind == "column":
        c = _text(e.args[0])
        yes = F.when(c.isin("true", "t"), 1).when(c.isin("false", "f"), 0).cast("long")
        return F.coalesce(c.try_cast("long"), yes)
    if e.kind == "int":
        return F.lit(e.args[0]).cast("long")
    if e.kind == "str":
        return F.lit(e.args[0]).try_cast("long")
    if e.kind == "null":
        return F.lit(None).cast("long")
    if e.kind == "shift":
        return F.shiftright(_integer(e.args[0]), e.args[1])
    if e.kind == "mask":
        return _integer(e.args[0]).bitwiseAND(F.lit(e.args[1]).cast("long"))
    if e.kind == "max":
        columns = [_text(a.args[0]).try_cast("long") for a in e.args]
        return columns[0] if len(columns) == 1 else F.greatest(*columns)
    return truth(e).cast("long")


def _string(e: Expr) -> Column:
    if e.kind == "column":
        return _text(e.args[0])
    if e.kind == "str":
        return F.lit(e.args[0])
    return value(e).cast("string")


def _equal(a: Expr, b: Expr) -> Column:
    if a.kind == "str" or b.kind == "str":
        return _string(a).eqNullSafe(_string(b))
    if a.kind == "null" or b.kind == "null":
        return _string(a if b.kind == "null" else b).isNull()
    if a.kind == "column" and b.kind == "column":
        same = _integer(a) == _integer(b)
        return F.coalesce(same, _string(a).eqNullSafe(_string(b)))
    return _integer(a).eqNullSafe(_integer(b))


def truth(e: Expr) -> Column:
    """Two-valued: null, 0, false and the empty string are false."""
    if e.kind == "and":
        return reduce(lambda a, b: a & b, map(truth, e.args))
    if e.kind == "or":
        return reduce(lambda a, b: a | b, map(truth, e.args))
    if e.kind == "eq":
        return _equal(*e.args)
    if e.kind == "ne":
        return ~_equal(*e.args)
    if e.kind == "bool":
        return F.lit(e.args[0])
    if e.kind == "null":
        return F.lit(False)
    if e.kind == "column":
        c = _text(e.args[0])
        return F.coalesce(_integer(e) != 0, c.isNotNull())
    if e.kind == "str":
        return F.lit(bool(e.args[0]))
    return F.coalesce(_integer(e) != 0, F.lit(False))


def value(e: Expr) -> Column:
    """The expression's value, in its own type."""
    if e.kind in ("and", "or", "eq", "ne", "bool"):
        return truth(e)
    if e.kind in ("str", "column"):
        return _string(e)
    return _integer(e)


def conditional(test: Expr, column: str) -> Column:
    """The column's integer where the test holds, else nothing."""
    return F.when(truth(test), _integer(Expr("column", (column,))))


def substituted(template: str, old: str = "old", new: str = "new") -> Column:
    """``{column}``, ``{OLD.column}`` and ``{NEW.column}`` of a template replaced by the values of two frames' aliases."""
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\{(?:(OLD|NEW)\.)?([A-Za-z_]\w*)\}", template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        parts.append(F.coalesce(F.col(f"{old if m[1] == 'OLD' else new}.{m[2]}").cast("string"), F.lit("null")))
        at = m.end()
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts) if parts else F.lit("")
