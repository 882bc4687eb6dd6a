"""Errors that callers can tell apart."""


class SiftwellError(Exception):
    """Base of all errors of this engine."""


class ConfigError(SiftwellError):
    """An index specification that can't be used."""


class FieldNotFound(SiftwellError):
    """A query or write names a field that the index doesn't have."""


class InvalidValue(SiftwellError):
    """A literal that the clause or field can't take."""


class QueryTooExpensive(SiftwellError):
    """A range over more distinct values than the index allows."""


class ParseError(SiftwellError):
    """A query text that isn't in the chosen format."""


class RowNotFound(SiftwellError):
    """A write addresses rows that aren't there."""


class Conflict(SiftwellError):
    """A name that is taken already."""
