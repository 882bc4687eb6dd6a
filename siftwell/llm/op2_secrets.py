"""Secret scan: all rules as one deterministic automaton, one pass over the bytes.

The rules' regular expressions are compiled by subset construction and
minimisation (``automata``) into one transition array.  The pass reports where a
rule has been completed; the rule's reversed automaton then runs back to where
the match began, never before the end of the rule's last match; a regular
expression anchored there gives the greedy end and the part whose length counts.

Matches are leftmost and non-overlapping for each kind.  This needs that of two
overlapping candidates of a kind the one that begins first is also completed
first, which holds for all rules here.  A match that fails its length test is
dropped but has taken its text.

Defined results: a null text is empty and has no spans; offsets count code
points; rows keep a null id; repeated rows are scanned one by one; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automata import Dfa, anchored, backwards, combined, parse
from .shared import arrow_ready, steps, text_bytes


@dataclass(frozen=True)
class Rule:
    """``least`` is the length that group ``group`` (0: the whole match) must have."""

    kind: str
    regex: str
    least: int
    group: int = 0
    fold: bool = False


#: The first three kinds, in this order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
RULES = (
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 24),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 16),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 32),
    Rule("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 27),
)


class Scanner:
    """The compiled rules."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        dfa = combined([parse(r.regex, r.fold) for r in rules])
        quiet = [s for s, a in enumerate(dfa.accepts) if not a]
        loud = [s for s, a in enumerate(dfa.accepts) if a]
        number = np.empty(len(dfa.accepts), np.int64)
        number[quiet + loud] = np.arange(len(dfa.accepts))
        #: Flat transition array; states are multiplied by 256, those that report rules come last.
        self.table: list[int] = (number[dfa.table[quiet + loud]] * 256).ravel().tolist()
        self.begin, self.loud = int(number[0]) * 256, len(quiet) * 256
        self.reports = {int(number[s]) * 256: sorted(dfa.accepts[s]) for s in loud}
        self.back = [self._lists(anchored(backwards(parse(r.regex, r.fold)))) for r in rules]
        self.exact = [re.compile(r.regex.encode(), re.IGNORECASE if r.fold else 0) for r in rules]

    @staticmethod
    def _lists(dfa: Dfa) -> tuple[list[list[int]], list[bool], int]:
        return dfa.table.tolist(), [bool(a) for a in dfa.accepts], dfa.dead()

    def start(self, rule: int, data: bytes, end: int, least: int) -> int:
        """The first position, not before ``least``, from which the rule matches up to ``end``; or -1."""
        table, accepts, dead = self.back[rule]
        s, found = 0, -1
        for at in range(end - 1, least - 1, -1):
            s = table[s][data[at]]
            if s == dead:
                break
            if accepts[s]:
                found = at
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """Byte spans (start, rule, end) in order of their starts, then rules."""
        table, loud, s = self.table, self.loud, self.begin
        done: dict[int, int] = {}
        found = []
        for at, byte in enumerate(data, 1):
            s = table[s + byte]
            if s >= loud:
                for rule in self.reports[s]:
                    after = done.get(rule, 0)
                    if at > after and (begin := self.start(rule, data, at, after)) >= 0:
                        m = self.exact[rule].match(data, begin)
                        done[rule] = m.end()
                        if len(m[self.rules[rule].group]) >= self.rules[rule].least:
                            found.append((begin, rule, m.end()))
        return sorted(found)


@lru_cache(4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans counted in code points."""
    if not spans or data.isascii():
        return spans
    to = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return [(int(to[a]), r, int(to[b])) for a, r, b in spans]


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: ``key`` and ``spans``, an array of (kind, start, end) in code points."""
    arrow_ready(df.sparkSession)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = scanner(rules)
        for b in steps(batches):
            data, offs = text_bytes(b.column(1))
            raw = data.tobytes()
            rows = []
            for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist()):
                doc = raw[lo:hi]
                rows.append([{"kind": rules[r].kind, "start": a, "end": e} for a, r, e in code_points(doc, compiled.spans(doc))])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["key", "spans"])

    kind = df.schema[key].dataType.simpleString()
    pair = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return pair.mapInArrow(look, f"key {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("key", key)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = [r.kind for r in BASE]

    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, base), F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), listed("spans").alias("spans")
    )


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLE: dict[str, str] = {}
