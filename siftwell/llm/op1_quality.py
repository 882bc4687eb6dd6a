"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` measures every text once and stores, for each row, its measurements
and one failure bit for each rule.  A policy is a named, versioned set of rules:
its mask.  Verdicts under any policy, and what each rule rejects alone
(``ablations``), come from the stored bits by bitwise aggregation; texts are not
read again.

Nothing is shuffled: a row's words stay in its row, as arrays.  Words and 3-word
windows are compared within their text by 64-bit hashes; repeated windows are found by sorting a
text's own hashes, and only for texts in which some window occurs twice.

Defined results: a null text has no words; rows keep a null id; repeated rows are
measured one by one; an empty table gives an empty ledger and empty ablations;
other columns are carried by ``judged`` and never clash, since the row travels as
one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACES = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"

#: Failure conditions by rule, in the order of their bits, over the measurements of a ledger.
RULES: dict[str, str] = {
    "short": "n_words < 50",
    "repeated": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "shouting": "2 * n_upper_words > n_words",
    "dup_lines": "n_lines >= 6 AND 2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 18 * n_words",
    "few_distinct": "n_words >= 100 AND 10 * n_distinct_words < n_words",
}
BASE = ("short", "repeated")
#: Rules by policy and version; the newest version of a name applies where none is given.
POLICIES: dict[tuple[str, int], tuple[str, ...]] = {
    ("default", 1): ("short", "repeated", "symbols"),
    ("default", 2): ("short", "repeated", "symbols", "shouting", "dup_lines", "long_words", "few_distinct"),
    # without few_distinct: the share of distinct words falls with the length of any text, so it rejects clean books
    ("default", 3): ("short", "repeated", "symbols", "shouting", "dup_lines", "long_words"),
    ("lenient", 1): ("short", "repeated"),
    ("corpus", 1): ("short", "repeated", "symbols", "shouting", "dup_lines", "long_words"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_distinct_words")


def mask(policy: str = "default", version: int | None = None) -> int:
    """The policy's rules as bits."""
    if version is None:
        version = max(v for name, v in POLICIES if name == policy)
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy, version])


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``df`` as a struct) and the measurements of its text."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, _SPACES), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(_WORD))
    n = F.size("words")
    first = df.select(F.struct("*").alias("row"), body.alias("body"), words.alias("words"), lines.alias("lines"))
    # windows as hashes: a long text's take a few bytes each, not three words
    first = first.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    grams = F.when(n >= 3, F.transform(F.slice("hashes", F.lit(1), n - 2), lambda w, i: F.xxhash64(w, F.get("hashes", i + 1), F.get("hashes", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    second = first.select(
        "row",
        n.cast("long").alias("n_words"),
        F.char_length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        (F.char_length("body") - F.char_length(F.regexp_replace("body", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: w.rlike("^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$"))).cast("long").alias("n_upper_words"),
        F.size(F.array_distinct("hashes")).cast("long").alias("n_distinct_words"),
        grams.alias("grams"),
    )
    pair = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    third = second.select("row", *[m for m in MEASURES if m != "n_repeat_words"], F.when(F.size(F.array_distinct("grams")) < F.size("grams"), pair).otherwise(F.array().cast("array<struct<g:bigint,i:int>>")).alias("pairs"))
    again = F.transform("pairs", lambda p, k: F.when((p["g"] == F.get("pairs", k - 1)["g"]) | (p["g"] == F.get("pairs", k + 1)["g"]), p["i"]))
    places = F.sort_array(F.filter(again, lambda i: i.isNotNull()))
    empty = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(places, empty, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    # as the output of a generator the measurements are computed once: filters on them aren't pushed below it
    return third.select("row", F.inline(F.array(F.struct(*[covered.cast("long").alias(m) if m == "n_repeat_words" else F.col(m) for m in MEASURES]))))


def bits() -> Column:
    """The failure bits from the measurements."""
    return sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())), F.lit(0)).cast("long")


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """``row``, the measurements and ``bits``: the table to store."""
    found = measured(df, text)
    return found.withColumn("bits", bits())


def failed(policy_mask: int) -> Column:
    return F.col("bits").bitwiseAND(F.lit(policy_mask)) != 0


def judged(df: DataFrame, text: str = "text", policy: str = "default", version: int | None = None) -> DataFrame:
    """The rows of ``df`` that the policy keeps, with their own columns."""
    return ledger(df, text).where(~failed(mask(policy, version))).select("row.*")


def ablations(stored_ledger: DataFrame, policy: str = "default", version: int | None = None) -> DataFrame:
    """For each rule of the policy: rows that fail it, that fail it alone, and rows kept without it.

    Rows are first counted by their bits, of which there are at most 2^rules.
    """
    whole, names = mask(policy, version), list(RULES)
    counts = stored_ledger.select(F.col("bits").bitwiseAND(F.lit(whole)).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).alias("bit")) for r in POLICIES[policy, version or max(v for p, v in POLICIES if p == policy)]])
    each = counts.select("bits", "n", F.explode(rules).alias("r")).select("n", "bits", "r.rule", F.col("r.bit").cast("long").alias("bit"))

    def total(when: Column) -> Column:
        return F.sum(F.when(when, F.col("n")).otherwise(F.lit(0)))

    return each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        total((F.col("bits").bitwiseAND(F.bitwise_not("bit"))) == 0).alias("n_kept_without"),
    )


def op1_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = sum(1 << list(RULES).index(r) for r in BASE)
    return ledger(docs).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed(base).alias("base_failed"), (~failed(mask() | base)).alias("kept"), "bits"
    )


QUERIES = {"op1_quality_ledger": op1_quality_ledger}

MEASURE_SQL = r"""
  d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {table}),
  w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
               list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
  g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
  p AS (SELECT rid, least(3, i - lag(i, 1, -3) OVER (PARTITION BY rid ORDER BY i)) AS new FROM g WHERE c > 1),
  r AS (SELECT rid, sum(new) AS n FROM p GROUP BY rid),
  m AS (SELECT w.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
               (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
               len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
               coalesce(r.n, 0)::BIGINT AS n_repeat_words,
               len(list_filter(w, lambda x: regexp_matches(x, '^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$')))::BIGINT AS n_upper_words,
               len(list_distinct(w))::BIGINT AS n_distinct_words FROM w LEFT JOIN r USING (rid)),
  f AS (SELECT *, ({bits})::BIGINT AS bits FROM m)
"""


def measure_sql(table: str) -> str:
    """DuckDB CTEs d to f: the ledger of ``table``."""
    return MEASURE_SQL.replace("{table}", table).replace("{bits}", " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(RULES.values())))


ORACLE = {
    "op1_quality_ledger": f"""WITH {measure_sql("documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, (bits & {mask() | 3}) = 0 AS kept, bits FROM f"""
}
