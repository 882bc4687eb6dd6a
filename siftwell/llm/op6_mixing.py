"""Mixing sources to target weights by soft membership, in DataFrame and SQL functions only.

1. A naive Bayes classifier over presence and absence is fitted on labelled rows: ``labels`` gives each
   labelled document a domain (clean, low, toxic).  Features are a text's distinct
   words and coarse shape marks; those kept are frequent enough and tell the
   domains apart best, at most ``VOCABULARY`` of them, so the weight table that is
   broadcast is bounded.
2. Every document gets domain posteriors, rounded to a grid of 1/``GRID``.  Rows
   with equal posteriors form one class, so rates are found over a table whose
   size depends on the grid, not on the corpus.
3. Projected gradient descent finds nonnegative rates whose expected domain token
   totals match the targets in the least-squares sense, relative to the present
   totals.  A rate depends on the posteriors alone, so a step's sums over all documents are
   sums over the classes, whose token totals one distributed aggregation gives; there are at most
   (``GRID`` + 1) * (``GRID`` + 2) / 2 of them, whatever the size of the corpus.  Steps are accelerated,
   with restarts, and go on until the targets are met to ``CLOSE`` or nothing changes any more
   (``STILL``: the optimum of targets that can't be met).

``TARGETS`` are weights of the mixture.  The first domain sets the scale: its
target is its present total, the others' follow from the weights.

Fitting uses at most about ``SAMPLE`` labelled rows that have a document, shared out
among the domains from the smallest up: of a rare domain all rows, of the others a
share chosen by a hash of the id.  Priors are those of all labelled rows.  Smoothing
keeps a domain of few rows near the mean; none with a labelled row is left out.

Defined results: a null text has no words; without any labelled row all
posteriors are those of the first domain and all rates 1; a domain without a
labelled row gets no posterior; a label without a
document is ignored, a document without a label is only scored; of several labels
of one id the smallest domain number counts; rows keep a null id and repeated
rows their own rates; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

DOMAINS = ("clean", "low", "toxic")
# a weight of zero would take every document in the least doubt, clean ones too
TARGETS = {"clean": 0.98, "low": 0.019, "toxic": 0.001}
#: Labelled rows used for fitting, about, at most.
SAMPLE = 20_000
#: Weights kept.
VOCABULARY = 4_096
#: Labelled documents that must have a feature; or two, if they are this part of a domain's rows.
LEAST_DOCS = 15
#: Least weight times the root of the documents of a feature: below, differences are chance.
LEAST_GAIN = 6.0
#: Rows at the mean rate that each domain is taken to have besides its own.
SMOOTHING = 4.0
#: Least weight in some domain: common words differ a little between all domains, and together, so that they would outvote the telling ones.
LEAST_WEIGHT = 1.6
GRID = 32
CLOSE, STILL = 1e-6, 1e-12
#: Steps after which the descent is taken to have failed; a few thousand are usual.
MOST_STEPS = 200_000

_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def domain_of(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``domain``, the number of its label in ``DOMAINS``."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    return labels.select("doc_id", domain.alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))


def shape(body: Column) -> Column:
    """Coarse marks of a text's form; '#' keeps them apart from words."""
    size = F.greatest(F.char_length(body), F.lit(1))

    def share(pattern: str, name: str) -> Column:
        part = (size - F.char_length(F.regexp_replace(body, pattern, ""))) / size
        return F.concat(F.lit(f"#{name}"), F.least(F.lit(8), F.floor(part * 40)).cast("string"))

    return F.array(share(r"[#*$%&|<>!]+", "symbols"), share(r"[A-Z]+", "upper"))


def variety(words: Column) -> Column:
    """A coarse mark of how many of a text's words are distinct."""
    return F.concat(F.lit("#distinct"), F.floor(F.size(F.array_distinct(words)) * 10 / F.greatest(F.size(words), F.lit(1))).cast("string"))


def featured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``rid``, the key, ``n_tokens`` (words) and ``feature``, one row for each feature of a row."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.split(F.lower("body"), _SPLIT)
    one = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("doc_id"), body.alias("body"))
    two = one.select("rid", "doc_id", "body", words.alias("words"))
    n = F.size("words") - F.size(F.filter("words", lambda w: w == ""))
    three = two.select("rid", "doc_id", n.cast("long").alias("n_tokens"), F.concat(F.array_distinct("words"), shape(F.col("body")), F.array(variety(F.col("words")))).alias("features"))
    return three.select("rid", "doc_id", "n_tokens", F.explode_outer("features").alias("feature"))  # apart: what stands beside an explode is computed for each of its rows; outer: never empty, so no filter on its size need be computed below the joins


def sampled(docs: DataFrame, domains: DataFrame, key: str = "doc_id") -> tuple[DataFrame, list[int]]:
    """``doc_id`` and ``domain`` of the labels to fit on, and how many labelled rows each domain has in all."""
    ids = docs.select(F.col(key).alias("doc_id")).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    labelled = stored(ids.join(domains, "doc_id"), "labelled")
    found = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.sum("n").alias("n")).collect()}  # a row for each domain
    total = [found.get(d, 0) for d in range(len(DOMAINS))]
    left, taken = SAMPLE, F.lit(False)
    for others, d in enumerate(sorted(range(len(DOMAINS)), key=total.__getitem__)):
        part = min(total[d], left / (len(DOMAINS) - others))  # what a small domain leaves goes to the larger ones
        left -= part
        limit = int(1_000_003 * part / max(total[d], 1)) + 1
        taken |= (F.col("domain") == d) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(limit))
    return labelled.where(taken).select("doc_id", "domain"), total


def fitted(docs: DataFrame, domains: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[list[float] | None, DataFrame | None]:
    """What a text without features scores for each domain, and the weight of each feature for each domain (``w0`` ...)."""
    import math

    k = range(len(DOMAINS))
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    chosen, every = sampled(docs, domains)
    if not sum(every):
        return None, None
    texts = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "domain")
    ids = texts.groupBy("domain").count().collect()  # a row for each domain
    count = [sum(r["count"] for r in ids if r["domain"] == d) for d in k]
    total = sum(count)
    # naive Bayes over presence and absence, relative to the mean rates
    rows = featured(texts.withColumn("doc_id", F.struct("doc_id", "domain")), "doc_id", "text").select(F.col("doc_id.domain").alias("domain"), "feature")
    seen = rows.where("feature <> ''").groupBy("feature").agg(*[F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"n{d}") for d in k])
    all_n = sum((F.col(f"n{d}") for d in k), F.lit(0))
    mean = (all_n + 0.5) / F.lit(total + 1.0)
    rate = [(F.col(f"n{d}") + SMOOTHING * mean) / F.lit(count[d] + SMOOTHING) for d in k]  # a domain of few rows stays near the mean
    mean, rate = F.least(mean, F.lit(0.999)), [F.least(r, F.lit(0.999)) for r in rate]
    # what at most one row of a domain has, or would be expected to have, says nothing
    seen_by = [F.greatest(F.col(f"n{d}") - 1, F.lit(float(count[d])) * mean - 1, F.lit(0.0)) for d in k]
    trust = [F.when(c > 0, 1.0).otherwise(0.0) for c in seen_by]
    weights = [t * F.log(r * (1 - mean) / (mean * (1 - r))) for t, r in zip(trust, rate)]
    absent = [t * F.log((1 - r) / (1 - mean)) for t, r in zip(trust, rate)]
    gain = reduce(F.greatest, [F.lit(0.0)] + [F.abs(w) * F.sqrt(all_n.cast("double")) for w, c in zip(weights, count) if c])
    telling = reduce(F.greatest, [F.lit(0.0)] + [F.abs(w) for w, c in zip(weights, count) if c])
    often = reduce(lambda so_far, d: so_far | (F.col(f"n{d}") >= max(2, count[d] / LEAST_DOCS)), k, all_n >= LEAST_DOCS)  # a rare domain has its own features too
    picked = seen.where(often).select("feature", *[w.alias(f"w{d}") for d, w in zip(k, weights)], *[w.alias(f"o{d}") for d, w in zip(k, absent)], gain.alias("gain"), telling.alias("telling"))
    kept = stored(picked.where((F.col("gain") >= LEAST_GAIN) & (F.col("telling") >= LEAST_WEIGHT)).drop("telling").orderBy(F.desc("gain"), "feature").limit(VOCABULARY).drop("gain"), "weights")
    none = kept.agg(*[F.coalesce(F.sum(f"o{d}"), F.lit(0.0)) for d in k]).first()  # what a text without any feature says
    base = [math.log(c / sum(every)) + none[d] if c else -math.inf for d, c in enumerate(every)]
    return base, kept.select("feature", *[f"w{d}" for d in k])


def posteriors(docs: DataFrame, priors: list[float] | None, weights: DataFrame | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``q0`` ...: the posteriors in units of 1/``GRID``; they add up to ``GRID``."""
    k = range(len(DOMAINS))
    rows = featured(docs, key, text)
    if weights is None:
        flat = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body")).select("doc_id", F.size(F.filter(F.split(F.lower("body"), _SPLIT), lambda w: w != "")).cast("long").alias("n_tokens"))
        return flat.select("doc_id", "n_tokens", *[F.lit(GRID if d == 0 else 0).alias(f"q{d}") for d in k])
    joined = rows.join(F.broadcast(weights), "feature", "left")
    scores = joined.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), *[(F.lit(max(priors[d], -1e9)) + F.coalesce(F.sum(f"w{d}"), F.lit(0.0))).alias(f"s{d}") for d in k])
    top = reduce(F.greatest, [F.col(f"s{d}") for d in k])
    raised = scores.select("doc_id", "n_tokens", *[F.exp(F.greatest(F.col(f"s{d}") - top, F.lit(-700.0))).alias(f"e{d}") for d in k])
    whole = sum((F.col(f"e{d}") for d in k), F.lit(0.0))
    gridded = raised.select("doc_id", "n_tokens", *[F.floor(F.col(f"e{d}") / whole * GRID + 0.5 - 1e-9).cast("int").alias(f"g{d}") for d in k])
    # what rounding leaves over goes to the likeliest domain
    best, rest = reduce(F.greatest, [F.col(f"g{d}") for d in k]), F.lit(GRID) - sum((F.col(f"g{d}") for d in k), F.lit(0))
    leader = reduce(lambda other, d: F.when(F.col(f"g{d}") == best, d).otherwise(other), reversed(k), F.lit(-1))
    return gridded.withColumns({"leader": leader, "rest": rest}).select("doc_id", "n_tokens", *[(F.col(f"g{d}") + F.when(F.col("leader") == d, F.col("rest")).otherwise(0)).cast("int").alias(f"q{d}") for d in k])


def descend(classes: list[tuple], targets: dict[str, float], grow: bool = True) -> list[float]:
    """The rate of each class (``q0`` ..., ``tokens``).

    Without ``grow`` no domain is asked for more than is there.
    In the metric of the token totals the step of 1 is that of the gradient's
    Lipschitz constant: the squared deviations are weighted by the present totals.
    """
    k = range(len(DOMAINS))
    share = [[c[d] / GRID for d in k] for c in classes]
    tokens = [float(c[len(DOMAINS)] or 0) for c in classes]
    begin = [sum(t * q[d] for t, q in zip(tokens, share)) for d in k]
    base = [max(b, 1e-9 * sum(begin), 1e-9) for b in begin]
    scale = begin[0] / targets[DOMAINS[0]] if targets[DOMAINS[0]] else sum(begin)
    wanted = [scale * targets[d] if b else 0.0 for d, b in zip(DOMAINS, begin)]  # nothing can be reached where there is nothing
    if not grow:
        wanted = [min(w, b) for w, b in zip(wanted, begin)]

    def off(rates: list[float]) -> list[float]:
        return [(sum(t * r * q[d] for t, r, q in zip(tokens, rates, share)) - wanted[d]) / base[d] for d in k]

    rate = ahead = [1.0] * len(classes)
    speed = 1.0
    for _ in range(MOST_STEPS):
        e = off(ahead)
        new = [max(0.0, y - sum(q[d] * e[d] for d in k)) for y, q in zip(ahead, share)]
        if max((abs(a - b) for a, b in zip(new, ahead)), default=0.0) < STILL or max(map(abs, off(new))) < CLOSE:
            return new
        if sum(t * (y - n) * (n - r) for t, y, n, r in zip(tokens, ahead, new, rate)) > 0:
            speed, ahead = 1.0, new  # it went too far
        else:
            faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
            ahead = [n + (speed - 1) / faster * (n - r) for n, r in zip(new, rate)]
            speed = faster
        rate = new
    raise ArithmeticError("the rates do not converge")


def rates_of(classes: DataFrame, targets: dict[str, float], grow: bool = True) -> DataFrame:
    """``q0`` ... and ``rate`` of each class."""
    q = [f"q{d}" for d in range(len(DOMAINS))]
    rows = [tuple(r) for r in classes.select(*q, "tokens").orderBy(*q).collect()]  # bounded by the grid
    values = ", ".join(f"({', '.join(map(str, row[:-1]))}, {rate!r}D)" for row, rate in zip(rows, descend(rows, targets, grow)))
    none = ", ".join(["0"] * len(q)) + ", 1.0D"
    return classes.sparkSession.sql(f"SELECT * FROM VALUES {values or f'({none})'} AS t({', '.join(q)}, rate)")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, key: str = "doc_id", text: str = "text", grow: bool = True) -> DataFrame:
    """One row for each document: ``doc_id``, ``n_tokens``, ``p_<domain>`` and ``rate``; without ``grow`` no domain gets a target above its present total."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))  # other columns may have any names
    priors, weights = fitted(docs, domain_of(labels))
    scored = posteriors(docs, priors, weights)
    q = [f"q{d}" for d in range(len(DOMAINS))]
    shares = [(F.col(c) / GRID).alias(f"p_{d}") for c, d in zip(q, DOMAINS)]
    if weights is None:
        return scored.select("doc_id", "n_tokens", *shares, F.lit(1.0).alias("rate"))
    scored = stored(scored, "posteriors")
    rates = rates_of(scored.groupBy(*q).agg(F.sum("n_tokens").alias("tokens")), targets, grow)
    return scored.join(F.broadcast(rates), q).select("doc_id", "n_tokens", *shares, "rate")


def drawn(key: str = "doc_id") -> Column:
    """A reproducible draw for each id, uniform in [0, 1)."""
    return F.pmod(F.xxhash64(key, F.lit(6)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = mixed(docs, labels)
    return found.select("*", F.floor(F.col("rate") + drawn()).cast("long").alias("copies"))


QUERIES = {"op6_soft_mixing": op6_soft_mixing}
ORACLE: dict[str, str] = {}
