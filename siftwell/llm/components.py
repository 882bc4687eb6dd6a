"""Connected components of a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) for each end of ``links`` (``a``, ``b``).

    Each round takes the smallest label among the neighbours and then the label
    of that label, so labels travel at doubling speed; every round is written to
    the shared folder.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")), "labels")
    while True:
        at = labels.select(F.col("id").alias("b"), F.col("component").alias("near"))
        least = both.join(at, "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        step = labels.join(least, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = stored(step.join(jump, "component", "left").select("id", "old", F.least("component", F.coalesce("far", "component")).alias("component")), "labels")
        changed = new.where("old <> component").limit(1).count()
        labels = new.drop("old")
        if not changed:
            return labels
