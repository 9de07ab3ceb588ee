"""Connected components of a link table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for every end of links(a, b): root is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then its label's label, so the
    distance covered doubles. Rounds are written out; they end when no label changed. Minima are
    combined before each shuffle and joins are sort-merge joins, whose skewed keys Spark splits.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.table(both, f"{name}-links")
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), f"{name}-0")
    turn = 0
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "root").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(heard.hint("merge"), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("up"))
        jump = labels.select(F.col("node").alias("up"), F.col("root").alias("far"))
        now = step.join(jump.hint("merge"), "up").select("node", F.least("up", "far").alias("root"), (F.least("up", "far") < F.col("old")).alias("moved"))
        now = scratch.table(now, f"{name}-{turn + 1}")
        scratch.drop(f"{name}-{turn}")
        turn += 1
        if not now.where("moved").limit(1).count():
            scratch.drop(f"{name}-links")
            return now.select("node", "root")
        labels = now.select("node", "root")
