"""Connected components by contraction, on the executors alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NARROW, discard, few_files, written


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) → (v, label) for every linked node; label is one node of its component.

    A round points each node at its smallest neighbour (or itself), follows the pointers, and rewrites the
    links between what they lead to.  Each round at least halves a component's nodes, so rounds grow with the
    logarithm of its size, whatever its diameter.  Every round ends in a written table, and the one before goes.

    Defined results: repeated links and links of a node to itself change nothing; null ends are left out; no links give no rows.
    """
    edges = written(links.where("a <> b").select("a", "b").distinct(), "links")
    found: DataFrame | None = None
    while n := edges.count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p"))
        for _ in range(2):
            to = to.alias("x").join(to.alias("y"), F.col("x.p") == F.col("y.v")).select(F.col("x.v").alias("v"), F.col("y.p").alias("p"))
        to = written(few_files(to, n, NARROW), "pointers", regroup=False)
        if found is None:
            found = written(to.select("v", F.col("p").alias("label")), "labels", regroup=False)
        else:
            before, found = found, written(few_files(found.join(to.select(F.col("v").alias("label"), "p"), "label", "left").select("v", F.coalesce("p", "label").alias("label")), n, NARROW), "labels", regroup=False)
            discard(before)
        ends = edges.join(to.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(to.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        old, edges = edges, written(few_files(ends.select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct(), n, NARROW), "links", regroup=False)
        discard(old, to)
    return found if found is not None else edges.select(F.col("a").alias("v"), F.col("b").alias("label"))
