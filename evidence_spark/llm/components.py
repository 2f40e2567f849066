"""Connected components of an edge table, by min-label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the (a, b) edges: root is the smallest node reachable.

    Alternates large-star and small-star steps: each node's neighbours are hooked to the
    smallest node around, first the larger ones, then the smaller ones. Every round is
    written to the shared folder; the loop ends when a round changes no edge, after about
    log^2 of the largest component's size rounds. Both steps aggregate minima before the
    shuffle and keep one edge per node, so a hub is never gathered in one place.
    """
    # edges run from the larger to the smaller end
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = stored(e, "links")
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of u go to the smallest of u and its neighbours
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = stored(large.distinct(), "links")
        # small star: u and its smaller neighbours go to the smallest of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = stored(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
        same = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        old = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        e = new
        if same == old:
            break
    # every edge now joins a node to its component's smallest
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
