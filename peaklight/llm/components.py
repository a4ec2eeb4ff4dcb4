"""Connected components of a link table that may exceed the memory of any machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peaklight.llm._base import Stage, join_counted


def connected_components(links: DataFrame, stage: Stage) -> DataFrame:
    """Links (a, b) to rows (node, comp), comp being the smallest node that can be reached.

    Alternates large-star and small-star steps until the links form stars.  A node
    with very many links is no hot spot: minima are taken with partial
    aggregation, and they join back by join_counted().
    Nodes without links to others have no row.  An empty table gives an empty one.
    """
    now = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before, old = None, None
    while True:
        total = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if old is not None:
            stage.drop(old)
        if (total.n, total.x) == before or not total.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
        before, old = (total.n, total.x), now
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        large = stage(join_counted(both, least, "u", total=2 * total.n).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, least, "u", total=2 * total.n).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = stage(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        stage.drop(large)
