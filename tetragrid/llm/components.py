"""Connected components of an edge table by alternating star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def connected_components(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """(node, root) for every node of `edges` (a, b) other than the roots themselves; root is the least node of its component.

    Each step reads and writes tables of at most the edges' size.  Minima are
    taken by partial aggregation and saved; the join with them is between two
    shuffled tables, so adaptive execution splits the edges of a node of very
    many neighbours.
    """
    e = ws.save(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
        f"{name}0",
    )
    step = 0
    while True:
        n = e.agg(F.count("*").alias("n"), F.count_distinct("u").alias("d")).first()
        if n.n == n.d and e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        step += 1
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ws.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}{step}-least")
        large = ws.save(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}{step}-large")
        least = ws.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}{step}-less")
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        )
        e = ws.save(small, f"{name}{step}")
        ws.drop(f"{name}{step - 1}", *(f"{name}{step}-{x}" for x in ("least", "large", "less")))
