"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm.common import drop_table, materialize


def _pairs(df: DataFrame) -> DataFrame:
    return df.where(F.col("lo") < F.col("hi")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("lo").alias("x"), F.col("hi").alias("y")).union(edges.select("hi", "lo"))
    # Written, so that both sides of the join are plain shuffles, which AQE can split where a hub is hot.
    least = materialize(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "star")
    return _pairs(both.where(F.col("y") > F.col("x")).join(least, "x").select(F.col("m").alias("lo"), F.col("y").alias("hi")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = materialize(edges.groupBy(F.col("hi").alias("x")).agg(F.min("lo").alias("m")), "star")
    moved = edges.withColumnRenamed("hi", "x").join(least, "x").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
    return _pairs(moved.union(least.select("m", "x")))


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """edges: two columns of one orderable type, in either direction, repeats and loops allowed; rows with a null
    are no edges. Returns ``node, component`` for each node that has an edge; the component is its smallest node.

    Every step is a partial aggregation and an equi-join, so a hub's edges never meet in one task; each round's
    edges are written to the shared folder, those of the round before are removed, and only their count and checksum
    reach the driver.
    """
    a, b = edges.columns
    now = materialize(_pairs(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where(F.col(a).isNotNull() & F.col(b).isNotNull())), "edges")
    before = None
    for _ in range(max_rounds):
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("lo", "hi"))).first()
        if seen[0] == 0 or tuple(seen) == before:
            break
        before = tuple(seen)
        used, large = now, materialize(_large_star(now), "large")
        now = materialize(_small_star(large), "edges")
        drop_table(used)
        drop_table(large)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())
