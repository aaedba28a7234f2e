"""Connected components over an edge table, with DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rawloom.session import discard, materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """Map every node that has an edge to the smallest node of its component: (node, component).

    Alternating large-star and small-star rounds: each is two aggregations of minima, which combine
    map-side, and two equi-joins, whose skewed partitions AQE can split; no adjacency list is ever
    gathered.  Each round's edges are written to the shared folder, so a lost executor costs one round
    at most.  Self-loops and repeated edges are harmless; rows with a null end are ignored; an empty
    table gives an empty table.
    """
    spark = edges.sparkSession
    u, v = F.col(src), F.col(dst)
    now = materialise(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        after = materialise(small.distinct())
        before, state, old = state, _state(after), now
        now = after
        discard(old)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
