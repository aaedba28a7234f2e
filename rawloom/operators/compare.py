"""Comparing tag tables and directory trees, and reports over their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rawloom.functions.codec import MARKER_TAG, MARKER_VALUE
from rawloom.functions.columns import ratio

COMPRESSION = 259


def tag_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str = "canon", allowed: tuple[int, ...] = (COMPRESSION, MARKER_TAG)) -> DataFrame:
    """(keys, tag, kind): tags that were Added, Removed or Changed, but for the allowed ones.

    A full outer equi-join on the directory and the tag, so it shuffles each side once on the same keys."""
    a = before.select(*keys, "tag", F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = after.select(*keys, "tag", F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    joined = a.join(b, [*keys, "tag"], "full_outer")
    kind = F.when(F.col("_in_a").isNull(), "Added").when(F.col("_in_b").isNull(), "Removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "Changed")
    return joined.where(~F.col("tag").isin(*allowed)).select(*keys, "tag", kind.alias("kind")).where("kind is not null")


def tree_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, place, kind): directories that only one tree has, or whose pointer tag differs.

    place is the way from the top: a directory's edge and number below its parent."""
    keys = ["path", "parent_id", "edge", "ordinal"]
    a = before.select(*keys, F.col("pointer_tag").alias("_a"), F.lit(True).alias("_in_a"))
    b = after.select(*keys, F.col("pointer_tag").alias("_b"), F.lit(True).alias("_in_b"))
    kind = F.when(F.col("_in_a").isNull(), "Added").when(F.col("_in_b").isNull(), "Removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "Changed")
    return a.join(b, keys, "full_outer").select(*keys, kind.alias("kind")).where("kind is not null")


def foreign_markers(entries: DataFrame, value: str = "ints") -> DataFrame:
    """Entries at the marker's tag that are not the marker."""
    ours = F.coalesce((F.col("type_code") == 4) & (F.col(value) == F.array(F.lit(MARKER_VALUE).cast("long"))), F.lit(False))
    return entries.where((F.col("tag") == MARKER_TAG) & ~ours)


def upsert(entries: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """entries with the rows of changes in place of those of the same keys."""
    return entries.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def top_one(rows: DataFrame, by: list[str], area: Column, order: str, positive: bool = True) -> DataFrame:
    """The row with the largest area of each group, the first in order among equals; with positive, none without area."""
    ranked = rows.withColumn("_area", area)
    ranked = ranked.where("_area > 0") if positive else ranked
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_area"), order))
    return ranked.withColumn("_rank", first).where("_rank = 1").drop("_rank", "_area")


def summary(stats: DataFrame, before: str = "input_bytes", after: str = "output_bytes") -> DataFrame:
    """Frames, total sizes and the ratio of the totals."""
    total = stats.agg(F.count("*").alias("frames"), F.coalesce(F.sum(before), F.lit(0)).cast("bigint").alias("input_bytes"), F.coalesce(F.sum(after), F.lit(0)).cast("bigint").alias("output_bytes"))
    return total.withColumn("ratio", ratio(F.col("output_bytes"), F.col("input_bytes")))


def file_outcomes(copies: DataFrame) -> DataFrame:
    """One row for each file of (source, size, error, destination, status): is it copied and verified everywhere?"""
    good = F.count_if(F.col("status") == "Verified")
    grouped = copies.groupBy("source").agg(F.max("size").alias("size"), F.max("error").alias("error"), F.count("destination").alias("destinations"), good.alias("verified"))
    ok = F.col("error").isNull() & (F.col("destinations") > 0) & (F.col("destinations") == F.col("verified"))
    return grouped.withColumn("ok", ok)


def offload_totals(files: DataFrame) -> DataFrame:
    """Verified and failed files, bytes, and whether all are verified (so they are if there are none)."""
    good = F.count_if("ok")
    return files.agg(
        F.count("*").alias("files"), good.alias("verified"), (F.count("*") - good).alias("failed"),
        F.coalesce(F.sum(F.coalesce("size", F.lit(0))), F.lit(0)).cast("bigint").alias("total_bytes"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("all_verified"),
    )
