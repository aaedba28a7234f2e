"""Mosaics and segments as tables: neighbourhood means, strip geometry, running offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rawloom.functions.columns import RGGB, strip_height


def filter_colour(y: Column, x: Column, cfa: tuple[int, ...] = RGGB) -> Column:
    place = y.bitwiseAND(F.lit(1)) * 2 + x.bitwiseAND(F.lit(1))
    return F.element_at(F.array(*[F.lit(c) for c in cfa]), (place + 1).cast("int"))


def demosaic(cells: DataFrame, image: list[str] | None = None, level: str = "s", cfa: tuple[int, ...] = RGGB) -> DataFrame:
    """(image, y, x, r, g, b): for each colour the mean of its samples in the 3 x 3 neighbourhood; 0 where none is.

    Sums and counts over three neighbours along each row, then of these along each column: every cell moves twice."""
    image = image or []
    colour = filter_colour(F.col("y"), F.col("x"), cfa)
    own = [F.when(colour == k, v).otherwise(0).alias(f"{c}{n}") for k, c in enumerate("rgb") for n, v in (("s", F.col(level)), ("n", F.lit(1)))]
    names = [f"{c}{n}" for c in "rgb" for n in "sn"]

    def around(df: DataFrame, along: str, across: str) -> DataFrame:
        near = Window.partitionBy(*image, across).orderBy(along).rangeBetween(-1, 1)
        return df.select(*image, "y", "x", *[F.sum(c).over(near).alias(c) for c in names])

    total = around(around(cells.select(*image, "y", "x", *own), "x", "y"), "y", "x")
    return total.select(*image, "y", "x", *[F.when(F.col(f"{c}n") > 0, F.col(f"{c}s") / F.col(f"{c}n")).otherwise(0.0).alias(c) for c in "rgb"])


def strips(images: DataFrame, height: str = "height", rows_per_strip: str = "rows_per_strip") -> DataFrame:
    """One row for each strip of an image: its number, first row and rows."""
    count = F.ceil(F.col(height) / F.col(rows_per_strip)).cast("int")
    cut = images.where(F.col(rows_per_strip) > 0).withColumn("strip", F.explode(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)))
    return cut.withColumn("first_row", F.col("strip").cast("long") * F.col(rows_per_strip)).withColumn("rows", strip_height(F.col("strip"), F.col(rows_per_strip), F.col(height)))


def running_offsets(pieces: DataFrame, by: list[str], order: list[str], size: str, start: int = 8) -> DataFrame:
    """pieces with the offset at which each lies if all follow one another from `start` on, on even offsets."""
    even = F.col(size) + F.pmod(F.col(size), F.lit(2))
    before = F.sum(even).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return pieces.withColumn("offset", (F.coalesce(before, F.lit(0)) + start).cast("bigint"))


def joined_segments(segments: DataFrame, by: list[str]) -> DataFrame:
    """The bytes of the segments of each group, in order of their index."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seg_index", "bytes"))), lambda s: s["bytes"])
    return segments.groupBy(*by).agg(F.aggregate(ordered, F.lit(b""), lambda a, b: F.concat(a, b)).alias("bytes"))
