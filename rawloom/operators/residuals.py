"""Prediction, residuals and code tables over a table of samples, with windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rawloom.functions.columns import category, value_bits, wrapped
from rawloom.session import fresh, quoted


def predicted(cells: DataFrame, middle: int, image: list[str], y: str = "y", x: str = "x", s: str = "s") -> tuple[DataFrame, Column]:
    """cells, with what it takes, and the prediction: the left neighbour; in the first column (x = 0) the sample above;
    in the first row of that column the middle of the range.  image: the columns that name an image.

    Only the first column is dealt by image: everything else stays within its row."""
    above, left = fresh(cells, "_above", "_left")
    first = cells.where(F.col(x) == 0).select(*image, y, F.lag(s).over(Window.partitionBy(*image).orderBy(y)).alias(above))
    with_left = cells.withColumn(left, F.lag(s).over(Window.partitionBy(*image, y).orderBy(x)))
    joined = with_left.join(first, [*image, y], "left")
    return joined, F.coalesce(left, F.when(F.col(x) == 0, F.col(above)), F.lit(middle))


def residuals(cells: DataFrame, precision: int, image: list[str] | None = None) -> DataFrame:
    """cells (y, x, s and the columns of image) with d, the wrapped difference to the prediction, its category and
    extra bits."""
    found, guess = predicted(cells, 1 << (precision - 1), image or [])
    made = found.withColumn("d", wrapped(F.col("s") - guess)).withColumn("cat", category("d")).withColumn("bits", value_bits("d"))
    return made.select(*[F.col(quoted(c)) for c in cells.columns], "d", "cat", "bits")


def reconstructed(cells: DataFrame, precision: int, image: list[str] | None = None) -> DataFrame:
    """The samples of residuals (y, x, d): running sums down the first column, then along the rows, modulo 2^16."""
    image = image or []
    down = F.sum("d").over(Window.partitionBy(*image).orderBy("y").rowsBetween(Window.unboundedPreceding, 0)) + (1 << (precision - 1))
    starts = cells.where("x = 0").select(*image, "y", down.alias("start"))
    along = F.sum(F.when(F.col("x") == 0, 0).otherwise(F.col("d"))).over(Window.partitionBy(*image, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    return cells.withColumn("along", along).join(starts, [*image, "y"]).withColumn("s", (F.col("start") + F.col("along")).bitwiseAND(F.lit(65535))).drop("along", "start")


def histogram(cells: DataFrame, image: list[str] | None = None) -> DataFrame:
    """Number and sum of the residuals of each category."""
    return cells.groupBy(*(image or []), "cat").agg(F.count("*").alias("n"), F.sum("d").cast("bigint").alias("sd"))


def canonical_codes(lengths: DataFrame, table: list[str] | None = None) -> DataFrame:
    """(symbol, len, code) from (symbol, len): codes count up by length, then symbol.

    Seen as a fraction of 2^16 every code starts where the ones before it end."""
    w = Window.partitionBy(*(table or [])).orderBy("len", "symbol").rowsBetween(Window.unboundedPreceding, -1)
    span = F.pow(F.lit(2), 16 - F.col("len")).cast("bigint")
    return lengths.withColumn("code", (F.coalesce(F.sum(span).over(w), F.lit(0)) / span).cast("bigint"))


def coded_bits(histograms: DataFrame, codes: DataFrame) -> DataFrame:
    """Bits of the entropy-coded data from a histogram (cat, n) and a code table (symbol, len) of 17 rows at most."""
    joined = histograms.join(F.broadcast(codes.select(F.col("symbol").alias("cat"), "len")), "cat")
    return joined.agg(F.sum(F.col("n") * (F.col("len") + F.when(F.col("cat") < 16, F.col("cat")).otherwise(0))).alias("bits"))
