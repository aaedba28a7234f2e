"""Bounded, documented samples of labelled rows for the classifiers, chosen by a hash and so repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash values by which rows are sampled.
SPACE = 1 << 30


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def sample_per_class(rows: DataFrame, label: str, id_col: str, most: int, salt: int = 0) -> DataFrame:
    """About `most` rows of each class, all of a class that has no more.

    One aggregation counts the classes (their number, not that of rows, comes to the driver); a hash of the id
    then decides on each row alone, so nothing is sorted or gathered."""
    counts = {r[label]: r["n"] for r in rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.limit(0)
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, most / n))])
    drawn = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(salt)), F.lit(SPACE)) / F.lit(float(SPACE))
    return rows.where(F.col(label).isNotNull()).where(drawn < rate[F.col(label)])


def labelled(labels: DataFrame, label: str, id_col: str, learn: Column) -> DataFrame:
    """(id, label) of the rows that may be learnt from, one for each id; ids with contradicting labels go."""
    kept = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & learn)
    one = kept.groupBy(id_col).agg(F.min(label).alias(label), F.max(label).alias("_max"))
    return one.where(F.col(label) == F.col("_max")).drop("_max")
