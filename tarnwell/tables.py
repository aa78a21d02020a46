"""Reading the tables of an index and reducing them to their current rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` in ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def current_rows(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per ``key``: the one with the greatest ``order``; equal orders mean equal rows.

    Rows without key are dropped, for they are no row of anything. A null or NaN order ranks lowest.
    Only ``columns`` are carried through the one shuffle; ``key`` itself need not be named. With an empty table
    the result is empty.
    """
    value = F.col(order).cast("double")
    rank = F.when(value.isNull() | F.isnan(value), F.lit(float("-inf"))).otherwise(value)
    kept = [c for c in columns if c != key]
    packed = F.struct(*[F.col(c) for c in kept])
    latest = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(packed, rank).alias("__row"))
    return latest.select(key, *[F.col(f"__row.`{c}`").alias(c) for c in kept])


def is_live(missing: Column, deleted: Column) -> Column:
    """Whether a current row stands for a file that is there; a null flag counts as 0."""
    return (F.coalesce(missing, F.lit(0)) == 0) & (F.coalesce(deleted, F.lit(0)) == 0)


def own_name(name: str, taken: tuple[str, ...] | list[str]) -> str:
    """``name``, with underscores after it while a result has a column of that name already, letter case aside."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name
