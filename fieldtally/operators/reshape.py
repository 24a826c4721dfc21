"""Unions, long/wide and positional pairing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.types import names_of, require_columns


def stack(*frames: DataFrame) -> DataFrame:
    """Union all by name; a column that one frame lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stack_strict(*frames: DataFrame) -> DataFrame:
    """Union all of frames with the same columns; duplicates stay."""
    first = set(frames[0].columns)
    for other in frames[1:]:
        if set(other.columns) != first:
            raise ValueError(f"columns differ: {sorted(first ^ set(other.columns))}")
    return reduce(lambda a, b: a.unionByName(b), frames)


def distinct_union(keys: str | Sequence[str], *frames: DataFrame) -> DataFrame:
    """Keys that occur in any of the frames, once each, NULL keys left out.

    Each frame is reduced to its own distinct keys before the union is shuffled.
    """
    columns = names_of(keys)
    narrowed = [f.select(*columns).na.drop(subset=columns).distinct() for f in frames]
    return reduce(lambda a, b: a.unionByName(b), narrowed).distinct()


def wide_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name_to: str, value_to: str) -> DataFrame:
    """One row per id and value column."""
    require_columns(df.columns, [*ids, *values], "wide to long")
    return df.unpivot(list(ids), list(values), name_to, value_to)


def pair_by_position(left: DataFrame, right: DataFrame, order_left: Sequence, order_right: Sequence) -> DataFrame:
    """Put two small sorted summaries side by side, row by row.

    For summaries only (one row per group): each side is numbered in a single task. Unequal row
    counts are an error at run time; columns of the same name get ``_left`` / ``_right``.
    """
    shared = set(left.columns) & set(right.columns)
    a = left.select(
        F.row_number().over(Window.orderBy(*order_left)).alias("_row"),
        *[F.col(c).alias(f"{c}_left" if c in shared else c) for c in left.columns],
        F.lit(True).alias("_in_left"),
    )
    b = right.select(
        F.row_number().over(Window.orderBy(*order_right)).alias("_row"),
        *[F.col(c).alias(f"{c}_right" if c in shared else c) for c in right.columns],
        F.lit(True).alias("_in_right"),
    )
    joined = a.join(b, "_row", "full")
    uneven = F.col("_in_left").isNull() | F.col("_in_right").isNull()
    check = F.when(uneven, F.raise_error(F.lit("the two summaries differ in row count")).cast("int")).otherwise(F.col("_row"))
    return joined.withColumn("position", check).drop("_row", "_in_left", "_in_right")
