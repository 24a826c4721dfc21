"""Participation relative to park visits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.values import ratio
from fieldtally.operators.calendar import mean_se_real
from fieldtally.operators.counts import count_distinct


def yearly_participation(
    df: DataFrame, observer: str, year: str = "year", park: str = "park", weight: str | None = None
) -> DataFrame:
    """Distinct observers and records per year and park of one feed."""
    return count_distinct(df, observer, [year, park], "observers", rows_name="observations", weight=weight)


def visit_rates(
    first: DataFrame,
    second: DataFrame,
    visits: DataFrame,
    first_year: int | None = None,
    keys: Sequence[str] = ("year", "park"),
) -> DataFrame:
    """Observers and records of two feeds per visit.

    Each feed is left-joined to the visits; the feeds are joined on year, park and visits, where two
    missing visit counts match each other. A year the second feed lacks gives NULL sums.
    """
    on = list(keys)
    a = first.join(visits, on, "left")
    b = second.join(visits, on, "left").select(
        *[F.col(k).alias(f"_{k}") for k in on],
        F.col("visits").alias("_visits"),
        F.col("observers").alias("_observers"),
        F.col("observations").alias("_observations"),
    )
    same = F.col("visits").eqNullSafe(F.col("_visits"))
    for k in on:
        same = same & (F.col(k) == F.col(f"_{k}"))
    joined = a.join(b, same, "left")
    kept = joined.where(F.col("year") >= first_year) if first_year is not None else joined
    return kept.select(
        *on,
        (F.col("observers") + F.col("_observers")).alias("observers"),
        (F.col("observations") + F.col("_observations")).alias("observations"),
        "visits",
    ).withColumns(
        {
            "observers_vis": ratio("observers", "visits"),
            "observations_vis": ratio("observations", "visits"),
        }
    )


def visit_rate_means(rates: DataFrame, park: str = "park") -> DataFrame:
    """Mean and standard error of the rates per park, as a percentage, and visits per observer / record."""
    means = mean_se_real(rates, {"observers_vis": "observers", "observations_vis": "observations"}, park)
    return means.withColumns(
        {
            "observers_p": F.col("mean_observers") * 100.0,
            "observations_p": F.col("mean_observations") * 100.0,
            "observer_times": 1.0 / F.col("mean_observers"),
            "observations_times": 1.0 / F.col("mean_observations"),
        }
    )
