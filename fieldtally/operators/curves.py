"""First records, accumulation curves and other cumulative series.

Records are reduced by ``min`` / ``min_by`` aggregates; running totals are windows over yearly rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.operators.counts import count_rows
from fieldtally.types import names_of, require_columns


def first_date(
    df: DataFrame, key: str | Sequence[str], date: str, strict: bool = False, name: str | None = None
) -> DataFrame:
    """Earliest date per key; keys without any date are left out.

    ``strict`` also leaves out a key as soon as one of its dates is missing.
    """
    keys, out = names_of(key), name or date
    found = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.min(f"`{date}`").alias(out), F.max(F.col(f"`{date}`").isNull()).alias("_gap")
    )
    wanted = F.col(f"`{out}`").isNotNull()
    return found.where(wanted & ~F.col("_gap") if strict else wanted).drop("_gap")


def _same(left: Sequence[str]) -> Column:
    return reduce(and_, [F.col(f"`{c}`").eqNullSafe(F.col(f"`_of_{c}`")) for c in left])


def _smallest(df: DataFrame, keys: list[str], order: Sequence[str]) -> DataFrame:
    """Smallest row per key by ``order`` and then by the remaining columns, among few rows per key."""
    rest = [c for c in df.columns if c not in keys]
    tie_break = [*order, *[c for c in rest if c not in order]]
    row, rank = (F.struct(*[F.col(f"`{c}`") for c in columns]) for columns in (rest, tie_break))
    found = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min_by(row, rank).alias("_row"))
    return found.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*[F.col(f"`{c}`") for c in df.columns])


def first_row(
    df: DataFrame, key: str | Sequence[str], order: Sequence[str], strict: bool = False
) -> DataFrame:
    """Whole first row per key in the order of the ``order`` columns, the first of which is the date.

    Ties that ``order`` leaves open fall back to the remaining columns, so the row is well defined.
    Only key and date are aggregated over all rows; the rows of each first date are fetched by a semi-join, and whole rows are
    compared among those few.
    """
    keys = names_of(key)
    require_columns(df.columns, [*keys, *order], "first row")
    firsts = first_date(df, keys, order[0], strict)
    named = firsts.withColumnsRenamed({c: f"_of_{c}" for c in firsts.columns})
    return _smallest(df.join(named, _same([*keys, order[0]]), "left_semi"), keys, order)


def one_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep one row per key, the smallest by ``order`` and then by the remaining columns; a missing value is the smallest.

    As in :func:`first_row` only the key and the first column of ``order`` are aggregated over all rows.
    """
    keys = names_of(key)
    if not order:
        return _smallest(df, keys, order)
    first = F.col(f"`{order[0]}`")
    least = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min(first).alias("_least"), F.max(first.isNull()).alias("_gap"))
    named = least.select(
        *[F.col(f"`{k}`").alias(f"_of_{k}") for k in keys], F.when(~F.col("_gap"), F.col("_least")).alias(f"_of_{order[0]}")
    )
    return _smallest(df.join(named, _same([*keys, order[0]]), "left_semi"), keys, order)


def running_total(
    yearly: DataFrame, value: str, by: str | Sequence[str] | None = None, year: str = "year", name: str = "cumsum"
) -> DataFrame:
    """Running total over years of a yearly frame, restarted per group."""
    window = Window.partitionBy(*names_of(by)).orderBy(F.col(year).asc_nulls_last())
    return yearly.withColumn(name, F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, 0)))


def records_curve(
    df: DataFrame, date: str, by: str | Sequence[str] | None = None, name: str = "cumsum"
) -> DataFrame:
    """Cumulative number of records per year; records without a date are in no year."""
    groups = names_of(by)
    yearly = count_rows(df.where(F.col(date).isNotNull()).withColumn("year", F.year(date)), [*groups, "year"], "_n")
    return running_total(yearly, "_n", groups, name=name).select(*groups, "year", name)


def accumulation(
    df: DataFrame,
    key: str,
    date: str,
    by: str | Sequence[str] | None = None,
    strict: bool = False,
    new_name: str | None = None,
    name: str = "cumsum",
) -> DataFrame:
    """Accumulation curve: keys (observers, species) seen so far, by year of their first record.

    The first shuffle carries one row per map task and key, the second one row per year.
    """
    groups = names_of(by)
    firsts = first_date(df, [*groups, key], date, strict, name="_first")
    fresh = new_name or "_new"
    yearly = count_rows(firsts.withColumn("year", F.year("_first")), [*groups, "year"], fresh)
    columns = [*groups, "year", *([new_name] if new_name else []), name]
    return running_total(yearly, fresh, groups, name=name).select(*columns)


def last_point(series: DataFrame, by: str | Sequence[str], year: str = "year", value: str = "cumsum") -> DataFrame:
    """Final point of every series, where a plot puts its label."""
    return series.groupBy(*names_of(by)).agg(F.max(year).alias(year), F.max_by(value, year).alias(value))


def filled_to_year(
    series: DataFrame, by: str | Sequence[str], last_year: int, year: str = "year", value: str = "cumsum"
) -> DataFrame:
    """Cumulative series with every year from its first one to ``last_year``; gaps repeat the last value.

    Years of the series after ``last_year`` stay; a row without a year has no place and goes.
    """
    groups = names_of(by)
    spans = series.where(F.col(year).isNotNull()).groupBy(*groups).agg(
        F.min(year).alias("_first"),
        F.max(year).alias("_last"),
        F.map_from_entries(F.collect_list(F.struct(year, value))).alias("_values"),
    )
    stop = F.greatest(F.lit(last_year), F.col("_last"))
    years = spans.select(*groups, "_values", F.explode(F.sequence(F.col("_first"), stop)).alias(year))
    points = years.select(*groups, year, F.try_element_at("_values", F.col(year)).alias(value))
    window = Window.partitionBy(*groups).orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn(value, F.last(value, ignorenulls=True).over(window))


def combined_curves(
    left: DataFrame,
    right: DataFrame,
    year: str = "year",
    value: str = "cumsum",
    left_name: str = "cumsum_left",
    right_name: str = "cumsum_right",
) -> DataFrame:
    """Two platforms' curves side by side on the years of the first one, and their sum.

    A year the second one lacks gives a NULL sum, not the first one's value.
    """
    a = left.select(year, F.col(value).alias(left_name))
    b = right.select(year, F.col(value).alias(right_name))
    return a.join(b, year, "left").withColumn(value, F.col(left_name) + F.col(right_name))


def yearly_totals(
    df: DataFrame,
    date: str,
    species: str,
    observer: str,
    first_year: int,
    last_year: int,
    weight: str | None = None,
) -> DataFrame:
    """Cumulative records, species and observers for every year from ``first_year``, starting at 0.

    One scan: each record is tagged as a record, a species and an observer, partial aggregation
    collapses the tags on the map side, and only first years travel further. Records before
    ``first_year`` are in the first total; missing species and observers are not counted; the series
    ends with ``last_year``. ``weight`` names a count column when the input is already reduced.
    """
    tagged = df.select(
        F.year(date).alias("year"),
        (F.col(weight) if weight else F.lit(1)).alias("_k"),
        F.explode(
            F.array(
                F.struct(F.lit("record").alias("kind"), F.year(date).cast("string").alias("key")),
                F.struct(F.lit("species").alias("kind"), F.col(species).cast("string").alias("key")),
                F.struct(F.lit("observer").alias("kind"), F.col(observer).cast("string").alias("key")),
            )
        ).alias("t"),
    ).where(F.col("year").isNotNull() & F.col("t.key").isNotNull())
    keyed = tagged.groupBy("t.kind", "t.key").agg(F.min("year").alias("year"), F.sum("_k").alias("_n"))
    is_kind = {k: F.col("kind") == k for k in ("record", "species", "observer")}
    yearly = keyed.groupBy(F.greatest("year", F.lit(first_year)).alias("year")).agg(
        F.coalesce(F.sum(F.when(is_kind["record"], F.col("_n"))), F.lit(0)).alias("total_observations"),
        F.count_if(is_kind["species"]).alias("total_spp"),
        F.count_if(is_kind["observer"]).alias("total_observers"),
    )
    measures = ["total_observations", "total_spp", "total_observers"]
    years = df.sparkSession.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    filled = years.join(yearly, "year", "left")
    window = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select("year", *[F.sum(F.coalesce(F.col(m), F.lit(0))).over(window).alias(m) for m in measures])
