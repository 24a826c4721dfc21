"""Counting operators. Shuffles carry partial aggregates, so a hot key costs one row per map task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.functions.dates import month_start
from fieldtally.functions.values import percent, ratio
from fieldtally.operators.reshape import stack
from fieldtally.types import ColumnLike, col_of, names_of


def count_rows(
    df: DataFrame, by: str | Sequence[str] | None = None, name: str = "n", weight: str | None = None
) -> DataFrame:
    """Rows per group; rows with missing values count as well.

    ``weight`` names a count column when the input is already reduced to counts.
    """
    counted = (F.sum(weight) if weight else F.count(F.lit(1))).alias(name)
    keys = names_of(by)
    return df.groupBy(*keys).agg(counted) if keys else df.agg(counted)


def ranked_counts(
    df: DataFrame, by: str | Sequence[str], name: str = "n", top: int | None = None, weight: str | None = None
) -> DataFrame:
    """Rows per group, largest first, ties in key order; ``top`` keeps the first k rows of the report."""
    ordered = count_rows(df, by, name, weight).orderBy(F.desc(name), *[F.asc(k) for k in names_of(by)])
    return ordered.limit(top) if top is not None else ordered


def distinct_keys(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    return df.select(*names_of(keys)).distinct()


def count_distinct(
    df: DataFrame,
    key: str,
    by: str | Sequence[str] | None = None,
    name: str = "n",
    rows_name: str | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Distinct values per group, a missing value counting as one; rows per group on request.

    Two plain aggregations instead of ``count(distinct)``: first by (group, value), then by group.
    No row is expanded, a hot group is spread over its values, and the row count comes for free.
    ``weight`` names a count column when the input is already reduced to counts.
    """
    groups = names_of(by)
    per_value = count_rows(df, [*groups, key], "_rows", weight)
    wanted = [F.count(F.lit(1)).alias(name)]
    if rows_name:
        wanted.append(F.sum("_rows").alias(rows_name))
    return per_value.groupBy(*groups).agg(*wanted) if groups else per_value.agg(*wanted)


def group_sums(df: DataFrame, by: str | Sequence[ColumnLike], value: str, name: str | None = None) -> DataFrame:
    """Sum counts up to coarser groups."""
    return df.groupBy(*names_of(by)).agg(F.sum(value).alias(name or value))


def rate_by_group(
    df: DataFrame,
    by: str | Sequence[str],
    condition: Column,
    total_name: str = "total_obs",
    hit_name: str = "rg_obs",
    rate_name: str | None = "percent_rg",
    digits: int = 0,
) -> DataFrame:
    """Rows, rows that meet the condition, and their rounded percentage, per group."""
    counted = df.groupBy(*names_of(by)).agg(
        F.count(F.lit(1)).alias(total_name), F.count_if(condition).alias(hit_name)
    )
    if rate_name is None:
        return counted
    return counted.withColumn(rate_name, percent(hit_name, total_name, digits))


def rolled_up_rates(
    rates: DataFrame,
    by: str | Sequence[str],
    total_name: str = "total_obs",
    hit_name: str = "rg_obs",
    rate_name: str | None = "percent_rg",
    digits: int = 0,
) -> DataFrame:
    """Counts of :func:`rate_by_group` summed up to coarser groups, with their percentage."""
    summed = rates.groupBy(*names_of(by)).agg(F.sum(total_name).alias(total_name), F.sum(hit_name).alias(hit_name))
    if rate_name is None:
        return summed
    return summed.withColumn(rate_name, percent(hit_name, total_name, digits))


def monthly_counts(
    df: DataFrame,
    date: str,
    by: str | Sequence[str] | None = None,
    distinct: str | None = None,
    name: str = "tot_obs",
    month_name: str = "date",
) -> DataFrame:
    """Records per month, or distinct keys per month when ``distinct`` is given."""
    groups = [*names_of(by), month_name]
    dated = df.withColumn(month_name, month_start(date))
    return count_distinct(dated, distinct, groups, name) if distinct else count_rows(dated, groups, name)


def monthly_variants(
    df: DataFrame,
    date: str,
    condition: Column,
    labels: tuple[str, str],
    by: str | Sequence[str] | None = None,
    distinct: str | None = None,
    name: str = "tot_obs",
    month_name: str = "date",
    label_name: str = "data",
) -> DataFrame:
    """Two monthly series stacked: all records and those that meet ``condition``.

    Both come from one scan. With ``distinct`` a key belongs to the second series if any of its
    records meets the condition.
    """
    groups = [*names_of(by), month_name]
    dated = df.withColumns({month_name: month_start(date), "_hit": F.coalesce(condition, F.lit(False))})
    if distinct:
        per_key = dated.groupBy(*groups, distinct).agg(F.max("_hit").alias("_hit"))
    else:
        per_key = dated
    both = per_key.groupBy(*groups).agg(F.count(F.lit(1)).alias("_all"), F.count_if("_hit").alias("_some"))
    all_label, some_label = labels
    series = F.array(
        F.struct(F.lit(all_label).alias("label"), F.col("_all").alias("n")),
        F.struct(F.lit(some_label).alias("label"), F.col("_some").alias("n")),
    )
    long = both.select(*groups, F.explode(series).alias("s"))
    # a month without a matching record has no row in the second series
    return long.where(F.col("s.n") > 0).select(*groups, F.col("s.n").alias(name), F.col("s.label").alias(label_name))


def with_totals(counted: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts with the row of totals of their group; a missing group is a group."""
    named = totals.withColumnsRenamed({c: f"_of_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    return counted.join(named, reduce(and_, same), "left").drop(*[f"_of_{c}" for c in by])


def share_of_total(
    counts: DataFrame,
    value: str = "n",
    name: str = "percent",
    keep: Column | None = None,
    digits: int | None = 2,
    total_name: str | None = None,
    by: str | Sequence[str] | None = None,
    feed: DataFrame | None = None,
) -> DataFrame:
    """Each group's share of the whole, for counts over *all* groups of the unfiltered frame.

    With ``by`` (parks) the whole is that of the group's own park. ``feed`` names the records behind the counts: their
    number is the whole then, also where a join has repeated some of them.

    ``keep`` then drops groups from the report (blank keys) without taking them out of the
    denominator. The total of each group of ``by`` is a window over its counts, the total of all a scalar subquery.
    """
    total = total_name or "_total"
    groups = names_of(by)
    if feed is None and groups:
        whole = counts.withColumn(total, F.sum(value).over(Window.partitionBy(*groups)))
    elif feed is None:
        whole = counts.withColumn(total, counts.agg(F.sum(value)).scalar())
    elif groups:
        whole = with_totals(counts, count_rows(feed, groups, total), groups)
    else:
        whole = counts.withColumn(total, feed.agg(F.count(F.lit(1))).scalar())
    kept = whole.where(keep) if keep is not None else whole
    shared = kept.withColumn(name, percent(value, total, digits))
    return shared if total_name else shared.drop(total)


def frequency_by_taxon(
    df: DataFrame,
    taxon: str | Sequence[str],
    unit: str,
    name: str = "frequency",
    digits: int | None = 2,
    rows_name: str = "n",
    units_name: str = "units",
    by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Rows of a taxon per 100 distinct units (checklists) of the whole frame, or of the taxon's own group of ``by``."""
    groups = names_of(by)
    if groups:
        units = count_distinct(df, unit, groups, units_name)
        counted = with_totals(count_rows(df, [*groups, *names_of(taxon)], rows_name), units, groups)
    else:
        units = df.select(unit).distinct().agg(F.count(F.lit(1))).scalar()
        counted = count_rows(df, taxon, rows_name).withColumn(units_name, units)
    return counted.withColumn(name, percent(rows_name, units_name, digits))


def distinct_pairs_per_group(
    df: DataFrame, item: str, by: str | Sequence[str], name: str = "count"
) -> DataFrame:
    """Distinct items per group (species per order)."""
    return count_distinct(df, item, by, name)


def completeness_summary(
    df: DataFrame,
    checklist: str,
    observer: str,
    complete: Column,
    by: str | Sequence[str] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Rows, checklists, observers, complete checklists, and their ratios, per group.

    One scan: rows collapse to one per (checklist, observer), then to one per observer and one per
    checklist through a tagged stack, which is a plain count at the end. ``weight`` names a count
    column when the input is already reduced to counts.
    """
    groups = names_of(by)
    rows = F.col(weight) if weight else F.lit(1)
    pairs = df.groupBy(*groups, checklist, observer).agg(
        F.sum(rows).alias("_rows"), F.sum(F.when(complete, rows).otherwise(F.lit(0))).alias("_complete_rows")
    )
    tagged = pairs.select(
        *groups,
        "_rows",
        "_complete_rows",
        F.explode(
            F.array(
                F.struct(F.lit("c").alias("kind"), F.col(checklist).cast("string").alias("key")),
                F.struct(F.lit("o").alias("kind"), F.col(observer).cast("string").alias("key")),
            )
        ).alias("k"),
    )
    keyed = tagged.groupBy(*groups, "k.kind", "k.key").agg(
        F.sum("_rows").alias("_rows"), F.sum("_complete_rows").alias("_complete_rows")
    )
    is_checklist = F.col("kind") == "c"
    sums = keyed.groupBy(*groups) if groups else keyed.groupBy()
    out = sums.agg(
        F.coalesce(F.sum(F.when(is_checklist, F.col("_rows"))), F.lit(0)).alias("records"),
        F.coalesce(F.sum(F.when(is_checklist, F.col("_complete_rows"))), F.lit(0)).alias("complete_records"),
        F.count_if(is_checklist).alias("checklists"),
        F.count_if(is_checklist & (F.col("_complete_rows") > 0)).alias("complete_checklists"),
        F.count_if(~is_checklist).alias("observers"),
    )
    return out.withColumns(
        {
            "checklists_per_observer": ratio("checklists", "observers"),
            "percent_complete": percent("complete_checklists", "checklists"),
        }
    )


def extent(df: DataFrame, x: ColumnLike, y: ColumnLike) -> DataFrame:
    """One row: smallest and largest coordinate on both axes."""
    return df.agg(
        F.min(col_of(x)).alias("xmin"),
        F.max(col_of(x)).alias("xmax"),
        F.min(col_of(y)).alias("ymin"),
        F.max(col_of(y)).alias("ymax"),
    )


def two_feed_summary(
    observations: DataFrame,
    checklists: DataFrame,
    research: Column,
    complete: Column,
    named: Column,
    observer_obs: str = "user_id",
    observer_chk: str = "observer_id",
    checklist: str = "checklist_id",
    weight: str | None = None,
    by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Totals over both feeds: records, shares, science-ready share, observers. One row, or one per group of ``by``.

    Science-ready means research-grade observations plus complete checklists, by records and by
    units (an observation or a checklist). ``weight`` names a count column of reduced checklist lines.
    """
    groups = names_of(by)
    obs = observations.groupBy(*groups, observer_obs).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(research).alias("_research"), F.count_if(named).alias("_named")
    ).groupBy(*groups).agg(
        F.sum("_rows").alias("obs_records"),
        F.sum("_research").alias("research_records"),
        F.sum("_named").alias("species_level_records"),
        F.count(F.lit(1)).alias("obs_observers"),
    )
    chk = completeness_summary(checklists, checklist, observer_chk, complete, groups, weight).select(
        *groups,
        F.col("records").alias("chk_records"),
        F.col("complete_records"),
        F.col("checklists"),
        F.col("complete_checklists"),
        F.col("observers").alias("chk_observers"),
    )
    # the feeds' rows of a group become one row: stacked, then each total picked from the row that has it
    merged = stack(obs, chk)
    row = merged.groupBy(*groups).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in merged.columns if c not in groups])
    records = F.col("obs_records") + F.col("chk_records")
    return row.withColumns(
        {
            "records": records,
            "observers": F.col("obs_observers") + F.col("chk_observers"),
            "records_per_observer": ratio("obs_records", "obs_observers"),
            "percent_observation_feed": percent("obs_records", records),
            "percent_checklist_feed": percent("chk_records", records),
            "percent_research": percent("research_records", "obs_records"),
            "percent_species_level": percent("species_level_records", "obs_records"),
            "percent_ready_records": percent(F.col("research_records") + F.col("complete_records"), records),
            "percent_ready_units": percent(
                F.col("research_records") + F.col("complete_checklists"), F.col("obs_records") + F.col("checklists")
            ),
        }
    )
