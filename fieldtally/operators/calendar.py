"""Zero-filled monthly series and their means with standard errors.

Everything here works on aggregated series (a row per month), never on records.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.functions.dates import month_sequence
from fieldtally.functions.values import zero_if_null
from fieldtally.operators.predicates import in_months, in_period
from fieldtally.types import names_of


def zero_filled(
    series: DataFrame,
    value: str = "tot_obs",
    by: str | Sequence[str] | None = None,
    first: str | None = None,
    last: str | None = None,
    date: str = "date",
) -> DataFrame:
    """Every month of the calendar for each group; months without records get 0.

    The calendar runs from ``first`` to ``last``; an end left out is taken from the data over all
    groups, so that the groups share one calendar. Months of the series outside it stay, as in a full
    outer join. Each group is folded to one row with a month -> value map and unfolded over the
    calendar: the series is read once and never joined to itself. Rows without a date are left out.
    """
    groups = names_of(by)
    dated = series.where(F.col(date).isNotNull())
    folded = dated.groupBy(*groups) if groups else dated.groupBy()
    spans = folded.agg(
        F.min(date).alias("_first"),
        F.max(date).alias("_last"),
        F.map_from_entries(F.collect_list(F.struct(date, value))).alias("_values"),
    )
    if groups and not (first and last):
        ends = F.broadcast(dated.agg(F.min(date).alias("_first"), F.max(date).alias("_last")))  # one row
        spans = spans.drop("_first", "_last").join(ends, F.lit(True), "left")
    start = F.lit(first).cast("date") if first else F.col("_first")
    stop = F.lit(last).cast("date") if last else F.col("_last")
    calendar = F.when(start <= stop, month_sequence(start, stop)).otherwise(F.array().cast("array<date>"))
    months = F.array_union(calendar, F.map_keys("_values"))
    unfolded = spans.select(*groups, "_values", F.explode(months).alias(date))
    return unfolded.select(*groups, date, zero_if_null(F.try_element_at("_values", F.col(date))).alias(value))


def _exact(column: Column) -> Column:
    return column.cast("decimal(38,0)")


def mean_se(
    df: DataFrame,
    value: str,
    by: str | Sequence[str] | None = None,
    mean_name: str = "mean",
    se_name: str = "se",
    n_name: str = "n",
) -> DataFrame:
    """Mean and standard error (sample sd / sqrt(n)) of an integer measure.

    The measure is first reduced to a histogram, then summed as exact integers: the result does not
    depend on the order of the rows, and the wide arithmetic touches one row per distinct value.
    The standard error is NULL for a single value. A missing value makes both results NULL. Real-valued
    measures are refused; ``mean_se_real`` takes those.
    """
    kind = df.schema[value].dataType
    if isinstance(kind, T.FractionalType) and getattr(kind, "scale", 1) != 0:
        raise TypeError(f"{value} is {kind.simpleString()}; mean_se takes integers, mean_se_real real values")
    groups = names_of(by)
    histogram = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_k"))
    x, k = _exact(F.col(value)), _exact(F.col("_k"))
    grouped = histogram.groupBy(*groups) if groups else histogram.groupBy()
    sums = grouped.agg(
        F.sum("_k").alias(n_name),
        F.sum(k * x).alias("_s1"),
        F.sum(k * x * x).alias("_s2"),
        F.max(F.col(value).isNull()).alias("_missing"),
    )
    n, s1, s2 = _exact(F.col(n_name)), F.col("_s1"), F.col("_s2")
    known = ~F.col("_missing")
    spread = (n * s2 - s1 * s1).cast("double") / F.nullif((n * (n - 1)).cast("double"), F.lit(0.0))
    return sums.select(
        *groups,
        n_name,
        F.when(known, s1.cast("double") / n.cast("double")).alias(mean_name),
        F.when(known, F.sqrt(spread) / F.sqrt(n.cast("double"))).alias(se_name),
    )


def _exact_totals(values: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Sum of real values per key that does not depend on how rows are dealt: ``keys, name, _k`` (values that are known).

    A value is a whole number of at most 55 bits times a power of two. Whole numbers are summed as such, per key and power;
    the few sums of a key are then added in the order of their powers.
    """
    known = F.col(value).isNotNull()
    power = F.when(F.col(value) == 0, 0).otherwise(F.greatest(F.lit(-960), F.floor(F.log2(F.abs(value))).cast("int")))
    whole = (F.col(value) * F.pow(F.lit(2.0), (53 - F.col("_power")).cast("double"))).cast("long").cast("decimal(38,0)")
    rows = values.select(*keys, value, F.when(known, power).alias("_power"))
    per_power = rows.groupBy(*keys, "_power").agg(F.sum(whole).alias("_whole"), F.count(value).alias("_k"))
    part = F.struct(F.col("_power").alias("power"), F.col("_whole").cast("double").alias("whole"))
    folded = per_power.groupBy(*keys).agg(
        F.sum("_k").alias("_k"), F.array_sort(F.collect_list(F.when(F.col("_power").isNotNull(), part))).alias("_parts")
    )
    total = F.aggregate(
        "_parts", F.lit(0.0), lambda s, p: s + p["whole"] * F.pow(F.lit(2.0), (p["power"] - 53).cast("double"))
    )
    return folded.select(*keys, total.alias(name), "_k")


def mean_se_real(
    df: DataFrame,
    values: Mapping[str, str],
    by: str | Sequence[str] | None = None,
    n_name: str = "n",
    skip_missing: bool = False,
) -> DataFrame:
    """Mean and standard error of real-valued measures; ``values`` maps a column to a result suffix.

    A missing or NaN value makes both NULL. With ``skip_missing`` it is left out, and ``n_<suffix>`` counts the values used.
    Sums are exact up to the last step, so results are the same to the last bit however the rows are partitioned. Reads the
    rows twice: squares are taken from the mean. An infinite value makes mean and error NaN.
    """
    groups = names_of(by)
    named = [F.struct(F.lit(suffix).alias("m"), F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")).alias("v")) for column, suffix in values.items()]
    long = df.select(*groups, F.explode(F.array(*named)).alias("_l")).select(*groups, F.col("_l.m").alias("_m"), F.col("_l.v").alias("_v"))
    keys = [*groups, "_m"]
    infinite = F.abs("_v") == float("inf")
    finite = long.withColumn("_v", F.when(~infinite, F.col("_v")))
    sums = _exact_totals(finite, keys, "_v", "_sum")
    marks = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if(infinite).alias("_infinite"))

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.withColumnsRenamed({c: f"_of_{c}" for c in keys})
        return left.join(other, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])).drop(*[f"_of_{c}" for c in keys])

    means = joined(sums, marks).withColumn("_mean", F.col("_sum") / F.nullif(F.col("_k").cast("double"), F.lit(0.0)))
    away = joined(finite, means.select(*keys, "_mean"))
    away = away.withColumn("_v", (F.col("_v") - F.col("_mean")) * (F.col("_v") - F.col("_mean")))
    squares = _exact_totals(away, keys, "_v", "_squares").drop("_k")
    known = F.col("_k") + F.col("_infinite")
    asked = F.lit(skip_missing) | (known == F.col("_n"))
    spread = F.sqrt(F.col("_squares") / F.nullif((F.col("_k") - 1).cast("double"), F.lit(0.0))) / F.nullif(F.sqrt(F.col("_k").cast("double")), F.lit(0.0))
    found = joined(means, squares).select(
        *keys, "_n", known.alias("_known"),
        F.when(asked, F.when(F.col("_infinite") > 0, F.lit(float("nan"))).otherwise(F.col("_mean"))).alias("_mean"),
        F.when(asked, F.when(F.col("_infinite") > 0, F.lit(float("nan"))).otherwise(spread)).alias("_se"),
    )
    out = [F.coalesce(F.max("_n"), F.lit(0).cast("long")).alias(n_name)]
    for suffix in values.values():
        mine = F.col("_m") == suffix
        out += [F.max(F.when(mine, F.col("_mean"))).alias(f"mean_{suffix}"), F.max(F.when(mine, F.col("_se"))).alias(f"se_{suffix}")]
        if skip_missing:
            out.append(F.coalesce(F.max(F.when(mine, F.col("_known"))), F.lit(0).cast("long")).alias(f"n_{suffix}"))
    return found.groupBy(*groups).agg(*out) if groups else found.agg(*out)


def period_mean_se(
    series: DataFrame,
    periods: Mapping[str, tuple[str | None, str | None]],
    value: str = "tot_obs",
    by: str | Sequence[str] | None = None,
    months: Mapping[str, Sequence[int]] | None = None,
    date: str = "date",
    period_name: str = "period",
) -> DataFrame:
    """Mean and standard error of a zero-filled series over several periods at once.

    ``periods`` maps a label to its (first, last) date, both included, ``None`` for open;
    ``months`` narrows a label to the months of a season. A month may fall into several periods.
    """
    months = months or {}
    labels = []
    for label, (first, last) in periods.items():
        test = in_period(date, first, last)
        if label in months:
            test = test & in_months(date, months[label])
        labels.append(F.when(test, F.lit(label)))
    tagged = series.select("*", F.explode(F.array_compact(F.array(*labels))).alias(period_name))
    return mean_se(tagged, value, [*names_of(by), period_name])
