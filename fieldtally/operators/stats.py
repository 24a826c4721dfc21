"""Two-sample rank-sum test and Poisson trend."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.functions.values import ratio, two_sided_p
from fieldtally.lineage import cut_lineage
from fieldtally.types import names_of

# Fixed value: below this many observations per sample, and without ties, the p-value is exact.
EXACT_BELOW = 50


def value_counts(df: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    """Distinct values with their frequency in both samples; missing values and NaN are left out."""
    in_samples = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(group).isin(first, second))
    return in_samples.groupBy(F.col(value).alias("value")).agg(
        F.count_if(F.col(group) == first).alias("n1"), F.count_if(F.col(group) == second).alias("n2")
    )


def with_rows_below(counts: DataFrame) -> DataFrame:
    """Adds ``below1`` / ``below2``: rows of each sample with a smaller value.

    A running total over ordered values without one global window: the distinct values are dealt to partitions by ranges, in
    order of their number, and materialised once. Sizes of the partitions give what lies below each of them, and a window runs
    inside each.
    """
    ranged = cut_lineage(counts.repartitionByRange("value").withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum("n1").alias("_t1"), F.sum("n2").alias("_t2"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_t1").over(before), F.lit(0)).alias("_o1"),
        F.coalesce(F.sum("_t2").over(before), F.lit(0)).alias("_o2"),
    )
    inside = Window.partitionBy("_part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(offsets, "_part").select(
        "value",
        "n1",
        "n2",
        (F.col("_o1") + F.coalesce(F.sum("n1").over(inside), F.lit(0))).alias("below1"),
        (F.col("_o2") + F.coalesce(F.sum("n2").over(inside), F.lit(0))).alias("below2"),
    )


def mid_ranks(counts: DataFrame) -> DataFrame:
    """Mid-rank of every distinct value in the pooled sample."""
    ranked = with_rows_below(counts)
    ties = F.col("n1") + F.col("n2")
    return ranked.withColumn("mid_rank", F.col("below1") + F.col("below2") + (ties + 1) / F.lit(2.0))


def rank_sum(df: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    """Rank-sum statistic of two samples: one row ``n1, n2, w, ties``.

    ``w`` is the rank sum of the first sample less its smallest possible value; ``ties`` is the sum
    of t^3 - t over tied values. Both are summed as exact integers.
    """
    ranked = with_rows_below(value_counts(df, value, group, first, second))
    n1, n2, below2 = (F.col(c).cast("decimal(38,0)") for c in ("n1", "n2", "below2"))
    t = n1 + n2
    sums = ranked.agg(
        F.coalesce(F.sum("n1"), F.lit(0)).alias("n1"),
        F.coalesce(F.sum("n2"), F.lit(0)).alias("n2"),
        F.sum(n1 * (below2 * 2 + n2)).alias("_w2"),
        F.sum(t * t * t - t).alias("_ties"),
    )
    return sums.select(
        "n1", "n2", (F.col("_w2").cast("double") / 2.0).alias("w"), F.col("_ties").cast("double").alias("ties")
    )


def _p_value_udf(exact: bool | None):
    """The p-value as an Arrow UDF. Everything it needs is inside, so workers need no installed package."""

    def exact_p(n1: int, n2: int, w: float) -> float:
        # lows[m]: chances of the lower half of the statistics with m members in the first sample and n in the second, made from
        # one member less on either side; sums of positive terms only. The upper half is the mirror of the lower one.
        n1, n2, w = (n1, n2, w) if n1 <= n2 else (n2, n1, n1 * n2 - w)
        lows = [np.ones(1) for _ in range(n1 + 1)]
        for n in range(1, n2 + 1):
            for m in range(1, n1 + 1):
                half, known = m * n // 2, lows[m]
                low = np.zeros(half + 1)
                low[: len(known)] = known
                beyond = np.arange(len(known), min(half, m * (n - 1)) + 1)
                low[beyond] = known[m * (n - 1) - beyond]
                low *= n / (m + n)
                fewer = lows[m - 1][: half + 1 - n] if half >= n else lows[m - 1][:0]
                low[n : n + len(fewer)] += fewer * (m / (m + n))
                lows[m] = low
        chance = lows[n1]
        top, half = n1 * n2, len(chance) - 1

        def up_to(u: int) -> float:
            if u < 0:
                return 0.0
            return float(chance[: u + 1].sum()) if u <= half else 1.0 - up_to(top - u - 1)

        return min(1.0, 2.0 * min(up_to(math.floor(w)), up_to(top - math.ceil(w))))

    def normal_p(n1: int, n2: int, w: float, ties: float) -> float:
        # tie-corrected variance, continuity correction towards the mean
        n = n1 + n2
        shift = w - n1 * n2 / 2.0
        variance = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1.0)))
        if variance <= 0:
            return float("nan")
        z = (shift - math.copysign(0.5, shift) * (shift != 0)) / math.sqrt(variance)
        return float(math.erfc(abs(z) / math.sqrt(2.0)))

    exact_below = EXACT_BELOW

    @F.pandas_udf(T.DoubleType())
    def p_values(n1s: pd.Series, n2s: pd.Series, ws: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for n1, n2, w, t in zip(n1s, n2s, ws, ties):
            if not n1 or not n2:
                out.append(None)
            elif exact if exact is not None else (n1 < exact_below and n2 < exact_below and t == 0):
                out.append(exact_p(int(n1), int(n2), w))
            else:
                out.append(normal_p(int(n1), int(n2), w, t))
        return pd.Series(out, dtype="float64")

    return p_values


def p_value(n1: Column, n2: Column, w: Column, ties: Column, exact: bool | None = None) -> Column:
    """Two-sided p-value of a rank-sum statistic; runs on result rows, never on records.

    ``exact`` asks for the exact distribution or the normal one; left out, it is exact without ties and below
    ``EXACT_BELOW`` values per sample. The exact distribution knows no ties.
    """
    return _p_value_udf(exact)(n1, n2, w, ties)


def rank_sum_test(
    df: DataFrame, value: str, group: str, first: str, second: str, exact: bool | None = None
) -> DataFrame:
    """Rank-sum statistic with its p-value, the ``method`` behind that, and the share of pairs the first sample wins."""
    stat = rank_sum(df, value, group, first, second)
    small = (F.col("n1") < EXACT_BELOW) & (F.col("n2") < EXACT_BELOW) & (F.col("ties") == 0)
    chosen = small if exact is None else F.lit(exact)
    return stat.withColumns(
        {
            "p_value": p_value(F.col("n1"), F.col("n2"), F.col("w"), F.col("ties"), exact),
            "method": F.when(chosen, "exact").otherwise("normal"),
            "win_share": ratio("w", F.col("n1").cast("double") * F.col("n2").cast("double")),
        }
    )


def poisson_trend(yearly: DataFrame, count: str = "n", year: str = "year", by: str | Sequence[str] | None = None, steps: int = 60) -> DataFrame:
    """Log-linear Poisson trend of yearly counts per group of ``by``: a row per coefficient, with standard error and z-test.

    Each group's years are folded to one array, and Newton steps on centred years run over it as column expressions, shortened
    while they are long; the intercept and its error are then moved to year 0. Rows without a year or a count are left out. A
    flat series has slope 0 and its error. A single year leaves the slope open (NULL), and a series without records has no finite
    intercept: NULL throughout. Without ``by`` there is one series, also of no rows.
    """
    groups = names_of(by)
    rows = yearly.select(*groups, F.col(year).cast("double").alias("_x"), F.col(count).cast("double").alias("_n"))
    known = F.col("_x").isNotNull() & F.col("_n").isNotNull()
    folded = rows.groupBy(*groups) if groups else rows.groupBy()
    series = folded.agg(
        F.array_sort(F.collect_list(F.when(known, F.struct(F.col("_x").alias("x"), F.col("_n").alias("n"))))).alias("_rows")
    )

    def total(values: Column, part) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, r: s + part(r))

    size = F.size("_rows").cast("double")
    series = series.withColumns({"_sum": total(F.col("_rows"), lambda r: r["n"]), "_mid": total(F.col("_rows"), lambda r: r["x"]) / F.nullif(size, F.lit(0.0))})
    series = series.withColumns({
        "_rows": F.transform("_rows", lambda r: F.struct((r["x"] - F.col("_mid")).alias("x"), r["n"].alias("n"))),
        "_start": F.when(F.col("_sum") > 0, F.log(F.col("_sum") / F.nullif(size, F.lit(0.0)))),
    })
    reach = F.array_max(F.transform("_rows", lambda r: F.abs(r["x"])))
    series = series.withColumn("_reach", reach)

    def sums(a: Column, b: Column) -> Column:
        """Slopes ``g`` and curvatures ``h`` of the likelihood."""
        names = ("g1", "g2", "h11", "h12", "h22")

        def add(s: Column, r: Column) -> Column:
            mean = F.exp(a + b * r["x"])
            parts = (r["n"] - mean, r["x"] * (r["n"] - mean), mean, r["x"] * mean, r["x"] * r["x"] * mean)
            return F.struct(*[(s[name] + part).alias(name) for name, part in zip(names, parts)])

        return F.aggregate("_rows", F.struct(*[F.lit(0.0).alias(name) for name in names]), add)

    def newton(state: Column, _: Column) -> Column:
        def moved(s: Column) -> Column:
            det = F.nullif(s["h11"] * s["h22"] - s["h12"] * s["h12"], F.lit(0.0))
            da = F.coalesce((s["h22"] * s["g1"] - s["h12"] * s["g2"]) / det, F.lit(0.0))
            db = F.coalesce((s["h11"] * s["g2"] - s["h12"] * s["g1"]) / det, F.lit(0.0))
            short = F.least(F.lit(1.0), F.lit(2.0) / F.greatest(F.lit(1e-300), F.abs(da) + F.abs(db) * F.col("_reach")))
            return F.struct((state["a"] + short * da).alias("a"), (state["b"] + short * db).alias("b"))

        return F.get(F.transform(F.array(sums(state["a"], state["b"])), moved), F.lit(0))

    fit = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.col("_start").alias("a"), F.lit(0.0).alias("b")), newton)
    series = series.withColumn("_fit", fit)
    series = series.withColumn("_s", sums(F.col("_fit.a"), F.col("_fit.b")))
    h11, h12, h22 = F.col("_s.h11"), F.col("_s.h12"), F.col("_s.h22")
    one = F.col("_reach") == 0
    det = F.when(~one, h11 * h22 - h12 * h12)
    mid = F.col("_mid")
    terms = {
        "(intercept)": (
            F.when(one, F.col("_start")).otherwise(F.col("_fit.a") - F.col("_fit.b") * mid),
            F.when(one, 1.0 / F.sqrt("_sum")).otherwise(F.sqrt((h22 + 2.0 * mid * h12 + mid * mid * h11) / det)),
        ),
        "year": (F.when(~one, F.col("_fit.b")), F.sqrt(h11 / det)),
    }
    fitted = F.col("_start").isNotNull()
    entries = [
        F.struct(F.lit(term).alias("term"), F.when(fitted, value).alias("estimate"), F.when(fitted, error).alias("std_error"))
        for term, (value, error) in terms.items()
    ]
    long = series.select(*groups, F.explode(F.array(*entries)).alias("_t")).select(*groups, "_t.*")
    return long.withColumn("p_value", two_sided_p(F.col("estimate") / F.col("std_error")))
