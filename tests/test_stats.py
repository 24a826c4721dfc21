"""Rank-sum test and trend against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from fieldtally.operators import stats
from fieldtally.sources import inline_rows


def brute_w(a, b):
    return sum(1.0 if x > y else 0.5 if x == y else 0.0 for x in a for y in b)


def frame(spark, a, b):
    return spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, v double")


def test_w_with_and_without_ties(spark):
    rng = random.Random(3)
    for a, b in (
        ([1.1, 2.5, 3.2], [0.5, 2.0, 9.0, 10.0]),
        ([rng.randint(0, 9) for _ in range(60)], [rng.randint(0, 9) for _ in range(45)]),
        ([rng.random() for _ in range(200)], [rng.random() for _ in range(150)]),
    ):
        df = frame(spark, a, b)
        first = stats.rank_sum(df, "v", "g", "a", "b").first()
        second = stats.rank_sum(df, "v", "g", "b", "a").first()
        assert (first["n1"], first["n2"], first["w"]) == (len(a), len(b), brute_w(a, b))
        assert first["w"] + second["w"] == len(a) * len(b)
        pooled = a + b
        assert first["ties"] == sum(pooled.count(v) ** 3 - pooled.count(v) for v in set(pooled))


def test_missing_values_and_other_groups_are_left_out(spark):
    df = inline_rows(spark, ["g", "v"], [("a", 1.0), ("b", 2.0), ("a", None), ("c", 5.0)])
    row = stats.rank_sum(df, "v", "g", "a", "b").first()
    assert (row["n1"], row["n2"], row["w"]) == (1, 1, 0.0)


def test_mid_ranks(spark, rows):
    ranked = stats.mid_ranks(stats.value_counts(frame(spark, [1, 2, 2], [2, 5]), "v", "g", "a", "b"))
    assert rows(ranked, "value", "mid_rank") == [(1.0, 1.0), (2.0, 3.0), (5.0, 5.0)]


def test_exact_p_value_equals_enumeration(spark):
    a, b = [1.2, 3.4, 8.8, 9.1], [0.3, 2.2, 4.4, 5.5, 7.1]
    pooled = a + b
    observed = brute_w(a, b)
    every = []
    for chosen in itertools.combinations(range(9), 4):
        rest = [pooled[i] for i in range(9) if i not in chosen]
        every.append(brute_w([pooled[i] for i in chosen], rest))
    low = sum(w <= observed for w in every) / len(every)
    high = sum(w >= observed for w in every) / len(every)
    row = stats.rank_sum_test(frame(spark, a, b), "v", "g", "a", "b").first()
    assert row["p_value"] == pytest.approx(min(1.0, 2 * min(low, high)), abs=1e-12)


def test_normal_p_value_with_ties(spark):
    a, b = [1, 2, 2, 3, 5], [2, 4, 6, 6, 7, 8]
    row = stats.rank_sum_test(frame(spark, a, b), "v", "g", "a", "b").first()
    n1, n2 = len(a), len(b)
    w = brute_w(a, b)
    ties = sum((a + b).count(v) ** 3 - (a + b).count(v) for v in set(a + b))
    n = n1 + n2
    sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = (w - n1 * n2 / 2 + 0.5) / sigma
    assert row["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_no_observations_gives_no_p_value(spark):
    row = stats.rank_sum_test(frame(spark, [1, 2], []), "v", "g", "a", "b").first()
    assert row["p_value"] is None


def test_poisson_trend_recovers_a_known_rate(spark):
    years = range(2000, 2020)
    table = [(y, round(50 * math.exp(0.08 * (y - 2000)))) for y in years]
    fit = {r["term"]: r for r in stats.poisson_trend(inline_rows(spark, ["year", "n"], table)).collect()}
    assert fit["year"]["estimate"] == pytest.approx(0.08, abs=2e-3)
    assert fit["year"]["p_value"] < 1e-20
    # the score equations of the fit: residuals sum to zero, also weighted by year
    fitted = [math.exp(fit["(intercept)"]["estimate"] + fit["year"]["estimate"] * y) for y in years]
    assert sum(fitted) == pytest.approx(sum(n for _, n in table), rel=1e-6)
    assert sum(f * y for f, y in zip(fitted, years)) == pytest.approx(sum(n * y for y, n in table), rel=1e-6)


def ways(n1, n2):
    """Arrangements by statistic, by adding pooled places one at a time."""
    table = {(0, 0): 1}
    for j in range(1, n1 + n2 + 1):
        new = {}
        for (k, u), c in table.items():
            for key in ((k, u), (k + 1, u + j - k - 1)):
                if key[0] <= n1 and key[1] <= n1 * n2 and j - key[0] <= n2:
                    new[key] = new.get(key, 0) + c
        table = new
    return {u: c for (k, u), c in table.items() if k == n1}


def test_exact_distribution_of_unequal_and_large_samples(spark):
    for n1, n2, w in ((3, 9, 5.0), (9, 3, 22.0), (12, 17, 60.5), (1, 1, 0.0), (20, 20, 130.0)):
        counts = ways(n1, n2)
        whole = sum(counts.values())
        low = sum(c for u, c in counts.items() if u <= w) / whole
        high = sum(c for u, c in counts.items() if u >= w) / whole
        row = spark.range(1).select(stats.p_value(F.lit(n1), F.lit(n2), F.lit(w), F.lit(0.0), exact=True).alias("p")).first()
        assert row["p"] == pytest.approx(min(1.0, 2 * min(low, high)), rel=1e-9)
    large = spark.range(1).select(
        stats.p_value(F.lit(400), F.lit(400), F.lit(73000.0), F.lit(0.0), exact=True).alias("e"),
        stats.p_value(F.lit(400), F.lit(400), F.lit(73000.0), F.lit(0.0), exact=False).alias("n"),
    ).first()
    assert large["e"] == pytest.approx(large["n"], rel=0.01)


def test_two_sided_p(spark):
    from fieldtally.functions.values import two_sided_p

    zs = [0.0, 0.3, -1.0, 2.0, 2.2, 5.0, -9.0, 30.0]
    rows = inline_rows(spark, ["z"], [(z,) for z in zs]).select("z", two_sided_p("z").alias("p")).collect()
    for r in rows:
        assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=1e-9, abs=1e-300)


def test_trend_per_group(spark):
    table = [("up", y, round(50 * math.exp(0.08 * (y - 2000)))) for y in range(2000, 2020)]
    table += [("flat", y, 7) for y in range(2000, 2010)] + [("single", 2001, 9), ("none", 2001, 0), ("none", 2002, 0)]
    table += [("steep", y, n) for y, n in zip(range(2000, 2006), (0, 0, 1, 0, 40, 4000))] + [("up", None, 5), ("up", 2003, None)]
    df = inline_rows(spark, ["park", "year", "n"], table)
    fit = {(r["park"], r["term"]): r for r in stats.poisson_trend(df, by="park").collect()}
    assert len(fit) == 10
    alone = {r["term"]: r for r in stats.poisson_trend(df.where("park = 'up'")).collect()}
    for term in ("(intercept)", "year"):
        assert tuple(fit["up", term])[2:] == pytest.approx(tuple(alone[term])[1:])
    assert fit["flat", "year"]["estimate"] == pytest.approx(0.0, abs=1e-12) and fit["flat", "year"]["p_value"] == pytest.approx(1.0)
    assert fit["single", "(intercept)"]["estimate"] == pytest.approx(math.log(9)) and fit["single", "year"]["estimate"] is None
    assert fit["none", "(intercept)"]["estimate"] is None and fit["none", "year"]["p_value"] is None
    a, b = (fit["steep", t]["estimate"] for t in ("(intercept)", "year"))
    means = [math.exp(a + b * y) for y in range(2000, 2006)]
    assert sum(means) == pytest.approx(4041, rel=1e-6) and sum(m * k for k, m in enumerate(means)) == pytest.approx(2 + 160 + 20000, rel=1e-6)
    assert {r["term"]: r["estimate"] for r in stats.poisson_trend(df.limit(0)).collect()} == {"(intercept)": None, "year": None}
