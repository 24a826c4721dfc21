"""Quality rules: statistics of whole texts, fixed limits, and robust multivariate outliers per language and source.

Every text gives a vector of five transformed statistics, kept as whole numbers (1/1024 steps), so that counts and moments are
exact and do not depend on how rows are dealt. For each language and source the minimum-covariance-determinant estimate is
sought by concentration: of the vectors of a cell, the ``share`` nearest to the present centre in the present metric give the
next centre and covariance, from two starts (medians with median deviations; plain mean and covariance); the smaller
determinant wins. Distances are compared in steps of 1/64 of their logarithm, whole steps at a time. ``FLOORS`` are added to the
variances, as most texts have no symbol and no repeated line at all. A text further than the chi-squared quantile is rejected.
Cells with fewer than ``least`` texts share one estimate. Column expressions and aggregates only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.llm.common import cut_lineage

_WHITE = " \t\n\x0b\x0c\r"
_SYMBOLS = "[#*$%&|<>]"
_SCALE = 1024
FLOORS = (0.05, 0.05, 0.25, 0.4, 0.4)  # deviations that no cell's estimate goes below, in the units of ``vector``
_SIZE = len(FLOORS)
_LOWER = [(i, j) for i in range(_SIZE) for j in range(i + 1)]
_POOLED = ""
_FEW = 20_000  # languages and sources whose estimates, of some 200 bytes each, are sent to all tasks


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also where lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words in runs of three words that the text holds twice or more."""

    def hashes(w: Column) -> Column:
        three = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.slice(three, 1, F.size(w) - 2)

    def same(a: Column, b: Column, w: Column) -> Column:
        equal = [F.get(w, a["p"] + F.lit(k)) == F.get(w, b["p"] + F.lit(k)) for k in range(3)]
        return F.coalesce((a["h"] == b["h"]) & equal[0] & equal[1] & equal[2], F.lit(False))

    def runs(w: Column, h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        found = let(
            F.sort_array(placed),
            lambda g: F.transform(
                F.filter(g, lambda x, i: same(F.get(g, i - 1), x, w) | same(F.get(g, i + 1), x, w)), lambda x: x["p"]
            ),
        )
        reach = let(
            F.sort_array(found),
            lambda r: F.transform(r, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(r, i + 1), p + 3) - p)),
        )
        return F.aggregate(reach, F.lit(0).cast("long"), lambda total, x: total + x)

    def counted(w: Column) -> Column:
        return let(
            hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), runs(w, h)).otherwise(F.lit(0).cast("long"))
        )

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(counted(w)))


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the statistics of every whole text; one row for each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    count = lambda c: c.cast("long")
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        text.alias("text"),
    )
    split = plain.select(
        "doc_id", "lang", "source", "text",
        F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.rtrim(x, F.lit(_WHITE)) != "").alias("lines"),
    )
    return split.select(
        "doc_id", "lang", "source",
        count(F.size("words")).alias("n_words"),
        count(F.length(F.array_join("words", ""))).alias("word_chars"),
        count(F.regexp_count("text", F.lit(_SYMBOLS))).alias("n_symbols"),
        count(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _repeated(F.col("words")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """Transformed statistics of a text with two words or more, in steps of 1/1024."""
    n, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    parts = (
        F.log(F.log(n)),
        F.log(chars / n),
        F.log(1 + 100 * F.col("n_symbols") / chars),
        F.log(1 + F.col("n_dup_lines").cast("double")),
        F.log(1 + 10 * F.col("n_repeat_words") / n),
    )
    return [F.round(part * _SCALE).cast("long").alias(f"y{i}") for i, part in enumerate(parts)]


def _gamma_share(a: float, x: float) -> float:
    """Lower incomplete gamma function over the whole one."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi_squared(share: float, freedom: int) -> float:
    """Quantile of the chi-squared distribution."""
    low, high = 0.0, 200.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _gamma_share(freedom / 2, middle / 2) < share else (low, middle)
    return high


def _metric(moments: DataFrame, factor: float) -> DataFrame:
    """Centre ``m``, inverse Cholesky factor ``w`` and log determinant from exact sums ``n, s<i>, s<i>_<j>`` of the chosen vectors."""
    keys = [c for c in ("cell", "start") if c in moments.columns]
    n = F.col("n").cast("double")
    df = moments.select(*keys, *((F.col(f"s{i}") / n).alias(f"m{i}") for i in range(_SIZE)), "n", *(f"s{i}_{j}" for i, j in _LOWER))
    floor = [(f * _SCALE) ** 2 for f in FLOORS]
    cov = {(i, j): (F.col(f"s{i}_{j}") / n - F.col(f"m{i}") * F.col(f"m{j}")) * factor + (floor[i] if i == j else 0.0) for i, j in _LOWER}
    df = df.select(*keys, *(f"m{i}" for i in range(_SIZE)), *(c.alias(f"c{i}{j}") for (i, j), c in cov.items()))
    return _factored(df, keys)


def _factored(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds to ``m`` and the covariances ``c`` the inverse of their Cholesky factor and keeps what distances need."""
    for i, j in _LOWER:
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        df = df.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    for j in range(_SIZE):
        for i in range(j, _SIZE):
            if i == j:
                df = df.withColumn(f"w{i}{j}", 1.0 / F.col(f"l{i}{i}"))
                continue
            total = F.col(f"l{i}{j}") * F.col(f"w{j}{j}")
            for k in range(j + 1, i):
                total = total + F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
            df = df.withColumn(f"w{i}{j}", -total / F.col(f"l{i}{i}"))
    size = F.log(F.col("l00"))
    for i in range(1, _SIZE):
        size = size + F.log(F.col(f"l{i}{i}"))
    return df.select(*keys, *(f"m{i}" for i in range(_SIZE)), *(f"w{i}{j}" for i, j in _LOWER), size.alias("size"))


def squared_distance() -> Column:
    """Squared Mahalanobis distance of ``y`` in the metric beside it."""
    total = F.lit(0.0)
    for i in range(_SIZE):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col(f"w{i}{j}") * (F.col(f"y{j}") - F.col(f"m{j}"))
        total = total + part * part
    return total


def _sums() -> list[Column]:
    out = [F.sum("n").alias("n")]
    out += [F.sum(F.col("n") * F.col(f"y{i}")).alias(f"s{i}") for i in range(_SIZE)]
    return out + [F.sum(F.col("n") * F.col(f"y{i}") * F.col(f"y{j}")).alias(f"s{i}_{j}") for i, j in _LOWER]


def _medians(values: DataFrame) -> DataFrame:
    """Lower median of the exact counts ``cell, k, y, n`` for each cell and coordinate."""
    counted = values.groupBy("cell", "k", "y").agg(F.sum("n").alias("n"))
    up = Window.partitionBy("cell", "k").orderBy("y")
    totals = counted.withColumn("up", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy("cell", "k")))
    return totals.where(2 * F.col("up") >= F.col("all")).groupBy("cell", "k").agg(F.min("y").alias("middle"))


def _robust_start(points: DataFrame) -> DataFrame:
    """Medians as centre, median deviations as scales, no correlations."""
    pair = [F.struct(F.lit(i).alias("k"), F.col(f"y{i}").alias("y")) for i in range(_SIZE)]
    long = points.select("cell", "n", F.explode(F.array(*pair)).alias("v")).select("cell", "n", "v.k", "v.y")
    middle = cut_lineage(_medians(long))
    away = long.join(middle, ["cell", "k"]).select("cell", "k", F.abs(F.col("y") - F.col("middle")).alias("y"), "n")
    spread = _medians(away).withColumnRenamed("middle", "spread")
    pivot = middle.join(spread, ["cell", "k"]).groupBy("cell")
    found = pivot.agg(
        *(F.max(F.when(F.col("k") == i, F.col("middle"))).cast("double").alias(f"m{i}") for i in range(_SIZE)),
        *(F.max(F.when(F.col("k") == i, F.col("spread"))).cast("double").alias(f"r{i}") for i in range(_SIZE)),
    )
    cov = [
        ((1.4826 * F.col(f"r{i}")) ** 2 + (FLOORS[i] * _SCALE) ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _LOWER
    ]
    found = found.select("cell", F.lit(0).alias("start"), *(f"m{i}" for i in range(_SIZE)), *cov)
    return _factored(found, ["cell", "start"])


def _concentrated(points: DataFrame, metric: DataFrame, share: float, factor: float) -> DataFrame:
    """The metric of the nearest ``share`` of each cell's vectors, in whole steps of distance."""
    step = F.least(F.lit(4095), F.floor(64 * F.log(1 + squared_distance()))).cast("int")
    binned = points.join(metric, "cell").withColumn("bin", step).groupBy("cell", "start", "bin").agg(*_sums())
    mine = Window.partitionBy("cell", "start")
    before = F.coalesce(F.sum("n").over(mine.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = binned.withColumn("before", before).withColumn("all", F.sum("n").over(mine))
    near = near.where(F.col("before") < F.ceil(F.col("all") * share))
    sums = [c for c in binned.columns if c not in ("cell", "start", "bin")]
    return _metric(near.groupBy("cell", "start").agg(*(F.sum(c).alias(c) for c in sums)), factor)


def estimates(points: DataFrame, share: float, steps: int, small) -> DataFrame:
    """Metric of each cell of ``cell, y<i>, n``: concentration from both starts, the smaller determinant (ties: the first start).

    ``small`` marks a frame of a row per cell that is to be sent to all tasks.
    """
    factor = share / _gamma_share((_SIZE + 2) / 2, chi_squared(share, _SIZE) / 2)
    plain = _metric(points.groupBy("cell").agg(*_sums()), 1.0).withColumn("start", F.lit(1))
    metric = cut_lineage(_robust_start(points).unionByName(plain))
    for _ in range(steps):
        metric = cut_lineage(_concentrated(points, small(metric), share, factor))
    first = Window.partitionBy("cell").orderBy("size", "start")
    return metric.withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank", "start", "size")


def quality_rules(docs: DataFrame, share: float = 0.75, steps: int = 6, quantile: float = 1 - 1e-6, least: int = 50) -> DataFrame:
    """``doc_id``, statistics, ``base_failed``, ``kept`` and the squared ``distance`` of every row.

    NULL texts count as empty and fail the fixed limits, as do all texts under 50 words; such texts enter no estimate and have no
    distance. NULL languages and sources are values of their own. Where even the shared estimate has fewer than ``least``
    texts, the fixed limits decide. Repeated rows each get their row and weigh as often as they stand there; other columns, of
    any name, are not looked at; no rows give no rows.
    """
    cell = F.to_json(F.struct("lang", "source")).alias("own")
    stats = cut_lineage(statistics(docs).withColumn("base_failed", base_failed()))
    vectors = F.array(*vector())
    rows = stats.select("*", cell, F.when(~F.col("base_failed"), vectors).alias("y"))
    single = rows.where("y is not null").groupBy("own", *(F.get("y", F.lit(i)).alias(f"y{i}") for i in range(_SIZE)))
    single = single.agg(F.count(F.lit(1)).alias("n"))
    sizes = cut_lineage(single.groupBy("own").agg(F.sum("n").alias("texts")))
    names = sizes.select("own", F.when(F.col("texts") >= least, F.col("own")).otherwise(_POOLED).alias("cell"), "texts")
    # one row per language and source: sent to all tasks while they are few enough, shuffled beyond
    known_cells = names.groupBy("cell").agg(F.sum("texts").alias("texts"))
    enough = cut_lineage(names.drop("texts").join(known_cells.where(F.col("texts") >= least).select("cell"), "cell"))
    small = F.broadcast if enough.count() <= _FEW else lambda df: df
    points = single.join(small(enough), "own").groupBy("cell", *(f"y{i}" for i in range(_SIZE))).agg(F.sum("n").alias("n"))
    metric = estimates(cut_lineage(points), share, steps, small)
    known = small(enough.select("own", "cell").join(metric, "cell").drop("cell"))
    judged = rows.select("*", *(F.get("y", F.lit(i)).alias(f"y{i}") for i in range(_SIZE))).join(known, "own", "left")
    judged = judged.withColumn("distance", squared_distance())
    near = F.coalesce(F.col("distance") <= chi_squared(quantile, _SIZE), F.lit(True))
    names_out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select("doc_id", *names_out, (~F.col("base_failed") & near).alias("kept"), "distance")
