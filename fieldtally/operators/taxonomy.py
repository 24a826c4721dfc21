"""Joins to a taxonomy list and counts along its ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.lineage import cut_lineage
from fieldtally.operators.counts import count_rows
from fieldtally.operators.curves import one_per_key
from fieldtally.types import ColumnLike, names_of


def enrich(df: DataFrame, taxonomy: DataFrame, key: str = "scientific_name") -> DataFrame:
    """Left join to the taxonomy; a name listed several times fans out.

    No hint: Spark broadcasts a list under its size threshold, and sorts and merges a larger one, where adaptive execution splits
    a name that holds a large share of the records. A blank or missing name matches nothing, and there can be very many: such
    records do not take part in the join and are added behind it. Only the columns that are asked for are read.
    """
    name = F.coalesce(F.trim(F.col(key).cast("string")), F.lit(""))
    named = taxonomy.where(F.trim(F.col(key).cast("string")) != "")
    joined = df.where(name != "").join(named, key, "left")
    added = [F.lit(None).cast(f.dataType).alias(f.name) for f in taxonomy.schema.fields if f.name != key]
    blank = df.where(name == "").select(key, *[F.col(f"`{c}`") for c in df.columns if c != key], *added)
    return joined.unionAll(blank)


def counts_by_rank(
    df: DataFrame,
    taxonomy: DataFrame,
    ranks: str | Sequence[str],
    by: str | Sequence[str] | None = None,
    key: str = "scientific_name",
    name: str = "n",
    weight: str | None = None,
) -> DataFrame:
    """Records per rank of the taxonomy, equal to counting after :func:`enrich`.

    Records are counted per name first, so the join sees one row per name instead of one per record.
    """
    groups = names_of(by)
    per_name = count_rows(df, [*groups, key], "_rows", weight)
    joined = per_name.join(taxonomy.select(key, *names_of(ranks)), key, "left")
    return joined.groupBy(*groups, *names_of(ranks)).agg(F.sum("_rows").alias(name))


def enrich_once(totals: DataFrame, taxonomy: DataFrame, order: Sequence[str], key: str = "scientific_name") -> DataFrame:
    """Left join of species totals to the taxonomy, one taxonomy entry per name.

    The taxonomy is reduced before the join, which gives the same rows and keeps the join 1:1.
    """
    return totals.join(one_per_key(taxonomy, key, order), key, "left")


def level_counts(
    df: DataFrame,
    ranks: Sequence[str],
    name: str = "num_obs",
    weight: str | None = None,
    by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Records per rank at every level of a hierarchy, with the ``depth`` of the level.

    Levels that are deeper than a row's depth are NULL. Records are counted at the deepest level
    once and only those counts are rolled up; ``by`` makes one hierarchy per group. A row whose rank is blank or missing stops there: it
    counts for the levels above and makes no row at its own.
    """
    ranks, groups = names_of(ranks), names_of(by)
    deepest = count_rows(df, [*groups, *ranks], "_rows", weight)
    levels = [
        F.struct(
            F.lit(depth).alias("depth"),
            *[(F.col(r) if i < depth else F.lit(None).cast("string")).alias(r) for i, r in enumerate(ranks)],
        )
        for depth in range(1, len(ranks) + 1)
    ]
    prefix, filled_to = F.lit(True), F.lit(0)
    for rank in ranks:
        prefix = prefix & F.coalesce(F.col(rank) != "", F.lit(False))
        filled_to = filled_to + prefix.cast("int")
    exploded = deepest.select(*groups, "_rows", filled_to.alias("_to"), F.explode(F.array(*levels)).alias("l"))
    kept = exploded.where(F.col("l.depth") <= F.col("_to")).select(*groups, "_rows", "l.*")
    return kept.groupBy(*groups, "depth", *ranks).agg(F.sum("_rows").alias(name))


def parent_child(
    df: DataFrame,
    ranks: Sequence[str],
    name: str = "num_obs",
    path_parents: bool = False,
    weight: str | None = None,
    by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Hierarchy as ``(parents, labels, value)`` rows, one per group of ``by``; roots have a blank parent.

    ``path_parents`` names a parent by its whole path (``kingdom - phylum``), for ranks whose labels
    repeat under different parents. A parent may exceed the sum of its children.
    """
    ranks = names_of(ranks)
    counts = level_counts(df, ranks, name, weight, by)
    label = F.coalesce(*[F.col(r) for r in reversed(ranks)])
    if path_parents:
        parents = [F.concat_ws(" - ", *[F.col(r) for r in ranks[:d]]) for d in range(len(ranks))]
    else:
        parents = [F.lit(""), *[F.col(r) for r in ranks[:-1]]]
    parent = F.element_at(F.array(*parents), F.col("depth"))
    return counts.select(*names_of(by), "depth", parent.alias("parents"), label.alias("labels"), name)


def numbered(df: DataFrame, *order: ColumnLike, name: str = "row") -> DataFrame:
    """Row numbers from 1 in a global order, without gathering the rows in one task.

    The rows are range-sorted and materialised with their place inside their partition; only the
    partition sizes are added up. Materialising keeps the sort's sampled ranges from changing between
    the two uses.
    """
    placed = df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    # the id holds the partition above the lower 33 bits and the place inside it below
    kept = cut_lineage(placed.withColumn("_part", F.shiftright("_place", 33)))
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_place").alias("_start"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", "_start", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_place") - F.col("_start") + 1
    return kept.join(offsets, "_part").select(number.alias(name), *[F.col(f"`{c}`") for c in df.columns])


def ranked_summary(df: DataFrame, keys: str | Sequence[str], name: str = "count", row_name: str = "row") -> DataFrame:
    """Records per key, numbered from the most frequent; ties in key order."""
    columns = names_of(keys)
    return numbered(count_rows(df, columns, name), F.desc(name), *[F.asc(c) for c in columns], name=row_name)


def grade_share_by_key(
    df: DataFrame, key: str, condition: Column, total_name: str = "total", hit_name: str = "hits"
) -> DataFrame:
    """Two summaries of one frame, all rows and matching rows per key, paired by key.

    A key without a matching row shows 0; blank and missing keys are left out.
    """
    return (
        df.where(F.col(key) != "")
        .groupBy(key)
        .agg(F.count_if(condition).alias(hit_name), F.count(F.lit(1)).alias(total_name))
    )
