"""Watch-list classification of an occurrence feed.

Every row-level operator reads the feed once and keeps no global order, so each also works on a
streaming feed joined to static lists; callers sort a report at its edge with :func:`newest_first`.

``by`` names the columns (a park) that feed and watch list share: every park is then held against its own list, and all of them
in the same pass. Status lists count in each park that has a list; records of other parks, and of none, are left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import names as N
from fieldtally.operators.counts import count_rows, group_sums
from fieldtally.operators.reshape import stack
from fieldtally.types import names_of, require_columns

# Watch-list categories.
RARE_CATEGORY = "species of interest"
INVASIVE_CATEGORIES = ("invasive not established", "invasive established", "pest disease")

# Labels of the three tallies and of the three record sets.
PEST, THREATENED, RARE = "pest/invasive", "threatened/endangered", "rare native"

FEED_COLUMNS = (
    "scientific_name",
    "common_name",
    "observed_on",
    "place_guess",
    "latitude",
    "longitude",
    "positional_accuracy",
    "url",
)


def combined_feed(observations: DataFrame, checklists: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Research-grade observations and checklist lines in one feed with the watch-list columns, after those of ``by``."""
    keys = names_of(by)
    obs = observations.where(F.col("quality_grade") == "research").select(*keys, *FEED_COLUMNS)
    chk = checklists.withColumnsRenamed({"obs_date": "observed_on", "locality": "place_guess"}).select(
        *keys, "scientific_name", "common_name", "observed_on", "place_guess", "latitude", "longitude"
    )
    return stack(obs, chk)


def status_entries(*lists: DataFrame) -> DataFrame:
    """Status lists stacked; a species on two lists has two entries, and so two rows per record."""
    columns = ["scientific_name", "listing_status"]
    return stack(*[one.select(*columns) for one in lists])


def threatened(feed: DataFrame, entries: DataFrame) -> DataFrame:
    """Records of listed species with their status, once per list entry."""
    require_columns(feed.columns, FEED_COLUMNS, "feed")
    return feed.join(entries, "scientific_name").select(
        "scientific_name",
        "common_name",
        "observed_on",
        F.col("place_guess").alias("location"),
        "listing_status",
        "latitude",
        "longitude",
        "url",
    )


def rare(feed: DataFrame, watch: DataFrame, category: str = RARE_CATEGORY) -> DataFrame:
    """Records of native species of interest."""
    require_columns(feed.columns, FEED_COLUMNS, "feed")
    names = watch.where(F.col("category") == category).select("scientific_name")
    return feed.join(names, "scientific_name", "left_semi").select(
        "scientific_name",
        "common_name",
        "observed_on",
        F.col("place_guess").alias("location"),
        "latitude",
        "longitude",
        "positional_accuracy",
        "url",
    )


def by_park(lists: Mapping[str, DataFrame], name: str = "park") -> DataFrame:
    """Watch lists of several parks as one, told apart by ``name``; a column that one list lacks is NULL there."""
    return stack(*[one.withColumn(name, F.lit(park)) for park, one in lists.items()])


def _invasive_names(watch: DataFrame, categories: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Exact names of the invasive categories, once each (per park)."""
    return (
        watch.where(F.col("category").isin(*categories))
        .select(*keys, "scientific_name")
        .distinct()
        .withColumn("_by_name", F.lit(1))
    )


def _listed_genera(watch: DataFrame, genus_categories: Sequence[str] | None, keys: Sequence[str] = ()) -> DataFrame:
    """Genera of the ``Genus spp.`` entries, once each; by default of entries in any category."""
    entries = watch.where(N.is_genus_entry("scientific_name"))
    if genus_categories is not None:
        entries = entries.where(F.col("category").isin(*genus_categories))
    return entries.select(*keys, N.genus_of_list_entry("scientific_name").alias("_genus")).distinct().withColumn(
        "_by_genus", F.lit(1)
    )


def _with_hits(
    df: DataFrame,
    watch: DataFrame,
    categories: Sequence[str],
    genus_categories: Sequence[str] | None,
    strict_genus: bool,
) -> DataFrame:
    """Adds ``_hits``: how often a row matches, by name (0/1) plus by genus (0/1); rows with 0 are dropped."""
    # the short form of a name: its first blank and the word behind it are removed, so a trinomial
    # keeps two words and never equals a genus; the strict form compares the true genus
    short = N.genus("scientific_name") if strict_genus else N.drop_first_word("scientific_name")
    joined = (
        df.withColumn("_genus", short)
        .join(_invasive_names(watch, categories), "scientific_name", "left")
        .join(_listed_genera(watch, genus_categories), "_genus", "left")
    )
    hits = F.coalesce("_by_name", F.lit(0)) + F.coalesce("_by_genus", F.lit(0))
    return joined.withColumn("_hits", hits).where(F.col("_hits") > 0).drop("_genus", "_by_name", "_by_genus")


def invasive(
    feed: DataFrame,
    watch: DataFrame,
    categories: Sequence[str] = INVASIVE_CATEGORIES,
    genus_categories: Sequence[str] | None = None,
    strict_genus: bool = False,
) -> DataFrame:
    """Records of invasive species and pests, by exact name or by listed genus.

    A record that matches both ways appears twice. The feed is read once; the second copy comes from
    the hit count, not from a second pass.
    """
    hits = _with_hits(feed, watch, categories, genus_categories, strict_genus)
    copies = hits.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_hits"))))
    return copies.select(*feed.columns)


def _sets_by(listed: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One row per key with all its list entries."""
    return listed.groupBy(*keys).agg(F.collect_list(F.struct("list", "listing_status")).alias(name))


def _with_lists(
    df: DataFrame,
    entries: DataFrame,
    watch: DataFrame,
    categories: Sequence[str],
    genus_categories: Sequence[str] | None,
    strict_genus: bool,
    by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Rows copied once per list they belong to, with ``list`` and ``listing_status``; others drop.

    The lists are first folded to one row per name that says which sets it belongs to and how often,
    so the records meet one small table by name and one by genus, and with ``by`` one of statuses.
    """
    parks = names_of(by)
    names = [*parks, "scientific_name"]
    no_status = F.lit(None).cast("string").alias("listing_status")
    rare_names = watch.where(F.col("category") == RARE_CATEGORY).select(*names).distinct()
    of_status = entries.select("scientific_name", F.lit(THREATENED).alias("list"), "listing_status")
    of_watch = stack(
        rare_names.select(*names, F.lit(RARE).alias("list"), no_status),
        _invasive_names(watch, categories, parks).select(*names, F.lit(PEST).alias("list"), no_status),
    )
    short = N.genus("scientific_name") if strict_genus else N.drop_first_word("scientific_name")
    joined = df.withColumn("_genus", short)
    if parks:
        joined = joined.join(watch.select(*parks).distinct(), parks, "left_semi")
        joined = joined.join(_sets_by(of_watch, names, "_sets"), names, "left")
        joined = joined.join(_sets_by(of_status, ["scientific_name"], "_statuses"), "scientific_name", "left")
        found = ["_sets", "_statuses"]
    else:
        joined = joined.join(_sets_by(stack(of_status, of_watch), names, "_sets"), names, "left")
        found = ["_sets"]
    joined = joined.join(_listed_genera(watch, genus_categories, parks), [*parks, "_genus"], "left")
    nothing = F.array().cast("array<struct<list:string,listing_status:string>>")
    pest_set = F.array(F.struct(F.lit(PEST).alias("list"), no_status))
    by_genus = F.when(F.col("_by_genus") == 1, pest_set).otherwise(nothing)
    hits = F.concat(*(F.coalesce(x, nothing) for x in found), by_genus)
    listed = reduce(or_, (F.col(x).isNotNull() for x in [*found, "_by_genus"]))
    copied = joined.where(listed).select(*df.columns, F.explode(hits).alias("_hit"))
    return copied.select(*df.columns, "_hit.list", "_hit.listing_status")


def classify(
    feed: DataFrame,
    entries: DataFrame,
    watch: DataFrame,
    categories: Sequence[str] = INVASIVE_CATEGORIES,
    genus_categories: Sequence[str] | None = None,
    strict_genus: bool = False,
    by: str | Sequence[str] | None = None,
) -> DataFrame:
    """All three record sets in one pass over the feed, told apart by ``list`` (and by park)."""
    columns = [*names_of(by), *FEED_COLUMNS]
    require_columns(feed.columns, columns, "feed")
    return _with_lists(feed.select(*columns), entries, watch, categories, genus_categories, strict_genus, by)


def newest_first(df: DataFrame, date: str = "observed_on") -> DataFrame:
    """Report order: newest first, ties by the remaining columns; missing dates last."""
    rest = [F.asc(c) for c in df.columns if c != date]
    return df.orderBy(F.desc_nulls_last(date), *rest)


def tallies(
    feed: DataFrame,
    entries: DataFrame,
    watch: DataFrame,
    categories: Sequence[str] = INVASIVE_CATEGORIES,
    genus_categories: Sequence[str] | None = None,
    strict_genus: bool = False,
    rare_label: str = RARE,
    weight: str | None = None,
    by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Records per species on each of the three lists (of its park), stacked.

    The feed is counted per species first; the lists are joined to those counts. A species counts
    once per list entry or per way of matching, as in the record sets.
    """
    names = [*names_of(by), "scientific_name"]
    per_name = count_rows(feed, names, "count", weight)
    matched = _with_lists(per_name, entries, watch, categories, genus_categories, strict_genus, by)
    label = F.when(F.col("list") == RARE, F.lit(rare_label)).otherwise(F.col("list"))
    return group_sums(matched, [*names, label.alias("category")], "count").select(*names, "count", "category")


def report_order(table: DataFrame) -> DataFrame:
    """Tally table as printed: pests, then threatened, then rare; most frequent first."""
    place = F.when(F.col("category") == PEST, 0).when(F.col("category") == THREATENED, 1).otherwise(2)
    return table.orderBy(place, F.desc("count"), "scientific_name")


def list_totals(table: DataFrame, name: str = "sum", by: str | Sequence[str] | None = None) -> DataFrame:
    """Records per list (and park)."""
    return group_sums(table, [*names_of(by), "category"], "count", name)


def detection(
    watch: DataFrame, table: DataFrame, in_park: Sequence[str] | None = None, by: str | Sequence[str] | None = None
) -> DataFrame:
    """Watch-list entries (optionally of one presence class) flagged yes/no by whether they were seen (in their park)."""
    names = [*names_of(by), "scientific_name"]
    kept = watch.where(F.col("in_park").isin(*in_park)) if in_park is not None else watch
    seen = table.select(*names).distinct().withColumn("_seen", F.lit(True))
    flag = F.when(F.col("_seen"), F.lit("yes")).otherwise(F.lit("no"))
    return kept.join(seen, names, "left").withColumn("detected", flag).drop("_seen")


def detection_rate(flags: DataFrame, name: str = "rate", by: str | Sequence[str] | None = None) -> DataFrame:
    """Entries, entries seen, and their ratio (per park)."""
    seen = [F.count(F.lit(1)).alias("listed"), F.count_if(F.col("detected") == "yes").alias("detected")]
    keys = names_of(by)
    counted = flags.groupBy(*keys).agg(*seen) if keys else flags.agg(*seen)
    return counted.withColumn(name, F.col("detected").cast("double") / F.nullif(F.col("listed").cast("double"), F.lit(0.0)))
