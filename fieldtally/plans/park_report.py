"""The whole park analysis over the two canonical feeds.

``ingest`` clips both feeds to all park polygons at once and stores them partitioned by park and
year; ``report`` reads the stored feeds and returns every result as a named, lazy DataFrame, with a
``park`` column where results are per park. Nothing runs until a result is written or shown.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import names as N
from fieldtally.operators import calendar as K
from fieldtally.operators import counts, curves, participation, predicates as P, reshape, spatial, stats, taxonomy
from fieldtally.lineage import cut_lineage
from fieldtally.operators import watchlist as W
from fieldtally.sources.inline import inline_rows
from fieldtally.sources.writers import write_dataset

TOTAL_CHECKLISTS, COMPLETE_CHECKLISTS = "Total checklists", "Complete checklists"
TOTAL_RECORDS, RESEARCH_RECORDS = "Total observations", "Research grade observations"


@dataclass(frozen=True)
class Settings:
    """Choices of one study; dates are ISO text, both ends of a period included."""

    last_date: str = "2023-12-31"
    bad_checklists: Sequence[str] = ()
    first_checklist_year: int = 1958
    first_visit_year: int = 2020
    calendar_first: str | None = None
    calendar_last: str | None = None
    periods: Mapping[str, tuple[str | None, str | None]] = field(default_factory=dict)
    seasons: Mapping[str, Sequence[int]] = field(default_factory=dict)
    tool_period: tuple[str, str] = ("2023-01-23", "2023-12-24")
    hotspots: Mapping[str, str] = field(default_factory=dict)
    relabel: Mapping[str, str] = field(default_factory=dict)
    grid_shapes: Mapping[str, tuple[int, int]] = field(default_factory=dict)
    grid_pads: Mapping[str, tuple[float, float, float, float]] = field(default_factory=dict)
    density_breaks: Sequence[int] = spatial.DENSITY_BREAKS


def clip(feed: DataFrame, parks: spatial.Cover) -> DataFrame:
    """Records inside a park, with the park's name in ``park``."""
    (key,) = parks.keys
    return spatial.points_in_polygons(feed, parks).withColumnRenamed(key, "park")


def ingest(
    observations: DataFrame, checklists: DataFrame, parks: DataFrame, settings: Settings, path: str
) -> tuple[str, str]:
    """Cut both feeds to the study's dates and parks and store them; returns the two dataset paths.

    ``parks`` is an edge table (:func:`spatial.edges_of`) keyed by park name. Date cuts run before the
    clip, each feed is read once for all parks.
    """
    cover = spatial.cover_of(parks)
    obs = clip(observations.where(P.on_or_before("observed_on", settings.last_date)), cover)
    dated = checklists.where(P.on_or_before("obs_date", settings.last_date))
    if settings.bad_checklists:
        dated = dated.where(P.not_among("checklist_id", settings.bad_checklists))
    chk = clip(dated, cover).withColumn("year", F.year("obs_date"))
    paths = f"{path.rstrip('/')}/observations", f"{path.rstrip('/')}/checklists"
    write_dataset(obs, paths[0])
    write_dataset(chk, paths[1])
    return paths


def totals(obs: DataFrame, chk: DataFrame) -> dict[str, DataFrame]:
    """Species lists, checklist completeness and record totals."""
    named = P.is_named_research()
    complete = P.is_complete()
    species_obs = obs.where(named).select("park", "scientific_name")
    species_chk = chk.where(P.is_species()).select("park", "scientific_name")
    graded = counts.rate_by_group(obs, "park", P.is_research(), "records", "research", "percent_research", 2)
    species_level = counts.rate_by_group(
        obs, "park", P.all_filled("scientific_name"), "records", "species_level", "percent_species_level", 2
    )
    return {
        "species_per_park_observations": counts.count_distinct(species_obs, "scientific_name", "park", "species"),
        "species_per_park_checklists": counts.count_distinct(species_chk, "scientific_name", "park", "species"),
        "species_list": reshape.distinct_union("scientific_name", species_obs, species_chk),
        "checklist_completeness": counts.completeness_summary(chk, "checklist_id", "observer_id", complete, "park"),
        "research_grade": graded,
        "species_level": species_level,
        "records_per_observer": counts.count_distinct(obs, "user_id", "park", "observers", rows_name="records"),
        "all_parks": counts.two_feed_summary(obs, chk, P.is_research(), complete, P.all_filled("scientific_name")),
        "per_park": counts.two_feed_summary(obs, chk, P.is_research(), complete, P.all_filled("scientific_name"), by="park"),
    }


def series(obs: DataFrame, chk: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """Curves and monthly series."""
    recent = chk.where(P.from_year("obs_date", settings.first_checklist_year))
    monthly_chk = counts.monthly_variants(
        recent, "obs_date", P.is_complete(), (TOTAL_CHECKLISTS, COMPLETE_CHECKLISTS), "park", "checklist_id"
    )
    monthly_obs = counts.monthly_variants(
        obs, "observed_on", P.is_research(), (TOTAL_RECORDS, RESEARCH_RECORDS), "park"
    )
    out = {
        "observer_curve_observations": curves.accumulation(obs, "user_id", "observed_on", "park"),
        "observer_curve_checklists": curves.accumulation(chk, "observer_id", "obs_date", "park"),
        "records_curve_observations": curves.records_curve(obs, "observed_on", "park"),
        "records_curve_checklists": curves.records_curve(chk, "obs_date", "park"),
        "species_curve_observations": curves.accumulation(
            obs.where(P.is_named_research()), "scientific_name", "observed_on", "park"
        ),
        "species_curve_checklists": curves.accumulation(
            chk.where(P.is_species()), "scientific_name", "obs_date", "park"
        ),
        "monthly_checklists": monthly_chk,
        "monthly_observations": monthly_obs,
        "richness_per_checklist": K.mean_se(
            counts.count_rows(chk.where(P.is_species() & P.is_complete()), ["park", "checklist_id"], "richness"),
            "richness",
            "park",
        ),
    }
    if settings.periods:
        for name, monthly, label in (
            ("period_means_checklists", monthly_chk, TOTAL_CHECKLISTS),
            ("period_means_observations", monthly_obs, TOTAL_RECORDS),
        ):
            filled = K.zero_filled(
                monthly.where(F.col("data") == label),
                by="park",
                first=settings.calendar_first,
                last=settings.calendar_last,
            )
            out[name] = K.period_mean_se(filled, settings.periods, by="park", months=settings.seasons)
    return out


def taxa(obs: DataFrame, chk: DataFrame, birds: DataFrame) -> dict[str, DataFrame]:
    """Taxonomic shares, frequencies and hierarchies."""
    research = obs.where(P.is_research())
    tidy = birds.select("scientific_name", "order", N.strip_bracketed("family").alias("family"))
    # one count per park and name serves every bird table
    per_name = counts.count_rows(chk, ["park", "scientific_name"], "k")
    ranked_birds = per_name.join(tidy, "scientific_name", "left").withColumn("class", F.lit("Aves"))
    both_orders = reshape.stack(
        counts.count_rows(ranked_birds, "order", "n", "k"), counts.count_rows(research, "order", "n")
    )
    all_orders = counts.group_sums(both_orders, "order", "n")
    return {
        "order_share_checklists": counts.share_of_total(
            counts.count_rows(ranked_birds, "order", "n", "k"), keep=P.all_filled("order")
        ),
        "order_share_checklists_by_park": counts.share_of_total(
            counts.count_rows(ranked_birds, ["park", "order"], "n", "k"), keep=P.all_filled("order"), by="park"
        ),
        "order_share_all": counts.share_of_total(all_orders, keep=P.all_filled("order")),
        "species_frequency": counts.frequency_by_taxon(chk, ["common_name", "scientific_name"], "checklist_id"),
        "species_frequency_by_park": counts.frequency_by_taxon(
            chk, ["common_name", "scientific_name"], "checklist_id", by="park"
        ),
        "research_rate_by_kingdom": counts.rate_by_group(
            obs.where(P.all_filled("kingdom")), ["park", "kingdom"], P.is_research()
        ).orderBy("park", F.desc("percent_rg"), "kingdom"),
        "species_per_kingdom": counts.count_distinct(
            obs.where(P.is_named_research()), "scientific_name", ["park", "kingdom"], "species"
        ),
        "records_per_order": counts.ranked_counts(research.where(P.all_filled("order")), ["park", "kingdom", "order"]),
        "species_per_order": counts.count_distinct(
            research.where(P.all_filled("order")), "scientific_name", ["park", "kingdom", "order"], "species"
        ),
        "records_per_species": counts.ranked_counts(obs.where(P.is_named_research()), ["park", "scientific_name"]),
        "hierarchy_observations": taxonomy.parent_child(research, ["kingdom", "phylum", "class"]),
        "hierarchy_checklists": taxonomy.parent_child(
            ranked_birds.where(P.all_filled("order")), ["class", "order", "family"], weight="k"
        ),
        "hierarchy_observations_by_park": taxonomy.parent_child(research, ["kingdom", "phylum", "class"], by="park"),
        "hierarchy_checklists_by_park": taxonomy.parent_child(
            ranked_birds.where(P.all_filled("order")), ["class", "order", "family"], weight="k", by="park"
        ),
    }


def visit_rates(obs: DataFrame, chk: DataFrame, visits: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """Participation per visit, its means, and the rank-sum test between the first two parks by name."""
    rates = participation.visit_rates(
        participation.yearly_participation(chk, "observer_id"),
        participation.yearly_participation(obs, "user_id"),
        visits,
        settings.first_visit_year,
    )
    return {"participation": rates, "participation_means": participation.visit_rate_means(rates)}


def coverage(obs: DataFrame, chk: DataFrame, parks: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """Zero-filled cells with density classes and the share of covered cells, of all parks with a grid in one pass."""
    if not settings.grid_shapes:
        return {}
    relabelled = chk
    for checklist, label in settings.relabel.items():
        relabelled = relabelled.withColumn("locality", P.relabelled("locality", "checklist_id", [checklist], label))
    (key,) = [c for c in parks.columns if c not in ("x1", "y1", "x2", "y2")]
    names = list(settings.grid_shapes)
    rows = [(n, *settings.grid_shapes[n], *map(float, settings.grid_pads.get(n, (0.01,) * 4))) for n in names]
    shapes = inline_rows(obs.sparkSession, ["park", "rows", "cols", "left", "right", "bottom", "top"], rows)
    kept = F.lit(True)
    for park, hotspot in settings.hotspots.items():
        kept = kept & ((F.col("park") != park) | P.not_hotspot("locality", hotspot))
    points = reshape.stack_strict(
        obs.where(F.col("park").isin(*names)).select("park", "longitude", "latitude"),
        relabelled.where(F.col("park").isin(*names) & kept).select("park", "longitude", "latitude"),
    )
    grids = cut_lineage(spatial.grid_table(points, shapes))
    cells = cut_lineage(spatial.zero_filled_grids(spatial.grid_counts_by(points, grids), grids))
    classed = cells.withColumn("density", spatial.density_class("count", settings.density_breaks))
    covered = spatial.grid_coverage(cells, spatial.cover_of(parks.where(F.col(key).isin(*names)), (key,)), own="park")
    out = {"grids": classed, "grid_coverage": covered.withColumnRenamed(key, "park")}
    for park in names:
        here = F.col("park") == park
        out[f"grid_{park}"] = classed.where(here).drop("park")
        out[f"grid_coverage_{park}"] = out["grid_coverage"].where(here).drop("park")
    return out


def watch_lists(
    obs: DataFrame, chk: DataFrame, entries: DataFrame, lists: Mapping[str, DataFrame], settings: Settings
) -> dict[str, DataFrame]:
    """Watch-list records, tallies, detection and tool statistics of all parks with a list, each against its own, in one pass."""
    if not lists:
        return {}
    first, last = settings.tool_period
    watch, some = W.by_park(lists), F.col("park").isin(*lists)
    feed = W.combined_feed(obs.where(some), chk.where(some), "park")
    table = W.tallies(feed, entries, watch, by="park")
    inside = W.tallies(feed.where(P.in_period("observed_on", first, last, closed=False)), entries, watch, by="park")
    flags = W.detection(watch, table, by="park")
    out = {
        "watch_records": W.classify(feed, entries, watch, by="park"),
        "watch_table": table,
        "watch_tool_stats": W.list_totals(inside, by="park"),
        "watch_detection_rate": W.detection_rate(flags.where("in_park = 'Y'"), by="park"),
        "watch_unexpected": flags.where("in_park IN ('N', 'U') AND detected = 'yes'"),
    }
    for park, own in lists.items():
        of_park = {f"{name}_{park}": df.where(F.col("park") == park).drop("park") for name, df in out.items() if "park" in df.columns}
        of_park[f"watch_table_{park}"] = W.report_order(of_park[f"watch_table_{park}"])
        of_park[f"watch_unexpected_{park}"] = of_park[f"watch_unexpected_{park}"].select(*own.columns, "detected")
        out = out | of_park
    return out


def visits_rank_sum(rates: DataFrame, first: str, second: str, measure: str = "observers_vis") -> DataFrame:
    """Rank-sum test of a visit rate between two parks. Runs at once: it needs the values' quantiles."""
    return stats.rank_sum_test(rates, measure, "park", first, second)


def report(
    obs: DataFrame,
    chk: DataFrame,
    settings: Settings,
    birds: DataFrame | None = None,
    visits: DataFrame | None = None,
    parks: DataFrame | None = None,
    entries: DataFrame | None = None,
    lists: Mapping[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Every result the given inputs allow, by name."""
    out = totals(obs, chk) | series(obs, chk, settings)
    if birds is not None:
        out |= taxa(obs, chk, birds)
    if visits is not None:
        out |= visit_rates(obs, chk, visits, settings)
    if parks is not None:
        out |= coverage(obs, chk, parks, settings)
    if entries is not None and lists is not None:
        out |= watch_lists(obs, chk, entries, lists, settings)
    return out
