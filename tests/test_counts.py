"""Predicates, counts, unions, calendars and means on hand-made frames."""

import datetime as dt
import math
import statistics

import random

import pytest
from pyspark.sql import functions as F

from fieldtally.operators.calendar import mean_se_real
from fieldtally.operators import calendar as K
from fieldtally.operators import columns as C
from fieldtally.operators import counts, participation, predicates as P, reshape, taxonomy
from fieldtally.sources import inline_rows

PROTOCOLS = ("Traveling", "Stationary", "Incidental")


@pytest.fixture(scope="module")
def checklists(spark):
    """Every combination of protocol, duration and all-species flag, one checklist each."""
    table = []
    for protocol in PROTOCOLS:
        for duration in (None, 4.0, 5.0):
            for reported in (0, 1):
                table.append((len(table), protocol, duration, reported))
    return inline_rows(spark, ["checklist_id", "protocol", "duration_min", "all_species_reported"], table).cache()


@pytest.mark.parametrize(
    "rule, expected",
    [
        ("standard", {("Traveling", 5.0, 1), ("Stationary", 5.0, 1)}),
        (
            "protocol",
            {("Traveling", d, r) for d in (None, 4.0, 5.0) for r in (0, 1)} | {("Stationary", 5.0, 1)},
        ),
        (
            "richness",
            {("Traveling", d, r) for d in (None, 4.0, 5.0) for r in (0, 1)} | {("Stationary", 5.0, 0), ("Stationary", 5.0, 1)},
        ),
    ],
)
def test_complete_checklist_rules(checklists, rule, expected):
    kept = checklists.where(P.is_complete(rule=rule)).select("protocol", "duration_min", "all_species_reported")
    assert {tuple(r) for r in kept.collect()} == expected


def test_unknown_rule_is_refused():
    with pytest.raises(ValueError):
        P.is_complete("duration_min", rule="other")


def test_named_research_drops_blank_and_missing(spark, rows):
    df = inline_rows(spark, ["scientific_name", "quality_grade"], [("a b", "research"), ("", "research"), (None, "research"), ("c d", "casual")])
    assert rows(df.where(P.is_named_research()), "scientific_name") == [("a b",)]


def test_text_tests_are_never_missing(spark, rows):
    df = inline_rows(spark, ["n", "t"], [(1, "species complex"), (2, "gull"), (3, None)])
    assert rows(df.where(~P.has_text("t", "complex")), "n") == [(2,), (3,)]
    assert rows(df.where(~P.matches("t", "l$")), "n") == [(1,), (3,)]


def test_periods_and_seasons(spark, rows):
    df = spark.sql("SELECT explode(sequence(date'2022-11-01', date'2023-03-01', interval 1 month)) AS d")
    assert df.where(P.in_period("d", "2022-12-01", "2023-02-01")).count() == 3
    assert df.where(P.in_period("d", "2022-12-01", "2023-02-01", closed=False)).count() == 1
    assert df.where(P.in_months("d", (12, 1, 2))).count() == 3
    assert df.where(P.on_or_before("d", "2022-12-01") & P.from_year("d", 2022)).count() == 2


def test_missing_accuracy_does_not_pass(spark):
    df = inline_rows(spark, ["a"], [(10.0,), (100.0,), (None,)])
    assert df.where(P.accurate_within("a", 100)).count() == 1


def test_distinct_count_takes_missing_as_a_value(spark, rows):
    df = inline_rows(spark, ["g", "k"], [("a", "1"), ("a", "1"), ("a", None), ("b", None), ("b", "2"), ("b", "3")])
    assert rows(counts.count_distinct(df, "k", "g", "n", rows_name="rows")) == [("a", 2, 3), ("b", 3, 3)]
    assert rows(counts.count_distinct(df, "k", name="n")) == [(4,)]


def test_ranked_counts_break_ties_by_key(spark):
    df = inline_rows(spark, ["k"], [("b",), ("a",), ("c",), ("c",)])
    assert [tuple(r) for r in counts.ranked_counts(df, "k").collect()] == [("c", 2), ("a", 1), ("b", 1)]
    assert [r[0] for r in counts.ranked_counts(df, "k", top=2).collect()] == ["c", "a"]


def test_share_keeps_blank_keys_in_the_denominator(spark, rows):
    df = inline_rows(spark, ["order", "n"], [("A", 50), ("B", 30), ("", 15), (None, 5)])
    shares = counts.share_of_total(df, keep=P.all_filled("order"))
    assert rows(shares, "order", "percent") == [("A", 50.0), ("B", 30.0)]


def test_frequency_per_distinct_checklist(spark, rows):
    df = inline_rows(spark, ["name", "list"], [("a", 1), ("a", 2), ("b", 1), ("b", 1), ("c", 3)])
    freq = counts.frequency_by_taxon(df, "name", "list")
    assert rows(freq, "name", "frequency") == [("a", 66.67), ("b", 66.67), ("c", 33.33)]


# Published totals, research-grade totals and rounded percentages per kingdom.
KINGDOMS = [
    ("Animalia", 20279, 13586, 67.0, "first"),
    ("Plantae", 35618, 21933, 62.0, "first"),
    ("Chromista", 531, 269, 51.0, "first"),
    ("Bacteria", 14, 3, 21.0, "first"),
    ("Fungi", 11011, 2048, 19.0, "first"),
    ("Protozoa", 203, 39, 19.0, "first"),
    ("Plantae", 1288, 966, 75.0, "second"),
    ("Animalia", 1168, 671, 57.0, "second"),
    ("Fungi", 371, 131, 35.0, "second"),
    ("Chromista", 1, 0, 0.0, "second"),
    ("Protozoa", 2, 0, 0.0, "second"),
    ("Viruses", 1, 0, 0.0, "second"),
]


def test_published_kingdom_rates(spark):
    """The published table, rebuilt from records expanded from its own counts."""
    table = inline_rows(spark, ["kingdom", "total", "rg", "park"], [(k, t, r, p) for k, t, r, _, p in KINGDOMS])
    records = table.select("kingdom", "park", F.explode(F.sequence(F.lit(1), "total")).alias("i"), "rg").select(
        "kingdom", "park", F.when(F.col("i") <= F.col("rg"), "research").otherwise("casual").alias("quality_grade")
    )
    found = counts.rate_by_group(records, ["kingdom", "park"], P.is_research())
    got = {(r["kingdom"], r["total_obs"], r["rg_obs"], r["percent_rg"], r["park"]) for r in found.collect()}
    assert got == set(KINGDOMS)
    by_park = {r["park"]: r["rg_obs"] for r in counts.rolled_up_rates(found, "park").collect()}
    assert by_park == {"first": 37878, "second": 1768}


def test_monthly_variants_skip_empty_months_of_the_second_series(spark, rows):
    df = spark.sql("SELECT * FROM VALUES (date'2020-01-05', 1, true), (date'2020-01-07', 1, false), (date'2020-02-01', 2, false) AS t(d, list, ok)")
    both = counts.monthly_variants(df, "d", F.col("ok"), ("all", "some"), distinct="list")
    assert rows(both) == [(dt.date(2020, 1, 1), 1, "all"), (dt.date(2020, 1, 1), 1, "some"), (dt.date(2020, 2, 1), 1, "all")]
    single = counts.monthly_counts(df, "d", distinct="list")
    assert rows(single) == [(dt.date(2020, 1, 1), 1), (dt.date(2020, 2, 1), 1)]


def test_completeness_summary(spark):
    df = inline_rows(
        spark,
        ["list", "obs", "ok"],
        [(1, "a", 1), (1, "a", 0), (2, "a", 0), (3, "b", 1), (3, None, 1)],
    )
    row = counts.completeness_summary(df, "list", "obs", F.col("ok") == 1).first()
    assert (row["records"], row["complete_records"], row["checklists"], row["complete_checklists"], row["observers"]) == (5, 3, 3, 2, 3)
    assert row["checklists_per_observer"] == 1.0
    assert row["percent_complete"] == pytest.approx(200 / 3)


def test_completeness_summary_of_reduced_lines(spark):
    full = inline_rows(spark, ["list", "obs", "ok"], [(1, "a", 1), (1, "a", 1), (1, "a", 0), (2, "b", 0)])
    reduced = counts.count_rows(full, ["list", "obs", "ok"], "k")
    a = counts.completeness_summary(full, "list", "obs", F.col("ok") == 1).first()
    b = counts.completeness_summary(reduced, "list", "obs", F.col("ok") == 1, weight="k").first()
    assert a == b


def test_zero_filled_calendar_gaps_and_late_months(spark, rows):
    series = spark.sql("SELECT * FROM VALUES (date'2020-01-01', 3), (date'2020-04-01', 2) AS t(date, tot_obs)")
    by_data = K.zero_filled(series)
    assert rows(by_data) == [(dt.date(2020, m, 1), n) for m, n in ((1, 3), (2, 0), (3, 0), (4, 2))]
    # a calendar that ends before the data keeps the later months but fills no gap there
    short = K.zero_filled(series, first="2019-12-01", last="2020-02-01")
    assert rows(short) == [(dt.date(2019, 12, 1), 0), (dt.date(2020, 1, 1), 3), (dt.date(2020, 2, 1), 0), (dt.date(2020, 4, 1), 2)]


def test_groups_share_one_calendar(spark, rows):
    series = spark.sql("SELECT * FROM VALUES ('a', date'2020-01-01', 3), ('b', date'2020-02-01', 2) AS t(park, date, tot_obs)")
    assert rows(K.zero_filled(series, by="park")) == [
        ("a", dt.date(2020, 1, 1), 3),
        ("a", dt.date(2020, 2, 1), 0),
        ("b", dt.date(2020, 1, 1), 0),
        ("b", dt.date(2020, 2, 1), 2),
    ]


def test_mean_and_standard_error(spark):
    values = [3, 5, 5, 9, 0, 12]
    row = K.mean_se(inline_rows(spark, ["v"], [(v,) for v in values]), "v").first()
    assert row["n"] == 6
    assert row["mean"] == pytest.approx(statistics.mean(values))
    assert row["se"] == pytest.approx(statistics.stdev(values) / math.sqrt(6))
    single = K.mean_se(inline_rows(spark, ["v"], [(4,)]), "v").first()
    assert (single["mean"], single["se"]) == (4.0, None)
    gap = K.mean_se(inline_rows(spark, ["v"], [(4,), (None,)]), "v").first()
    assert (gap["mean"], gap["se"]) == (None, None)


def test_mean_of_very_large_counts_does_not_overflow(spark):
    big = 9 * 10**12
    row = K.mean_se(inline_rows(spark, ["v"], [(big,), (big + 2,), (big + 4,)]), "v").first()
    assert row["mean"] == big + 2
    assert row["se"] == pytest.approx(2 / math.sqrt(3))


def test_season_means(spark, rows):
    series = spark.sql("SELECT d AS date, month(d) AS tot_obs FROM (SELECT explode(sequence(date'2020-01-01', date'2021-12-01', interval 1 month)) AS d)")
    out = K.period_mean_se(series, {"summer": ("2020-06-01", "2021-08-31"), "all": (None, None)}, months={"summer": (6, 7, 8)})
    assert rows(out, "period", "n", "mean") == [("all", 24, 6.5), ("summer", 6, 7.0)]


def test_union_rules(spark, rows):
    a = inline_rows(spark, ["k", "only_a"], [("x", 1)])
    b = inline_rows(spark, ["k"], [("x",), (None,)])
    assert rows(reshape.stack(a, b)) == [(None, None), ("x", None), ("x", 1)]
    assert rows(reshape.distinct_union("k", a, b)) == [("x",)]
    assert reshape.stack_strict(a, a).count() == 2
    with pytest.raises(ValueError):
        reshape.stack_strict(a, b)


def test_wide_to_long(spark, rows):
    wide = inline_rows(spark, ["year", "north", "south"], [(2019, 10, None), (2020, 11, 5)])
    long = reshape.wide_to_long(wide, ["year"], ["north", "south"], "park", "visits").where("visits IS NOT NULL")
    assert rows(long) == [(2019, "north", 10), (2020, "north", 11), (2020, "south", 5)]


def test_positional_pair_and_its_guard(spark, rows):
    a = inline_rows(spark, ["k", "n"], [("x", 5), ("y", 9)])
    b = inline_rows(spark, ["k", "m"], [("y", 1), ("x", 4)])
    paired = reshape.pair_by_position(a, b, [F.desc("n")], [F.desc("m")])
    assert rows(paired, "k_left", "n", "k_right", "m") == [("x", 5, "y", 1), ("y", 9, "x", 4)]
    with pytest.raises(Exception, match="row count"):
        reshape.pair_by_position(a, b.limit(1), [F.desc("n")], [F.desc("m")]).collect()


def test_column_helpers(spark):
    df = inline_rows(spark, ["A b", "c_d", "e", "f"], [(1, 2, 3, 4)])
    named = C.normalise_names(df, "_")
    assert named.columns == ["a_b", "c_d", "e", "f"]
    assert C.column_range(named, "c_d", "e") == ["c_d", "e"]
    assert C.move_to_front(named, ["e"]).columns == ["e", "a_b", "c_d", "f"]
    assert C.drop_range(named, "c_d", "e").columns == ["a_b", "f"]
    assert C.select_renamed(named, {"e": "g"}).columns == ["g"]
    with pytest.raises(ValueError):
        C.column_range(named, "e", "a_b")
    with pytest.raises(ValueError):
        C.normalise_names(inline_rows(spark, ["a b", "a_b"], [(1, 2)]), "_")
    with pytest.raises(ValueError):
        C.select_renamed(named, {"zz": "g"})


def test_participation_missing_years(spark, rows):
    first = inline_rows(spark, ["year", "park", "observers", "observations"], [(2020, "a", 4, 10), (2021, "a", 6, 20), (2021, "b", 1, 1)])
    second = inline_rows(spark, ["year", "park", "observers", "observations"], [(2020, "a", 1, 5), (2021, "b", 2, 3)])
    visits = inline_rows(spark, ["year", "park", "visits"], [(2020, "a", 100), (2021, "a", 200)])
    rates = participation.visit_rates(first, second, visits)
    assert rows(rates, "year", "park", "observers", "observations", "visits", "observers_vis") == [
        (2020, "a", 5, 15, 100, 0.05),
        # the second feed has no such year: the sum is missing, not the first feed's value
        (2021, "a", None, None, 200, None),
        # no visit count on either side still pairs the feeds
        (2021, "b", 3, 4, None, None),
    ]


def test_hierarchy_counts(spark, rows):
    table = [("Aves", "P", "x")] * 3 + [("Aves", "P", "")] * 2 + [("Aves", "Q", None)] + [("Aves", "", "y")] + [("", "P", "x")]
    df = inline_rows(spark, ["class", "order", "family"], table)
    out = taxonomy.parent_child(df, ["class", "order", "family"])
    assert rows(out) == [(1, "", "Aves", 7), (2, "Aves", "P", 5), (2, "Aves", "Q", 1), (3, "P", "x", 3)]
    paths = taxonomy.parent_child(df, ["class", "order", "family"], path_parents=True)
    assert (3, "Aves - P", "x", 3) in rows(paths)


# A published hierarchy, counts per order, and those of its families that differ.
BIRD_ORDERS = {"Accipitriformes": 211, "Anseriformes": 223, "Caprimulgiformes": 174, "Charadriiformes": 75, "Columbiformes": 25}
BIRD_FAMILIES = [
    ("Accipitriformes", "Accipitridae", 199),
    ("Accipitriformes", "Pandionidae", 12),
    ("Anseriformes", "Anatidae", 223),
    ("Caprimulgiformes", "Apodidae", 73),
    ("Caprimulgiformes", "Caprimulgidae", 59),
    ("Caprimulgiformes", "Trochilidae", 42),
    ("Charadriiformes", "Laridae", 7),
    ("Charadriiformes", "Scolopacidae", 68),
    ("Columbiformes", "Columbidae", 25),
]


def test_published_hierarchy(spark, rows):
    table = inline_rows(spark, ["order", "family", "k"], BIRD_FAMILIES).withColumn("class", F.lit("Aves"))
    out = taxonomy.parent_child(table, ["class", "order", "family"], weight="k")
    got = {(p, label): n for _, p, label, n in rows(out)}
    assert {o: got[("Aves", o)] for o in BIRD_ORDERS} == BIRD_ORDERS
    assert all(got[(o, f)] == n for o, f, n in BIRD_FAMILIES)
    assert got[("", "Aves")] == sum(BIRD_ORDERS.values())


def test_enrich_once_and_fan_out(spark, rows):
    totals = inline_rows(spark, ["scientific_name", "total"], [("a", 3), ("b", 1)])
    taxa = inline_rows(spark, ["scientific_name", "order"], [("a", "Z"), ("a", "Y")])
    assert rows(taxonomy.enrich_once(totals, taxa, ["order"])) == [("a", 3, "Y"), ("b", 1, None)]
    assert taxonomy.enrich(totals, taxa).count() == 3
    by_order = taxonomy.counts_by_rank(totals, taxa, "order", weight="total")
    assert rows(by_order) == [(None, 1), ("Y", 3), ("Z", 3)]


def test_ranked_summary(spark, rows):
    df = inline_rows(spark, ["u"], [("b",), ("a",), ("c",), ("c",)])
    assert rows(taxonomy.ranked_summary(df, "u")) == [(1, "c", 2), (2, "a", 1), (3, "b", 1)]


def test_enrich_reads_only_what_is_asked_for(spark, tmp_path, rows):
    """Counting by a rank reads the name alone; records without a name do not meet the taxonomy but stay."""
    names = F.when(F.col("id") % 3 == 0, F.lit(" ")).when(F.col("id") % 3 == 1, F.concat(F.lit("n"), F.col("id") % 5))
    spark.range(300).select("id", names.alias("scientific_name"), F.create_map(F.lit("a"), "id").alias("extra")).write.parquet(f"{tmp_path}/r")
    taxa = inline_rows(spark, ["scientific_name", "order"], [("n1", "A"), ("n2", "B"), ("n2", "C"), (" ", "never"), (None, "never")])
    joined = taxonomy.enrich(spark.read.parquet(f"{tmp_path}/r"), taxa)
    by_order = joined.groupBy("order").count()
    assert rows(by_order) == [(None, 260), ("A", 20), ("B", 20), ("C", 20)]
    assert joined.columns == ["scientific_name", "id", "extra", "order"]
    plan = by_order._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<scientific_name:string>") >= 2 and "extra" not in plan


def test_row_numbers_over_many_partitions(spark):
    df = spark.range(5000).select(F.pmod(F.hash("id"), F.lit(700)).alias("k"), "id")
    found = taxonomy.numbered(df, "k", F.desc("id")).orderBy("row").collect()
    assert [r["row"] for r in found] == list(range(1, 5001))
    assert [(r["k"], -r["id"]) for r in found] == sorted((r["k"], -r["id"]) for r in found)


def test_calendar_that_ends_before_it_starts(spark, rows):
    series = spark.sql("SELECT * FROM VALUES (date'2020-01-01', 3) AS t(date, tot_obs)")
    assert rows(K.zero_filled(series, first="2021-01-01")) == [(dt.date(2020, 1, 1), 3)]


def test_shares_frequencies_and_hierarchies_per_park(spark):
    rows = [("a", "x", 1), ("a", "x", 2), ("a", "y", 1), ("b", "x", 3), (None, "y", 4), (None, "y", 5)]
    df = spark.createDataFrame(rows, "park string, name string, list long")
    got = lambda frame, *c: {tuple(r[x] for x in c) for r in frame.collect()}
    per_name = counts.count_rows(df, ["park", "name"])
    expected = {("a", "x", 66.67), ("a", "y", 33.33), ("b", "x", 100.0), (None, "y", 100.0)}
    assert got(counts.share_of_total(per_name, by="park"), "park", "name", "percent") == expected
    # a name that a join has repeated does not enlarge the whole
    twice = per_name.withColumn("n", F.col("n") * 2)
    shared = counts.share_of_total(twice, by="park", feed=df, total_name="total")
    assert got(shared, "park", "name", "total", "percent") == {
        ("a", "x", 3, 133.33), ("a", "y", 3, 66.67), ("b", "x", 1, 200.0), (None, "y", 2, 200.0)
    }
    found = counts.frequency_by_taxon(df, "name", "list", by="park")
    assert got(found, "park", "name", "units", "frequency") == {
        ("a", "x", 2, 100.0), ("a", "y", 2, 50.0), ("b", "x", 1, 100.0), (None, "y", 2, 100.0)
    }
    tree = taxonomy.parent_child(df, ["name"], by="park")
    assert got(tree, "park", "labels", "num_obs") == {("a", "x", 2), ("a", "y", 1), ("b", "x", 1), (None, "y", 2)}


def test_real_means_do_not_depend_on_partitions(spark):
    """Equal to the last bit for any dealing of the rows, and right."""
    import statistics

    rng = random.Random(12)
    values = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-12, 12) for _ in range(4000)]
    table = [(i % 2, v, None if i % 50 == 0 else v * 3) for i, v in enumerate(values)] + [(2, 5.0, None), (3, float("inf"), 1.0), (3, 1.0, 2.0)]
    df = spark.createDataFrame(table, "park int, v double, w double")
    found = []
    for dealt in (df.coalesce(1), df.repartition(7), df.orderBy(F.desc("v")), df.repartition(3, "w")):
        means = mean_se_real(dealt, {"v": "v", "w": "w"}, "park", skip_missing=True)
        found.append(sorted(map(str, means.collect())))
    assert all(f == found[0] for f in found)
    by = {r["park"]: r for r in mean_se_real(df, {"v": "v", "w": "w"}, "park").collect()}
    for park in (0, 1):
        mine = [v for p, v, _ in table if p == park]
        assert by[park]["mean_v"] == pytest.approx(statistics.fmean(mine), rel=1e-12)
        assert by[park]["se_v"] == pytest.approx(statistics.stdev(mine) / len(mine) ** 0.5, rel=1e-12)
    assert by[0]["mean_w"] is None and by[2]["se_v"] is None and by[2]["mean_v"] == 5.0 and math.isnan(by[3]["mean_v"])
    assert by[3]["mean_w"] == 1.5 and mean_se_real(df.limit(0), {"v": "v"}).first()["n"] == 0
