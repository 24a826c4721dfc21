"""Watch-list classification."""

import pytest
from pyspark.sql import functions as F

from fieldtally.operators import counts, watchlist as W
from fieldtally.sources import inline_rows

FEED = [
    ("Salmo salar", "2023-07-02"),
    ("Charadrius melodus", "2023-05-02"),
    ("Charadrius melodus", "2023-05-02"),
    ("Pinus banksiana", "2022-01-01"),
    ("Lonicera morrowii", "2021-01-01"),
    ("Lonicera japonica", "2023-02-02"),
    ("Lonicera japonica var", "2023-02-03"),
    ("Rosa rugosa", None),
    ("Lonicera", "2020-01-01"),
    ("Corvus corax", "2020-01-01"),
    (None, "2020-01-01"),
]
WATCH = [
    ("Pinus banksiana", "Jack pine", "species of interest", "Y"),
    ("Rosa rugosa", "Rugosa rose", "invasive established", "Y"),
    ("Lonicera morrowii", "Morrow's honeysuckle", "invasive not established", "N"),
    ("Lonicera spp.", "honeysuckles", "species of interest", "Y"),
    ("Agrilus planipennis", "Emerald ash borer", "pest disease", "U"),
]


@pytest.fixture(scope="module")
def feed(spark):
    base = inline_rows(spark, ["scientific_name", "observed_on"], FEED)
    return base.select(
        "scientific_name",
        F.lit("common").alias("common_name"),
        F.col("observed_on").cast("date").alias("observed_on"),
        F.lit("place").alias("place_guess"),
        F.lit(1.0).alias("latitude"),
        F.lit(2.0).alias("longitude"),
        F.lit(None).cast("double").alias("positional_accuracy"),
        F.lit(None).cast("string").alias("url"),
    ).cache()


@pytest.fixture(scope="module")
def watch(spark):
    return inline_rows(spark, ["scientific_name", "common_name", "category", "in_park"], WATCH).cache()


@pytest.fixture(scope="module")
def entries(spark):
    federal = inline_rows(spark, ["scientific_name", "listing_status"], [("Salmo salar", "federally endangered"), ("Charadrius melodus", "federally threatened")])
    state = inline_rows(spark, ["scientific_name", "listing_status"], [("Charadrius melodus", "state endangered")])
    return W.status_entries(federal, state).cache()


def test_species_on_two_lists_have_two_rows_per_record(feed, entries, rows):
    hits = W.threatened(feed, entries)
    assert hits.columns == ["scientific_name", "common_name", "observed_on", "location", "listing_status", "latitude", "longitude", "url"]
    assert rows(hits, "scientific_name", "listing_status") == [
        ("Charadrius melodus", "federally threatened"),
        ("Charadrius melodus", "federally threatened"),
        ("Charadrius melodus", "state endangered"),
        ("Charadrius melodus", "state endangered"),
        ("Salmo salar", "federally endangered"),
    ]


def test_rare_species(feed, watch, rows):
    hits = W.rare(feed, watch)
    assert rows(hits, "scientific_name") == [("Pinus banksiana",)]
    assert "positional_accuracy" in hits.columns and "location" in hits.columns


def test_invasive_by_name_and_by_genus(feed, watch, rows):
    hits = W.invasive(feed, watch)
    # by name and by genus: two rows; a trinomial keeps two words and is no genus match
    assert rows(hits, "scientific_name") == [
        ("Lonicera",),
        ("Lonicera japonica",),
        ("Lonicera morrowii",),
        ("Lonicera morrowii",),
        ("Rosa rugosa",),
    ]
    assert hits.columns == feed.columns
    strict = W.invasive(feed, watch, strict_genus=True)
    assert ("Lonicera japonica var",) in rows(strict, "scientific_name")
    narrowed = W.invasive(feed, watch, genus_categories=W.INVASIVE_CATEGORIES)
    assert rows(narrowed, "scientific_name") == [("Lonicera morrowii",), ("Rosa rugosa",)]


def test_newest_first(feed, watch):
    dates = [r["observed_on"] for r in W.newest_first(W.invasive(feed, watch)).collect()]
    known = [d for d in dates if d is not None]
    assert known == sorted(known, reverse=True) and dates[-1] is None


def test_tallies_agree_with_the_record_sets(feed, watch, entries, rows):
    table = W.tallies(feed, entries, watch)
    by_records = set()
    for label, hits in ((W.PEST, W.invasive(feed, watch)), (W.THREATENED, W.threatened(feed, entries)), (W.RARE, W.rare(feed, watch))):
        by_records |= {(r["scientific_name"], r["n"], label) for r in counts.count_rows(hits, "scientific_name").collect()}
    assert {tuple(r) for r in table.collect()} == by_records
    ordered = [(r["category"], r["count"]) for r in W.report_order(table).collect()]
    assert ordered[0] == (W.PEST, 2) and ordered[-1][0] == W.RARE
    assert rows(W.list_totals(table)) == [(W.PEST, 5), (W.RARE, 1), (W.THREATENED, 5)]


def test_detection(feed, watch, entries, rows):
    table = W.tallies(feed, entries, watch)
    rate = W.detection_rate(W.detection(watch, table, ["Y"])).first()
    assert (rate["listed"], rate["detected"], rate["rate"]) == (3, 2, 2 / 3)
    absent = W.detection(watch, table, ["N", "U"]).where("detected = 'yes'")
    assert rows(absent, "scientific_name") == [("Lonicera morrowii",)]


def test_combined_feed(spark, rows):
    obs = inline_rows(
        spark,
        ["scientific_name", "common_name", "observed_on", "place_guess", "latitude", "longitude", "positional_accuracy", "url", "quality_grade"],
        [("a", "A", "2020-01-01", "p", 1.0, 2.0, 3.0, "u", "research"), ("b", "B", "2020-01-01", "p", 1.0, 2.0, 3.0, "u", "casual")],
    )
    chk = inline_rows(spark, ["scientific_name", "common_name", "obs_date", "locality", "latitude", "longitude"], [("c", "C", "2020-02-02", "q", 5.0, 6.0)])
    out = W.combined_feed(obs, chk)
    assert rows(out, "scientific_name", "observed_on", "place_guess", "positional_accuracy", "url") == [
        ("a", "2020-01-01", "p", 3.0, "u"),
        ("c", "2020-02-02", "q", None, None),
    ]


def test_streaming_feed_gives_the_batch_result(spark, feed, watch, entries, tmp_path, rows):
    source = str(tmp_path / "feed")
    feed.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(feed.schema).parquet(source)
    out = str(tmp_path / "out")
    hits = W.classify(stream, entries, watch).writeStream.option("checkpointLocation", str(tmp_path / "chk"))
    hits.trigger(availableNow=True).start(out).awaitTermination(120)
    want = W.classify(feed, entries, watch)
    got = spark.read.schema(want.schema).parquet(out)
    assert rows(got, *want.columns) == rows(want)
    assert counts.count_rows(got, "list").count() == 3


def test_one_pass_classification_equals_the_separate_sets(feed, watch, entries, rows):
    together = W.classify(feed, entries, watch)
    assert rows(together.where(F.col("list") == W.THREATENED), "scientific_name", "listing_status") == rows(
        W.threatened(feed, entries), "scientific_name", "listing_status"
    )
    for label, alone in ((W.RARE, W.rare(feed, watch)), (W.PEST, W.invasive(feed, watch))):
        assert rows(together.where(F.col("list") == label), "scientific_name", "observed_on") == rows(
            alone, "scientific_name", "observed_on"
        )


def test_parks_against_their_own_lists_equal_one_park_at_a_time(feed, watch, entries, rows):
    parks = F.when(F.col("latitude") % 2 == 0, "a").when(F.col("scientific_name") > "M", "b").otherwise("c")
    marked = feed.withColumn("park", parks).unionByName(feed.withColumn("park", F.lit(None).cast("string")))
    lists = {"a": watch, "b": watch.where("category <> 'species of interest'"), "empty": watch}
    together = W.by_park(lists)
    records = W.classify(marked, entries, together, by="park")
    table = W.tallies(marked, entries, together, by="park")
    flags = W.detection(together, table, by="park")
    assert {r.park for r in table.collect()} <= {"a", "b"}
    for park, own in lists.items():
        here = F.col("park") == park
        one = marked.where(here).drop("park")
        alone = W.tallies(one, entries, own)
        for got, want in (
            (records, W.classify(one, entries, own)),
            (table, alone),
            (W.list_totals(table, by="park"), W.list_totals(alone)),
            (flags, W.detection(own, alone)),
            (W.detection_rate(flags, by="park"), W.detection_rate(W.detection(own, alone))),
        ):
            of_park = got.where(here).select(*want.columns)
            assert sorted(map(str, of_park.collect())) == sorted(map(str, want.collect()))
    assert W.tallies(marked, entries, together.limit(0), by="park").count() == 0
