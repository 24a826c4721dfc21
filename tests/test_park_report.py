"""The whole analysis on a small made-up study."""

import pytest
from pyspark.sql import functions as F

from fieldtally.operators import spatial, watchlist as W
from fieldtally.plans import park_report as R
from fieldtally.sources import inline_rows, schemas

PARKS = [("north", 1, 1, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (10, 0), (10, 10), (0, 10)])] + [
    ("south", 1, 1, i, float(x), float(y)) for i, (x, y) in enumerate([(20, 0), (30, 0), (25, 10)])
]
SETTINGS = R.Settings(
    bad_checklists=("S9",),
    periods={"all": (None, None), "summer": ("2020-01-01", "2023-12-31")},
    seasons={"summer": (6, 7, 8)},
    hotspots={"north": "somewhere in the park"},
    relabel={"S3": "moved"},
    grid_shapes={"north": (10, 10)},
    grid_pads={"north": (0.5, 0.5, 0.5, 0.5)},
    density_breaks=(1, 2),
)


def shaped(spark, schema, rows):
    """Rows given as dictionaries, all other columns of the schema missing."""
    return spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in rows], schema)


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    import datetime as dt

    obs, chk = [], []
    for i in range(40):
        north = i % 3 != 0
        day = dt.date(2020 + i % 4, 1 + i % 12, 1 + i % 28)
        obs.append(
            dict(
                id=i,
                observed_on=day,
                user_id=i % 5,
                quality_grade="research" if i % 2 else "casual",
                scientific_name=("", "Rosa rugosa", "Acer rubrum", "Pinus banksiana")[i % 4],
                common_name="c",
                kingdom="Plantae" if i % 4 else "",
                phylum="Tracheophyta",
                **{"class": "Magnoliopsida"},
                order="Rosales" if i % 4 == 1 else "",
                longitude=(i % 10 + 0.5) if north else 25.0,
                latitude=(i % 7 + 0.5) if north else 2.0,
                year=day.year,
                month=day.month,
                url=f"r/{i}",
            )
        )
    obs.append(dict(obs[1], id=98, longitude=99.0))
    obs.append(dict(obs[1], id=99, observed_on=dt.date(2024, 1, 1)))
    for i in range(30):
        chk.append(
            dict(
                common_name="b",
                scientific_name=("Larus argentatus", "Charadrius melodus", "gull sp.")[i % 3],
                category="species" if i % 3 < 2 else "spuh",
                obs_date=dt.date(2021, 1 + i % 12, 3),
                count="X",
                duration_min=float(i % 9),
                checklist_id=f"S{i // 3}",
                observer_id=f"o{i % 4}",
                protocol=("Traveling", "Incidental")[i % 2],
                all_species_reported=1,
                locality="somewhere in the park" if i < 12 else "cove",
                longitude=1.0 + i % 8,
                latitude=9.5,
            )
        )
    parks = spatial.edges_of(inline_rows(spark, ["poly_id", "part", "ring", "seq", "x", "y"], PARKS))
    path = str(tmp_path_factory.mktemp("study"))
    paths = R.ingest(shaped(spark, schemas.OBSERVATIONS, obs), shaped(spark, schemas.CHECKLISTS, chk), parks, SETTINGS, path)
    stored = [spark.read.parquet(p).cache() for p in paths]
    birds = inline_rows(
        spark, ["scientific_name", "order", "family"], [("Larus argentatus", "Charadriiformes", "Laridae (Gulls)"), ("Charadrius melodus", "Charadriiformes", "")]
    )
    visits = inline_rows(spark, ["year", "park", "visits"], [(2020, "north", 100), (2021, "north", 200), (2021, "south", 10)])
    entries = inline_rows(spark, ["scientific_name", "listing_status"], [("Charadrius melodus", "state endangered")])
    watch = inline_rows(
        spark,
        ["scientific_name", "common_name", "category", "in_park"],
        [("Pinus banksiana", "Jack pine", "species of interest", "Y"), ("Rosa rugosa", "Rose", "pest disease", "N"), ("Salix x", "Willow", "species of interest", "Y")],
    )
    results = R.report(*stored, SETTINGS, birds, visits, parks, entries, {"north": watch})
    return obs, chk, stored, results


def test_ingest_clips_dates_and_ids(study):
    obs, chk, (stored_obs, stored_chk), _ = study
    assert stored_obs.count() == 40
    assert {r["park"]: r["count"] for r in stored_obs.groupBy("park").count().collect()} == {"north": 26, "south": 14}
    assert stored_chk.count() == len([c for c in chk if c["checklist_id"] != "S9"])


def test_every_result_runs(study):
    _, _, _, results = study
    assert len(results) >= 30
    for name, df in results.items():
        assert df.count() > 0, name


def test_some_results_by_hand(study):
    obs, chk, (stored_obs, stored_chk), results = study
    row = results["all_parks"].first()
    kept = [c for c in chk if c["checklist_id"] != "S9"]
    complete = [c for c in kept if c["duration_min"] >= 5 and c["protocol"] != "Incidental"]
    assert (row["obs_records"], row["chk_records"], row["complete_records"]) == (40, len(kept), len(complete))
    assert row["complete_checklists"] == len({c["checklist_id"] for c in complete})
    assert row["observers"] == 5 + 4
    freq = {r["scientific_name"]: r["frequency"] for r in results["species_frequency"].collect()}
    assert freq == {"Larus argentatus": 100.0, "Charadrius melodus": 100.0, "gull sp.": 100.0}
    hierarchy = {(r["parents"], r["labels"]): r["num_obs"] for r in results["hierarchy_checklists"].collect()}
    # names without an order are left out as a whole, a blank family stops at the order
    assert hierarchy == {("", "Aves"): 18, ("Aves", "Charadriiformes"): 18, ("Charadriiformes", "Laridae"): 9}
    table = {r["scientific_name"]: (r["count"], r["category"]) for r in results["watch_table_north"].collect()}
    research = [o for o in obs[:40] if o["quality_grade"] == "research" and o["longitude"] < 20]
    assert table["Rosa rugosa"] == (sum(o["scientific_name"] == "Rosa rugosa" for o in research), W.PEST)
    rate = results["watch_detection_rate_north"].first()
    assert (rate["listed"], rate["detected"]) == (2, 1)
    grid = results["grid_north"]
    hidden = [c for c in kept if c["locality"] == "somewhere in the park" and c["checklist_id"] != "S3"]
    assert grid.agg(F.sum("count")).first()[0] == 26 + len(kept) - len(hidden)


def test_rank_sum_between_parks(study):
    _, _, _, results = study
    row = R.visits_rank_sum(results["participation"], "north", "south").first()
    assert row["n1"] + row["n2"] <= results["participation"].count()
