"""Readers and writers on small files with the quirks of the real ones."""

import datetime as dt
import glob
import json

import pytest
from pyspark.sql import functions as F

from fieldtally.operators import spatial as G
from fieldtally.sources import (
    canonical_checklists,
    canonical_observations,
    inline_rows,
    read_bird_taxonomy,
    read_checklist_dump,
    read_dimension_csv,
    read_observation_export,
    read_rings,
    read_status_list,
    read_taxonomy,
    read_visits,
    read_watch_list,
    readers,
    schemas,
    write_csv,
    write_dataset,
    write_geojson_points,
)

BOM = "﻿"


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


# Fixed value: the header of an observation export.
EXPORT_HEADER = (
    "id,observed_on_string,observed_on,time_observed_at,user_id,user_login,quality_grade,license,url,place_guess,"
    "positional_accuracy,coordinates_obscured,species_guess,scientific_name,common_name,iconic_taxon_name,latitude,longitude,"
    "taxon_kingdom_name,taxon_phylum_name,taxon_class_name,taxon_order_name,taxon_family_name,taxon_genus_name,"
    "taxon_species_name,taxon_subspecies_name"
)


def test_observation_export(spark, tmp_path, rows):
    path = put(
        tmp_path,
        "obs.csv",
        BOM + EXPORT_HEADER + "\n"
        '1,"x, y",2023-05-01,2023-05-01 10:00:00 UTC,7,"al ""b""",research,CC,http://r/1,"Trail, north",12,false,gull,Larus argentatus smithsonianus,'
        "Herring Gull,Aves,44.3,-68.2,Animalia,Chordata,Aves,Charadriiformes,Laridae,Larus,Larus argentatus,Larus argentatus smithsonianus\n"
        "2,z,,,8,cy,needs_id,CC,http://r/2,Cove,,true,,Plantae,NA,Plantae,44.4,-68.3,Plantae,,,,,,,\n",
    )
    export = read_observation_export(spark, path)
    assert export.columns == schemas.OBSERVATION_EXPORT.names
    obs = canonical_observations(export)
    assert [(f.name, f.dataType) for f in obs.schema] == [(f.name, f.dataType) for f in schemas.OBSERVATIONS]
    first, second = sorted(obs.collect(), key=lambda r: r["id"])
    assert first["scientific_name"] == "Larus argentatus"
    assert first["full_scientific_name"] == "Larus argentatus smithsonianus"
    assert (first["genus"], first["user_login"], first["place_guess"]) == ("Larus", 'al "b"', "Trail, north")
    assert (first["observed_on"], first["year"], first["month"]) == (dt.date(2023, 5, 1), 2023, 5)
    # a coarser identification: blank species name, missing date and accuracy, NA is missing
    assert (second["scientific_name"], second["observed_on"], second["year"], second["positional_accuracy"]) == ("", None, None, None)
    assert second["common_name"] is None
    assert second["genus"] == "Plantae"
    assert canonical_observations(export, genus_from="rank").where("id = 2").first()["genus"] == ""
    with pytest.raises(ValueError):
        canonical_observations(export, genus_from="guess")


def test_export_reads_only_the_columns_a_query_uses(spark, tmp_path):
    path = put(tmp_path, "obs.csv", EXPORT_HEADER + "\n" + ",".join(["1"] * 26) + "\n")
    narrow = canonical_observations(read_observation_export(spark, path)).select("user_id")
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:string>" in plan


def test_missing_export_columns_are_named(spark, tmp_path):
    with pytest.raises(ValueError, match="quality_grade"):
        read_observation_export(spark, put(tmp_path, "bad.csv", "id,observed_on\n1,2\n"))


@pytest.mark.parametrize("sep", [" ", "."])
def test_checklist_dump(spark, tmp_path, sep):
    header = "\t".join(["GLOBAL ID", *schemas.CHECKLIST_DUMP, "COMMENTS"]).replace(" ", sep)
    cells = ["g1", 'Gull "Herring', "Larus argentatus", "species", "2020-06-01", "X", "30", "S1", "obs1", "2", "Traveling", "1", "1.5", "Cove", "Hancock", "44.3", "-68.2", 'said "hi']
    bare = ["g2", "Gull", "Larus", "spuh", "2020-06-02", "3", "", "S2", "obs2", "", "Incidental", "0", "", "", "", "44.4", "-68.1", ""]
    path = put(tmp_path, "dump.txt", header + "\n" + "\t".join(cells) + "\n" + "\t".join(bare) + "\n")
    lines = canonical_checklists(read_checklist_dump(spark, path))
    assert [(f.name, f.dataType) for f in lines.schema] == [(f.name, f.dataType) for f in schemas.CHECKLISTS]
    first, second = sorted(lines.collect(), key=lambda r: r["checklist_id"])
    assert first["common_name"] == 'Gull "Herring'
    assert (first["obs_date"], first["count"], first["duration_min"], first["all_species_reported"]) == (dt.date(2020, 6, 1), "X", 30.0, 1)
    assert (second["duration_min"], second["num_observers"], second["distance_km"], second["locality"]) == (None, None, None, "")


def test_status_lists(spark, tmp_path, rows):
    federal = put(
        tmp_path,
        "federal.csv",
        BOM + 'Scientific Name,Common Name,Where Listed,Region  ,ESA Listing Status  ,Group\n'
        'Sterna dougallii,Roseate tern,"Northeast, nesting",5,Endangered,Birds\nIsotria medeoloides,Small whorled pogonia,,5,Threatened,Plants',
    )
    raw = read_dimension_csv(spark, federal)
    assert raw.columns == ["scientific_name", "common_name", "where_listed", "region", "esa_listing_status", "group"]
    assert rows(read_status_list(spark, federal, "federally", "esa_listing_status"), "scientific_name", "listing_status") == [
        ("Isotria medeoloides", "federally threatened"),
        ("Sterna dougallii", "federally endangered"),
    ]
    state = put(tmp_path, "state.csv", BOM + "scientific.name,common.name,listing.status\nSterna dougallii,Roseate tern,Endangered\nChlidonias niger,Black tern,Endangered\n")
    assert rows(read_status_list(spark, state, "state", skip_common_names=("Roseate tern",))) == [("Chlidonias niger", "Black tern", "state endangered")]


def test_visits(spark, tmp_path, rows):
    path = put(tmp_path, "visits.csv", BOM + "year,north.visits,south.visits\n2019,64000,NA\n2020,66500,12")
    long = read_visits(spark, path, {"north_visits": "N", "south_visits": "S"})
    assert rows(long) == [(2019, "N", 64000), (2020, "N", 66500), (2020, "S", 12)]
    assert dict(long.dtypes) == {"year": "int", "park": "string", "visits": "bigint"}


def test_taxonomies(spark, tmp_path, rows):
    birds = put(tmp_path, "birds.csv", "TAXON_ORDER,SCI_NAME,ORDER1,FAMILY,SPECIES_GROUP\n1,Larus argentatus,Charadriiformes,Laridae (Gulls),Gulls\n2,bird sp.,,,\n")
    assert rows(read_bird_taxonomy(spark, birds), "scientific_name", "order", "family") == [
        ("Larus argentatus", "Charadriiformes", "Laridae (Gulls)"),
        ("bird sp.", "", ""),
    ]
    general = put(
        tmp_path,
        "taxa.csv",
        "scientific_name,common_name,taxon_order_name\nPhytomyza minuscula group,NA,Diptera\nA b,A complex,X\nA b,plain,X\nA b,plain,X\n",
    )
    assert rows(read_taxonomy(spark, general), "scientific_name", "common_name") == [("A b", "plain"), ("Phytomyza minuscula", None)]


def test_watch_list_from_csv_and_parquet(spark, tmp_path, rows):
    path = put(tmp_path, "watch.csv", "Scientific Name,Common Name,Category,In North\nAcer x,Maple,pest disease,Y\nRosa spp.,,invasive established,N\n")
    want = [("Acer x", "Maple", "pest disease", "Y"), ("Rosa spp.", "", "invasive established", "N")]
    assert rows(read_watch_list(spark, path, "in_north")) == want
    bare = inline_rows(spark, ["scientific_name", "category"], [("a", "b")])
    bare.write.parquet(str(tmp_path / "watch_table"))
    assert rows(read_watch_list(spark, str(tmp_path / "watch_table"))) == [("a", None, "b", None)]


def test_rings_from_csv_and_parquet(spark, tmp_path):
    path = put(tmp_path, "rings.csv", "poly_id,part,ring,seq,x,y\np,1,1,1,0,0\np,1,1,2,1.5,0\np,1,1,3,0,1\n")
    rings = read_rings(spark, path)
    assert dict(rings.dtypes) == {"poly_id": "string", "part": "int", "ring": "int", "seq": "int", "x": "double", "y": "double"}
    assert G.edges_of(rings).count() == 3
    rings.write.parquet(str(tmp_path / "rings_table"))
    assert read_rings(spark, str(tmp_path / "rings_table")).count() == 3


def test_result_csv(spark, tmp_path, rows):
    df = inline_rows(spark, ["a", "b"], [("x", 1), ("", None), (None, 3)])
    path = str(tmp_path / "out")
    write_csv(df.coalesce(1), path)
    text = open(glob.glob(path + "/part-*")[0]).read().splitlines()
    assert text[0] == "a,b" and sorted(text[1:]) == [",NA", "NA,3", "x,1"]
    back = read_dimension_csv(spark, path)
    assert rows(back) == [(None, "3"), ("", None), ("x", "1")]
    with pytest.raises(ValueError):
        write_csv(df, path + "/")


def test_dataset_is_pruned_by_partition(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") < 90, "hot").otherwise("cold").alias("park"), (F.col("id") % 2 + 2000).cast("int").alias("year"))
    path = str(tmp_path / "canonical")
    write_dataset(df, path)
    back = spark.read.parquet(path).where("park = 'cold' AND year = 2001")
    assert back.count() == 5
    assert "PartitionFilters: [isnotnull(park" in back._jdf.queryExecution().executedPlan().toString()


def test_geojson(spark, tmp_path):
    df = inline_rows(spark, ["scientific_name", "longitude", "latitude"], [("Acer x", -68.2, 44.3)])
    path = str(tmp_path / "points")
    write_geojson_points(df, path)
    lines = [line for f in glob.glob(path + "/part-*") for line in open(f).read().splitlines()]
    feature = json.loads(lines[0])
    assert feature["geometry"] == {"type": "Point", "coordinates": [-68.2, 44.3]}
    assert feature["properties"] == {"scientific_name": "Acer x"}


def test_inline_rows_quote_text(spark, rows):
    df = inline_rows(spark, ["a", "b"], [("it's", 1.5), ("back\\slash", None)])
    assert rows(df) == [("back\\slash", None), ("it's", 1.5)]


def test_checklist_dump_is_read_in_parts_with_malformed_lines_apart(spark, tmp_path):
    """Two files with headers, foreign line ends, blank lines and broken lines, cut into many parts."""
    header = "﻿" + "\t".join([*schemas.CHECKLIST_DUMP, "EXTRA"])
    width = len(schemas.CHECKLIST_DUMP) + 1
    at = {h: i for i, h in enumerate(schemas.CHECKLIST_DUMP)}
    wanted, broken = [], []
    for part, end in (("a", "\n"), ("b", "\r\n")):
        lines = [header, ""]
        for i in range(4000):
            cells = [""] * width
            cells[at["SAMPLING EVENT IDENTIFIER"]] = f'S{part}"{i}'
            cells[at["OBSERVATION COUNT"]] = "NA" if i % 5 == 0 else "X"
            cells[at["DURATION MINUTES"]] = str(i % 90)
            if i % 1000 == 7:
                cells = cells[:-2] if part == "a" else [*cells, "more"]
                broken.append(("\t".join(cells), len(cells)))
            else:
                wanted.append((f'S{part}"{i}', None if i % 5 == 0 else "X", float(i % 90)))
            lines.append("\t".join(cells))
        (tmp_path / f"{part}.txt").write_bytes((end.join(lines) + end).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        found = readers.canonical_checklists(readers.read_checklist_dump(spark, str(tmp_path)))
        assert found.rdd.getNumPartitions() > 4
        rows = found.select("checklist_id", "count", F.col("duration_min").cast("double")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(tuple, rows), key=str) == sorted(wanted, key=str)
    bad = readers.malformed_checklist_lines(spark, str(tmp_path)).collect()
    assert sorted((r["line"], r["cells"]) for r in bad) == sorted(broken) and {r["file"][-5:] for r in bad} == {"a.txt", "b.txt"}
