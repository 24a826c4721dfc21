"""Declared schemas; nothing is inferred at read time.

Column names in this module that belong to an input file are fixed values of that file format.
"""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "DATE": T.DateType(),
    "STRING": T.StringType(),
}


def _struct(columns: str) -> T.StructType:
    """``name TYPE, ...`` as a schema, without needing a session at import."""
    pairs = [item.split() for item in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Columns of an observation export that the analyses use, with their types.
# An export may hold more columns or another order; readers select by header name.
OBSERVATION_EXPORT = _struct(
    """
    id BIGINT, observed_on STRING, time_observed_at STRING, user_id BIGINT, user_login STRING,
    quality_grade STRING, url STRING, place_guess STRING, positional_accuracy DOUBLE,
    coordinates_obscured STRING, species_guess STRING, scientific_name STRING, common_name STRING,
    iconic_taxon_name STRING, latitude DOUBLE, longitude DOUBLE, taxon_kingdom_name STRING,
    taxon_phylum_name STRING, taxon_class_name STRING, taxon_order_name STRING,
    taxon_family_name STRING, taxon_genus_name STRING, taxon_species_name STRING,
    taxon_subspecies_name STRING
    """
)

# Header of the checklist dump -> canonical name and type.
CHECKLIST_DUMP = {
    "COMMON NAME": ("common_name", "string"),
    "SCIENTIFIC NAME": ("scientific_name", "string"),
    "CATEGORY": ("category", "string"),
    "OBSERVATION DATE": ("obs_date", "date"),
    "OBSERVATION COUNT": ("count", "string"),
    "DURATION MINUTES": ("duration_min", "double"),
    "SAMPLING EVENT IDENTIFIER": ("checklist_id", "string"),
    "OBSERVER ID": ("observer_id", "string"),
    "NUMBER OBSERVERS": ("num_observers", "int"),
    "PROTOCOL TYPE": ("protocol", "string"),
    "ALL SPECIES REPORTED": ("all_species_reported", "int"),
    "EFFORT DISTANCE KM": ("distance_km", "double"),
    "LOCALITY": ("locality", "string"),
    "COUNTY": ("county", "string"),
    "LATITUDE": ("latitude", "double"),
    "LONGITUDE": ("longitude", "double"),
}

# Seven-rank columns of an export -> canonical rank names.
RANK_COLUMNS = {
    "taxon_kingdom_name": "kingdom",
    "taxon_phylum_name": "phylum",
    "taxon_class_name": "class",
    "taxon_order_name": "order",
    "taxon_family_name": "family",
    "taxon_genus_name": "genus",
    "taxon_species_name": "scientific_name",
    "taxon_subspecies_name": "subspecies",
}

# Header of the bird taxonomy -> canonical name.
BIRD_TAXONOMY = {
    "SCI_NAME": "scientific_name",
    "ORDER1": "order",
    "FAMILY": "family",
    "SPECIES_GROUP": "species_group",
}

OBSERVATIONS = _struct(
    """
    id BIGINT, observed_on DATE, time_observed_at STRING, user_id BIGINT, user_login STRING,
    quality_grade STRING, url STRING, place_guess STRING, positional_accuracy DOUBLE,
    coordinates_obscured STRING, species_guess STRING, full_scientific_name STRING,
    scientific_name STRING, common_name STRING, iconic_taxon_name STRING, latitude DOUBLE,
    longitude DOUBLE, kingdom STRING, phylum STRING, class STRING, order STRING, family STRING,
    genus STRING, subspecies STRING, year INT, month INT
    """
)

CHECKLISTS = _struct(
    """
    common_name STRING, scientific_name STRING, category STRING, obs_date DATE, count STRING,
    duration_min DOUBLE, checklist_id STRING, observer_id STRING, num_observers INT,
    protocol STRING, all_species_reported INT, distance_km DOUBLE, locality STRING, county STRING,
    latitude DOUBLE, longitude DOUBLE
    """
)

RINGS = _struct("poly_id STRING, part INT, ring INT, seq INT, x DOUBLE, y DOUBLE")
