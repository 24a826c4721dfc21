"""Readers and writers."""
from fieldtally.sources.readers import (
    canonical_checklists,
    canonical_observations,
    read_bird_taxonomy,
    read_checklist_dump,
    read_dimension_csv,
    read_observation_export,
    read_rings,
    read_status_list,
    read_taxonomy,
    read_visits,
    read_watch_list,
)
from fieldtally.sources.inline import inline_rows
from fieldtally.sources.writers import csv_format, geojson_lines, write_csv, write_dataset, write_geojson_points

__all__ = [
    "inline_rows",
    "canonical_checklists",
    "canonical_observations",
    "read_bird_taxonomy",
    "read_checklist_dump",
    "read_dimension_csv",
    "read_observation_export",
    "read_rings",
    "read_status_list",
    "read_taxonomy",
    "read_visits",
    "read_watch_list",
    "write_csv",
    "write_dataset",
    "write_geojson_points",
]
