"""Result and table writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.types import require_columns


def csv_format(null_text: str = "NA") -> dict[str, object]:
    """Cell format of result tables: doubled quotes, blanks at the ends kept, NULL as ``null_text``."""
    return {
        "nullValue": null_text,
        "emptyValue": "",
        "escape": '"',
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
    }


def write_csv(df: DataFrame, path: str, null_text: str = "NA", mode: str = "overwrite") -> None:
    """Result table as a CSV directory: header, no row numbers, NULL as ``NA``.

    Quotes are doubled and blanks at the ends stay, as the package's reader expects; read texts with line breaks
    with ``multi_line``. A path that ends in a slash is refused, because callers join file names to it.
    """
    if path.endswith("/"):
        raise ValueError("the output path must not end with '/'")
    df.write.mode(mode).option("header", True).options(**csv_format(null_text)).csv(path)


def write_dataset(
    df: DataFrame, path: str, partition_by: Sequence[str] = ("park", "year"), mode: str = "overwrite"
) -> None:
    """Canonical feed as partitioned Parquet, the layout later reads prune on.

    The rebalance hint gathers each partition's rows into few files and lets adaptive execution
    split a partition that holds a large share of the rows.
    """
    require_columns(df.columns, partition_by, "dataset")
    df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)


def geojson_lines(df: DataFrame, x: str = "longitude", y: str = "latitude") -> DataFrame:
    """One ``value`` per point: a GeoJSON feature with all other columns as properties."""
    require_columns(df.columns, [x, y], "points")
    properties = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in (x, y)])
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(x), F.col(y)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson_points(
    df: DataFrame, path: str, x: str = "longitude", y: str = "latitude", mode: str = "overwrite"
) -> None:
    """Points as newline-delimited GeoJSON features."""
    geojson_lines(df, x, y).write.mode(mode).text(path)
