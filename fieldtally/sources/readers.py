"""File readers. Every reader declares its schema, so no file is read twice to guess types.

CSV is read with ``multiLine``, so quoted line breaks stay in their record; pass ``multi_line=False`` for files without any, which Spark can then split.
The checklist dump has no quoting, so its cells hold no line breaks: it is read as lines, in as many tasks as its size asks for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldtally.functions import names as N
from fieldtally.functions.dates import date_from_text
from fieldtally.operators.columns import normalise_names, select_renamed
from fieldtally.operators.reshape import wide_to_long
from fieldtally.sources import schemas as S
from fieldtally.types import require_columns

# Fixed value: the text that stands for a missing cell.
MISSING_TEXT = "NA"


def _read_text_table(
    spark: SparkSession, path: str, sep: str = ",", quote: str = '"', multi_line: bool = True
) -> DataFrame:
    """All columns as text under the header as written; an empty cell is blank text, ``NA`` is NULL.

    Spark itself reads empty cells as NULL, so the two are told apart here. The casts sit in a
    projection: columns a query does not use are neither parsed nor converted.
    """
    raw = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("quote", quote)
        .option("escape", '"' if quote else "\\")
        .option("multiLine", multi_line)
        .csv(path)
    )
    return raw.select(*_texts(raw.columns))


def _texts(columns: Sequence[str]) -> list[Column]:
    """Cells as read -> blank text for empty ones, NULL for the missing text."""
    cells = [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in columns]
    return [F.nullif(cell, F.lit(MISSING_TEXT)).alias(c) for cell, c in zip(cells, columns)]


def table_of_lines(
    lines: DataFrame, header: Sequence[str], sep: str = ",", quote: str = '"', column: str = "value"
) -> DataFrame:
    """Lines that did not come as files (a text column of a table or a stream) as a table of texts under ``header``.

    Cells follow the rules of the file readers. ``malformed`` is true for a line with too few or too many cells, whose
    cells may then be short; it is for the caller to count or to refuse such lines.
    """
    fields = ", ".join(f"`{c}` STRING" for c in [*header, "_bad"])
    options = {"sep": sep, "quote": quote, "escape": '"' if quote else "\\", "columnNameOfCorruptRecord": "_bad"}
    parsed = lines.select(F.from_csv(F.col(column), fields, options).alias("_row")).select("_row.*")
    return parsed.select(*_texts(header), F.col("_bad").isNotNull().alias("malformed"))


@dataclass(frozen=True)
class LineTable:
    """Well-formed lines as a table of texts, and the others as they stand: ``file, line, cells`` (how many they have)."""

    rows: DataFrame
    malformed: DataFrame


def cells_of_lines(lines: DataFrame, header: Sequence[str], sep: str, column: str = "value") -> DataFrame:
    """Unquoted lines as a table of texts under ``header``, with ``malformed`` for a wrong number of cells.

    A line is cut once, at every ``sep``; only cells that are asked for become texts.
    """
    cut = lines.select(_without_return(column).alias("_line")).select(F.split("_line", _literally(sep), -1).alias("_cells"))
    cells = [F.nullif(F.coalesce(F.get("_cells", F.lit(i)), F.lit("")), F.lit(MISSING_TEXT)).alias(c) for i, c in enumerate(header)]
    return cut.select(*cells, (F.size("_cells") != len(header)).alias("malformed"))


def _literally(sep: str) -> str:
    return "".join(f"\\x{ord(c):02x}" for c in sep)


def _without_return(column: str) -> Column:
    """The line without the carriage return of a foreign line end."""
    text = F.col(column)
    return F.when(text.endswith("\r"), F.expr(f"left(`{column}`, length(`{column}`) - 1)")).otherwise(text)


def read_line_table(spark: SparkSession, path: str, sep: str = "\t") -> LineTable:
    """Files of unquoted cells, one line a row, split over tasks at line ends wherever Spark likes.

    The header is the first line of the first file; lines equal to it head the other files and are left out, as are blank ones. A
    line with too few or too many cells is not guessed at: it goes to ``malformed``, with its file.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    first = lines.select(_without_return("value").alias("value")).head(1)
    if not first:
        raise ValueError(f"no header in {path}")
    header = first[0][0]
    names = header.removeprefix("\ufeff").split(sep)
    filled = lines.select("value", F.col("_metadata.file_path").alias("file"))
    filled = filled.where((_without_return("value") != header) & (F.trim(_without_return("value")) != ""))
    size = F.size(F.split("value", _literally(sep), -1))
    good = cells_of_lines(filled.where(size == len(names)), names, sep).drop("malformed")
    bad = filled.where(size != len(names)).select("file", _without_return("value").alias("line"), size.alias("cells"))
    return LineTable(good, bad)


def unparsed_cells(raw: DataFrame, wanted: StructType) -> DataFrame:
    """One row: rows of ``raw``, and per column of ``wanted`` the filled cells that are not of its type.

    The typed readers turn such cells into NULL; this counts them, and lines that are ``malformed`` where ``raw`` marks those.
    """
    failed = [
        F.count_if((F.col(f.name) != "") & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name) for f in wanted.fields
    ]
    if "malformed" in raw.columns:
        failed.append(F.count_if("malformed").alias("malformed"))
    return raw.agg(F.count(F.lit(1)).alias("rows"), *failed)


def read_observation_export(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Comma-separated observation export with a header; typed, in :data:`schemas.OBSERVATION_EXPORT` order.

    Columns are picked by header name, so extra columns and another column order do no harm, and
    Spark reads only the picked ones. ``multi_line=False`` lets Spark split files without line breaks in texts; else a file is
    then one task, so split large exports into several files.
    """
    return observation_export(_read_text_table(spark, path, multi_line=multi_line))


def observation_export(raw: DataFrame) -> DataFrame:
    """Table of texts -> typed observation export."""
    raw = normalise_names(raw, sep="_")
    wanted = S.OBSERVATION_EXPORT
    require_columns(raw.columns, wanted.names, "observation export")
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted.fields])


def canonical_observations(export: DataFrame, genus_from: str = "name") -> DataFrame:
    """Observation export -> canonical observations.

    ``scientific_name`` is the species-rank name, blank for a coarser identification; the name as
    identified stays in ``full_scientific_name``. ``genus_from`` takes the genus from the first
    word of that name (``"name"``) or from the export's genus rank (``"rank"``).
    """
    if genus_from not in ("name", "rank"):
        raise ValueError("genus_from must be 'name' or 'rank'")
    ranks = [F.col(raw).alias(name) for raw, name in S.RANK_COLUMNS.items() if name != "genus"]
    genus = N.genus("scientific_name") if genus_from == "name" else F.col("taxon_genus_name")
    return export.select(
        "id",
        date_from_text("observed_on").alias("observed_on"),
        "time_observed_at",
        "user_id",
        "user_login",
        "quality_grade",
        "url",
        "place_guess",
        "positional_accuracy",
        "coordinates_obscured",
        "species_guess",
        F.col("scientific_name").alias("full_scientific_name"),
        "common_name",
        "iconic_taxon_name",
        "latitude",
        "longitude",
        *ranks,
        genus.alias("genus"),
        F.year(date_from_text("observed_on")).alias("year"),
        F.month(date_from_text("observed_on")).alias("month"),
    ).select(*S.OBSERVATIONS.names)


def read_checklist_dump(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated checklist dump; quote characters in it are plain text. Malformed lines are in :func:`malformed_checklist_lines`."""
    return checklist_dump(read_line_table(spark, path).rows)


def malformed_checklist_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a checklist dump with a wrong number of cells: ``file, line, cells``."""
    return read_line_table(spark, path).malformed


def checklist_dump(raw: DataFrame) -> DataFrame:
    """Table of texts -> the columns of a checklist dump that are used, under their plain headers."""
    by_header = {" ".join(name.replace(".", " ").split()).upper(): name for name in raw.columns}
    require_columns(list(by_header), S.CHECKLIST_DUMP, "checklist dump")
    return raw.select(*[F.col(f"`{by_header[header]}`").alias(header) for header in S.CHECKLIST_DUMP])


def canonical_checklists(dump: DataFrame) -> DataFrame:
    """Checklist dump -> canonical checklist lines (16 of its columns, typed)."""
    columns = []
    for header, (name, kind) in S.CHECKLIST_DUMP.items():
        source = F.col(f"`{header}`")
        if kind == "date":
            columns.append(date_from_text(source).alias(name))
        elif kind == "string":
            columns.append(source.alias(name))
        else:
            columns.append(source.try_cast(kind).alias(name))
    return dump.select(*columns)


def read_dimension_csv(spark: SparkSession, path: str, rename: Mapping[str, str] | None = None) -> DataFrame:
    """Small list with a header: byte-order mark dropped, header cells trimmed, lower-cased, blanks -> ``_``."""
    df = normalise_names(_read_text_table(spark, path), sep="_")
    return select_renamed(df, rename) if rename else df


def read_status_list(
    spark: SparkSession,
    path: str,
    level: str,
    status_column: str = "listing_status",
    skip_common_names: tuple[str, ...] = (),
) -> DataFrame:
    """Threatened/endangered list; the status is lower-cased behind ``level`` ("federally", "state").

    ``skip_common_names`` drops entries already covered by another list.
    """
    return status_list(read_dimension_csv(spark, path), level, status_column, skip_common_names)


def status_list(
    df: DataFrame, level: str, status_column: str = "listing_status", skip_common_names: tuple[str, ...] = ()
) -> DataFrame:
    """Dimension table -> status list, with the status tidied."""
    require_columns(df.columns, ["scientific_name", "common_name", status_column], "status list")
    kept = df.where(~F.coalesce(F.col("common_name").isin(*skip_common_names), F.lit(False))) if skip_common_names else df
    return kept.select(
        "scientific_name",
        "common_name",
        N.tidy_status(status_column, level).alias("listing_status"),
    )


def read_watch_list(spark: SparkSession, path: str, in_park_column: str | None = None) -> DataFrame:
    """Watch list from CSV or a Parquet directory, with the presence column renamed to ``in_park``."""
    is_text = path.rstrip("/").lower().endswith((".csv", ".csv.gz", ".txt"))
    return watch_list(_read_text_table(spark, path) if is_text else spark.read.parquet(path), in_park_column)


def watch_list(df: DataFrame, in_park_column: str | None = None) -> DataFrame:
    """Table of texts -> watch list."""
    df = normalise_names(df, sep="_")
    common = F.col("common_name") if "common_name" in df.columns else F.lit(None).cast("string")
    in_park = F.col(in_park_column) if in_park_column else F.lit(None).cast("string")
    return df.select("scientific_name", common.alias("common_name"), "category", in_park.alias("in_park"))


def read_bird_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Bird taxonomy: species name, order, family (with its bracketed common name), group."""
    raw = _read_text_table(spark, path)
    return select_renamed(raw, S.BIRD_TAXONOMY)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """General taxonomy list, exact duplicates removed, a few names brought to species rank.

    Entries whose common name contains "complex" are left out; a missing common name is kept.
    """
    df = read_dimension_csv(spark, path).distinct()
    is_complex = F.coalesce(F.contains(F.col("common_name"), F.lit("complex")), F.lit(False))
    return df.withColumn("scientific_name", N.recode("scientific_name", N.TAXONOMY_RENAMES)).where(~is_complex)


def read_visits(spark: SparkSession, path: str, parks: Mapping[str, str]) -> DataFrame:
    """Yearly visit counts, one column per park -> one row per (year, park) with a known count.

    ``parks`` maps the file's column (after normalising, for example ``north_visits``) to the park tag.
    """
    df = read_dimension_csv(spark, path)
    typed = df.select(
        F.col("year").cast("int").alias("year"),
        *[F.col(column).try_cast("bigint").alias(park) for column, park in parks.items()],
    )
    long = wide_to_long(typed, ids=["year"], values=list(parks.values()), name_to="park", value_to="visits")
    return long.where(F.col("visits").isNotNull())


def read_rings(spark: SparkSession, path: str) -> DataFrame:
    """Polygon or line layer as a vertex table: ``poly_id, part, ring, seq, x, y`` (CSV or Parquet)."""
    if path.rstrip("/").lower().endswith((".csv", ".csv.gz")):
        df = _read_text_table(spark, path)
    else:
        df = spark.read.parquet(path)
    return vertices(df)


def vertices(df: DataFrame) -> DataFrame:
    """Table of texts or values -> typed vertex table."""
    require_columns(df.columns, S.RINGS.names, "vertex table")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.RINGS.fields])
