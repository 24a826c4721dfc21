"""Row predicates, as Columns to pass to ``where``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtally.functions.values import is_filled
from fieldtally.types import ColumnLike, col_of

# Words used by the two feeds.
RESEARCH_GRADE = "research"
SPECIES_CATEGORY = "species"
INCIDENTAL = "Incidental"
TRAVELING = "Traveling"
STATIONARY = "Stationary"
MIN_DURATION = 5


def on_or_before(column: ColumnLike, last: str) -> Column:
    """Inclusive cut-off date."""
    return col_of(column) <= F.lit(last).cast("date")


def not_among(column: ColumnLike, bad_ids: Sequence) -> Column:
    """Leave out known-bad ids; a NULL id is left out too, as in a plain ``!=``."""
    return ~col_of(column).isin(*bad_ids)


def is_research(column: ColumnLike = "quality_grade", word: str = RESEARCH_GRADE) -> Column:
    return col_of(column) == word


def is_named_research(
    name: ColumnLike = "scientific_name", grade: ColumnLike = "quality_grade", word: str = RESEARCH_GRADE
) -> Column:
    """Research grade and identified to species rank (name neither NULL nor blank)."""
    return is_filled(name) & (col_of(grade) == word)


def is_species(column: ColumnLike = "category", word: str = SPECIES_CATEGORY) -> Column:
    return col_of(column) == word


def is_complete(
    duration: ColumnLike = "duration_min",
    all_species: ColumnLike = "all_species_reported",
    protocol: ColumnLike = "protocol",
    rule: str = "standard",
    traveling: str = TRAVELING,
    stationary: str = STATIONARY,
    incidental: str = INCIDENTAL,
    min_duration: float = MIN_DURATION,
) -> Column:
    """Is the checklist complete?

    * ``standard``: long enough, all species reported, not incidental.
    * ``protocol``: every travelling list, or a stationary one that is long enough and reports all species.
    * ``richness``: every travelling list, or a stationary one that is long enough.

    In the last two the extra tests bind to the stationary lists only.
    """
    lasted = col_of(duration) >= min_duration
    reported = col_of(all_species) == 1
    kind = col_of(protocol)
    if rule == "standard":
        return lasted & reported & (kind != incidental)
    if rule == "protocol":
        return (kind == traveling) | ((kind == stationary) & lasted & reported)
    if rule == "richness":
        return (kind == traveling) | ((kind == stationary) & lasted)
    raise ValueError(f"unknown completeness rule: {rule}")


def all_filled(*columns: ColumnLike) -> Column:
    """Every key is neither NULL nor blank."""
    test = is_filled(columns[0])
    for column in columns[1:]:
        test = test & is_filled(column)
    return test


def in_period(column: ColumnLike, first: str | None = None, last: str | None = None, closed: bool = True) -> Column:
    """Date window, ends included (``closed``) or excluded; an end left out is unbounded."""
    date, test = col_of(column), F.lit(True)
    if first is not None:
        edge = F.lit(first).cast("date")
        test = test & ((date >= edge) if closed else (date > edge))
    if last is not None:
        edge = F.lit(last).cast("date")
        test = test & ((date <= edge) if closed else (date < edge))
    return test


def in_months(column: ColumnLike, months: Sequence[int]) -> Column:
    """Calendar months of a season, for example 12, 1, 2."""
    return F.month(col_of(column)).isin(*months)


def from_year(column: ColumnLike, first: int) -> Column:
    """Dates from the start of a year on; a plain date comparison, so it reaches the file scan."""
    return col_of(column) >= F.lit(f"{first:04d}-01-01").cast("date")


def relabelled(column: ColumnLike, key: ColumnLike, key_values: Sequence, label: str) -> Column:
    """The column, with another label on the rows of some keys."""
    return F.when(col_of(key).isin(*key_values), F.lit(label)).otherwise(col_of(column))


def not_hotspot(column: ColumnLike, hotspot: str) -> Column:
    """Leave out the catch-all locality of a park."""
    return col_of(column) != hotspot


def accurate_within(column: ColumnLike, metres: float) -> Column:
    """Positional accuracy under a threshold; unknown accuracy does not pass."""
    return col_of(column) < metres


def matches(column: ColumnLike, pattern: str) -> Column:
    """Regular-expression test that is False, not NULL, for a missing value."""
    return F.coalesce(col_of(column).rlike(pattern), F.lit(False))


def has_text(column: ColumnLike, text: str) -> Column:
    """Substring test that is False, not NULL, for a missing value; negate it freely."""
    return F.coalesce(F.contains(col_of(column), F.lit(text)), F.lit(False))


def in_box(x: ColumnLike, y: ColumnLike, xmin: float, xmax: float, ymin: float, ymax: float) -> Column:
    """Points inside a box, border included; both tests reach the file scan."""
    return col_of(x).between(xmin, xmax) & col_of(y).between(ymin, ymax)


def edge_in_box(edge: Column, xmin: float, xmax: float, ymin: float, ymax: float) -> Column:
    """Segments whose own box overlaps a box."""
    return (
        (F.greatest(edge["x1"], edge["x2"]) >= xmin)
        & (F.least(edge["x1"], edge["x2"]) <= xmax)
        & (F.greatest(edge["y1"], edge["y2"]) >= ymin)
        & (F.least(edge["y1"], edge["y2"]) <= ymax)
    )
