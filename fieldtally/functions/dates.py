"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtally.types import ColumnLike, col_of

# the whole text: a date, then perhaps a time of day and a zone
_ISO = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?( ?(Z|UTC|[+-]\d{2}:?\d{2}))?)?$"


def date_from_text(column: ColumnLike) -> Column:
    """Local DATE of an ISO date or date and time; any other text, also one that goes on after it, is NULL."""
    text = F.trim(col_of(column).cast("string"))
    return F.when(text.rlike(_ISO), F.try_to_date(F.substring(text, 1, 10)))


def year_of(column: ColumnLike) -> Column:
    return F.year(col_of(column))


def month_of(column: ColumnLike) -> Column:
    return F.month(col_of(column))


def month_start(column: ColumnLike) -> Column:
    """First day of the month, the key of every monthly series."""
    return F.trunc(col_of(column), "month")


def month_from_parts(year: ColumnLike, month: ColumnLike) -> Column:
    """The same key from a year and a month column."""
    return F.make_date(col_of(year), col_of(month), F.lit(1))


def month_sequence(first: ColumnLike, last: ColumnLike) -> Column:
    """Array of month keys from ``first`` to ``last``, both ends included."""
    return F.sequence(month_start(first), month_start(last), F.expr("interval 1 month"))
