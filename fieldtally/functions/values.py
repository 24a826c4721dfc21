"""Scalar value expressions: missing values, counts held as text, ratios, messages."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtally.types import ColumnLike, col_of


def zero_if_null(column: ColumnLike) -> Column:
    """NULL counts become 0 (zero filling after an outer join)."""
    return F.coalesce(col_of(column), F.lit(0))


def null_if_zero(column: ColumnLike) -> Column:
    """0 becomes NULL, so empty grid cells drop out of a colour scale or a mean."""
    return F.nullif(col_of(column), F.lit(0))


def count_from_text(column: ColumnLike, present_mark: str = "X") -> Column:
    """Counts held as text; ``present_mark`` means present but not counted and is read as 1.

    Anything else that is not a number is NULL.
    """
    text = col_of(column)
    return F.when(text == present_mark, F.lit(1.0)).otherwise(text.try_cast("double"))


def ratio(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """One double division; NULL when the denominator is 0."""
    return col_of(numerator).cast("double") / F.nullif(col_of(denominator).cast("double"), F.lit(0.0))


def percent(numerator: ColumnLike, denominator: ColumnLike, digits: int | None = None) -> Column:
    """100 * numerator / denominator, rounded half to even when ``digits`` is given."""
    value = ratio(numerator, denominator) * 100.0
    return value if digits is None else F.bround(value, digits)


def is_filled(column: ColumnLike) -> Column:
    """True only for text that is neither NULL nor blank."""
    return F.coalesce(col_of(column) != "", F.lit(False))


def message(template: str, *columns: ColumnLike) -> Column:
    """Fill a printf-style template from columns, for example ``"%s checklists"``."""
    return F.format_string(template, *[col_of(c) for c in columns])


def two_sided_p(z: ColumnLike) -> Column:
    """Chance that a standard normal value is at least as far from 0: a series near 0, a continued fraction beyond."""
    x = F.abs(col_of(z)) / math.sqrt(2.0)
    square = x * x

    def term(state: Column, k: Column) -> Column:
        power = -state["power"] * square / k
        return F.struct(power.alias("power"), (state["sum"] + power / (2.0 * k + 1.0)).alias("sum"))

    steps = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: k.cast("double"))
    near = F.aggregate(steps, F.struct(x.alias("power"), x.alias("sum")), term, lambda s: 1.0 - s["sum"] * (2.0 / math.sqrt(math.pi)))
    far = F.aggregate(
        F.reverse(F.transform(F.sequence(F.lit(1), F.lit(160)), lambda k: k.cast("double") / 2.0)), x, lambda s, k: x + k / s
    )
    tail = F.exp(-square) / math.sqrt(math.pi) / far
    return F.when(x.isNotNull() & ~F.isnan(x), F.when(x < 1.5, near).otherwise(tail))
