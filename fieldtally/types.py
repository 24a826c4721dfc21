"""Small shared helpers for arguments that are a column name or a Column."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Union[str, Column]


def col_of(column: ColumnLike) -> Column:
    """A name becomes a column reference; a Column is returned as it is."""
    return F.col(column) if isinstance(column, str) else column


def names_of(columns: str | Iterable[str] | None) -> list[str]:
    """One name, several names or none, as a list."""
    if columns is None:
        return []
    return [columns] if isinstance(columns, str) else list(columns)


def require_columns(available: Sequence[str], wanted: Iterable[str], what: str) -> None:
    """Fail early, with the missing names, instead of deep inside a plan."""
    missing = [name for name in wanted if name not in available]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}; have {list(available)}")
