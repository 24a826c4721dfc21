"""Projection and schema operators."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.types import require_columns


def select_renamed(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Keep the mapped columns only, under their new names, in mapping order."""
    require_columns(df.columns, mapping, "select")
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in mapping.items()])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename some columns and keep the rest where they are."""
    require_columns(df.columns, mapping, "rename")
    return df.withColumnsRenamed(dict(mapping))


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in frame order, both included."""
    require_columns(df.columns, [first, last], "column range")
    start, stop = df.columns.index(first), df.columns.index(last)
    if start > stop:
        raise ValueError(f"column range: {first} comes after {last}")
    return df.columns[start : stop + 1]


def move_to_front(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns first, every other column behind them."""
    require_columns(df.columns, columns, "reorder")
    rest = [c for c in df.columns if c not in set(columns)]
    return df.select(*[F.col(f"`{c}`") for c in [*columns, *rest]])


def drop_range(df: DataFrame, first: str, last: str) -> DataFrame:
    """Drop a run of neighbouring columns."""
    return df.drop(*column_range(df, first, last))


def normalise_names(df: DataFrame, sep: str = ".") -> DataFrame:
    """Trim and lower-case all names; runs of blanks, dots and underscores become ``sep``."""
    names = [re.sub(r"[\s._]+", sep, name.replace("﻿", "").strip().lower()) for name in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"normalised names collide: {names}")
    return df.toDF(*names)


def tag(df: DataFrame, **constants: object) -> DataFrame:
    """Add constant columns."""
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def with_null_columns(df: DataFrame, columns: Mapping[str, str | T.DataType]) -> DataFrame:
    """Add typed NULL columns, so that two feeds line up for a union."""
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in columns.items()})


def path_label(*columns: str, sep: str = " - "):
    """Composite label such as ``kingdom - phylum``."""
    return F.concat_ws(sep, *[F.col(c) for c in columns])
