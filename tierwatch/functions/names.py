"""Column choice by name. Works on the schema only; no data is read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType


def containing(df: DataFrame, *parts: str) -> list[str]:
    return [c for c in df.columns if any(p in c for p in parts)]


def ending(df: DataFrame, *suffixes: str) -> list[str]:
    return [c for c in df.columns if c.endswith(tuple(suffixes))]


def starting(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(tuple(prefixes))]


def numeric(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skip
    ]


def quoted(name: str):
    """Escape a column name that may hold dots or back-ticks."""
    return "`" + name.replace("`", "``") + "`"
