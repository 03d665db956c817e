"""Column selection, type unification, imputation and dummies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tierwatch.functions.names import containing, ending, quoted


def drop_matching(df: DataFrame, contains: Sequence[str] = (), suffixes: Sequence[str] = ()) -> DataFrame:
    doomed = set(containing(df, *contains)) if contains else set()
    if suffixes:
        doomed |= set(ending(df, *suffixes))
    return df.drop(*sorted(doomed))


def drop_named(df: DataFrame, *names: str, strict: bool = False) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if strict and missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*names)


def select_matching(df: DataFrame, contains: str | Sequence[str], key: str) -> DataFrame:
    parts = [contains] if isinstance(contains, str) else list(contains)
    kept = [c for c in containing(df, *parts) if c != key]
    return df.select(*[quoted(c) for c in kept], quoted(key))


def strip_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Remove `prefix` from the column names that hold it."""
    return df.withColumnsRenamed({c: c.replace(prefix, "") for c in df.columns if prefix in c})


def to_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cast to double; NaN becomes null so that one notion of "missing" remains."""
    return df.withColumns(
        {c: F.nanvl(F.col(quoted(c)).cast("double"), F.lit(None).cast("double")) for c in cols}
    )


def _known(df: DataFrame, col: str):
    """The column with NaN as null, like any other missing value."""
    c = F.col(quoted(col))
    kind = df.schema[col].dataType.typeName()
    return F.nanvl(c, F.lit(None).cast(kind)) if kind in ("double", "float") else c


def _fill(df: DataFrame, values: Mapping[str, float | None]) -> DataFrame:
    return df.withColumns(
        {
            c: F.coalesce(_known(df, c), F.lit(v).cast(df.schema[c].dataType))
            for c, v in values.items()
            if v is not None
        }
    )


def fill_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    stats = df.agg(*[F.avg(_known(df, c)).alias(c) for c in cols]).first().asDict()
    return _fill(df, stats)


def fill_extreme(df: DataFrame, cols: Sequence[str], otherwise: float | None = None) -> DataFrame:
    """Missing values become minus the column maximum, so that they stand apart from real ones.

    A column without any value has no maximum; it gets `otherwise`, or stays as it is.
    """
    stats = df.agg(*[F.max(_known(df, c)).alias(c) for c in cols]).first().asDict()
    return _fill(df, {c: otherwise if v is None else -v for c, v in stats.items()})


def fill_const(df: DataFrame, value: float = 0.0, cols: Sequence[str] | None = None) -> DataFrame:
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    return _fill(df, dict.fromkeys(cols if cols is not None else names, value))


def null_audit(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per column: `(variable, n_null, any_null)`, from a single aggregation."""
    names = list(cols or df.columns)
    counts = df.agg(*[F.count_if(_known(df, c).isNull()).alias(c) for c in names])
    return counts.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("variable"), F.col(quoted(c)).alias("n_null")) for c in names])
        )
    ).withColumn("any_null", F.col("n_null") > 0)


def distinct_values(df: DataFrame, col: str, limit: int = 10_000) -> list:
    """The values of a low-cardinality column; fails rather than truncating a long list."""
    rows = df.select(quoted(col)).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{col} has more than {limit} distinct values")
    return sorted((r[0] for r in rows), key=lambda v: (v is None, v))


def one_hot(df: DataFrame, col: str, prefix: str | None = None, values: Sequence | None = None) -> DataFrame:
    """Replace `col` by 0/1 columns `<prefix>_<value>`."""
    return dummies(df, col, prefix, values).drop(col)


def dummies(df: DataFrame, col: str, prefix: str | None = None, values: Sequence | None = None) -> DataFrame:
    """Put 0/1 columns for the values of `col` in front of the existing columns."""
    found = distinct_values(df, col) if values is None else list(values)
    flags = [F.when(F.col(quoted(col)) == v, 1).otherwise(0).alias(f"{prefix or col}_{v}") for v in found]
    return df.select(*flags, *[quoted(c) for c in df.columns])


def transpose(df: DataFrame, id_col: str) -> DataFrame:
    """Turn a small rows-by-columns table around: former columns become rows."""
    cols = [c for c in df.columns if c != id_col]
    ids = distinct_values(df, id_col)
    return (
        df.unpivot([id_col], cols, "name", "value").groupBy("name").pivot(id_col, ids).agg(F.first("value"))
    )
