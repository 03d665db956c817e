"""Arrow tasks over rows with any columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def map_rows(docs: DataFrame, task) -> DataFrame:
    """`docs.mapInArrow` with the same columns out as in, whatever their names; the task goes by position."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(task, plain.schema).toDF(*docs.columns)
