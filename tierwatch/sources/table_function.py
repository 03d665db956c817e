"""A stored taxonomy as a table function of SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tierwatch.plans.taxonomy import Taxonomy

HELD_ROWS = 4096


def register_taxonomy(spark: SparkSession, path: str, name: str, group: str = "group") -> None:
    """Make the taxonomy saved at `path` a function: `SELECT * FROM <name>(TABLE(records))`.

    Its result has the columns of its input, then the label of each level and the group, as
    `Taxonomy.classify` gives them. An input that lacks a variable of the taxonomy is refused when the query
    is analysed. Rows are classified where they are, `HELD_ROWS` at a time.
    """
    levels = [
        (
            lv.label,
            list(lv.variables),
            [lv.scaler.mean[c] for c in lv.variables],
            [lv.scaler.std[c] or 1.0 for c in lv.variables],
            [list(p) for p in lv.centers.points],
        )
        for lv in Taxonomy.load(spark, path).levels
    ]

    class Classify:
        @staticmethod
        def analyze(records: AnalyzeArgument) -> AnalyzeResult:
            if not records.isTable:
                raise Exception("give the records as TABLE(...)")
            lacking = sorted({c for _, cols, *_ in levels for c in cols} - set(records.dataType.names))
            if lacking:
                raise Exception(f"the records lack {', '.join(lacking)}")
            out = StructType(list(records.dataType.fields))
            for label, *_ in levels:
                out = out.add(label, IntegerType())
            return AnalyzeResult(out.add(group, StringType()))

        def __init__(self):
            self.rows: list[Row] = []

        def eval(self, row: Row) -> Iterator[tuple]:
            self.rows.append(row)
            if len(self.rows) >= HELD_ROWS:
                yield from self.classified()

        def terminate(self) -> Iterator[tuple]:
            yield from self.classified()

        def classified(self) -> Iterator[tuple]:
            rows, self.rows = self.rows, []
            if not rows:
                return
            columns = list(zip(*rows))
            place = {c: i for i, c in enumerate(rows[0].__fields__)}
            found = []
            for _, cols, mean, std, points in levels:
                # Added up column by column, as the projection does, so that ties fall alike.
                gaps = np.zeros((len(rows), len(points)))
                for i, c in enumerate(cols):
                    z = (np.array(columns[place[c]], float) - mean[i]) / std[i]
                    gaps += (z[:, None] - np.array([p[i] for p in points])) ** 2
                found.append(gaps.argmin(axis=1).tolist())
            labels = list(zip(*found))
            names = {own: "_".join(map(str, own)) for own in set(labels)}
            yield from zip(*columns, *found, [names[own] for own in labels])

    # Over Arrow, Spark makes a table of what each single row gives; rows as they are go in batches.
    spark.udtf.register(name, udtf(Classify, useArrow=False))
