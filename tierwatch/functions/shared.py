"""Where intermediate tables live, and how small tables meet large ones."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast only after it was measured to be within both bounds.
SMALL_ROWS = 10_000
SMALL_BYTES = 32 << 20
SPLIT_BYTES = 128 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder: `spark.checkpoint.dir`, or else the one set on the context.

    Only a local session without either gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tierwatch-"))
    return spark.sparkContext.getCheckpointDir()


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size; nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can reach it."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


_RUN = uuid.uuid4().hex
_CLEANED: set[str] = set()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder. What this process put there is deleted when it ends."""
    root = f"{shared_dir(spark).rstrip('/')}/tierwatch/{_RUN}"
    if root not in _CLEANED:
        _CLEANED.add(root)

        def clean():
            with contextlib.suppress(Exception):  # the JVM may be gone by then
                delete_path(spark, root)

        atexit.register(clean)
    return f"{root}/{label}-{uuid.uuid4().hex}"


class scratch:
    """A scope whose staged tables are deleted at its end, but for those that are kept.

    Kept tables pass to the scope around it, if there is one. A table may be left out only if nothing
    that is still to be read comes from it.

        with scratch(spark) as own:
            steps = stage(first(df), "steps")
            out = own.keep(stage(second(steps), "out"))
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], []

    def keep(self, df: DataFrame) -> DataFrame:
        """`df`, as `stage` returned it, whose files stay after the scope."""
        self.kept.append(df.staged_path)
        return df

    def __enter__(self) -> scratch:
        _SCOPES.append(self)
        return self

    def __exit__(self, kind, *_) -> None:
        _SCOPES.remove(self)
        for path in set(self.paths) - set(self.kept):
            delete_path(self.spark, path)
        for scope in _SCOPES[-1:]:
            scope.paths += dict.fromkeys(self.kept)
        # Shuffle files go once the driver has collected the plans that name them.
        gc.collect()
        self.spark._jvm.System.gc()


_SCOPES: list[scratch] = []


def stage(df: DataFrame, label: str, spread: bool = False, codec: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Multi-pass work then scans pruned Parquet columns rather than re-running the
    lineage, and a lost executor costs a re-read and not a recomputation.
    With `spread`, a table that Spark estimates to fill less than one split per core is dealt out
    over the cores before this only write; a larger one is written as it comes.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if spread and estimated_bytes(df) < cores * SPLIT_BYTES:
        df = df.repartition(cores)
    path = scratch_path(df.sparkSession, label)
    for scope in _SCOPES[-1:]:
        scope.paths.append(path)
    writer = df.write.option("compression", codec) if codec else df.write
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def measured(df: DataFrame) -> DataFrame | None:
    """`df` as a local relation if it is small, else None; never fetches more than the bound."""
    table = df.limit(SMALL_ROWS + 1).toArrow()
    if table.num_rows > SMALL_ROWS or table.nbytes > SMALL_BYTES:
        return None
    return df.sparkSession.createDataFrame(table, schema=df.schema)


def join_small(df: DataFrame, side: DataFrame, on, how: str = "left") -> DataFrame:
    """Join a table that is expected to be small: broadcast if measured so, shuffled otherwise."""
    local = measured(side)
    if local is None:
        return df.join(side, on, how)
    return df.join(F.broadcast(local), on, how)


def join_shuffled(df: DataFrame, side: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join tables that both grow with the input, without a broadcast whatever their files' sizes.

    Spark takes a staged table for as large as its compressed files, which can be a tenth of what the rows
    need once the driver holds them for a broadcast.
    """
    return df.join(side.hint("merge"), on, how)
