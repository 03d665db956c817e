"""Exact duplicates by a tree merge of sorted digest runs.

Every document falls into one of `runs` runs by a hash of its id; `runs` is a power of two. A run holds
one row per digest, in order: the smallest id seen and the number of rows. In binomial rounds the runs
whose numbers agree above the next `log2(fan)` bits exchange their rows and are merged in the order of
(digest, id): the first row of a digest has its smallest id, and the rows that meet are verified to agree
in an independent 64-bit hash and in length, else the job fails. When one run is left, the answers
go back down the same tree. A digest that a third of all rows share is therefore never gathered under
one key: each level meets it at most `fan` times per key.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierwatch.functions.shared import scratch, stage

FAN = 8
SAME_TEXT = ("digest", "check", "size")

# White space other than one single blank; replacing it by a blank leaves single blanks alone.
GAPS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of white space as one blank; null as the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), GAPS, " ")


def run_count(docs: DataFrame, fan: int = FAN) -> int:
    """The smallest power of `fan` that gives every shuffle partition two runs."""
    runs = fan
    while runs < 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        runs *= fan
    return runs


def with_digests(docs: DataFrame, runs: int) -> DataFrame:
    """`docs` with `text`, `doc_id` and the columns of `SAME_TEXT` and `run`, in front of a clean text."""
    clean = docs.withColumn("clean", normalised(F.col("text")))
    return clean.withColumns(
        {
            "digest": F.unhex(F.sha2("clean", 256)),
            "check": F.xxhash64("clean"),
            "size": F.octet_length("clean"),
            "run": F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int"),
        }
    ).drop("clean")


def first_runs(rows: DataFrame) -> DataFrame:
    """The leaves of the tree: one row per run and digest with the smallest id and the number of rows, in order."""
    merged = rows.groupBy("run", *SAME_TEXT).agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    return merged.sortWithinPartitions("run", "digest")


def merge_runs(rows: DataFrame) -> DataFrame:
    """Runs that now bear one number, merged digest by digest in one ordered scan.

    Of the rows that meet, at most one from each run, the first has the smallest id. Every row must agree
    with the one before it in hash and length.
    """
    meet = Window.partitionBy("run", "digest")
    order = meet.orderBy(F.asc_nulls_last("keep_id"), "check", "size")
    said = F.struct("check", "size")
    before = F.lag(said).over(order)
    verified = F.when(before.isNull() | (before == said), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("different texts share the digest "), F.hex("digest"))).cast("boolean")
    )
    scanned = rows.select(
        "run", *SAME_TEXT, "keep_id",
        F.sum("n").over(meet).alias("n"),
        F.min(verified).over(meet).alias("verified"),
        F.row_number().over(order).alias("nth"),
    )
    return scanned.where("nth = 1 and verified").drop("nth", "verified")


def exact_groups(digests: DataFrame, runs: int, fan: int = FAN) -> DataFrame:
    """For each run and digest of `digests`: `keep_id` and `group_size` over all runs."""
    leaf = digests.select("run", *SAME_TEXT, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    levels = [stage(first_runs(leaf), "runs", codec="zstd")]
    while runs > 1:
        runs //= fan
        merged = merge_runs(levels[-1].withColumn("run", (F.col("run") / fan).cast("int")))
        levels.append(stage(merged, "runs", codec="zstd") if runs > 1 else merged)
    known = levels.pop().withColumnRenamed("n", "group_size")
    while levels:
        above = known.withColumnRenamed("run", "above")
        known = (
            levels.pop()
            .select("run", *SAME_TEXT, (F.col("run") / fan).cast("int").alias("above"))
            .join(above, ["above", *SAME_TEXT])
            .drop("above")
        )
    return known


def exact_duplicates(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; empty texts are equal to each other. Of equal texts the smallest id
    stays; null ids never win against others, and a group of null ids only has a null keep_id.
    Rows that repeat id and text are the same document and are all marked as kept; `distinct_documents`
    leaves one of them. Other columns of `docs` are ignored. An empty table gives an empty result.
    """
    runs = run_count(docs, fan)
    digests = stage(with_digests(docs.select("doc_id", "text"), runs).drop("text"), "digests", codec="zstd")
    groups = exact_groups(digests, runs, fan)
    return digests.join(groups, ["run", *SAME_TEXT]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _kept_rows(docs: DataFrame, runs: int, fan: int) -> DataFrame:
    """(doc_id, kept_digest, times) of the ids that stay, and how many rows bear id and text."""
    digests = stage(with_digests(docs.select("doc_id", "text"), runs).drop("text"), "digests", codec="zstd")
    keys = digests.groupBy("run", "doc_id", *SAME_TEXT).agg(F.count(F.lit(1)).alias("times"))
    kept = keys.join(exact_groups(digests, runs, fan), ["run", *SAME_TEXT])
    kept = kept.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return kept.select("doc_id", F.col("digest").alias("kept_digest"), "times")


def distinct_documents(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """The rows of `docs`, all columns, that `exact_duplicates` keeps; repeated rows once."""
    runs = run_count(docs, fan)
    with scratch(docs.sparkSession) as own:
        kept = own.keep(stage(_kept_rows(docs, runs, fan), "kept", codec="zstd"))
    inner = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    slim = inner.withColumn("digest", F.unhex(F.sha2(normalised(F.col("text")), 256))).drop("text")
    same = slim["doc_id"].eqNullSafe(kept["doc_id"]) & (F.col("digest") == F.col("kept_digest"))

    def whole(part: DataFrame) -> DataFrame:
        return slim.join(part, same).select(slim["doc_id"], "digest", "whole")

    once = whole(kept)
    if kept.where("times > 1").limit(1).count():
        repeated = whole(kept.where("times > 1")).dropDuplicates(["doc_id", "digest"])
        once = whole(kept.where("times = 1")).unionByName(repeated)
    return once.select("whole.*")
