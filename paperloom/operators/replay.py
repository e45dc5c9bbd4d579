"""Replaying recorded answers, and comparing what two runs wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(needed: DataFrame, recorded: DataFrame) -> DataFrame:
    """Needed (kind, digest) rows with their recorded value; ``found`` is false where none was recorded."""
    known = recorded.select("kind", "digest", "value", F.lit(True).alias("_found")).dropDuplicates(["kind", "digest"])
    joined = needed.join(known, ["kind", "digest"], "left")
    return joined.withColumn("found", F.col("_found").isNotNull()).drop("_found")


def missing_answers(needed: DataFrame, recorded: DataFrame) -> DataFrame:
    """What a replay would ask for and not get, by kind."""
    return needed.select("kind", "digest").distinct().join(recorded.select("kind", "digest"), ["kind", "digest"], "left_anti")


def to_answer_once(needed: DataFrame) -> DataFrame:
    """One row per (kind, digest): equal crops are asked about once."""
    return needed.select("kind", "digest").dropDuplicates()


def spread_answers(needed: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers given once, back on every row they serve."""
    return needed.join(answers.select("kind", "digest", "value"), ["kind", "digest"], "left")


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths added, removed or changed between two (path, digest) manifests."""
    old = before.select("path", F.col("digest").alias("_old"), F.lit(True).alias("_b"))
    new = after.select("path", F.col("digest").alias("_new"), F.lit(True).alias("_a"))
    status = (
        F.when(F.col("_b").isNull(), "added")
        .when(F.col("_a").isNull(), "removed")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    )
    return old.join(new, "path", "full_outer").select("path", status.alias("status")).filter(F.col("status").isNotNull())
