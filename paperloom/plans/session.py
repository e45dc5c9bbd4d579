"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "paperloom", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the library relies on (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder lineage cuts go to.

    A cluster names a shared folder in ``spark.checkpoint.dir``. A temporary folder is made only where that is unset and the
    master is local (a laptop, the tests); on a cluster other machines could not read it, so that is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that every machine of the cluster shares")
    folder = named or tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write *df* to the checkpoint folder and go on from the written copy.

    Used where two branches must see the same physical rows (a slice number, say). The copy is on
    shared storage, so a lost executor costs a re-read and never a recomputation with other slices.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
