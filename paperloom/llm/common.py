"""What the operators of this subpackage share."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.plans.session import ensure_checkpoint_dir

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def travels(name: str) -> None:
    """Ship the module's functions inside the jobs that use them, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


travels(__name__)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def settle(df: DataFrame) -> DataFrame:
    """Write *df* as a table in the shared checkpoint folder and go on from there.

    Cuts lineage, keeps a result that several branches read from being computed again, and survives a lost executor.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    settled = spark.read.schema(df.schema).parquet(path)
    settled.written_at = path
    return settled


def forget(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed(value: Column, digits: int = 8) -> Column:
    """The leading hex digits of the md5 of a value's text, as a number; null counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, digits), 16, 10).cast("long")


def each_number(df: DataFrame, low: Column, high: Column, name: str, piece: int = 1 << 16) -> DataFrame:
    """A row for every whole number from *low* to *high* in the column *name*; none where high is less.

    Numbers are dealt in pieces first, so an array holds at most *piece* numbers, or one for each piece.
    """
    begun = df.withColumn("_from", low.cast("long")).withColumn("_upto", high.cast("long")).where("_from <= _upto")
    parts = begun.withColumn("_from", F.explode(F.sequence(F.col("_from"), F.col("_upto"), F.lit(piece))))
    return parts.withColumn(name, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (piece - 1), F.col("_upto"))))).drop("_from", "_upto")


def each_copy(runs: DataFrame, count: str, name: str, piece: int = 1 << 16) -> DataFrame:
    """A row for every copy of a run of equal rows, numbered from 0 in *name*. The pieces of a long run go to different tasks."""
    n, zero = F.col(count), F.lit(0)
    short = each_number(runs.where(n <= piece), zero, n - 1, name, piece)
    pieces = each_number(runs.where(n > piece), zero, F.floor((n - 1) / piece), "_piece", piece)
    dealt = pieces.repartition("_piece", *runs.columns)
    long = each_number(dealt, F.col("_piece") * piece, F.least((F.col("_piece") + 1) * piece, n) - 1, name, piece).drop("_piece")
    return short.unionByName(long)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8_000_000, measure=pc.binary_length) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that *column* holds about *most* bytes in each; a longer value comes alone."""
    for batch in batches:
        sizes = pc.fill_null(measure(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)
