"""The operators kept current as streams: scored answers, running scores, registration, image rows.

A stream is folded into a table kept in a fixed number of parts by the hash of a key. A batch rewrites only the parts it
touches, under its own number, and reads versions before its own: a batch repeated after a lost executor replaces what it
wrote. Nothing is dropped for being late.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import assess, changes, people
from paperloom.plans.session import ensure_checkpoint_dir
from paperloom.sources import files

# Parts of a table that streams keep. Fixed for the life of a table.
BUCKETS = 32


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def current(spark: SparkSession, root: str, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
    """The newest version of every part of a kept table (of *parts*, of versions *before* a number)."""
    rows = spark.read.parquet(root)
    seen = rows if before is None else rows.filter(F.col("v") < before)
    seen = seen if parts is None else seen.filter(F.col("bucket").isin(parts))
    newest = seen.groupBy("bucket").agg(F.max("v").alias("v")).collect()  # a row a part
    chosen = [(F.col("bucket") == r["bucket"]) & (F.col("v") == r["v"]) for r in newest]
    return seen.filter(reduce(lambda x, y: x | y, chosen, F.lit(False))).drop("bucket", "v")


def merge_stream(
    stream: DataFrame, root: str, checkpoint: str, key: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], mode: str = "append"
) -> None:
    """Drain a stream into the table at *root*: merge(rows of the touched parts so far or None, batch) gives those parts anew."""
    spark = stream.sparkSession

    def fold(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}.batch")  # read three times; a stateful batch must run once
        batch = spark.read.schema(batch.schema).parquet(f"{root}.batch")
        touched = [r["b"] for r in batch.select(bucket_of(key).alias("b")).distinct().collect()]  # at most BUCKETS numbers
        known = current(spark, root, number, touched) if number else None
        merged = merge(known, batch).withColumn("bucket", bucket_of(key))
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/v={number}")
        _retire(spark, root, number, touched)

    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).outputMode(mode)
    query.trigger(availableNow=True).start().awaitTermination()


def _retire(spark: SparkSession, root: str, number: int, parts: list[int]) -> None:
    """Delete versions of the parts just written but for the one before, which a repeated batch would read."""
    old = spark.read.parquet(root).filter((F.col("v") < number) & F.col("bucket").isin(parts)).select("bucket", "v").distinct().collect()
    newest = {}
    for r in old:
        newest[r["bucket"]] = max(r["v"], newest.get(r["bucket"], -1))
    jvm, settings = spark._jvm, spark._jsc.hadoopConfiguration()
    for r in old:
        if r["v"] < newest[r["bucket"]]:
            path = jvm.org.apache.hadoop.fs.Path(f"{root}/v={r['v']}/bucket={r['bucket']}")
            path.getFileSystem(settings).delete(path, True)


def scored_answer_stream(replies: DataFrame, questions: DataFrame) -> DataFrame:
    """Scored facts of a reply stream against the key table, repeats included."""
    return assess.score_answers(replies, questions)


def merge_facts(replies: DataFrame, questions: DataFrame, root: str, checkpoint: str, order: list[str], scores: str | None = None) -> None:
    """Keep the first answer to each (session, question), however late it comes, with the verdict it got when it came.

    With *scores*, also the score by part of every session in the touched parts.
    """

    def merge(known: DataFrame | None, batch: DataFrame) -> DataFrame:
        return assess.first_answers(batch if known is None else known.unionByName(batch), order)

    merge_stream(scored_answer_stream(replies, questions), root, checkpoint, "session_id", merge)
    if scores:
        facts = replies.sparkSession.readStream.schema(replies.sparkSession.read.parquet(root).schema).parquet(root)
        merge_stream(facts, scores, f"{checkpoint}-scores", "session_id", lambda _, batch: score_newest(batch))


def score_newest(facts: DataFrame) -> DataFrame:
    """Score by session and part of the newest version of every part among *facts*."""
    newest = facts.groupBy("bucket").agg(F.max("v").alias("v"))
    return assess.score_by_part(facts.join(newest, ["bucket", "v"]).drop("bucket", "v"))


def registration_stream(events: DataFrame) -> DataFrame:
    """Current registration state per person: the batch aggregation, kept by the stream's state store."""
    return people.student_table(events)


def image_file_stream(spark: SparkSession, root: str) -> DataFrame:
    """New image files below *root* with their digest."""
    arriving = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .load(root)
    )
    return files.keyed_digests(arriving, root)


def image_rows(arriving: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(question_id, object_key, content_hash) of arriving files: each key is read as subject, year, option, part and number.

    Files that name no stored question are left out, as a load leaves them out.
    """
    subjects = tables["subjects"].select("subject_id", F.col("name").alias("subject"))
    books = tables["books"].select("book_id", "subject_id", F.col("year_value").alias("year"))
    options = tables["options"].select("option_id", "book_id", F.col("option_number").alias("option"))
    questions = tables["questions"].select("question_id", "option_id", "part", F.col("question_number").alias("number"))
    found = files.seedable_images(files.question_images(arriving))
    found = found.join(subjects, "subject").join(books, ["subject_id", "year"]).join(options, ["book_id", "option"])
    return found.join(questions, ["option_id", "part", "number"]).select("question_id", "object_key", "content_hash")


def run_to_folder(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Drain an append stream into Parquet."""
    query = (
        stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_updates(stream: DataFrame, root: str, checkpoint: str, key: str) -> None:
    """Drain an update stream whose rows are each the whole state of their key."""

    def merge(known: DataFrame | None, batch: DataFrame) -> DataFrame:
        return batch if known is None else known.join(batch.select(key), key, "left_anti").unionByName(batch)

    merge_stream(stream, root, checkpoint, key, merge, mode="update")


def merge_images(stream: DataFrame, root: str, checkpoint: str) -> None:
    """Fold arriving (question_id, object_key, content_hash) rows into the images table."""
    spark = stream.sparkSession
    empty = "question_id long, object_key string, content_hash string, telegram_file_id string"

    def merge(known: DataFrame | None, batch: DataFrame) -> DataFrame:
        return changes.upsert_images(spark.createDataFrame([], empty) if known is None else known, batch).drop("changed")

    merge_stream(stream, root, checkpoint, "question_id", merge)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
