"""The stream jobs, drained over the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.streaming import jobs
from paperloom.workload.assessment import SCORED_SQL
from paperloom.workload.people import STATE_SQL
from paperloom.workload.views import Tables, with_views


class StreamTables(Tables):
    """The same views with every table read as a stream."""

    def read(self, name: str):
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)


def _facts(spark, folder, scores: str | None = None) -> str:
    out = jobs.scratch(spark, "facts")
    jobs.merge_facts(StreamTables(spark, folder).replies, Tables(spark, folder).questions, out, jobs.scratch(spark, "facts-state"), ["answered_at", "line"], scores)
    return out


def stream_scored_answers(spark, folder):
    """The first answer to every (session, question), with the key it was judged by and the verdict."""
    return jobs.current(spark, _facts(spark, folder)).select(
        "session_id", "question_id", "part", "question_number", "correct_answer", "student_answer", "is_correct",
        F.unix_micros("answered_at").alias("answered_us"),
    )


def stream_session_scores(spark, folder):
    """Right answers and answers per session and part, kept while facts arrive."""
    scores = jobs.scratch(spark, "scores")
    _facts(spark, folder, scores)
    return jobs.current(spark, scores).select("session_id", "part", "correct", "total")


def stream_registration(spark, folder):
    out = jobs.scratch(spark, "registration")
    jobs.run_updates(jobs.registration_stream(StreamTables(spark, folder).requests), out, jobs.scratch(spark, "registration-state"), "telegram_id")
    table = jobs.current(spark, out)
    return table.select(
        "telegram_id", "telegram_name", "telegram_username", "full_name", "status", "handled_by",
        F.unix_micros("created_at").alias("created_us"), F.unix_micros("handled_at").alias("handled_us"),
    )


def stream_image_rows(spark, folder):
    out = jobs.scratch(spark, "images")
    jobs.merge_images(StreamTables(spark, folder).images.drop("telegram_file_id"), out, jobs.scratch(spark, "images-state"))
    return jobs.current(spark, out).select("question_id", "object_key", "content_hash")


QUERIES = {f.__name__: f for f in (stream_scored_answers, stream_session_scores, stream_registration, stream_image_rows)}

SQL = {
    "stream_scored_answers": with_views(
        "questions replies",
        f"""{SCORED_SQL} SELECT session_id, question_id, part, question_number, correct_answer, student_answer, is_correct,
            epoch_us(answered_at) AS answered_us FROM scored""",
    ),
    "stream_session_scores": with_views(
        "questions replies",
        f"""{SCORED_SQL} SELECT session_id, part, count(*) FILTER (is_correct) AS correct, count(*) AS total FROM scored GROUP BY 1, 2""",
    ),
    "stream_registration": with_views("requests", f"{STATE_SQL} SELECT * FROM state"),
    "stream_image_rows": with_views("images", "SELECT question_id, object_key, content_hash FROM images"),
}
