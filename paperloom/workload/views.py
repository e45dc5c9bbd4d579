"""The domain tables as views of the given ones: once as DataFrames, once as SQL for the oracle.

Every view keeps one row per row of its source, so a query's work grows with the tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import exam


class Tables:
    """Lazy views of one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def books(self) -> DataFrame:
        return self.read("region").select(
            F.col("r_regionkey").cast("long").alias("book_id"),
            F.col("r_regionkey").cast("long").alias("subject_id"),
            F.col("r_name").alias("subject_name"),
            (F.col("r_regionkey") + 2020).alias("year_value"),
        )

    @cached_property
    def subjects(self) -> DataFrame:
        return self.read("region").select(
            F.col("r_regionkey").cast("long").alias("subject_id"), F.col("r_name").alias("name")
        )

    @cached_property
    def options(self) -> DataFrame:
        number = (F.floor(F.col("n_nationkey") / 5) * 2 + 2).cast("int")
        options = self.read("nation").select(
            F.col("n_nationkey").cast("long").alias("option_id"),
            F.col("n_regionkey").cast("long").alias("book_id"),
            number.alias("option_number"),
        )
        typed = exam.exam_type(F.col("book_id") + 2020, F.col("option_number"))
        return options.withColumn("exam_type", typed)

    @cached_property
    def questions(self) -> DataFrame:
        part = F.when(F.col("p_size") % 3 == 0, "B").otherwise("A")
        key_a = (F.col("p_size") % 5 + 1).cast("string")
        key_b = F.concat(F.col("p_brand"), F.lit(" / "), F.col("p_type"))
        return self.read("part").select(
            F.col("p_partkey").alias("question_id"),
            (F.col("p_partkey") % 25).alias("option_id"),
            part.alias("part"),
            (F.floor(F.col("p_partkey") / 25) + 1).cast("int").alias("question_number"),
            F.when(F.col("p_size") % 11 != 0, F.when(part == "A", key_a).otherwise(key_b)).alias("answer"),
        )

    @cached_property
    def images(self) -> DataFrame:
        part = F.when(F.col("p_size") % 3 == 0, "B").otherwise("A")
        number = (F.floor(F.col("p_partkey") / 25) + 1).cast("string")
        return (
            self.read("part")
            .filter(F.col("p_partkey") % 9 != 0)
            .select(
                F.col("p_partkey").alias("question_id"),
                F.concat_ws("/", (F.col("p_partkey") % 25).cast("string"), part, F.concat(number, F.lit(".png"))).alias(
                    "object_key"
                ),
                F.sha2(F.concat("p_name", "p_brand"), 256).alias("content_hash"),
                F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("f"), F.col("p_partkey").cast("string"))).alias(
                    "telegram_file_id"
                ),
            )
        )

    @cached_property
    def sessions(self) -> DataFrame:
        started = F.col("o_orderdate").cast("timestamp")
        return self.read("orders").select(
            F.col("o_orderkey").alias("session_id"),
            F.col("o_custkey").alias("student_telegram_id"),
            (F.col("o_orderkey") % 25).alias("option_id"),
            started.alias("started_at"),
            F.when(F.col("o_orderstatus") != "O", started + F.expr("INTERVAL 1 HOUR")).alias("completed_at"),
        )

    @cached_property
    def replies(self) -> DataFrame:
        reply = F.when(
            F.col("l_returnflag") == "R",
            F.concat(F.lit(" Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string"), F.lit(" ")),
        ).otherwise((F.col("l_suppkey") % 5 + 1).cast("string"))
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("session_id"),
            F.col("l_partkey").alias("question_id"),
            reply.alias("student_answer"),
            F.col("l_quantity").alias("time_spent_seconds"),
            F.col("l_shipdate").cast("timestamp").alias("answered_at"),
            F.col("l_linenumber").alias("line"),
            F.col("l_suppkey").alias("supplier"),
            F.col("l_extendedprice").alias("price"),
        )

    @cached_property
    def topics(self) -> DataFrame:
        return self._topic_rows.select("topic_id", "subject_id", "name").distinct()

    @cached_property
    def _topic_rows(self) -> DataFrame:
        # The option's book is its region, and a nation's region is its key modulo 5.
        subject = F.col("p_partkey") % 25 % 5
        return self.read("part").select(
            F.col("p_partkey").alias("question_id"),
            subject.alias("subject_id"),
            F.col("p_type").alias("name"),
            exam.seeded_number("topic", subject, F.col("p_type")).alias("topic_id"),
        )

    @cached_property
    def question_topics(self) -> DataFrame:
        return self._topic_rows.filter(F.col("question_id") % 3 != 0).select("question_id", "topic_id")

    @cached_property
    def students(self) -> DataFrame:
        status = (
            F.when(F.col("c_acctbal") < 0, "rejected").when(F.col("c_acctbal") < 3000, "pending").otherwise("approved")
        )
        return self.read("customer").select(
            F.col("c_custkey").alias("telegram_id"), F.col("c_name").alias("telegram_name"), status.alias("status")
        )

    @cached_property
    def events(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").try_cast("int")
        return self.read("events").select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", k.alias("k")
        )

    @cached_property
    def updates(self) -> DataFrame:
        kind = F.when(F.col("event_type") == "view", "show").when(F.col("event_type") == "click", "reply")
        part = F.when(F.col("k") % 3 == 0, "B").otherwise("A")
        return self.events.select(
            F.col("user_id").alias("chat"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"), part.alias("part")
        ).filter(F.col("kind").isNotNull())

    @cached_property
    def regions(self) -> DataFrame:
        label = (
            F.when(F.col("event_type") == "signup", "option")
            .when(F.col("event_type") == "error", "part")
            .when((F.col("event_type") == "purchase") & (F.col("k") % 17 == 0), "figure")
            .otherwise("question")
        )
        return self.events.select(
            F.col("user_id").alias("book"),
            F.date_format("ts", "yyyy-MM-dd").alias("page"),
            F.col("event_id").alias("ord"),
            label.alias("label"),
            F.when(label == "option", F.col("k") % 3 + 1).alias("reading_option"),
            F.when((label == "part") & (F.col("k") % 13 != 0), F.when(F.col("k") % 2 == 0, "A").otherwise("B")).alias(
                "reading_part"
            ),
            F.coalesce((label == "question") & (F.col("k") % 10 == 0), F.lit(False)).alias("joins_next"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        kind = (
            F.when(F.col("event_type") == "signup", "request")
            .when(F.col("event_type") == "purchase", "approve")
            .when(F.col("event_type") == "error", "reject")
            .otherwise("contact")
        )
        name = F.concat(F.lit("n"), F.col("k").cast("string"))
        return self.events.select(
            F.col("user_id").alias("telegram_id"),
            "ts",
            F.col("event_id").alias("seq"),
            kind.alias("kind"),
            name.alias("name"),
            F.when(F.col("k") % 4 != 0, F.concat(F.lit("u"), F.col("k").cast("string"))).alias("username"),
            F.col("k").cast("long").alias("admin_id"),
        )


# The same views for the oracle.
VIEW_SQL = {
    "books": """SELECT r_regionkey::BIGINT AS book_id, r_regionkey::BIGINT AS subject_id, r_name AS subject_name,
        2020 + r_regionkey AS year_value FROM region""",
    "options": """SELECT n_nationkey::BIGINT AS option_id, n_regionkey::BIGINT AS book_id,
        (n_nationkey // 5) * 2 + 2 AS option_number,
        CASE WHEN 2020 + n_regionkey >= 2023 AND (n_nationkey // 5) * 2 + 2 <= 5 THEN 'CE' ELSE 'CT' END AS exam_type
        FROM nation""",
    "questions": """SELECT p_partkey AS question_id, p_partkey % 25 AS option_id,
        CASE WHEN p_size % 3 = 0 THEN 'B' ELSE 'A' END AS part, (p_partkey // 25 + 1)::INT AS question_number,
        CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_size % 3 = 0 THEN p_brand || ' / ' || p_type
             ELSE (p_size % 5 + 1)::VARCHAR END AS answer FROM part""",
    "images": """SELECT p_partkey AS question_id,
        (p_partkey % 25)::VARCHAR || '/' || CASE WHEN p_size % 3 = 0 THEN 'B' ELSE 'A' END || '/'
          || (p_partkey // 25 + 1)::VARCHAR || '.png' AS object_key,
        sha256(p_name || p_brand) AS content_hash,
        CASE WHEN p_partkey % 4 <> 0 THEN 'f' || p_partkey::VARCHAR END AS telegram_file_id
        FROM part WHERE p_partkey % 9 <> 0""",
    "sessions": """SELECT o_orderkey AS session_id, o_custkey AS student_telegram_id, o_orderkey % 25 AS option_id,
        o_orderdate AS started_at,
        CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 HOUR END AS completed_at FROM orders""",
    "replies": """SELECT l_orderkey AS session_id, l_partkey AS question_id,
        CASE WHEN l_returnflag = 'R' THEN ' Brand#' || (l_suppkey % 25 + 1)::VARCHAR || ' '
             ELSE (l_suppkey % 5 + 1)::VARCHAR END AS student_answer,
        l_quantity AS time_spent_seconds, l_shipdate AS answered_at, l_linenumber AS line, l_suppkey AS supplier,
        l_extendedprice AS price FROM lineitem""",
    "topic_rows": """SELECT p_partkey AS question_id, p_partkey % 25 % 5 AS subject_id, p_type AS name,
        ('0x' || substr(md5('topic|' || (p_partkey % 25 % 5)::VARCHAR || '|' || p_type), 1, 15))::BIGINT AS topic_id
        FROM part""",
    "topics": "SELECT DISTINCT topic_id, subject_id, name FROM topic_rows",
    "question_topics": "SELECT question_id, topic_id FROM topic_rows WHERE question_id % 3 <> 0",
    "students": """SELECT c_custkey AS telegram_id, c_name AS telegram_name,
        CASE WHEN c_acctbal < 0 THEN 'rejected' WHEN c_acctbal < 3000 THEN 'pending' ELSE 'approved' END AS status
        FROM customer""",
    "ev": """SELECT event_id, ts, user_id, event_type, value, json_extract_string(props, '$.k')::INT AS k FROM events""",
    "updates": """SELECT user_id AS chat, ts, event_id AS seq,
        CASE event_type WHEN 'view' THEN 'show' ELSE 'reply' END AS kind,
        CASE WHEN k % 3 = 0 THEN 'B' ELSE 'A' END AS part FROM ev WHERE event_type IN ('view', 'click')""",
    "regions": """SELECT user_id AS book, strftime(ts, '%Y-%m-%d') AS page, event_id AS ord, label,
        CASE WHEN label = 'option' THEN k % 3 + 1 END AS reading_option,
        CASE WHEN label = 'part' AND k % 13 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'A' ELSE 'B' END END AS reading_part,
        coalesce(label = 'question' AND k % 10 = 0, false) AS joins_next
        FROM (SELECT *, CASE WHEN event_type = 'signup' THEN 'option' WHEN event_type = 'error' THEN 'part'
                             WHEN event_type = 'purchase' AND k % 17 = 0 THEN 'figure' ELSE 'question' END AS label
              FROM ev)""",
    "requests": """SELECT user_id AS telegram_id, ts, event_id AS seq,
        CASE event_type WHEN 'signup' THEN 'request' WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject'
             ELSE 'contact' END AS kind, 'n' || k::VARCHAR AS name,
        CASE WHEN k % 4 <> 0 THEN 'u' || k::VARCHAR END AS username, k::BIGINT AS admin_id FROM ev""",
}

_NEEDS = {
    "topics": ["topic_rows"],
    "question_topics": ["topic_rows"],
    "updates": ["ev"],
    "regions": ["ev"],
    "requests": ["ev"],
}


def with_views(views: str, body: str, recursive: bool = False) -> str:
    """*body* under a WITH clause defining the named *views* (space separated).

    *body* may itself start with further ``name AS (...)`` definitions, ended by its final SELECT.
    """
    wanted: list[str] = []
    for view in views.split():
        for name in [*_NEEDS.get(view, []), view]:
            if name not in wanted:
                wanted.append(name)
    ctes = ",\n".join(f"{name} AS ({VIEW_SQL[name]})" for name in wanted)
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    joiner = "\n" if body.upper().startswith("SELECT") else ",\n"
    if not ctes:
        return (head if joiner == ",\n" else "") + body
    return head + ctes + joiner + body
