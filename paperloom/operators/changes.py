"""Upserts, inserts and deletes over tables kept as immutable snapshots.

Each function returns the table as it is afterwards; the caller writes it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.functions import exam
from paperloom.plans.ordered import running
from paperloom.plans.session import cut_lineage


# Where offers carry this column they are applied in its order.
OFFER = "offer"


def last_offers(new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """One row per key: the values of the last offer made for it.

    Offers stand in the order of the column ``offer``; where there is none, or on a tie, the greatest values count,
    so the outcome never depends on how the rows are partitioned.
    """
    row = F.struct(*values) if values else F.struct(F.lit(1))
    place = F.struct(OFFER, row) if OFFER in new.columns else row
    last = new.groupBy(*key).agg(F.max_by(row, place).alias("_last"))
    return last.select(*key, *[F.col(f"_last.{v}").alias(v) for v in values])


def add_by_key(existing: DataFrame, new: DataFrame, key: list[str], id_column: str) -> DataFrame:
    """*existing* with the rows of *new* whose natural key it lacks; ids go on from the highest.

    New ids follow key order, so the same input gives the same ids however it is partitioned. Of several offers for a
    key the last counts.
    """
    fresh = last_offers(new, key, [c for c in existing.columns if c not in (id_column, *key)])
    fresh = fresh.join(existing.select(*key), key, "left_anti")
    top = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("m")).scalar()
    ranked = running(fresh, [], key, rank="_rank").withColumn(id_column, F.col("_rank") + top)
    return existing.unionByName(ranked.select(*existing.columns))


def upsert_subjects(existing: DataFrame, names: DataFrame) -> DataFrame:
    return add_by_key(existing, names, ["name"], "subject_id")


def upsert_topics(existing: DataFrame, topics: DataFrame) -> DataFrame:
    return add_by_key(existing, topics, ["subject_id", "name"], "topic_id")


def create_books(existing: DataFrame, books: DataFrame) -> DataFrame:
    return add_by_key(existing, books, ["subject_id", "year_value"], "book_id")


def duplicate_books(existing: DataFrame, books: DataFrame) -> DataFrame:
    """Books that cannot be created because their subject and year are there already."""
    return books.join(existing.select("subject_id", "year_value"), ["subject_id", "year_value"], "left_semi")


def _overwrite(existing: DataFrame, new: DataFrame, key: list[str], id_column: str, value: str) -> DataFrame:
    """Upsert where a new row's value replaces the old one, null included."""
    grown = add_by_key(existing, new, key, id_column)
    latest = last_offers(new, key, [value]).select(*key, F.col(value).alias("_value"), F.lit(True).alias("_new"))
    joined = grown.join(latest, key, "left")
    chosen = F.when(F.col("_new").isNotNull(), F.col("_value")).otherwise(F.col(value))
    return joined.withColumn(value, chosen).select(*existing.columns)


def upsert_options(existing: DataFrame, options: DataFrame) -> DataFrame:
    """By (book, number); the exam type is overwritten."""
    return _overwrite(existing, options, ["book_id", "option_number"], "option_id", "exam_type")


def upsert_questions(existing: DataFrame, questions: DataFrame) -> DataFrame:
    """By (option, part, number); the answer is overwritten, also by none."""
    return _overwrite(existing, questions, ["option_id", "part", "question_number"], "question_id", "answer")


def upsert_images(existing: DataFrame, images: DataFrame) -> DataFrame:
    """By question, only where key or content differ; then the cached file id is cleared.

    ``changed`` marks rows written, so untouched partitions need not be.
    """
    new = last_offers(images, ["question_id"], ["object_key", "content_hash"]).select(
        "question_id", F.col("object_key").alias("_key"), F.col("content_hash").alias("_hash"), F.lit(True).alias("_new")
    )
    both = existing.withColumn("_old", F.lit(True)).join(new, "question_id", "full_outer")
    differs = ~F.col("object_key").eqNullSafe(F.col("_key")) | ~F.col("content_hash").eqNullSafe(F.col("_hash"))
    changed = F.col("_new").isNotNull() & (F.col("_old").isNull() | differs)
    return both.select(
        "question_id",
        F.when(changed, F.col("_key")).otherwise(F.col("object_key")).alias("object_key"),
        F.when(changed, F.col("_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(~changed, F.col("telegram_file_id")).alias("telegram_file_id"),
        changed.alias("changed"),
    )


def insert_mappings(existing: DataFrame, mappings: DataFrame) -> DataFrame:
    """Mappings with the new pairs added; a pair already there is left alone."""
    return existing.unionByName(mappings.select(*existing.columns)).dropDuplicates(["question_id", "topic_id"])


def load_year(
    subject: int,
    year: int,
    images: DataFrame,
    tables: dict[str, DataFrame],
) -> dict[str, DataFrame]:
    """One year's load: books, options, questions and images as they stand afterwards.

    *images* holds (option, exam_type, part, number, answer, object_key, content_hash) of that year, and ``offer`` where one
    question comes several times: the last counts.
    """
    spark = images.sparkSession
    book = spark.createDataFrame([(subject, year)], "subject_id long, year_value int")
    books = create_books(tables["books"], book)
    where = books.filter((F.col("subject_id") == subject) & (F.col("year_value") == year)).select("book_id")
    book_id = where.first()["book_id"]
    order = [OFFER] if OFFER in images.columns else []
    wanted = images.select(F.lit(book_id).cast("long").alias("book_id"), F.col("option").alias("option_number"), "exam_type", *order)
    options = upsert_options(tables["options"], wanted)
    ids = options.filter(F.col("book_id") == book_id).select("option_id", F.col("option_number").alias("option"))
    rows = images.join(ids, "option").withColumnRenamed("number", "question_number")
    questions = upsert_questions(tables["questions"], rows.select("option_id", "part", "question_number", "answer", *order))
    keyed = rows.join(questions.select("question_id", "option_id", "part", "question_number"), ["option_id", "part", "question_number"])
    stored = upsert_images(tables["images"], keyed.select("question_id", "object_key", "content_hash", *order))
    return {**tables, "books": books, "options": options, "questions": questions, "images": stored.drop("changed")}


def refused_years(images: DataFrame) -> DataFrame:
    """(subject_id, year_value) of the years that hold a row the stored tables would not take."""
    part_a = (F.col("part") == "A") & F.col("answer").isNotNull()
    allowed = (
        F.col("option").between(1, exam.OPTIONS_PER_BOOK)
        & F.col("exam_type").isin(*exam.EXAM_TYPES)
        & F.col("part").isin(*exam.PARTS)
        & (F.col("number") > 0)
        & (~part_a | F.col("answer").rlike(exam.PART_A_KEY_PATTERN))
    )
    return images.filter(~F.coalesce(allowed, F.lit(False))).select("subject_id", "year_value").distinct()


def load_years(images: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The load of all years at once: books, options, questions and images as they stand afterwards, and the years ``refused``.

    *images* holds (subject_id, year_value, option, exam_type, part, number, answer, object_key, content_hash), and ``offer`` where one
    question comes several times: the last counts. A year is taken whole or not at all. Each level of ids is handed out in one pass
    over all years and written, as the next one refers to it.
    """
    order = [OFFER] if OFFER in images.columns else []
    refused = cut_lineage(refused_years(images))
    year = ["subject_id", "year_value"]
    taken = images.join(refused, year, "left_anti")
    books = cut_lineage(create_books(tables["books"], taken.select(*year).distinct()))
    rows = taken.join(books.select(*year, "book_id"), year).withColumnsRenamed({"option": "option_number", "number": "question_number"})
    options = cut_lineage(upsert_options(tables["options"], rows.select("book_id", "option_number", "exam_type", *order)))
    rows = rows.drop("exam_type").join(options.select("option_id", "book_id", "option_number"), ["book_id", "option_number"])
    key = ["option_id", "part", "question_number"]
    questions = cut_lineage(upsert_questions(tables["questions"], rows.select(*key, "answer", *order)))
    keyed = rows.join(questions.select("question_id", *key), key)
    stored = upsert_images(tables["images"], keyed.select("question_id", "object_key", "content_hash", *order))
    return {**tables, "books": books, "options": options, "questions": questions, "images": stored.drop("changed"), "refused": refused}


def write_years(df: DataFrame, root: str, partition: list[str]) -> None:
    """Replace the partitions *df* holds and no others: a year is swapped whole or not at all."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition).parquet(root)


def delete_plan(tables: dict[str, DataFrame], table: str, ids: DataFrame) -> DataFrame:
    """What deleting rows of *table* would do: (root, table, key, action).

    *ids* holds the roots in its only column. Cascades are followed through every reference; a root
    that a restricting reference is found under is blocked, which shows as ``blocked`` rows naming what
    refers to it. References that are set to null show as ``set null``.

    Rows reached so far stand in one frontier (root, table, key). A level takes the tables all of whose referenced tables have been
    reached, reads each once with all of its references, and joins them to the frontier; what it finds is written and becomes part of
    the frontier. A table is thus read once, the root's own a second time where it refers to itself.
    """
    key = schemas.UNIQUE_KEYS[table][0][0]
    roots = ids.select(F.col(ids.columns[0]).cast("string").alias("key")).distinct()
    held = tables[table].select(F.col(key).cast("string").alias("key"), F.col(key).alias("root"))
    start = held.join(roots, "key", "left_semi").select("root", F.lit(table).alias("table"), "key", F.lit("delete").alias("action"))
    plan = cut_lineage(start.distinct())
    for level in _levels(table, set(tables)):
        every = reduce(DataFrame.unionByName, [_references(tables[child], child, keys) for child, keys in level.items()])
        reached = plan.filter("action = 'delete'").select("root", F.col("table").alias("_parent"), F.col("key").alias("_at"))
        found = every.join(reached, ["_parent", "_at"]).select("root", "table", "key", "action").distinct()
        plan = plan.unionByName(cut_lineage(found))
    return plan


def _levels(table: str, present: set[str]) -> list[dict[str, list]]:
    """Per level the tables to read, each with its references to what deleting rows of *table* reaches.

    A table's level is one beyond the deepest table it refers to. References to the own table are only ever set to null here.
    """
    graph = [k for k in schemas.FOREIGN_KEYS if k[0] in present]
    depth = {table: 0}
    for _ in graph:
        for child, _, parent, _, action in graph:
            if action == "cascade" and parent in depth and child != parent:
                depth[child] = max(depth.get(child, 0), depth[parent] + 1)
    wanted: dict[str, list] = {}
    for reference in graph:
        if reference[2] in depth:
            wanted.setdefault(reference[0], []).append(reference)
    levels: dict[int, dict[str, list]] = {}
    for child, references in wanted.items():
        levels.setdefault(1 + max(depth[r[2]] for r in references), {})[child] = references
    return [levels[k] for k in sorted(levels)]


def _references(rows: DataFrame, child: str, keys: list) -> DataFrame:
    """(table, key, _parent, _at, action): a row per reference of a child row, read in one pass."""
    own = F.concat_ws("|", *[F.col(k).cast("string") for k in schemas.UNIQUE_KEYS[child][0]])
    actions = {"cascade": "delete", "restrict": "blocked", "set null": "set null"}
    each = [
        F.struct(F.lit(parent).alias("_parent"), F.col(column).cast("string").alias("_at"), F.lit(actions[action]).alias("action"))
        for _, column, parent, _, action in keys
    ]
    return rows.select(F.lit(child).alias("table"), own.alias("key"), F.explode(F.array(*each)).alias("_r")).select("table", "key", "_r.*")


def deletable(plan: DataFrame) -> DataFrame:
    """The part of a plan that may be carried out: everything under a root nothing blocks."""
    blocked = plan.filter("action = 'blocked'").select("root").distinct()
    return plan.join(blocked, "root", "left_anti")
