"""Upserts, deletes and replays.

These compare two states of a table; each state is a rule over the whole of it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import exam
from paperloom.operators import changes, replay
from paperloom.workload.views import Tables, with_views


def subject_upsert(spark, folder):
    """Subjects are the regions; every document source is offered as one more."""
    t = Tables(spark, folder)
    names = t.read("documents").select(F.col("source").alias("name")).unionByName(t.subjects.select("name"))
    return changes.upsert_subjects(t.subjects, names)


def topic_upsert(spark, folder):
    t = Tables(spark, folder)
    offered = t.read("part").select((F.col("p_partkey") % 5).alias("subject_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("name"))
    return changes.upsert_topics(t.topics, offered)


def book_create(spark, folder):
    t = Tables(spark, folder)
    offered = t.read("documents").select((F.col("doc_id") % 5).alias("subject_id"), (F.col("doc_id") % 8 + 2018).cast("int").alias("year_value"))
    existing = t.books.select("book_id", "subject_id", F.col("year_value").cast("int").alias("year_value"))
    return changes.create_books(existing, offered)


def book_duplicates(spark, folder):
    t = Tables(spark, folder)
    offered = t.read("documents").select("doc_id", (F.col("doc_id") % 5).alias("subject_id"), (F.col("doc_id") % 8 + 2018).alias("year_value"))
    return changes.duplicate_books(t.books, offered)


def _in_turn(earlier, later):
    """Offers in two rounds, the rows of both mixed: the later one counts."""
    return later.withColumn("offer", F.lit(2)).unionByName(earlier.withColumn("offer", F.lit(1))).repartition(3)


def option_upsert(spark, folder):
    t = Tables(spark, folder)
    number = (F.col("p_partkey") % 10 + 1).cast("int")
    offered = t.read("part").select((F.col("p_partkey") % 5).alias("book_id"), number.alias("option_number"), exam.exam_type(F.col("p_partkey") % 5 + 2022, number).alias("exam_type"))
    earlier = offered.withColumn("exam_type", F.lit("CX"))
    return changes.upsert_options(t.options, _in_turn(earlier, offered))


def question_upsert(spark, folder):
    """Every third question is offered again with another answer or none, every seventh is new."""
    t = Tables(spark, folder)
    i = F.col("question_id")
    existing = t.questions.filter(i % 7 != 0)
    offered = t.questions.filter((i % 3 == 0) | (i % 7 == 0)).withColumn("answer", F.when(i % 2 == 0, F.col("answer")))
    earlier = offered.filter(i % 5 == 0).withColumn("answer", F.lit("~"))
    return changes.upsert_questions(existing, _in_turn(earlier, offered))


def image_upsert(spark, folder):
    t = Tables(spark, folder)
    i = F.col("question_id")
    offered = t.images.filter(i % 2 == 0).select(
        "question_id", F.when(i % 8 == 0, F.concat("object_key", F.lit(".webp"))).otherwise(F.col("object_key")).alias("object_key"),
        F.when(i % 6 == 0, F.reverse("content_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
    )
    earlier = offered.filter(i % 4 == 0).withColumn("content_hash", F.lit("~"))
    return changes.upsert_images(t.images.filter(i % 10 != 4), _in_turn(earlier, offered))


def mapping_insert(spark, folder):
    t = Tables(spark, folder)
    return changes.insert_mappings(t.question_topics.filter("question_id % 2 = 0"), t.question_topics.unionByName(t.question_topics))


def _stored(t: Tables):
    answers = t.replies.select("session_id", "question_id").distinct()
    people = t.students.withColumn("handled_by", F.when(F.col("telegram_id") % 10 == 1, F.col("telegram_id") + 1))
    return {
        "subjects": t.subjects,
        "books": t.books,
        "options": t.options,
        "questions": t.questions,
        "images": t.images,
        "topics": t.topics,
        "question_topics": t.question_topics,
        "students": people,
        "test_sessions": t.sessions,
        "session_answers": answers,
    }


def delete_plan(spark, folder):
    """Deleting every rejected student."""
    t = Tables(spark, folder)
    return changes.delete_plan(_stored(t), "students", t.students.filter("status = 'rejected'").select("telegram_id"))


def delete_options_plan(spark, folder):
    """Deleting each option: those just created go, no session having used them; the rest are blocked."""
    t = Tables(spark, folder)
    created = t.options.withColumn("option_id", F.col("option_id") + 25)
    tables = _stored(t) | {"options": t.options.unionByName(created)}
    return changes.delete_plan(tables, "options", tables["options"].select("option_id"))


def deletable_options(spark, folder):
    return changes.deletable(delete_options_plan(spark, folder))


def _years(t: Tables):
    """A year's images for every part: six years of five subjects, some there already; now and then a key no table takes."""
    i = F.col("p_partkey")
    part = F.when(F.col("p_size") % 3 == 0, "B").otherwise("A")
    return t.read("part").select(
        (i % 5).alias("subject_id"),
        (F.floor(i / 5) % 6 + 2018).cast("int").alias("year_value"),
        (F.floor(i / 30) % 10 + 1).cast("int").alias("option"),
        F.when(F.floor(i / 30) % 2 == 0, "CE").otherwise("CT").alias("exam_type"),
        part.alias("part"),
        (F.floor(i / 300) + 1).cast("int").alias("number"),
        F.when(i % 37 == 5, None).when(i % 411 == 17, "0").when(part == "B", F.col("p_type")).otherwise((i % 5 + 1).cast("string")).alias("answer"),
        F.concat(F.lit("y/"), i.cast("string"), F.lit(".png")).alias("object_key"),
        F.md5("p_name").alias("content_hash"),
    )


def year_loads(spark, folder):
    """The questions of all loaded years with the ids and images they have afterwards."""
    t = Tables(spark, folder)
    after = changes.load_years(_years(t), {"books": t.books.drop("subject_name"), "options": t.options, "questions": t.questions, "images": t.images})
    where = after["options"].join(after["books"], "book_id")
    asked = after["questions"].join(where, "option_id").join(after["images"], "question_id", "left")
    return asked.select(
        "subject_id", "year_value", "book_id", "option_id", "option_number", "exam_type", "question_id", "part", "question_number", "answer",
        "object_key", "content_hash", "telegram_file_id",
    )


def _manifest(spark, folder, salt: int):
    i = F.col("doc_id")
    docs = Tables(spark, folder).read("documents").filter(i % (7 + salt) != 0)
    text = F.when(i % (11 + salt) == 0, F.reverse("text")).otherwise(F.col("text"))
    return docs.select(F.concat_ws("/", "source", i.cast("string")).alias("path"), F.md5(text).alias("digest"))


def manifest_diff(spark, folder):
    return replay.manifest_diff(_manifest(spark, folder, 0), _manifest(spark, folder, 2))


def _needed(spark, folder):
    """Crops to be read: one per conversation turn, equal texts being equal crops."""
    turns = Tables(spark, folder).read("conversations")
    return turns.select("conv_id", "turn", F.col("role").alias("kind"), F.md5("text").alias("digest"))


def _recorded(spark, folder):
    rows = Tables(spark, folder).read("conversations").filter("conv_id % 5 <> 1")
    return rows.select(F.col("role").alias("kind"), F.md5("text").alias("digest"), F.length("text").cast("string").alias("value")).distinct()


def recalled_answers(spark, folder):
    return replay.recall(_needed(spark, folder), _recorded(spark, folder))


def missing_recorded(spark, folder):
    return replay.missing_answers(_needed(spark, folder), _recorded(spark, folder))


def shared_answers(spark, folder):
    """Each distinct crop answered once, the answer spread to every turn that shows it."""
    needed = _needed(spark, folder)
    answers = replay.to_answer_once(needed).withColumn("value", F.concat(F.lit("answer to "), F.col("digest")))
    return replay.spread_answers(needed, answers)


QUERIES = {
    f.__name__: f
    for f in (
        subject_upsert,
        topic_upsert,
        book_create,
        book_duplicates,
        option_upsert,
        question_upsert,
        image_upsert,
        mapping_insert,
        delete_plan,
        delete_options_plan,
        deletable_options,
        year_loads,
        manifest_diff,
        recalled_answers,
        missing_recorded,
        shared_answers,
    )
}


def _added(table: str, columns: str, key: str, id_column: str) -> str:
    """Rows of *table* and the offered keys it lacks, numbered on from its highest id."""
    match = " AND ".join(f"e.{k.strip()} = o.{k.strip()}" for k in key.split(","))
    return f"""fresh AS (SELECT DISTINCT {columns} FROM offered o WHERE NOT EXISTS (SELECT 1 FROM {table} e WHERE {match})),
      grown AS (SELECT {id_column}, {columns} FROM {table} UNION ALL
        SELECT (SELECT max({id_column}) FROM {table}) + row_number() OVER (ORDER BY {key}), {columns} FROM fresh)"""


_OPTION_DELETES = """roots AS (SELECT option_id AS root FROM options UNION ALL SELECT option_id + 25 FROM options),
  plan AS (SELECT root, 'options' AS "table", root::VARCHAR AS key, 'delete' AS action FROM roots
    UNION ALL SELECT option_id, 'questions', question_id::VARCHAR, 'delete' FROM questions WHERE option_id IN (SELECT root FROM roots)
    UNION ALL SELECT q.option_id, 'images', i.question_id::VARCHAR, 'delete' FROM images i JOIN questions q USING (question_id)
      WHERE q.option_id IN (SELECT root FROM roots)
    UNION ALL SELECT q.option_id, 'question_topics', m.question_id::VARCHAR || '|' || m.topic_id::VARCHAR, 'delete'
      FROM question_topics m JOIN questions q USING (question_id) WHERE q.option_id IN (SELECT root FROM roots)
    UNION ALL SELECT q.option_id, 'session_answers', r.session_id::VARCHAR || '|' || r.question_id::VARCHAR, 'blocked'
      FROM (SELECT DISTINCT session_id, question_id FROM replies) r JOIN questions q USING (question_id)
    UNION ALL SELECT option_id, 'test_sessions', session_id::VARCHAR, 'blocked' FROM sessions
      WHERE option_id IN (SELECT root FROM roots))"""
_CROPS = """needed AS (SELECT conv_id, turn, role AS kind, md5(text) AS digest FROM conversations),
  recorded AS (SELECT DISTINCT role AS kind, md5(text) AS digest, length(text)::VARCHAR AS value FROM conversations WHERE conv_id % 5 <> 1)"""

SQL = {
    "subject_upsert": with_views(
        "",
        f"""subjects AS (SELECT r_regionkey::BIGINT AS subject_id, r_name AS name FROM region),
            offered AS (SELECT source AS name FROM documents), {_added('subjects', 'name', 'name', 'subject_id')} SELECT * FROM grown""",
    ),
    "topic_upsert": with_views(
        "topics",
        f"""offered AS (SELECT p_partkey % 5 AS subject_id, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END AS name FROM part),
            {_added('topics', 'subject_id, name', 'subject_id, name', 'topic_id')} SELECT * FROM grown""",
    ),
    "book_create": with_views(
        "books",
        f"""offered AS (SELECT doc_id % 5 AS subject_id, doc_id % 8 + 2018 AS year_value FROM documents),
            {_added('books', 'subject_id, year_value', 'subject_id, year_value', 'book_id')} SELECT * FROM grown""",
    ),
    "book_duplicates": with_views(
        "books",
        """SELECT doc_id, doc_id % 5 AS subject_id, doc_id % 8 + 2018 AS year_value FROM documents
           WHERE (doc_id % 5, doc_id % 8 + 2018) IN (SELECT (subject_id, year_value::BIGINT) FROM books)""",
    ),
    "option_upsert": with_views(
        "options",
        f"""offered AS (SELECT DISTINCT p_partkey % 5 AS book_id, p_partkey % 10 + 1 AS option_number,
              CASE WHEN p_partkey % 5 + 2022 >= 2023 AND p_partkey % 10 + 1 <= 5 THEN 'CE' ELSE 'CT' END AS exam_type FROM part),
            {_added('options', 'book_id, option_number, exam_type', 'book_id, option_number', 'option_id')}
            SELECT g.option_id, g.book_id, g.option_number, coalesce(o.exam_type, g.exam_type) AS exam_type
            FROM grown g LEFT JOIN offered o USING (book_id, option_number)""",
    ),
    "question_upsert": with_views(
        "questions",
        f"""kept AS (SELECT * FROM questions WHERE question_id % 7 <> 0),
            offered AS (SELECT option_id, part, question_number, CASE WHEN question_id % 2 = 0 THEN answer END AS answer
              FROM questions WHERE question_id % 3 = 0 OR question_id % 7 = 0),
            {_added('kept', 'option_id, part, question_number, answer', 'option_id, part, question_number', 'question_id')}
            SELECT g.question_id, g.option_id, g.part, g.question_number,
              CASE WHEN o.option_id IS NOT NULL THEN o.answer ELSE g.answer END AS answer
            FROM grown g LEFT JOIN offered o USING (option_id, part, question_number)""",
    ),
    "image_upsert": with_views(
        "images",
        """SELECT question_id,
             CASE WHEN question_id % 8 = 0 THEN object_key || '.webp' ELSE object_key END AS object_key,
             CASE WHEN question_id % 6 = 0 THEN reverse(content_hash) ELSE content_hash END AS content_hash,
             CASE WHEN question_id % 8 <> 0 AND question_id % 6 <> 0 AND question_id % 10 <> 4 THEN telegram_file_id END AS telegram_file_id,
             question_id % 8 = 0 OR question_id % 6 = 0 OR question_id % 10 = 4 AS changed FROM images""",
    ),
    "mapping_insert": with_views("question_topics", "SELECT * FROM question_topics"),
    "delete_plan": with_views(
        "students sessions replies",
        """roots AS (SELECT telegram_id AS root FROM students WHERE status = 'rejected')
           SELECT root, 'students' AS "table", root::VARCHAR AS key, 'delete' AS action FROM roots
           UNION ALL SELECT telegram_id + 1, 'students', telegram_id::VARCHAR, 'set null' FROM students
             WHERE telegram_id % 10 = 1 AND telegram_id + 1 IN (SELECT root FROM roots)
           UNION ALL SELECT student_telegram_id, 'test_sessions', session_id::VARCHAR, 'delete' FROM sessions
             WHERE student_telegram_id IN (SELECT root FROM roots)
           UNION ALL SELECT DISTINCT s.student_telegram_id, 'session_answers', r.session_id::VARCHAR || '|' || r.question_id::VARCHAR, 'delete'
             FROM replies r JOIN sessions s USING (session_id) WHERE s.student_telegram_id IN (SELECT root FROM roots)""",
    ),
    "delete_options_plan": with_views("options questions images question_topics sessions replies", f"{_OPTION_DELETES} SELECT * FROM plan"),
    "deletable_options": with_views(
        "options questions images question_topics sessions replies",
        f"""{_OPTION_DELETES}, told AS (SELECT *, bool_or(action = 'blocked') OVER (PARTITION BY root) AS held FROM plan)
            SELECT * EXCLUDE (held) FROM told WHERE NOT held""",
    ),
    "year_loads": with_views(
        "books options questions images",
        """offered AS (SELECT p_partkey % 5 AS subject_id, (p_partkey // 5) % 6 + 2018 AS year_value, (p_partkey // 30) % 10 + 1 AS option_number,
             CASE WHEN (p_partkey // 30) % 2 = 0 THEN 'CE' ELSE 'CT' END AS exam_type, CASE WHEN p_size % 3 = 0 THEN 'B' ELSE 'A' END AS part,
             p_partkey // 300 + 1 AS question_number, CASE WHEN p_partkey % 37 = 5 THEN NULL WHEN p_partkey % 411 = 17 THEN '0' WHEN p_size % 3 = 0 THEN p_type
               ELSE (p_partkey % 5 + 1)::VARCHAR END AS answer, 'y/' || p_partkey::VARCHAR || '.png' AS object_key, md5(p_name) AS content_hash FROM part),
           bad AS (SELECT DISTINCT subject_id, year_value FROM offered WHERE part = 'A' AND answer = '0'),
           loaded AS (SELECT o.* FROM offered o WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.subject_id = o.subject_id AND b.year_value = o.year_value)),
           all_books AS (SELECT book_id, subject_id, year_value FROM books UNION ALL
             SELECT (SELECT max(book_id) FROM books) + row_number() OVER (ORDER BY subject_id, year_value), subject_id, year_value
             FROM (SELECT DISTINCT subject_id, year_value FROM loaded WHERE (subject_id, year_value) NOT IN (SELECT (subject_id, year_value) FROM books))),
           in_book AS (SELECT l.*, b.book_id FROM loaded l JOIN all_books b USING (subject_id, year_value)),
           typed AS (SELECT DISTINCT book_id, option_number, exam_type FROM in_book),
           all_options AS (SELECT o.option_id, o.book_id, o.option_number, coalesce(t.exam_type, o.exam_type) AS exam_type FROM (
             SELECT option_id, book_id, option_number, exam_type FROM options UNION ALL
             SELECT (SELECT max(option_id) FROM options) + row_number() OVER (ORDER BY book_id, option_number), book_id, option_number, exam_type
             FROM typed WHERE (book_id, option_number) NOT IN (SELECT (book_id, option_number) FROM options)) o LEFT JOIN typed t USING (book_id, option_number)),
           in_option AS (SELECT l.*, o.option_id FROM in_book l JOIN all_options o USING (book_id, option_number)),
           all_questions AS (SELECT q.question_id, q.option_id, q.part, q.question_number, CASE WHEN n.option_id IS NULL THEN q.answer ELSE n.answer END AS answer,
               n.object_key, n.content_hash FROM (
             SELECT question_id, option_id, part, question_number, answer FROM questions UNION ALL
             SELECT (SELECT max(question_id) FROM questions) + row_number() OVER (ORDER BY option_id, part, question_number), option_id, part, question_number, answer
             FROM in_option i WHERE NOT EXISTS (SELECT 1 FROM questions q WHERE q.option_id = i.option_id AND q.part = i.part AND q.question_number = i.question_number)) q
             LEFT JOIN in_option n USING (option_id, part, question_number))
           SELECT b.subject_id, b.year_value, b.book_id, o.option_id, o.option_number, o.exam_type, q.question_id, q.part, q.question_number, q.answer,
             coalesce(q.object_key, i.object_key) AS object_key, coalesce(q.content_hash, i.content_hash) AS content_hash,
             CASE WHEN q.object_key IS NULL THEN i.telegram_file_id END AS telegram_file_id
           FROM all_questions q JOIN all_options o USING (option_id) JOIN all_books b USING (book_id) LEFT JOIN images i ON i.question_id = q.question_id""",
    ),
    "manifest_diff": """
        WITH a AS (SELECT source || '/' || doc_id::VARCHAR AS path, md5(CASE WHEN doc_id % 11 = 0 THEN reverse(text) ELSE text END) AS d FROM documents WHERE doc_id % 7 <> 0),
        b AS (SELECT source || '/' || doc_id::VARCHAR AS path, md5(CASE WHEN doc_id % 13 = 0 THEN reverse(text) ELSE text END) AS d FROM documents WHERE doc_id % 9 <> 0)
        SELECT path, CASE WHEN a.d IS NULL THEN 'added' WHEN b.d IS NULL THEN 'removed' ELSE 'changed' END AS status
        FROM a FULL JOIN b USING (path) WHERE a.d IS DISTINCT FROM b.d""",
    "recalled_answers": f"WITH {_CROPS} SELECT n.*, r.value, r.kind IS NOT NULL AS found FROM needed n LEFT JOIN recorded r USING (kind, digest)",
    "missing_recorded": f"WITH {_CROPS} SELECT DISTINCT kind, digest FROM needed WHERE (kind, digest) NOT IN (SELECT (kind, digest) FROM recorded)",
    "shared_answers": f"WITH {_CROPS} SELECT conv_id, turn, kind, digest, 'answer to ' || digest AS value FROM needed",
}
