"""Stored rules over tables with seeded faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import quality
from paperloom.workload.views import Tables, with_views


def _tables(spark, folder):
    """The domain tables with faults: odd numbers, odd keys, repeated and dangling rows."""
    t = Tables(spark, folder)
    i = F.col("question_id")
    questions = t.questions.withColumns(
        {
            "part": F.when(i % 101 == 5, "C").otherwise(F.col("part")),
            "question_number": F.when(i % 103 == 7, 0).otherwise(F.col("question_number")),
            "answer": F.when(i % 50 == 9, "0").when(i % 50 == 19, "7x").otherwise(F.col("answer")),
            "option_id": F.when(i % 107 == 3, 99).otherwise(F.col("option_id")),
        }
    )
    c = F.col("telegram_id")
    handled = F.when((F.col("status") != "pending") & (c % 17 != 1) | (c % 19 == 1), F.timestamp_seconds(c))
    students = t.students.withColumns(
        {
            "handled_at": handled,
            "full_name": F.when(c % 13 != 2, F.col("telegram_name")),
            "status": F.when(c % 23 == 4, "unknown").otherwise(F.col("status")),
            "handled_by": F.when(c % 29 == 6, c * 100000 + 1),
        }
    )
    sessions = t.sessions.withColumn("completed_at", F.when(F.col("session_id") % 31 == 8, F.col("started_at") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("completed_at")))
    answers = t.replies.select("session_id", "question_id", (F.col("time_spent_seconds") - 2).alias("time_spent_seconds"))
    options = t.options.withColumn("option_number", F.when(F.col("option_id") == 24, 11).otherwise(F.col("option_number")))
    return {
        "subjects": t.subjects,
        "books": t.books,
        "options": options,
        "questions": questions,
        "images": t.images,
        "students": students,
        "test_sessions": sessions.filter("session_id % 37 <> 9"),
        "session_answers": answers,
    }


def violations(spark, folder):
    return quality.violations(_tables(spark, folder))


def violation_counts(spark, folder):
    return quality.counted_violations(_tables(spark, folder))


QUERIES = {f.__name__: f for f in (violations, violation_counts)}

_FAULTY = """fq AS (SELECT question_id, CASE WHEN question_id % 107 = 3 THEN 99 ELSE option_id END AS option_id,
    CASE WHEN question_id % 101 = 5 THEN 'C' ELSE part END AS part, CASE WHEN question_id % 103 = 7 THEN 0 ELSE question_number END AS question_number,
    CASE WHEN question_id % 50 = 9 THEN '0' WHEN question_id % 50 = 19 THEN '7x' ELSE answer END AS answer FROM questions),
  fs AS (SELECT telegram_id AS id, CASE WHEN telegram_id % 23 = 4 THEN 'unknown' ELSE status END AS status,
    (status <> 'pending' AND telegram_id % 17 <> 1) OR telegram_id % 19 = 1 AS handled, telegram_id % 13 <> 2 AS named,
    CASE WHEN telegram_id % 29 = 6 THEN telegram_id * 100000 + 1 END AS handled_by FROM students),
  ft AS (SELECT * REPLACE (CASE WHEN session_id % 31 = 8 THEN started_at - INTERVAL 1 DAY ELSE completed_at END AS completed_at) FROM sessions
    WHERE session_id % 37 <> 9),
  fo AS (SELECT * REPLACE (CASE WHEN option_id = 24 THEN 11 ELSE option_number END AS option_number) FROM options),
  fa AS (SELECT session_id, question_id, session_id::VARCHAR || '|' || question_id::VARCHAR AS key, time_spent_seconds - 2 AS spent FROM replies),
  found AS (
    SELECT 'option number range' AS rule, 'options' AS "table", option_id::VARCHAR AS key FROM fo WHERE option_number NOT BETWEEN 1 AND 10
    UNION ALL SELECT 'part', 'questions', question_id::VARCHAR FROM fq WHERE part NOT IN ('A', 'B')
    UNION ALL SELECT 'question number', 'questions', question_id::VARCHAR FROM fq WHERE question_number <= 0
    UNION ALL SELECT 'part A key', 'questions', question_id::VARCHAR FROM fq WHERE part = 'A' AND NOT regexp_full_match(answer, '[1-9][0-9]*')
    UNION ALL SELECT 'status', 'students', id::VARCHAR FROM fs WHERE status NOT IN ('pending', 'approved', 'rejected')
    UNION ALL SELECT 'decision recorded', 'students', id::VARCHAR FROM fs WHERE (status = 'pending') = handled
    UNION ALL SELECT 'decision after application', 'students', id::VARCHAR FROM fs WHERE status <> 'pending' AND NOT named
    UNION ALL SELECT 'completed after started', 'test_sessions', session_id::VARCHAR FROM ft WHERE completed_at < started_at
    UNION ALL SELECT 'time spent', 'session_answers', key FROM fa WHERE spent < 0
    UNION ALL SELECT 'unique option_id, part, question_number', 'questions', concat_ws('|', option_id, part, question_number)
      FROM fq GROUP BY option_id, part, question_number HAVING count(*) > 1
    UNION ALL SELECT 'unique session_id, question_id', 'session_answers', key FROM fa GROUP BY key HAVING count(*) > 1
    UNION ALL SELECT 'unique object_key', 'images', object_key FROM images GROUP BY object_key HAVING count(*) > 1
    UNION ALL SELECT 'unique book_id, option_number', 'options', concat_ws('|', book_id, option_number) FROM fo GROUP BY book_id, option_number HAVING count(*) > 1
    UNION ALL SELECT 'option_id refers to options', 'questions', question_id::VARCHAR FROM fq WHERE option_id NOT IN (SELECT option_id FROM fo)
    UNION ALL SELECT 'handled_by refers to students', 'students', id::VARCHAR FROM fs WHERE handled_by NOT IN (SELECT id FROM fs)
    UNION ALL SELECT 'session_id refers to test_sessions', 'session_answers', key FROM fa WHERE session_id NOT IN (SELECT session_id FROM ft)
    UNION ALL SELECT 'question_id refers to questions', 'session_answers', key FROM fa WHERE question_id NOT IN (SELECT question_id FROM fq)
    UNION ALL SELECT 'student_telegram_id refers to students', 'test_sessions', session_id::VARCHAR FROM ft WHERE student_telegram_id NOT IN (SELECT id FROM fs))"""

SQL = {
    "violations": with_views("questions students sessions options replies images", f"{_FAULTY} SELECT * FROM found"),
    "violation_counts": with_views(
        "questions students sessions options replies images", f'{_FAULTY} SELECT "table", rule, count(*) AS violations FROM found GROUP BY 1, 2'
    ),
}
