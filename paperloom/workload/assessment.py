"""Sessions, answers, topics and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import exam
from paperloom.operators import assess, draws
from paperloom.workload.views import Tables, with_views

ORDER = ["answered_at", "line", "supplier", "price", "student_answer", "time_spent_seconds"]


def scored(t: Tables):
    return assess.score_answers(assess.first_answers(t.replies, ORDER), t.questions)


def session_results(spark, folder):
    t = Tables(spark, folder)
    return assess.session_results(t.sessions, scored(t), t.options)


def score_by_part(spark, folder):
    return assess.score_by_part(scored(Tables(spark, folder)))


def scored_answers(spark, folder):
    s = scored(Tables(spark, folder))
    return s.select(
        "session_id",
        "question_id",
        "student_answer",
        "correct_answer",
        "is_correct",
        "reject_reason",
        "time_spent_seconds",
        F.unix_micros("answered_at").alias("answered_us"),
    )


def wrong_answers(spark, folder):
    return assess.in_review_order(assess.wrong_answers(scored(Tables(spark, folder))))


def session_identity(spark, folder):
    t = Tables(spark, folder)
    return assess.session_identity(t.sessions, t.options, t.books, t.subjects)


def session_outcomes(spark, folder):
    t = Tables(spark, folder)
    s = scored(t)
    results = assess.session_results(t.sessions, s, t.options)
    identity = assess.session_identity(t.sessions, t.options, t.books, t.subjects)
    return assess.session_outcomes(results, assess.wrong_answers(s), identity)


def question_with_image(spark, folder):
    t = Tables(spark, folder)
    return assess.questions_with_image(t.questions, t.images)


def question_with_origin(spark, folder):
    t = Tables(spark, folder)
    return assess.questions_with_origin(t.questions, t.images, t.options, t.books)


def playlist(spark, folder):
    t = Tables(spark, folder)
    return assess.playlist(t.questions).select("option_id", "position", "part", "question_number", "question_id")


def next_questions(spark, folder):
    """Where every session stands: its distinct answers, and what its option shows next."""
    t = Tables(spark, folder)
    reached = (
        t.replies.groupBy("session_id").agg(F.count_distinct("question_id").alias("position"))
        .join(t.sessions.select("session_id", "option_id"), "session_id")
    )
    return assess.next_question(assess.playlist(t.questions), reached)


def topics_with_questions(spark, folder):
    t = Tables(spark, folder)
    return assess.topics_with_questions(t.topics, t.question_topics)


def topic_candidates(spark, folder):
    t = Tables(spark, folder)
    return assess.topic_candidates(t.topics, t.question_topics)


def _origin(t: Tables):
    where = t.options.join(t.books.select("book_id", "subject_id"), "book_id")
    return t.questions.select("question_id", "option_id", "part").join(
        where.select("option_id", "subject_id", "exam_type"), "option_id"
    )


def random_question(spark, folder):
    return draws.draw_one(_origin(Tables(spark, folder)), ["subject_id", "part", "exam_type"], "round")


def random_topic_question(spark, folder):
    t = Tables(spark, folder)
    return draws.draw_one(assess.topic_candidates(t.topics, t.question_topics), ["subject_id", "name"], "topic-round")


def kth_question(spark, folder):
    return draws.kth_of_group(_origin(Tables(spark, folder)), ["subject_id", "part"], "kth")


def round_choice(spark, folder):
    """A wish per student: some name a topic, some a part and type, some nothing."""
    t = Tables(spark, folder)
    key = F.col("telegram_id")
    wishes = t.students.select(
        "telegram_id",
        (key % 5).alias("subject_id"),
        F.when(key % 3 == 0, F.lit("PROMO")).alias("topic_name"),
        F.when(key % 3 == 1, F.when(key % 2 == 0, "A").otherwise("B")).alias("random_part"),
        F.when(key % 4 == 1, "CT").alias("exam_type"),
    )
    origin = _origin(t)
    typed = draws.draw_one(origin, ["subject_id", "part", "exam_type"], "round")
    either = draws.draw_one(origin, ["subject_id", "part"], "round").withColumn("exam_type", F.lit(None).cast("string"))
    topical = draws.draw_one(assess.topic_candidates(t.topics, t.question_topics), ["subject_id", "name"], "topic-round")
    return draws.choose_for_round(wishes, topical, typed.unionByName(either))


def immediate_verdicts(spark, folder):
    t = Tables(spark, folder)
    shown = t.replies.select("session_id", "question_id", "line", "student_answer")
    return assess.immediate_verdicts(shown, t.questions).select(
        "session_id", "question_id", "line", "student_answer", "is_correct", "key_shown"
    )


def on_screen(t: Tables):
    return assess.question_on_screen(t.updates)


def reply_claims(spark, folder):
    claims = assess.reply_claims(on_screen(Tables(spark, folder)))
    return claims.select("chat", "seq", "part", "shown_seq", "shown_part", "claimed")


def time_on_question(spark, folder):
    claims = assess.reply_claims(on_screen(Tables(spark, folder))).filter("claimed")
    spent = assess.time_on_question(F.col("ts"), F.col("shown_ts"))
    return claims.select("chat", "seq", F.round(spent, 3).alias("seconds"))


def reply_on_screen(spark, folder):
    return on_screen(Tables(spark, folder)).select("chat", "seq", "kind", "island", "shown_seq", "shown_part")


def answer_insert(spark, folder):
    """Recorded answers are the even lines; the odd lines arrive later."""
    t = Tables(spark, folder)
    existing = assess.first_answers(t.replies.filter(F.col("line") % 2 == 0), ORDER)
    merged = assess.recorded_answers(existing, t.replies.filter(F.col("line") % 2 == 1), ORDER)
    return merged.select("session_id", "question_id", "line", "supplier", "student_answer")


def session_lifecycle(spark, folder):
    t = Tables(spark, folder)
    start = t.sessions.select("session_id", F.lit("start").alias("kind"), F.col("started_at").alias("ts"))
    end = t.sessions.select("session_id", F.lit("complete").alias("kind"), F.col("completed_at").alias("ts"))
    table = assess.session_table(start.unionByName(end))
    return table.select(
        "session_id",
        F.unix_micros("started_at").alias("started_us"),
        F.unix_micros("completed_at").alias("completed_us"),
    )


def cached_file_ids(spark, folder):
    """A cache write per reply; a question's image changed on its newest third of days."""
    t = Tables(spark, folder)
    cached = t.replies.select(
        "question_id", F.concat(F.lit("f"), F.col("session_id").cast("string")).alias("file_id"), F.col("answered_at").alias("ts")
    )
    changed = F.timestamp_seconds(F.lit(883612800) + F.pmod(F.col("question_id"), F.lit(1700)) * 86400)
    images = t.images.select("question_id", changed.alias("changed_at"))
    return assess.cached_file_ids(cached, images)


def subject_menu(spark, folder):
    """Every document source as a subject."""
    source = F.col("source")
    subjects = Tables(spark, folder).read("documents").select(exam.seeded_number("subject", source).alias("subject_id"), source.alias("name"))
    return assess.subject_menu(subjects.distinct())


def year_menu(spark, folder):
    year = (F.col("doc_id") % 60 + 1970).alias("year_value")
    books = Tables(spark, folder).read("documents").select(exam.seeded_number("subject", F.col("source")).alias("subject_id"), year)
    return assess.year_menu(books.distinct())


def option_menu(spark, folder):
    """The CE options of a book per hundred parts."""
    book, number = F.floor(F.col("p_partkey") / 100), (F.col("p_partkey") % 10 + 1).cast("int")
    options = Tables(spark, folder).read("part").select(
        book.alias("book_id"), number.alias("option_number"), exam.exam_type(book % 5 + 2021, number).alias("exam_type")
    )
    return assess.option_menu(options.distinct(), "CE")


QUERIES = {
    f.__name__: f
    for f in (
        session_results,
        score_by_part,
        scored_answers,
        wrong_answers,
        session_identity,
        session_outcomes,
        question_with_image,
        question_with_origin,
        playlist,
        next_questions,
        topics_with_questions,
        topic_candidates,
        random_question,
        random_topic_question,
        kth_question,
        round_choice,
        immediate_verdicts,
        reply_on_screen,
        reply_claims,
        time_on_question,
        answer_insert,
        session_lifecycle,
        cached_file_ids,
        subject_menu,
        year_menu,
        option_menu,
    )
}

_FIRST = """first_reply AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id, question_id
      ORDER BY answered_at, line, supplier, price, student_answer, time_spent_seconds) AS rn FROM replies) WHERE rn = 1)"""
_VERDICT = """coalesce(CASE WHEN q.part = 'A' THEN try_cast(trim(r.student_answer) AS BIGINT) = try_cast(q.answer AS BIGINT)
    ELSE list_contains(list_filter(list_transform(string_split(q.answer, '/'), lambda x: trim(x)), lambda x: x <> ''),
                       trim(r.student_answer)) END, false)"""
SCORED_SQL = f"""{_FIRST}, scored AS (
  SELECT r.session_id, r.question_id, q.part, q.question_number, trim(r.student_answer) AS student_answer,
         q.answer AS correct_answer, {_VERDICT} AS is_correct,
         CASE WHEN q.part = 'A' AND q.answer IS NOT NULL AND try_cast(trim(r.student_answer) AS BIGINT) IS NULL
              THEN 'not an integer' END AS reject_reason,
         r.time_spent_seconds, r.answered_at
  FROM first_reply r JOIN questions q USING (question_id))"""
_RESULTS = """results AS (
  SELECT s.session_id, count(*) FILTER (a.part = 'A' AND a.is_correct) AS part_a_correct,
         count(*) FILTER (a.part = 'B' AND a.is_correct) AS part_b_correct,
         count(*) FILTER (a.is_correct) AS total_correct, count(a.question_id) AS max_score,
         any_value(epoch_us(s.completed_at) - epoch_us(s.started_at)) / 1e6 AS time_seconds,
         any_value(o.exam_type) AS exam_type
  FROM sessions s LEFT JOIN scored a USING (session_id) LEFT JOIN options o USING (option_id) GROUP BY s.session_id)"""
_IDENTITY = """identity AS (
  SELECT s.session_id, s.student_telegram_id, b.subject_name AS subject, b.year_value, o.option_number, o.exam_type
  FROM sessions s JOIN options o USING (option_id) JOIN books b USING (book_id))"""
_ORIGIN = """origin AS (
  SELECT q.question_id, q.part, b.subject_id, o.exam_type
  FROM questions q JOIN options o USING (option_id) JOIN books b USING (book_id))"""
_PLAYLIST = """listed AS (SELECT option_id, row_number() OVER (PARTITION BY option_id
    ORDER BY part, question_number, question_id) AS position, part, question_number, question_id FROM questions)"""
_SCREEN = """screen AS (
  SELECT chat, seq, kind, part, ts,
    sum((kind = 'show')::INT) OVER w AS island,
    last_value(CASE WHEN kind = 'show' THEN seq END IGNORE NULLS) OVER w AS shown_seq,
    last_value(CASE WHEN kind = 'show' THEN part END IGNORE NULLS) OVER w AS shown_part,
    last_value(CASE WHEN kind = 'show' THEN ts END IGNORE NULLS) OVER w AS shown_ts
  FROM updates WINDOW w AS (PARTITION BY chat ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_CLAIMS = f"""{_SCREEN}, claims AS (
  SELECT *, coalesce(part = shown_part AND row_number() OVER (
      PARTITION BY chat, shown_seq, part = shown_part ORDER BY ts, seq) = 1, false) AS claimed
  FROM screen WHERE kind = 'reply')"""


def _draw(source: str, keys: str, seed: str) -> str:
    return f"""SELECT {keys}, question_id FROM (
      SELECT {keys}, question_id, row_number() OVER (PARTITION BY {keys}
        ORDER BY md5('{seed}|' || question_id::VARCHAR), question_id) AS rn FROM {source}) WHERE rn = 1"""


_TOPICAL = "candidates AS (SELECT t.topic_id, t.subject_id, t.name, m.question_id FROM topics t JOIN question_topics m USING (topic_id))"

SQL = {
    "session_results": with_views("questions sessions replies options", f"{SCORED_SQL}, {_RESULTS} SELECT * FROM results"),
    "score_by_part": with_views(
        "questions replies",
        f"{SCORED_SQL} SELECT session_id, part, count(*) FILTER (is_correct) AS correct, count(*) AS total FROM scored GROUP BY 1, 2",
    ),
    "scored_answers": with_views(
        "questions replies",
        f"""{SCORED_SQL} SELECT session_id, question_id, student_answer, correct_answer, is_correct, reject_reason,
            time_spent_seconds, epoch_us(answered_at) AS answered_us FROM scored""",
    ),
    "wrong_answers": with_views(
        "questions replies",
        f"""{SCORED_SQL} SELECT session_id, part, question_number, student_answer, correct_answer FROM scored
            WHERE NOT is_correct ORDER BY 1, 2, 3""",
    ),
    "session_identity": with_views("sessions options books", f"{_IDENTITY} SELECT * FROM identity"),
    "session_outcomes": with_views(
        "questions sessions replies options books",
        f"""{SCORED_SQL}, {_RESULTS}, {_IDENTITY}
            SELECT r.*, i.student_telegram_id, i.subject, i.year_value, i.option_number,
                   m.part, m.question_number, m.student_answer, m.correct_answer
            FROM results r JOIN identity i USING (session_id)
            LEFT JOIN (SELECT * FROM scored WHERE NOT is_correct) m USING (session_id)""",
    ),
    "question_with_image": with_views(
        "questions images",
        "SELECT q.*, i.object_key, i.telegram_file_id FROM questions q LEFT JOIN images i USING (question_id)",
    ),
    "question_with_origin": with_views(
        "questions images options books",
        """SELECT q.*, i.object_key, i.telegram_file_id, o.book_id, o.option_number, o.exam_type, b.subject_id, b.year_value
           FROM questions q JOIN options o USING (option_id) JOIN books b USING (book_id)
           LEFT JOIN images i USING (question_id)""",
    ),
    "playlist": with_views("questions", f"{_PLAYLIST} SELECT * FROM listed"),
    "next_questions": with_views(
        "questions replies sessions",
        f"""{_PLAYLIST}, reached AS (SELECT session_id, count(DISTINCT question_id) AS position FROM replies GROUP BY 1)
            SELECT r.session_id, s.option_id, r.position, l.question_id AS next_id, l.question_id IS NULL AS finished
            FROM reached r JOIN sessions s USING (session_id)
            LEFT JOIN listed l ON l.option_id = s.option_id AND l.position = r.position + 1""",
    ),
    "topics_with_questions": with_views(
        "topics question_topics",
        "SELECT * FROM topics t WHERE EXISTS (SELECT 1 FROM question_topics m WHERE m.topic_id = t.topic_id)",
    ),
    "topic_candidates": with_views("topics question_topics", f"{_TOPICAL} SELECT * FROM candidates"),
    "random_question": with_views(
        "questions options books", f"{_ORIGIN} {_draw('origin', 'subject_id, part, exam_type', 'round')}"
    ),
    "random_topic_question": with_views(
        "topics question_topics", f"{_TOPICAL} {_draw('candidates', 'subject_id, name', 'topic-round')}"
    ),
    "kth_question": with_views(
        "questions options books",
        f"""{_ORIGIN}, ranked AS (SELECT subject_id, part, question_id,
              row_number() OVER (PARTITION BY subject_id, part ORDER BY question_id) AS k,
              count(*) OVER (PARTITION BY subject_id, part) AS n FROM origin)
            SELECT subject_id, part, n, k, question_id FROM ranked
            WHERE k = 1 + ('0x' || substr(md5('kth|' || subject_id::VARCHAR || '|' || part), 1, 15))::BIGINT % n""",
    ),
    "round_choice": with_views(
        "questions options books topics question_topics students",
        f"""{_ORIGIN}, {_TOPICAL},
            typed AS ({_draw('origin', 'subject_id, part, exam_type', 'round')}),
            either AS ({_draw('origin', 'subject_id, part', 'round')}),
            topical AS ({_draw('candidates', 'subject_id, name', 'topic-round')}),
            wishes AS (SELECT telegram_id, telegram_id % 5 AS subject_id,
              CASE WHEN telegram_id % 3 = 0 THEN 'PROMO' END AS topic_name,
              CASE WHEN telegram_id % 3 = 1 THEN CASE WHEN telegram_id % 2 = 0 THEN 'A' ELSE 'B' END END AS random_part,
              CASE WHEN telegram_id % 4 = 1 THEN 'CT' END AS exam_type FROM students)
            SELECT w.*, CASE WHEN w.topic_name IS NOT NULL THEN t.question_id
                             WHEN w.exam_type IS NOT NULL THEN p.question_id ELSE e.question_id END AS question_id
            FROM wishes w
            LEFT JOIN topical t ON t.subject_id = w.subject_id AND t.name = w.topic_name
            LEFT JOIN typed p ON p.subject_id = w.subject_id AND p.part = w.random_part AND p.exam_type = w.exam_type
            LEFT JOIN either e ON e.subject_id = w.subject_id AND e.part = w.random_part""",
    ),
    "immediate_verdicts": with_views(
        "questions replies",
        f"""SELECT r.session_id, r.question_id, r.line, trim(r.student_answer) AS student_answer, {_VERDICT} AS is_correct,
            coalesce(q.answer, 'неизвестен') AS key_shown FROM replies r JOIN questions q USING (question_id)""",
    ),
    "reply_on_screen": with_views(
        "updates", f"{_SCREEN} SELECT chat, seq, kind, island, shown_seq, shown_part FROM screen"
    ),
    "reply_claims": with_views(
        "updates", f"{_CLAIMS} SELECT chat, seq, part, shown_seq, shown_part, claimed FROM claims"
    ),
    "time_on_question": with_views(
        "updates",
        f"""{_CLAIMS} SELECT chat, seq, round((epoch_us(ts) - epoch_us(shown_ts)) / 1e6, 3) AS seconds FROM claims
            WHERE claimed""",
    ),
    "answer_insert": with_views(
        "replies",
        """ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id, question_id
             ORDER BY line % 2, answered_at, line, supplier, price, student_answer, time_spent_seconds) AS rn FROM replies)
           SELECT session_id, question_id, line, supplier, student_answer FROM ranked WHERE rn = 1""",
    ),
    "session_lifecycle": with_views(
        "sessions",
        "SELECT session_id, epoch_us(started_at) AS started_us, epoch_us(completed_at) AS completed_us FROM sessions",
    ),
    "cached_file_ids": with_views(
        "replies images",
        """latest AS (SELECT question_id, answered_at, file_id FROM (
             SELECT question_id, answered_at, 'f' || session_id::VARCHAR AS file_id, row_number() OVER (
               PARTITION BY question_id ORDER BY answered_at DESC, 'f' || session_id::VARCHAR DESC) AS rn FROM replies)
             WHERE rn = 1)
           SELECT i.question_id, CASE WHEN epoch(l.answered_at) >= 883612800 + (i.question_id % 1700) * 86400
                                      THEN l.file_id END AS telegram_file_id
           FROM images i LEFT JOIN latest l USING (question_id)""",
    ),
    "subject_menu": """SELECT DISTINCT ('0x' || substr(md5('subject|' || source), 1, 15))::BIGINT AS subject_id, source AS name
        FROM documents ORDER BY name""",
    "year_menu": """SELECT DISTINCT ('0x' || substr(md5('subject|' || source), 1, 15))::BIGINT AS subject_id, doc_id % 60 + 1970 AS year_value
        FROM documents ORDER BY 1, 2 DESC""",
    "option_menu": """SELECT DISTINCT p_partkey // 100 AS book_id, p_partkey % 10 + 1 AS option_number, 'CE' AS exam_type FROM part
        WHERE (p_partkey // 100) % 5 + 2021 >= 2023 AND p_partkey % 10 + 1 <= 5 ORDER BY 1, 2""",
}
