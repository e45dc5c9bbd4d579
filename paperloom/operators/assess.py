"""Assessment: scoring answers, session results, mistakes, replies on screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import exam
from paperloom.functions.text import display_answer, integer_text, unicode_trim
from paperloom.plans.ordered import running


def first_answers(replies: DataFrame, order: list[str]) -> DataFrame:
    """The first reply to each (session, question); later ones are ignored.

    A minimum over a struct rather than a row number, so repeats of one pair are combined before the
    shuffle.
    """
    payload = [c for c in replies.columns if c not in ("session_id", "question_id", *order)]
    first = F.min(F.struct(*order, *payload)).alias("first")
    return replies.groupBy("session_id", "question_id").agg(first).select("session_id", "question_id", "first.*")


def score_answers(replies: DataFrame, questions: DataFrame) -> DataFrame:
    """Replies with their question's part, number and key as it stands now, and the verdict.

    Everything that depends on the key alone is worked out on the question side, and everything that
    depends on the reply alone before the join, each once. The rule is :func:`exam.answer_matches`.
    """
    answer = F.col("answer")
    keys = questions.select(
        "question_id",
        "part",
        "question_number",
        answer.alias("correct_answer"),
        F.when(F.col("part") == "A", integer_text(unicode_trim(answer))).alias("_number"),
        F.when(F.col("part") == "B", exam.accepted_spellings(answer)).alias("_spellings"),
    )
    said = replies.withColumn("student_answer", unicode_trim(F.col("student_answer")))
    said = said.withColumn("_said_number", integer_text(F.col("student_answer")))
    is_a = F.col("part") == "A"
    right = F.when(is_a, F.col("_said_number") == F.col("_number")).otherwise(
        F.array_contains("_spellings", F.col("student_answer"))
    )
    unreadable = is_a & F.col("correct_answer").isNotNull() & F.col("_said_number").isNull()
    return (
        said.join(keys, "question_id")
        .withColumn("is_correct", F.coalesce(right, F.lit(False)))
        .withColumn("reject_reason", F.when(unreadable, "not an integer"))
        .drop("_spellings", "_number", "_said_number")
    )


def score_by_part(scored: DataFrame) -> DataFrame:
    """Per session and part: right answers and answers. A part without answers has no row."""
    return scored.groupBy("session_id", "part").agg(
        F.count_if("is_correct").alias("correct"), F.count(F.lit(1)).alias("total")
    )


def session_results(sessions: DataFrame, scored: DataFrame, options: DataFrame | None = None) -> DataFrame:
    """One row per session: score by part, the number recorded, the time taken and the exam type.

    A session without answers scores 0 of 0; an open one has no time.
    """
    right = F.col("is_correct")
    per_session = scored.groupBy("session_id").agg(
        F.count_if((F.col("part") == "A") & right).alias("part_a_correct"),
        F.count_if((F.col("part") == "B") & right).alias("part_b_correct"),
        F.count(F.lit(1)).alias("max_score"),
    )
    zero = F.lit(0).cast("long")
    joined = sessions.join(per_session, "session_id", "left")
    if options is not None:
        joined = joined.join(options.select("option_id", "exam_type"), "option_id", "left")
    seconds = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6
    result = joined.withColumns(
        {
            "part_a_correct": F.coalesce("part_a_correct", zero),
            "part_b_correct": F.coalesce("part_b_correct", zero),
            "max_score": F.coalesce("max_score", zero),
            "time_seconds": seconds,
        }
    ).withColumn("total_correct", F.col("part_a_correct") + F.col("part_b_correct"))
    columns = ["session_id", "part_a_correct", "part_b_correct", "total_correct", "max_score", "time_seconds"]
    return result.select(*columns, *(["exam_type"] if options is not None else []))


def wrong_answers(scored: DataFrame) -> DataFrame:
    """Mistakes with the key they were judged by."""
    return scored.filter(~F.col("is_correct")).select(
        "session_id", "part", "question_number", "student_answer", "correct_answer"
    )


def in_review_order(mistakes: DataFrame) -> DataFrame:
    return mistakes.repartition("session_id").sortWithinPartitions("session_id", "part", "question_number")


def questions_with_image(questions: DataFrame, images: DataFrame) -> DataFrame:
    """Every question with its image, where it has one."""
    return questions.join(images.select("question_id", "object_key", "telegram_file_id"), "question_id", "left")


def questions_with_origin(questions: DataFrame, images: DataFrame, options: DataFrame, books: DataFrame) -> DataFrame:
    """Questions with the year, option and exam type they come from."""
    origin = options.join(books.select("book_id", "subject_id", "year_value"), "book_id")
    return questions_with_image(questions, images).join(origin, "option_id")


def session_identity(sessions: DataFrame, options: DataFrame, books: DataFrame, subjects: DataFrame) -> DataFrame:
    """What each session was a test of."""
    what = options.join(books.select("book_id", "subject_id", "year_value"), "book_id").join(
        subjects.withColumnRenamed("name", "subject"), "subject_id"
    )
    return sessions.join(what, "option_id").select(
        "session_id", "student_telegram_id", "subject", "year_value", "option_number", "exam_type"
    )


def session_outcomes(results: DataFrame, mistakes: DataFrame, identity: DataFrame) -> DataFrame:
    """Result, identity and mistakes of each session, a row per mistake.

    Long rather than nested: a session's mistakes never have to fit one row. A session without
    mistakes keeps one row with empty mistake columns; its counts already say that it has none, so the
    mistakes are the streamed side of an inner join, which splits a session holding too many of them.
    """
    known = results.join(identity.drop("exam_type"), "session_id")
    with_mistakes = mistakes.join(known, "session_id")
    clean = known.filter(F.col("max_score") == F.col("total_correct"))
    return with_mistakes.unionByName(clean, allowMissingColumns=True)


def playlist(questions: DataFrame) -> DataFrame:
    """Each question's place in its option's test: part, then number."""
    return running(questions, ["option_id"], ["part", "question_number", "question_id"], rank="position")


def next_question(listed: DataFrame, at: DataFrame) -> DataFrame:
    """For (option_id, position) reached, the question to show next; none left means finished."""
    upcoming = listed.select("option_id", (F.col("position") - 1).alias("position"), F.col("question_id").alias("next_id"))
    return at.join(upcoming, ["option_id", "position"], "left").withColumn("finished", F.col("next_id").isNull())


def topics_with_questions(topics: DataFrame, mapped: DataFrame) -> DataFrame:
    """Topics at least one question is mapped to."""
    return topics.join(mapped.select("topic_id"), "topic_id", "left_semi")


def topic_candidates(topics: DataFrame, mapped: DataFrame) -> DataFrame:
    return topics.join(mapped, "topic_id")


def question_on_screen(updates: DataFrame) -> DataFrame:
    """Each update with the last question shown in its chat before it (an as-of lookup)."""
    shown = F.col("kind") == "show"
    return running(
        updates,
        ["chat"],
        ["ts", "seq"],
        sums={"island": shown.cast("long")},
        lasts={
            "shown_seq": F.when(shown, F.col("seq")),
            "shown_part": F.when(shown, F.col("part")),
            "shown_ts": F.when(shown, F.col("ts")),
        },
    )


def reply_claims(on_screen: DataFrame) -> DataFrame:
    """Replies with whether each is spent on the question on screen.

    The first reply whose part matches takes the question; others are refused, and one with the wrong
    part does not use the question up. The first is a grouped minimum joined back, so no chat is
    gathered in one task.
    """
    replies = on_screen.filter(F.col("kind") == "reply")
    fits = (F.col("part") == F.col("shown_part")) & (F.col("island") > 0)
    first = (
        replies.filter(fits)
        .groupBy("chat", "shown_seq")
        .agg(F.min(F.struct("ts", "seq")).getField("seq").alias("claimed_by"))
    )
    marked = replies.join(first, ["chat", "shown_seq"], "left")
    return marked.withColumn("claimed", F.coalesce(F.col("claimed_by") == F.col("seq"), F.lit(False))).drop("claimed_by")


def time_on_question(ts: Column, shown_ts: Column) -> Column:
    """Seconds since the question was shown, 0 when no show was recorded."""
    return F.coalesce((F.unix_micros(ts) - F.unix_micros(shown_ts)) / 1e6, F.lit(0.0))


def immediate_verdicts(replies: DataFrame, questions: DataFrame) -> DataFrame:
    """Random-mode feedback: the verdict and the key in display form, nothing recorded."""
    scored = score_answers(replies, questions)
    return scored.withColumn("key_shown", display_answer(F.col("correct_answer")))


def recorded_answers(existing: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Existing rows win over new ones, and the first of several new ones is kept."""
    fresh = first_answers(new, order).join(existing.select("session_id", "question_id"), ["session_id", "question_id"], "left_anti")
    return existing.unionByName(fresh)


def session_table(events: DataFrame) -> DataFrame:
    """Sessions out of their start and complete events: first start, last completion."""
    start = F.col("kind") == "start"
    return events.groupBy("session_id").agg(
        F.min(F.when(start, F.col("ts"))).alias("started_at"),
        F.max(F.when(F.col("kind") == "complete", F.col("ts"))).alias("completed_at"),
    )


def cached_file_ids(cached: DataFrame, images: DataFrame) -> DataFrame:
    """Latest cached file id per question, kept only if cached since the image last changed.

    *cached* holds (question_id, file_id, ts), *images* (question_id, changed_at).
    """
    latest = cached.groupBy("question_id").agg(F.max(F.struct("ts", "file_id")).alias("c"))
    joined = images.select("question_id", "changed_at").join(latest, "question_id", "left")
    valid = F.col("c.ts") >= F.col("changed_at")
    return joined.select("question_id", F.when(valid, F.col("c.file_id")).alias("telegram_file_id"))


def subject_menu(subjects: DataFrame) -> DataFrame:
    return subjects.orderBy("name")


def year_menu(books: DataFrame) -> DataFrame:
    """Years of each subject, newest first."""
    return books.orderBy("subject_id", F.desc("year_value"))


def option_menu(options: DataFrame, kind: str | None = None) -> DataFrame:
    kept = options if kind is None else options.filter(F.col("exam_type") == kind)
    return kept.orderBy("book_id", "option_number")
