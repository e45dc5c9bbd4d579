"""Streams over several small files: the result is the batch result."""

import datetime as dt

import pytest

from paperloom.operators import people
from paperloom.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
IMAGES = "question_id long, object_key string, content_hash string"
EVENTS = "telegram_id long, ts timestamp, seq long, kind string, name string, username string, admin_id long"


def drop(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_registration_over_three_batches(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    kinds = ["request", "approve", "contact", "reject", "request", "approve"]
    rows = [(p, T0 + dt.timedelta(minutes=i * 7 + p), i, kinds[(i + p) % 6], f"n{i}", None if i % 2 else f"u{i}", 9) for p in range(5) for i in range(9)]
    for at in range(3):
        drop(spark, [r for r in rows if r[2] // 3 == at], EVENTS, source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        jobs.run_updates(jobs.registration_stream(stream), out, state, "telegram_id")
    got = jobs.current(spark, out)
    batch = people.student_table(spark.createDataFrame(rows, EVENTS))
    assert sorted(map(str, got.select(batch.columns).collect())) == sorted(map(str, batch.collect()))


REPLIES = "session_id long, question_id long, student_answer string, answered_at timestamp"
QUESTIONS = "question_id long, part string, question_number int, answer string"


def test_the_first_answer_counts_however_late_it_comes(spark, tmp_path):
    questions = spark.createDataFrame([(1, "A", 1, "3"), (2, "B", 1, "x / y")], QUESTIONS)
    source, out, state, scores = (str(tmp_path / n) for n in ("in", "out", "state", "scores"))
    at = lambda days: T0 + dt.timedelta(days=days)
    rounds = [
        [(1, 1, "3", at(60)), (1, 1, "2", at(61)), (2, 2, " y ", at(60)), (9, 2, "n", at(60))],
        [(1, 1, "4", at(62)), (3, 2, "x", at(1))],  # a session's first reply, months behind
        [(1, 1, "5", at(2))],  # an earlier answer that comes last
    ]
    for rows in rounds:
        drop(spark, rows, REPLIES, source)
        jobs.merge_facts(spark.readStream.schema(REPLIES).parquet(source), questions, out, state, ["answered_at"], scores)
    facts = {(r.session_id, r.question_id): (r.student_answer, r.is_correct) for r in jobs.current(spark, out).collect()}
    assert facts == {(1, 1): ("5", False), (2, 2): ("y", True), (3, 2): ("x", True), (9, 2): ("n", False)}
    totals = {(r.session_id, r.part): (r.correct, r.total) for r in jobs.current(spark, scores).collect()}
    assert totals == {(1, "A"): (0, 1), (2, "B"): (1, 1), (3, "B"): (1, 1), (9, "B"): (0, 1)}


def test_a_repeated_batch_and_old_versions(spark, tmp_path):
    source, root, state = (str(tmp_path / n) for n in ("in", "root", "state"))
    for n in range(5):
        drop(spark, [(1, f"k{n}", f"h{n}")], IMAGES, source)
        jobs.merge_images(spark.readStream.schema(IMAGES).parquet(source), root, state)
    assert [r.v for r in spark.read.parquet(root).select("v").orderBy("v").collect()] == [3, 4]
    assert [r.content_hash for r in jobs.current(spark, root, before=4).collect()] == ["h3"]
    assert [r.content_hash for r in jobs.current(spark, root).collect()] == ["h4"]


def test_files_are_resolved_to_their_questions(spark):
    tables = {
        "subjects": spark.createDataFrame([(7, "my bio")], "subject_id long, name string"),
        "books": spark.createDataFrame([(70, 7, 2016)], "book_id long, subject_id long, year_value int"),
        "options": spark.createDataFrame([(700, 70, 2)], "option_id long, book_id long, option_number int"),
        "questions": spark.createDataFrame([(5, 700, "A", 3)], "question_id long, option_id long, part string, question_number int"),
    }
    names = ["my bio/2016/2/A/3.png", "my bio/2016/2/B/3.png", "other/2016/2/A/3.png", "my bio/2016/x/A/3.png"]
    found = jobs.image_rows(spark.createDataFrame([(n, "h") for n in names], "object_key string, content_hash string"), tables)
    assert [tuple(r) for r in found.collect()] == [(5, "my bio/2016/2/A/3.png", "h")]


@pytest.mark.parametrize("again", [False, True])
def test_image_rows_are_merged_by_version(spark, tmp_path, again):
    source, root, state = (str(tmp_path / n) for n in ("in", "root", "state"))
    for rows in ([(1, "a", "h1"), (2, "b", "h2")], [(1, "a", "h9"), (3, "c", "h3")]):
        drop(spark, rows, IMAGES, source)
        jobs.merge_images(spark.readStream.schema(IMAGES).parquet(source), root, state)
        if again:
            jobs.merge_images(spark.readStream.schema(IMAGES).parquet(source), root, state)
    table = {r.question_id: r.content_hash for r in jobs.current(spark, root).collect()}
    assert table == {1: "h9", 2: "h2", 3: "h3"}


def test_image_files_arrive_with_digests(spark, tmp_path):
    folder = tmp_path / "tree" / "bio" / "2016"
    folder.mkdir(parents=True)
    (folder / "1.png").write_bytes(b"x")
    out = str(tmp_path / "out")
    jobs.run_to_folder(jobs.image_file_stream(spark, str(tmp_path / "tree")), out, str(tmp_path / "state"))
    assert [r.object_key for r in spark.read.parquet(out).collect()] == ["bio/2016/1.png"]
