"""Operators on the small cases their rules are stated with."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperloom.operators import assess, changes, corpus, dataset, draws, labelling, people, quality, replay, sheets

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)
QUESTIONS = "question_id long, option_id long, part string, question_number int, answer string"
REPLIES = "session_id long, question_id long, student_answer string, time_spent_seconds double, answered_at timestamp"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_session_scoring(spark):
    """A right A1 and a wrong B1; a session whose question has no key; one without answers; one still open."""
    questions = spark.createDataFrame([(1, 1, "A", 1, "3"), (2, 1, "B", 1, "neutron"), (3, 1, "B", 2, None)], QUESTIONS)
    replies = spark.createDataFrame(
        [(10, 1, " 3 ", 5.0, at(5)), (10, 2, "wrong", 10.0, at(15)), (10, 1, "4", 1.0, at(20)), (11, 3, "anything", 1.0, at(1)), (13, 1, "x", 1.0, at(1))],
        REPLIES,
    )
    sessions = spark.createDataFrame(
        [(10, 7, 1, T0, at(60.5)), (11, 7, 1, T0, at(1)), (12, 7, 1, T0, at(2)), (13, 7, 1, T0, None)],
        "session_id long, student_telegram_id long, option_id long, started_at timestamp, completed_at timestamp",
    )
    scored = assess.score_answers(assess.first_answers(replies, ["answered_at"]), questions)
    got = {r.session_id: tuple(r)[1:] for r in assess.session_results(sessions, scored).collect()}
    assert got == {10: (1, 0, 1, 2, 60.5), 11: (0, 0, 0, 1, 1.0), 12: (0, 0, 0, 0, 2.0), 13: (0, 0, 0, 1, None)}
    wrong = {(r.session_id, r.part, r.question_number): r.correct_answer for r in assess.wrong_answers(scored).collect()}
    assert wrong == {(10, "B", 1): "neutron", (11, "B", 2): None, (13, "A", 1): "3"}
    assert scored.filter("session_id = 13").first().reject_reason == "not an integer"


def test_a_later_key_does_not_change_what_was_recorded(spark):
    replies = spark.createDataFrame([(1, 1, "proton", 1.0, T0)], REPLIES)
    then = assess.score_answers(replies, spark.createDataFrame([(1, 1, "B", 1, "neutron")], QUESTIONS))
    recorded = then.select("session_id", "question_id", "student_answer", "time_spent_seconds", "answered_at")
    kept = assess.recorded_answers(recorded, replies.withColumn("student_answer", F.lit("neutron")), ["answered_at"])
    assert kept.collect()[0].student_answer == "proton" and kept.count() == 1
    assert then.first().correct_answer == "neutron"


def test_reply_claims(spark):
    """Wrong part does not disarm; the first fitting reply claims; a second is refused; nothing shown refuses."""
    rows = [(1, at(0), 0, "reply", "A"), (1, at(1), 1, "show", "A"), (1, at(2), 2, "reply", "B"), (1, at(3), 3, "reply", "A"), (1, at(4), 4, "reply", "A"), (1, at(5), 5, "show", "B"), (1, at(6), 6, "reply", "B")]
    updates = spark.createDataFrame(rows, "chat long, ts timestamp, seq long, kind string, part string")
    claims = assess.reply_claims(assess.question_on_screen(updates))
    assert sorted(r.seq for r in claims.filter("claimed").collect()) == [3, 6]
    spent = claims.filter("claimed").select("seq", assess.time_on_question(F.col("ts"), F.col("shown_ts")).alias("s"))
    assert {r.seq: r.s for r in spent.collect()} == {3: 2.0, 6: 1.0}


EVENTS = "telegram_id long, ts timestamp, seq long, kind string, name string, username string, admin_id long"


@pytest.mark.parametrize(
    ("kinds", "status", "full_name", "handled"),
    [
        (["contact"], "pending", None, False),
        (["request"], "pending", "n0", False),
        (["request", "approve"], "approved", "n0", True),
        (["request", "reject", "request"], "pending", "n2", False),
        (["request", "approve", "contact"], "approved", "n0", True),
        (["contact", "approve"], "pending", None, False),
        (["approve"], None, None, False),
        (["request", "approve", "reject"], "rejected", "n0", True),
    ],
)
def test_registration(spark, kinds, status, full_name, handled):
    events = spark.createDataFrame([(5, at(i), i, k, f"n{i}", f"u{i}", 9) for i, k in enumerate(kinds)], EVENTS)
    row = people.student_table(events).first()
    if status is None:
        assert row is None
        assert people.refused_decisions(events).first().reason == "unknown person"
        return
    assert (row.status, row.full_name, row.handled_at is not None) == (status, full_name, handled)
    assert row.created_at == T0
    assert row.telegram_username == f"u{max(i for i, k in enumerate(kinds) if k in ('contact', 'request'))}"
    gate = people.registration_gate(events.select("telegram_id").distinct(), people.student_table(events)).first().gate
    assert gate == ("new" if status == "rejected" else status)


def tasks(spark, *rows):
    """(id, path or None, flags): c a cancelled annotation, d a completed one."""
    made = []
    for task, path, flags in rows:
        data = {"image": f"/data/local-files/?d={path}"} if path else {"image": "http://x"}
        made.append((task, data, [(f == "c",) for f in flags]))
    return spark.createDataFrame(made, "task_id long, data map<string,string>, annotations array<struct<was_cancelled:boolean>>")


def located(spark, made, *present):
    manifest = spark.createDataFrame([(f"/root/{p}",) for p in present] or [("/none",)], "path string")
    return labelling.task_images(made, manifest, "/root")


def test_skipped_sweep(spark):
    made = tasks(spark, (1, "a.jpg", "c"), (2, "b.jpg", "cd"), (3, "c.jpg", "c"), (4, "C.jpg", ""), (5, None, "c"), (6, "gone.jpg", "c"), (7, "d.jpg", "d"))
    plan = {r.task_id: (r.verdict, r.with_image) for r in labelling.skipped_plan(located(spark, made, "a.jpg", "b.jpg", "c.jpg", "d.jpg")).collect()}
    assert plan == {1: ("delete", True), 2: ("keep", False), 3: ("keep", False), 5: ("keep", False), 6: ("delete", False)}


def test_repair_sweep(spark):
    made = tasks(
        spark, (1, "pages/p.jpg", "d"), (2, "var/pages/p.jpg", ""), (3, "pages/q.jpg", ""), (4, "var/q.jpg", ""), (5, "x.jpg", "d"),
        (6, "pages/r.jpg", "d"), (7, "a/r.jpg", ""), (8, "b/r.jpg", ""), (9, None, "d"),
    )
    found = located(spark, made, "var/pages/p.jpg", "var/q.jpg", "a/r.jpg", "b/r.jpg")
    plan = labelling.repair_plan(found)
    got = {r.task_id: (r.verdict, r.target_id) for r in plan.collect()}
    assert got == {
        1: ("move", 2), 2: ("live", None), 3: ("delete", None), 4: ("live", None), 5: ("left", None), 6: ("left", None),
        7: ("left", None), 8: ("left", None), 9: ("left", None),
    }
    totals = {r.plan: r for r in labelling.sweep_totals(plan, labelling.skipped_plan(found)).collect()}
    assert (totals["repair"].moves, totals["repair"].annotations, totals["repair"].deletions) == (1, 1, 1)


@pytest.mark.parametrize(("n", "expected"), [(10, (8, 1, 1)), (100, (80, 11, 9)), (1, (0, 0, 1)), (0, (0, 0, 0))])
def test_split_sizes(spark, n, expected):
    names = spark.range(n).selectExpr("concat('p', id) AS filename")
    split = draws.split_dataset(names, "filename", 0.8, "s")
    counts = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert tuple(counts.get(s, 0) for s in ("train", "val", "test")) == expected
    again = draws.split_dataset(names.repartition(3), "filename", 0.8, "s")
    assert sorted(map(str, split.collect())) == sorted(map(str, again.collect()))


def test_duplicate_names_and_negatives(spark):
    rows = [(0, "a.jpg", [("x", [(0.1, 0.2)])]), (1, "b.jpg", []), (2, "a.jpg", [("y", [(0.3, 0.4)]), ("x", [(0.5, 0.5)])])]
    images = spark.createDataFrame(rows, "ord long, filename string, regions array<struct<label:string,polygon_norm:array<struct<x:double,y:double>>>>")
    classes = dataset.class_map(images.select(F.explode("regions").alias("r")).select("r.label"))
    got = {r.filename: r for r in dataset.label_files(images, classes).collect()}
    assert got["a.jpg"].label_text == "1 0.300000 0.400000\n0 0.500000 0.500000"
    assert (got["a.jpg"].first_seen, got["a.jpg"].copies, got["b.jpg"].label_text) == (0, 2, "")


def test_answer_sheets(spark):
    """A year is written only whole; later sheets win; labels and options are normalised."""
    listed = sheets.with_year(
        spark.createDataFrame(
            [("s", "2016_1.jpg", False), ("s", "2016_2.jpg", False), ("s", "2017.jpg", False), ("s", "2018_1.jpg", True), ("s", "x.jpg", False)],
            "subject string, sheet string, unreadable boolean",
        )
    )
    answers = spark.createDataFrame(
        [("s", 2016, "2016_1.jpg", 0, "11", "а1", "ABC"), ("s", 2016, "2016_2.jpg", 0, "1", "A1", "B"), ("s", 2016, "2016_2.jpg", 1, "20", "В2", "F"), ("s", 2017, "2017.jpg", 0, "1", "C1", "x")],
        "subject string, year int, sheet string, place int, raw_option string, raw_label string, raw_answer string",
    )
    normal = sheets.normalise_answers(answers)
    outcomes = sheets.sheet_outcomes(listed, normal)
    assert {r.sheet: r.reason for r in outcomes.collect()} == {
        "2016_1.jpg": None, "2016_2.jpg": None, "2017.jpg": "invalid question label", "2018_1.jpg": "unreadable", "x.jpg": "invalid filename",
    }
    merged = [tuple(r)[1:] for r in sheets.in_answer_order(sheets.merge_sheets(normal, outcomes)).collect()]
    assert merged == [(2016, 1, "A", 1, "В"), (2016, 10, "B", 2, "Г")]


def test_renames(spark):
    """Names free up as pages move; a taken twin blocks a page, and the pages behind it."""

    def outcomes(pages, twins):
        numbered = corpus.number_pages(spark.createDataFrame([(f"d/{p}",) for p in pages], "object_key string"))
        held = spark.createDataFrame([("d", t) for t in twins] or [("other", "x")], "directory string, stem string")
        return {r.object_key[2:]: r.outcome for r in corpus.plan_renames(numbered, held).collect()}

    def by_hand(pages, twins):
        import re

        def key(name):
            return [int(c) if c.isdigit() else c.lower() for c in re.split(r"(\d+)", name.rsplit(".", 1)[0])]

        disk, held, out = set(pages), set(twins), {}
        for n, page in enumerate(sorted(sorted(pages), key=key), 1):
            stem, target = page.rsplit(".", 1)[0], f"{n:03d}.{page.rsplit('.', 1)[1]}"
            if target == page:
                out[page] = "unchanged"
            elif target in disk or (stem in held and f"{n:03d}" in held):
                out[page] = "taken"
            else:
                if stem in held:
                    held = held - {stem} | {f"{n:03d}"}
                disk = disk - {page} | {target}
                out[page] = "renamed"
        return out

    cases = [
        (["1.jpg", "2.jpg", "scan.jpg"], ["1", "scan"]),
        (["002.jpg", "003.jpg", "004.jpg"], ["002", "003", "004"]),
        (["002.jpg", "003.jpg", "004.jpg"], ["001", "002", "003", "004"]),
        (["000.jpg", "001.jpg", "002.jpg"], []),
        (["003.jpg", "005.jpg", "a.jpg"], ["001", "003", "005", "a", "002"]),
    ]
    for pages, twins in cases:
        assert outcomes(pages, twins) == by_hand(pages, twins), (pages, twins)


def test_year_load(spark, tmp_path):
    empty = {
        "books": spark.createDataFrame([], "book_id long, subject_id long, year_value int"),
        "options": spark.createDataFrame([], "option_id long, book_id long, option_number int, exam_type string"),
        "questions": spark.createDataFrame([], QUESTIONS),
        "images": spark.createDataFrame([], "question_id long, object_key string, content_hash string, telegram_file_id string"),
    }
    schema = "option int, exam_type string, part string, number int, answer string, object_key string, content_hash string"
    first = changes.load_year(1, 2016, spark.createDataFrame([(1, "CT", "A", 1, "3", "k1", "h1"), (1, "CT", "B", 1, None, "k2", "h2")], schema), empty)
    assert {k: v.count() for k, v in first.items()} == {"books": 1, "options": 1, "questions": 2, "images": 2}
    second = changes.load_year(1, 2016, spark.createDataFrame([(1, "CT", "A", 1, None, "k1", "h9")], schema), first)
    assert {r.part: r.answer for r in second["questions"].collect()} == {"A": None, "B": None}
    assert {r.object_key: r.content_hash for r in second["images"].collect()} == {"k1": "h9", "k2": "h2"}
    changes.write_years(first["books"], str(tmp_path / "b"), ["year_value"])
    changes.write_years(first["books"].withColumn("year_value", F.lit(2017)), str(tmp_path / "b"), ["year_value"])
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2


def test_image_guard(spark):
    schema = "question_id long, object_key string, content_hash string, telegram_file_id string"
    stored = spark.createDataFrame([(1, "k", "h", "f"), (2, "k2", "h2", "f2")], schema)
    offered = spark.createDataFrame([(1, "k", "h"), (2, "k2", "new"), (3, "k3", "h3")], "question_id long, object_key string, content_hash string")
    got = {r.question_id: (r.content_hash, r.telegram_file_id, r.changed) for r in changes.upsert_images(stored, offered).collect()}
    assert got == {1: ("h", "f", False), 2: ("new", None, True), 3: ("h3", None, True)}


@pytest.mark.parametrize("parts", [1, 5])
def test_the_last_offer_wins(spark, parts):
    offers = [(1, 1, "A", 1, "old", 1), (1, 1, "A", 1, "new", 3), (1, 1, "A", 1, "mid", 2), (1, 1, "A", 2, "x", 1), (1, 1, "A", 2, None, 2)]
    offered = spark.createDataFrame([(o, p, n, a, s) for _, o, p, n, a, s in offers], "option_id long, part string, question_number int, answer string, offer int")
    stored = spark.createDataFrame([(1, 1, "A", 2, "was")], QUESTIONS)
    got = changes.upsert_questions(stored, offered.repartition(parts)).collect()
    assert {r.question_number: r.answer for r in got} == {1: "new", 2: None} and len(got) == 2
    images = spark.createDataFrame([(1, "b", "2", 2), (1, "c", "3", 3), (1, "a", "1", 1)], "question_id long, object_key string, content_hash string, offer int")
    none = spark.createDataFrame([], "question_id long, object_key string, content_hash string, telegram_file_id string")
    assert [r.object_key for r in changes.upsert_images(none, images.repartition(parts)).collect()] == ["c"]
    tied = images.drop("offer").repartition(parts)
    assert [r.object_key for r in changes.upsert_images(none, tied).collect()] == ["c"]


def test_a_null_hash_is_stale(spark):
    rows = spark.createDataFrame([("a", None), ("b", "h")], "object_key string, content_hash string")
    found = spark.createDataFrame([("a", "h"), ("b", "h")], "object_key string, content_hash string")
    manifest = found.select("object_key")
    assert [tuple(r) for r in corpus.reconcile_tree(rows, manifest, found).collect()] == [("a", "stale")]
    assert [tuple(r) for r in corpus.reconcile(rows, found).collect()] == [("a", "stale")]


def test_each_rule_catches_its_row(spark):
    one = {
        "subjects": spark.createDataFrame([(1, "s")], "subject_id long, name string"),
        "options": spark.createDataFrame([(1, 1, 11, "XX")], "option_id long, book_id long, option_number int, exam_type string"),
        "questions": spark.createDataFrame([(1, 1, "A", 1, "0"), (2, 1, "C", 0, "x"), (3, 8, "B", 1, None), (4, 1, "A", 3, "5\n")], QUESTIONS),
        "students": spark.createDataFrame(
            [(500, "n", "odd", T0, "f", None), (501, "n", "pending", T0, "f", None), (502, "n", "approved", T0, None, 77)],
            "telegram_id long, telegram_name string, status string, handled_at timestamp, full_name string, handled_by long",
        ),
        "test_sessions": spark.createDataFrame([(1, 500, 1, at(5), T0)], "session_id long, student_telegram_id long, option_id long, started_at timestamp, completed_at timestamp"),
        "session_answers": spark.createDataFrame([(1, 1, -1.0), (1, 1, 2.0), (9, 1, 2.0)], "session_id long, question_id long, time_spent_seconds double"),
    }
    found = {(r.rule, r.key) for r in quality.violations(one).collect()}
    assert found == {
        ("option number range", "1"), ("exam type", "1"), ("part A key", "1"), ("part A key", "4"), ("part", "2"), ("question number", "2"), ("status", "500"),
        ("decision recorded", "501"), ("decision after application", "502"), ("completed after started", "1"), ("time spent", "1|1"),
        ("unique session_id, question_id", "1|1"), ("option_id refers to options", "3"), ("handled_by refers to students", "502"),
        ("session_id refers to test_sessions", "9|1"),
    }


def test_replay(spark):
    needed = spark.createDataFrame([("text", "a"), ("text", "b"), ("skew", "a")], "kind string, digest string")
    recorded = spark.createDataFrame([("text", "a", "1")], "kind string, digest string, value string")
    assert sorted(map(tuple, replay.missing_answers(needed, recorded).collect())) == [("skew", "a"), ("text", "b")]
    assert replay.recall(needed, recorded).filter("found").count() == 1
    before = spark.createDataFrame([("p", "1"), ("q", "1"), ("r", "1")], "path string, digest string")
    after = spark.createDataFrame([("p", "1"), ("q", "2"), ("s", "1")], "path string, digest string")
    assert {r.path: r.status for r in replay.manifest_diff(before, after).collect()} == {"q": "changed", "r": "removed", "s": "added"}


def test_preview_says_what_it_left_out(spark):
    shown, more = labelling.preview(spark.range(7).withColumnRenamed("id", "task_id"), ["task_id"], labelling.MOVES_SHOWN)
    assert (shown.count(), more) == (5, 2)


def test_renames_at_random(spark):
    """Many small directories at once, names drawn so that targets collide often."""
    import random
    import re

    rng = random.Random(3)

    def key(name):
        return [int(c) if c.isdigit() else c.lower() for c in re.split(r"(\d+)", name.rsplit(".", 1)[0])]

    pages, twins, expected = [], [], {}
    for d in range(150):
        stems = [f"{n:03d}" for n in range(9)] + ["1", "2", "a", "b7"]
        found = sorted({f"{rng.choice(stems)}.{rng.choice(['jpg', 'png'])}" for _ in range(rng.randint(1, 7))})
        held = {s for s in stems if rng.random() < 0.4}
        pages += [(f"d{d}/{p}",) for p in found]
        twins += [(f"d{d}", s) for s in held]
        disk = set(found)
        for n, page in enumerate(sorted(found, key=key), 1):
            stem, target = page.rsplit(".", 1)[0], f"{n:03d}.{page.rsplit('.', 1)[1]}"
            if target == page:
                expected[f"d{d}/{page}"] = "unchanged"
            elif target in disk or (stem in held and f"{n:03d}" in held):
                expected[f"d{d}/{page}"] = "taken"
            else:
                if stem in held:
                    held = held - {stem} | {f"{n:03d}"}
                disk = disk - {page} | {target}
                expected[f"d{d}/{page}"] = "renamed"
    numbered = corpus.number_pages(spark.createDataFrame(pages, "object_key string"))
    plan = corpus.plan_renames(numbered, spark.createDataFrame(twins, "directory string, stem string"))
    assert {r.object_key: r.outcome for r in plan.collect()} == expected


def test_delete_plan_reaches_a_row_by_two_ways_once(spark):
    def table(text, *rows):
        return spark.createDataFrame(list(rows), text)

    tables = {
        "subjects": table("subject_id long", (1,), (2,)),
        "books": table("book_id long, subject_id long", (10, 1), (11, 2)),
        "options": table("option_id long, book_id long", (20, 10), (21, 11)),
        "questions": table("question_id long, option_id long", (30, 20), (31, 21), (32, None)),
        "topics": table("topic_id long, subject_id long", (40, 1), (41, 2)),
        "question_topics": table("question_id long, topic_id long", (30, 40), (30, 41), (31, 41)),
        "test_sessions": table("session_id long, student_telegram_id long, option_id long", (50, 7, 21)),
    }
    plan = changes.delete_plan(tables, "subjects", table("id long", (1,), (2,), (2,), (9,)))
    got = sorted((r.root, r.table, r.key, r.action) for r in plan.collect())
    assert got == sorted(
        [(s, "subjects", str(s), "delete") for s in (1, 2)]
        + [(1, "books", "10", "delete"), (2, "books", "11", "delete"), (1, "options", "20", "delete"), (2, "options", "21", "delete")]
        + [(1, "questions", "30", "delete"), (2, "questions", "31", "delete"), (1, "topics", "40", "delete"), (2, "topics", "41", "delete")]
        + [(s, "question_topics", k, "delete") for s, k in ((1, "30|40"), (1, "30|41"), (2, "30|41"), (2, "31|41"))]
        + [(2, "test_sessions", "50", "blocked")]
    )
    assert {r.root for r in changes.deletable(plan).collect()} == {1}
