"""Readers and sinks over small trees on disk."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import audit, corpus, ports, replay
from paperloom.sources import documents, files, sinks, tables


SCANS = {"earth science/2019/4/A/7.png": b"layers", "earth science/2019/4/B/3.webp": b"a map", "химия+/2021/12/B/3.jpeg": b"flask"}


@pytest.fixture
def tree(tmp_path):
    """A subject with a space in its name and one in Cyrillic: three scans, a key for one year, a topic map."""
    for name, body in SCANS.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    (tmp_path / "earth science" / "2019" / "answers.json").write_text(json.dumps({"4": {"A7": "2", "B3": "granite"}}))
    (tmp_path / "химия+" / "topics.json").write_text(json.dumps({"Металлы": {"2021": {"CE": ["B3", "A7"]}}}, ensure_ascii=False))
    return tmp_path


def keys(df, column="object_key"):
    return sorted(r[column] for r in df.collect())


def test_walks(spark, tree):
    strays = {"earth science/2019/4/A/cover.png": b"x", "earth science/2019/4b/A/9.PNG": b"x", "earth science/99999999999/4/A/1.png": b"x", "earth science/2019/4/C/1.png": b"x"}
    for name, body in strays.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_bytes(body)
    images = files.question_images(files.file_manifest(spark, str(tree)))
    assert keys(images) == sorted([*SCANS, *list(strays)[1:]])
    assert keys(files.seedable_images(images)) == sorted(SCANS)
    assert sorted((r.subject, r.year, r.option) for r in files.seedable_images(images).collect()) == [("earth science", 2019, 4)] * 2 + [("химия+", 2021, 12)]


def test_manifest_reads_no_bytes(spark, tree):
    plan = files.file_manifest(spark, str(tree))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_pages(spark, tmp_path):
    for name in ("math/processed/pages/2016/1.jpg", "math/processed/pages/2016/a.txt", "math/processed/answers/2016.jpg", "art/raw/pages/2016/1.png"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    manifest = files.file_manifest(spark, str(tmp_path))
    assert keys(files.book_pages(manifest, "processed")) == ["math/processed/pages/2016/1.jpg"]
    assert keys(files.book_pages(manifest, "raw", "math")) == []


def test_reconcile_finds_each_drift(spark, tree):
    stored = files.file_digests(spark, str(tree)).filter("object_key NOT LIKE '%.json'").collect()
    rows = spark.createDataFrame(stored)

    def drift():
        manifest = files.file_manifest(spark, str(tree)).filter("object_key NOT LIKE '%.json'")
        found = corpus.reconcile_tree(rows, manifest, files.file_digests(spark, str(tree)))
        return sorted((r.object_key, r.status) for r in found.collect())

    assert {r.object_key: r.content_hash for r in stored} == {k: hashlib.sha256(v).hexdigest() for k, v in SCANS.items()}
    assert drift() == []
    gone, redrawn, kept = sorted(SCANS)
    (tree / gone).rename(tree / "earth science" / "loose.webp")
    (tree / redrawn).write_bytes(b"another map")
    assert drift() == [(gone, "missing"), (redrawn, "stale"), ("earth science/loose.webp", "orphaned")]


def test_answer_and_topic_readers(spark, tree):
    found = documents.read_documents(spark, str(tree), "answers.json")
    assert keys(found) == ["earth science/2019/answers.json"]
    rows = documents.answer_rows(found).select("option", "raw_key", "answer").collect()
    assert sorted(map(tuple, rows)) == [("4", "A7", "2"), ("4", "B3", "granite")]
    maps = documents.read_documents(spark, str(tree), "topics.json")
    assert keys(maps) == ["химия+/topics.json"]
    assert [tuple(r)[1:] for r in documents.topic_rows(maps).collect()] == [("Металлы", 2021, "CE", "B3"), ("Металлы", 2021, "CE", "A7")]


def test_documents_below_a_root_with_spaces(spark, tmp_path):
    root = tmp_path / "my root"
    (root / "a 100%").mkdir(parents=True)
    (root / "a 100%" / "answers.json").write_text("{}")
    assert keys(documents.read_documents(spark, str(root), "answers.json")) == ["a 100%/answers.json"]


def test_a_database_is_read_in_ranges(spark):
    options = tables.jdbc_options(spark, "jdbc:x", "answers", "answer_id", (1, 900))
    assert options["numPartitions"] == int(spark.conf.get("spark.sql.shuffle.partitions")) and options["partitionColumn"] == "answer_id"


def test_one_broken_document_costs_only_itself(spark):
    texts = {
        "good": '{"1": {"A1": "3"}, "1a": {"A1": "2", "B1": "Б"}}',
        "cut": '{"1": {',
        "number": '{"1": {"A1": 3, "B1": "Б"}}',
        "list": '["A1", "A2"]',
        "inner": '{"1": ["A1", "A2"]}',
        "null": '{"1": {"A1": null}}',
        "empty": "{}",
    }
    df = spark.createDataFrame(list(texts.items()), "name string, document string")
    checked = {r.name: r for r in documents.check_answer_maps(df).collect()}
    assert {n for n, r in checked.items() if r.valid} == {"good", "empty"}
    assert checked["good"].answers["1a"] == {"A1": "2", "B1": "Б"} and checked["cut"].answers is None


def test_export_reader(spark, tmp_path):
    square = [[10, 20], [50, 20], [50, 80], [10, 80]]
    entries = [
        {"image": "/data/local-files/?d=images%5Cmy%20file.jpg", "label": [{"polygonlabels": ["question"], "points": square}, {"points": square}, {"polygonlabels": ["x"], "points": []}]},
        {"image": "s3://bucket/x.jpg", "label": []},
        {"image": "/data/local-files/?d=other%2Fmy%20file.jpg"},
    ]
    (tmp_path / "e.json").write_text(json.dumps(entries))
    rows = documents.read_export(spark, str(tmp_path / "e.json")).collect()
    assert [(r.filename, len(r.regions), r.dropped_regions) for r in rows] == [("my file.jpg", 1, 2), ("my file.jpg", 0, 0)]
    assert [(p.x, p.y) for p in rows[0].regions[0].polygon_norm] == [(0.1, 0.2), (0.5, 0.2), (0.5, 0.8), (0.1, 0.8)]


def test_tasks_and_path_lists(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"id": 4, "data": {"image": "/x?d=a"}, "is_labeled": False, "annotations": [{"was_cancelled": True}], "predictions": []}]))
    task = documents.read_tasks(spark, str(tmp_path / "t.json")).first()
    assert task.task_id == 4 and task.annotations[0].was_cancelled
    (tmp_path / "l.txt").write_text("a/1.jpg \n\n\tb/2.jpg\n")
    listed = documents.read_path_list(spark, str(tmp_path / "l.txt"))
    manifest = spark.createDataFrame([("a/1.jpg",)], "object_key string")
    assert sorted(map(tuple, documents.with_presence(listed, manifest).collect())) == [("a/1.jpg", False), ("b/2.jpg", True)]


def test_recordings_and_completion(spark, tmp_path):
    answers = spark.createDataFrame([("text", "d1", "А")], "kind string, digest string, value string")
    tables.write_recording(answers, str(tmp_path / "r"))
    assert tables.read_recording(spark, str(tmp_path / "r")).collect() == answers.collect()
    answers.select(F.lit(9).alias("version"), "*").write.parquet(str(tmp_path / "old"))
    with pytest.raises(ValueError, match="version 9"):
        tables.read_recording(spark, str(tmp_path / "old"))
    run = spark.createDataFrame([("a/1.png", "x"), ("a/2.png", "y")], "path string, digest string")
    tables.write_outputs(run, str(tmp_path / "outputs"))
    now = run.withColumn("digest", F.when(F.col("digest") == "y", "z").otherwise(F.col("digest")))
    changed = replay.manifest_diff(tables.read_outputs(spark, str(tmp_path / "outputs")), now)
    assert [tuple(r) for r in changed.collect()] == [("a/2.png", "changed")]
    log = str(tmp_path / "log")
    assert tables.read_completed(spark, log).count() == 0
    done = spark.createDataFrame([("math", "2016"), ("math", "2016")], "subject string, identifier string")
    tables.mark_completed(done, log)
    tables.mark_completed(done, log)
    assert tables.read_completed(spark, log).count() == 1
    (tmp_path / "garbage").mkdir()
    (tmp_path / "garbage" / "part-0.parquet").write_bytes(b"this is no log at all")
    assert tables.read_completed(spark, str(tmp_path / "garbage")).count() == 0


def test_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "math")], "subject_id int, name string")
    tables.write_table(rows, str(tmp_path), "subjects")
    assert tables.read_table(spark, str(tmp_path), "subjects").collect()[0].subject_id == 1


def test_sinks(spark, tmp_path):
    answers = spark.createDataFrame(
        [("bio", 2016, o, p, n, f"{p}{n}") for o in (5, 2, 10, 1) for p, n in (("B", 1), ("A", 10), ("A", 2))],
        "subject string, year int, option int, part string, number int, answer string",
    )
    sinks.write_answer_documents(answers, str(tmp_path / "keys"))
    written = json.loads(spark.read.text(str(tmp_path / "keys")).first().value)
    assert list(written) == ["1", "2", "5", "10"] and list(written["1"]) == ["A2", "A10", "B1"]

    labels = spark.createDataFrame(
        [("a.jpg", "train", "0 1", True), ("b.jpg", "train", "", True), ("c.jpg", "val", "0 2", False)],
        "filename string, split string, label_text string, present boolean",
    )
    classes = spark.createDataFrame([(0, "question")], "class_id long, label string")
    sinks.write_training_set(labels, classes, str(tmp_path / "set"))
    assert keys(spark.read.json(str(tmp_path / "set" / "copies")), "filename") == ["a.jpg", "b.jpg"]
    assert keys(spark.read.json(str(tmp_path / "set" / "labels")), "file") == ["a.txt"]

    tasks = spark.createDataFrame([(1, "x"), (2, "y")], "task_id long, body string")
    sinks.write_archive(tasks, tasks.filter("task_id = 2"), str(tmp_path / "undo"))
    assert keys(spark.read.json(str(tmp_path / "undo")), "body") == ["y"]


def test_validation_of_small_years(spark):
    docs = spark.createDataFrame(
        [("s", "2016", '{"6": {"A1": "1", "B1": "Б"}, "7": {"A1": "2"}}'), ("s", "2017", "{"), ("s", "2019", '{"1": {"A1": "1", "A2": "1", "A10": "1"}}')],
        "subject string, year string, document string",
    )
    images = spark.createDataFrame(
        [("s", "2016", "a", 1), ("s", "2016", "B", 1), ("s", "2017", "A", 1), ("s", "2018", "A", 1), ("s", "2019", "A", 1)],
        "subject string, year string, part string, number int",
    )
    years = images.select("subject", "year").distinct()
    got = {r.year: r for r in audit.validate_years(years, documents.check_answer_maps(docs), images).collect()}
    assert {y: r.status for y, r in got.items()} == {"2016": "OPTIONS DIFFER", "2017": "IS UNREADABLE", "2018": "NOT FOUND", "2019": "MISMATCH"}
    assert (got["2016"].options_with_b, got["2016"].total_options, got["2016"].part_b_coverage) == (1, 2, "partial")
    listed = audit.listed(audit.key_differences(documents.check_answer_maps(docs), images), ["subject", "year", "side"], "key", 1)
    assert [(r.year, r.key, r.more) for r in listed.collect()] == [("2019", "A10", 1)]


def test_census(spark):
    rows = [("s", "2016", str(o), p, n) for o in range(1, 11) for p, top in (("A", 20), ("B", 6)) for n in range(top)]
    rows += [("s", "2017", "1", "A", n) for n in range(20)] + [("s", "2017", "1", "B", n) for n in range(6)] + [("s", "2017", "2", "A", n) for n in range(19)]
    images = spark.createDataFrame(rows, "subject string, year string, option string, part string, number int")
    parts = audit.part_counts(images)
    years = {r.year: r for r in audit.year_census(parts).collect()}
    assert years["2016"].complete and years["2016"].images == 260
    assert (years["2017"].images, years["2017"].folders, years["2017"].off_mode_parts, years["2017"].complete) == (45, 3, 0, False)


def test_ports(spark):
    images = spark.createDataFrame([("p1", bytearray(b"abc"))], "page string, content binary")

    def detector(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"page": batch["page"], "ord": 0, "label": "question", "polygon_px": [[{"x": 1, "y": len(c)}] for c in batch["content"]], "score": 0.5})

    def reader(batches):
        for batch in batches:
            yield batch.assign(text="A")[["page", "ord", "text"]]

    found = ports.detect_regions(images, detector).first()
    assert (found.label, found.polygon_px[0].y) == ("question", 3)
    crops = images.selectExpr("page", "1 AS ord", "content")
    assert ports.read_markers(crops, reader).first().text == "A"
