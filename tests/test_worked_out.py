"""Rules that filters read are worked out once a row, however many places name them."""

import re

from pyspark.sql import functions as F

from paperloom.functions import paths, text
from paperloom.sources import files
from paperloom.workload import corpus


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def times(pattern: str, df) -> int:
    return len(re.findall(pattern, plan_of(df)))


def test_a_path_is_taken_apart_once(spark, small):
    for query in (corpus.seedable_images, corpus.question_images, corpus.highest_numbers):
        assert times(r"split\(", query(spark, small)) == 1, query.__name__
        assert times(r"concat_ws\(", query(spark, small)) == 1, query.__name__


def test_slots_take_a_path_apart_once(spark, small):
    assert times(r"concat_ws\(", corpus.slots_taken(spark, small)) == 1


def test_loads_take_a_path_apart_once_a_branch(spark, small):
    """A load reads the tree for the images and for the typed answers."""
    assert times(r"concat_ws\(", corpus.seed_loads(spark, small)) == 2


def test_paths_are_worked_out_by_every_task(spark, small):
    """The rows of a tree are dealt out below the step that makes its paths, whatever row groups the table has."""
    for query in (corpus.seed_loads, corpus.admitted_answers, corpus.seedable_images, corpus.question_images, corpus.highest_numbers, corpus.slots_taken):
        lines = plan_of(query(spark, small)).splitlines()
        made = [k for k, line in enumerate(lines) if "concat_ws(" in line]
        assert made and all("RepartitionByExpression [p_partkey" in lines[k + 1] for k in made), query.__name__


def test_a_typed_key_is_read_once(spark, small):
    """No filter holds the key's rule: it is in the one column that is worked out."""
    assert not [line for line in plan_of(corpus.topic_expansion(spark, small)).splitlines() if "Filter" in line and "regexp_extract" in line]


def test_digits_and_keys_of_awkward_names(spark):
    names = {
        "a/007.png": "7", "000.JPG": "0", "a/12.tiff": "12", "x/" + "9" * 30 + ".Gif": "9" * 30, "a/+7.png": None, "a/7.txt": None,
        "a/7.png\n": None, "a/7b.png": None, "a/.png": None, "a/7.x.png": None, "a/7": None, "": None,
    }
    rows = spark.createDataFrame([(n,) for n in names], "p string").select("p", paths.question_digits(F.col("p")).alias("d")).collect()
    assert {r.p: r.d for r in rows} == names
    typed = {" а012\t": ("A", 12, "12"), "B000": ("B", 0, "0"), "A" + "8" * 25: ("A", None, "8" * 25), "A": None, "C1": None, "A1 2": None, "A-1": None}
    rows = spark.createDataFrame([(n,) for n in typed], "p string").select("p", text.question_key(F.col("p")).alias("k")).collect()
    assert {r.p: r.k and tuple(r.k) for r in rows} == typed


def test_walk_keeps_the_columns_of_its_manifest(spark):
    manifest = spark.createDataFrame([("s/2020/1/A/1.png", 5), ("s/2020/1/A/n.png", 6), (None, 7)], "object_key string, length int")
    got = files.question_images(manifest)
    assert got.columns == ["subject", "year", "option", "part", "number", "digits", "object_key", "length"]
    assert [tuple(r) for r in got.collect()] == [("s", "2020", "1", "A", 1, "1", "s/2020/1/A/1.png", 5)]
