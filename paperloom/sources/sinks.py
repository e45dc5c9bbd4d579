"""What the library writes for others to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_answer_documents(answers: DataFrame) -> DataFrame:
    """One ``{option: {label: answer}}`` text per (subject, year), sorted the way people read it.

    A document is one file's content: a year has ten options of a few dozen questions, so it is bounded
    by what it describes.
    """
    entry = F.struct("part", "number", F.struct(F.concat("part", F.col("number").cast("string")).alias("k"), F.col("answer").alias("v")).alias("e"))
    per_option = answers.groupBy("subject", "year", "option").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    labels = F.map_from_entries(F.transform("entries", lambda e: F.struct(e["e"]["k"], e["e"]["v"])))
    options = per_option.select("subject", "year", F.struct(F.col("option").cast("int").alias("option"), labels.alias("labels")).alias("o"))
    # A map cannot be sorted, so the option's number carries the order.
    gathered = options.groupBy("subject", "year").agg(F.collect_list("o").alias("os"))
    by_number = F.array_sort("os", lambda a, b: a["option"] - b["option"])
    document = F.to_json(F.map_from_entries(F.transform(by_number, lambda o: F.struct(o["option"].cast("string"), o["labels"]))))
    return gathered.select("subject", "year", document.alias("document"))


def write_answer_documents(answers: DataFrame, root: str) -> None:
    """Answer keys partitioned by subject and year, so a re-run replaces only what it read."""
    documents = sorted_answer_documents(answers)
    documents.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("subject", "year").text(root)


def write_training_set(labels: DataFrame, classes: DataFrame, root: str) -> None:
    """Label lines by split, the copy manifest, and the class list.

    *labels* holds (filename, split, label_text, present). Images without regions are negatives: they
    are in the copy manifest and have no label text. Images that are absent are in neither.
    """
    present = labels.filter("present")
    present.select("split", "filename").write.mode("overwrite").partitionBy("split").json(f"{root}/copies")
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    lines = present.filter(F.col("label_text") != "").select("split", F.concat(stem, F.lit(".txt")).alias("file"), F.col("label_text").alias("text"))
    lines.write.mode("overwrite").partitionBy("split").json(f"{root}/labels")
    classes.coalesce(1).orderBy("class_id").write.mode("overwrite").json(f"{root}/classes")


def write_archive(tasks: DataFrame, doomed_ids: DataFrame, path: str) -> None:
    """Every task a clean-up will destroy, kept before it does."""
    doomed_tasks(tasks, doomed_ids).write.mode("errorifexists").json(path)


def doomed_tasks(tasks: DataFrame, doomed_ids: DataFrame) -> DataFrame:
    return tasks.join(doomed_ids.select("task_id"), "task_id", "left_semi")


def dated(path: str, stamp: Column | str) -> str:
    return f"{path}/{stamp}"
