"""Training data: the page pool, class ids, label files and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import geometry, paths
from paperloom.operators.draws import split_dataset
from paperloom.plans.ordered import running


def pool_outcomes(listed: DataFrame, pool: DataFrame) -> DataFrame:
    """What happens to each page offered to the pool: saved, already present, unrecognised or missing.

    *listed* holds (ord, path, missing), *pool* the names already there. Of several pages with one
    target name the first is saved.
    """
    where = paths.page_subject_year(F.col("path"))
    name = paths.training_name(where["subject"], where["year"], paths.stem(F.col("path")))
    offered = listed.withColumn("target", F.when(~F.col("missing"), name))
    first = offered.filter("target IS NOT NULL").groupBy("target").agg(F.min("ord").alias("_first"))
    held = pool.select(F.col("name").alias("target"), F.lit(True).alias("_held")).distinct()
    joined = offered.join(first, "target", "left").join(held, "target", "left")
    outcome = (
        F.when(F.col("missing"), "missing")
        .when(F.col("target").isNull(), "unrecognised")
        .when(F.col("_held").isNotNull() | (F.col("_first") < F.col("ord")), "already present")
        .otherwise("saved")
    )
    return joined.select("ord", "path", "target", outcome.alias("outcome"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("pages"))


def class_map(regions: DataFrame) -> DataFrame:
    """Distinct labels in text order with ids from 0. *regions* holds one ``label`` per row."""
    ranked = running(regions.select("label").distinct(), [], ["label"], rank="class_id")
    return ranked.select((F.col("class_id") - 1).alias("class_id"), "label")


def label_files(images: DataFrame, classes: DataFrame) -> DataFrame:
    """Label text of each image name: (filename, first_seen, label_text, copies).

    *images* holds (ord, filename, regions). Of several images with one name the last one's text is
    kept at the first one's place; ``copies`` tells them apart from the rest.
    """
    last = images.groupBy("filename").agg(
        F.min("ord").alias("first_seen"), F.max("ord").alias("_last"), F.count(F.lit(1)).alias("copies")
    )
    kept = images.join(last.select("filename", F.col("_last").alias("ord")), ["filename", "ord"])
    one = kept.select("filename", F.posexplode_outer("regions").alias("place", "r"))
    lines = one.join(classes.withColumnRenamed("label", "_label"), F.col("r.label") == F.col("_label"), "left").select(
        "filename", "place", geometry.label_line(F.col("class_id"), F.col("r.polygon_norm")).alias("line"), F.col("r").isNotNull().alias("_has")
    )
    # An image's regions came out of one row, so they fit one again.
    texts = lines.groupBy("filename").agg(F.array_sort(F.collect_list(F.when(F.col("_has"), F.struct("place", "line")))).alias("ls"))
    text = F.array_join(F.transform("ls", lambda s: s["line"]), "\n")
    return last.drop("_last").join(texts.select("filename", text.alias("label_text")), "filename")


def build_dataset(labels: DataFrame, manifest: DataFrame, train: float, seed: str) -> DataFrame:
    """Label files with their split and whether the image is there to copy.

    The split is cut over all names; an absent image is in no split's count afterwards.
    """
    split = split_dataset(labels, "filename", train, seed)
    here = manifest.select("filename", F.lit(True).alias("_here")).distinct()
    return split.join(here, "filename", "left").withColumn("present", F.col("_here").isNotNull()).drop("_here")


def split_counts(dataset: DataFrame) -> DataFrame:
    return dataset.groupBy("split").agg(F.count_if("present").alias("images"), F.count_if(~F.col("present")).alias("missing"))
