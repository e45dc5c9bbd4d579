"""File trees as tables: manifests, page and question-image walks, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import exam, paths
from paperloom.functions.text import whole_number, worked_out


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Every file below *root*: key (path below it), length, modification time. No bytes are read."""
    return _files(spark, root).select("object_key", "length", "modificationTime")


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """SHA-256 of every file below *root*, by key. Hashing runs where the files are read."""
    return keyed_digests(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), root)


def keyed_digests(files: DataFrame, root: str) -> DataFrame:
    """Keys and digests of binary file rows, batch or streaming."""
    return _keyed(files, root).select("object_key", F.sha2("content", 256).alias("content_hash"))


def _files(spark: SparkSession, root: str) -> DataFrame:
    return _keyed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), root)


def _keyed(files: DataFrame, root: str) -> DataFrame:
    # Paths come back as URIs; drop the scheme so they compare with the root as given.
    path = F.regexp_replace("path", r"^file:/+", "/")
    return files.withColumn("object_key", paths.object_key(paths.local_root(root), path))


def book_pages(manifest: DataFrame, variant: str, subject: str | None = None) -> DataFrame:
    """Scanned pages of one variant: images under ``{subject}/{variant}/pages``; answer sheets are not."""
    parts = F.split("object_key", "/")
    kept = manifest.filter(
        (F.size(parts) >= 4)
        & (F.get(parts, F.lit(1)) == variant)
        & (F.get(parts, F.lit(2)) == paths.PAGES_SEGMENT)
        & paths.is_image(F.col("object_key"))
    )
    return kept if subject is None else kept.filter(F.get(parts, F.lit(0)) == subject)


def question_images(manifest: DataFrame) -> DataFrame:
    """Numbered images at ``{subject}/{year}/{option}/{part}/{n}.ext``, whatever the folders are called.

    ``digits`` is the number's text; ``number`` is null for one that no long holds, which no stored question can have.
    """
    told = F.struct(F.split("object_key", "/").alias("parts"), paths.question_digits(F.col("object_key")).alias("digits"))
    named = manifest.select("*", worked_out(told).alias("_told"))
    parts, digits = F.col("_told.parts"), F.col("_told.digits")
    return named.filter((F.size(parts) == 5) & digits.isNotNull()).select(
        *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("subject", "year", "option", "part"))],
        digits.try_cast("long").alias("number"),
        digits.alias("digits"),
        *manifest.columns,
    )


def seedable_images(images: DataFrame) -> DataFrame:
    """The stricter rule a load follows: numeric year and option, part exactly A or B.

    A folder whose number no year or option column can hold is a stray like any other name.
    """
    digits = F.col("year").rlike(r"^\d+$") & F.col("option").rlike(r"^\d+$")
    numbered = images.filter(digits & F.col("part").isin(*exam.PARTS)).withColumns(
        {name: whole_number(F.col(name), "int") for name in ("year", "option")}
    )
    return numbered.filter("year IS NOT NULL AND option IS NOT NULL AND number IS NOT NULL")
