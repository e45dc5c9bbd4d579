"""JSON and text inputs. A broken file is a row with ``valid = false``, never a failed job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.functions import geometry, paths
from paperloom.functions.text import unicode_trim, whole_number


def read_documents(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Every file called *name* below *root*, whole, with its key."""
    files = (
        spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root)
    )
    # The metadata column holds a URL: spaces and letters beyond ASCII come encoded, a plus sign does not.
    encoded = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/")
    path = F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))
    return files.select(paths.object_key(paths.local_root(root), path).alias("object_key"), F.col("value").alias("document"))


def answer_rows(documents: DataFrame, document: str = "document") -> DataFrame:
    """Strict reading of ``{option: {key: answer}}``: a row per answer, a bad document fails the job."""
    parsed = F.from_json(document, schemas.ANSWER_MAP, {"mode": "FAILFAST"})
    keep = [c for c in documents.columns if c != document]
    options = documents.select(*keep, F.explode(parsed).alias("option", "answers"))
    return options.select(*keep, "option", F.explode("answers").alias("raw_key", "answer"))


def is_answer_map(document: Column) -> Column:
    """True when a text really is a map of maps with string leaves.

    Plain parsing would turn a bare number into text, so the shape is read off the parsed value.
    """
    options = F.try_variant_get(F.try_parse_json(document), "$", "map<string,variant>")
    leaves = F.transform(F.map_values(options), lambda o: F.try_variant_get(o, "$", "map<string,variant>"))
    texts = F.forall(
        leaves,
        lambda m: F.coalesce(F.forall(F.map_values(m), lambda v: F.schema_of_variant(v) == "STRING"), F.lit(False)),
    )
    return F.coalesce(texts, F.lit(False))


def check_answer_maps(documents: DataFrame, document: str = "document") -> DataFrame:
    """Tolerant reading: ``valid`` and the parsed map, null where the document needs a human."""
    checked = documents.withColumn("valid", is_answer_map(F.col(document)))
    return checked.withColumn("answers", F.when(F.col("valid"), F.from_json(document, schemas.ANSWER_MAP))).drop(document)


def topic_rows(documents: DataFrame, document: str = "document") -> DataFrame:
    """``{topic: {year: {exam type: [keys]}}}`` as rows."""
    keep = [c for c in documents.columns if c != document]
    topics = documents.select(*keep, F.explode(F.from_json(document, schemas.TOPIC_MAP)).alias("topic", "years"))
    years = topics.select(*keep, "topic", F.explode("years").alias("year", "types"))
    types = years.select(*keep, "topic", "year", F.explode("types").alias("exam_type", "keys"))
    return types.select(*keep, "topic", whole_number(F.col("year"), "int").alias("year"), "exam_type", F.explode("keys").alias("raw_key"))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return usable_regions(spark.read.schema(schemas.EXPORT).json(path, multiLine=True))


def usable_regions(export: DataFrame) -> DataFrame:
    """Annotated images of an export: entries without a local file go, as do regions without a label or points.

    Duplicated names stay, and ``dropped_regions`` says how many regions an image lost.
    """
    usable = F.filter(
        F.coalesce("label", F.array().cast("array<struct<polygonlabels:array<string>,points:array<array<double>>>>")),
        lambda r: F.try_element_at(r["polygonlabels"], F.lit(1)).isNotNull() & (F.coalesce(F.size(r["points"]), F.lit(0)) > 0),
    )
    regions = F.transform(
        usable,
        lambda r: F.struct(
            F.element_at(r["polygonlabels"], 1).alias("label"),
            geometry.percent_to_normalised(geometry.from_pairs(r["points"])).alias("polygon_norm"),
        ),
    )
    local = paths.local_file_path(F.col("image"))
    lost = F.greatest(F.coalesce(F.size("label"), F.lit(0)), F.lit(0)) - F.size(regions)
    return export.select(
        paths.basename(local).alias("filename"), regions.alias("regions"), lost.alias("dropped_regions")
    ).filter(F.col("filename").isNotNull())


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TASKS).json(path, multiLine=True).withColumnRenamed("id", "task_id")


def read_path_list(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of a list of paths, trimmed."""
    line = unicode_trim(F.col("value"))
    return spark.read.text(path).select(line.alias("path")).filter(F.col("path") != "")


def with_presence(listed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Listed paths with ``missing`` set where no such file exists; a mistyped line costs only itself."""
    known = manifest.select(F.col("object_key").alias("path"), F.lit(True).alias("_here")).distinct()
    return listed.join(known, "path", "left").select(*listed.columns, F.col("_here").isNull().alias("missing"))
