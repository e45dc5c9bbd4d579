"""Annotation projects: where a task's image is, which tasks to clean up, what to send back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import geometry, paths

# Why a task is left alone, as reports word it.
NO_PATH = "no local-file URI in the task"
COMPLETED = "also holds a completed annotation"
LIVE_HOLDERS = "%d live tasks hold %s"
FILE_HOLDERS = "%d tasks hold %s"

# How many entries a plan's report names.
MOVES_SHOWN = 5


def task_images(tasks: DataFrame, manifest: DataFrame, root: str) -> DataFrame:
    """Tasks with the local path their data names and whether that file exists.

    *manifest* holds the absolute ``path`` of every file below *root*.
    """
    located = tasks.withColumn("path", paths.task_image_path(F.col("data")))
    located = located.withColumn("resolved", paths.resolve_against(F.col("path"), root))
    known = manifest.select(F.col("path").alias("resolved"), F.lit(True).alias("_here")).distinct()
    return located.join(known, "resolved", "left").withColumn("on_disk", F.col("_here").isNotNull()).drop("_here")


def unlabelled(tasks: DataFrame) -> DataFrame:
    """Tasks nobody labelled and nothing was predicted for."""
    return tasks.filter(~F.col("is_labeled") & (F.coalesce(F.size("predictions"), F.lit(0)) <= 0))


def repair_plan(located: DataFrame) -> DataFrame:
    """What to do with tasks whose image moved: (task_id, verdict, target_id, reason, annotations).

    A stranded task gives its annotations to the one task whose image exists under the same name, or is
    deleted when it has none to give. Without exactly one such twin it is left alone, and so are two
    live tasks over one name.
    """
    name = paths.basename(F.col("path"))
    named = located.select(
        "task_id", "path", "on_disk", name.alias("_name"), F.greatest(F.coalesce(F.size("annotations"), F.lit(0)), F.lit(0)).alias("_held")
    )
    live = named.filter("on_disk").groupBy("_name").agg(F.count(F.lit(1)).alias("_live"), F.min("task_id").alias("_twin"))
    joined = named.join(live, "_name", "left")
    twins = F.coalesce(F.col("_live"), F.lit(0))
    crowd = F.format_string(LIVE_HOLDERS, twins, F.col("_name"))
    verdict = (
        F.when(F.col("path").isNull(), "left")
        .when(F.col("on_disk"), F.when(twins > 1, "left").otherwise("live"))
        .when(twins != 1, "left")
        .when(F.col("_held") > 0, "move")
        .otherwise("delete")
    )
    reason = F.when(F.col("path").isNull(), NO_PATH).when(verdict == "left", crowd)
    return joined.select(
        "task_id",
        verdict.alias("verdict"),
        F.when(verdict == "move", F.col("_twin")).alias("target_id"),
        reason.alias("reason"),
        F.when(verdict == "move", F.col("_held")).otherwise(0).alias("annotations"),
    )


def skipped_plan(located: DataFrame) -> DataFrame:
    """What to do with tasks an annotator skipped: (task_id, verdict, with_image, reason).

    Kept when somebody also completed the task, when it names no file, or when another task holds the
    same file (names compared without case); deleted otherwise, with the image if it is still there.
    """
    folded = F.lower("path")
    holders = located.filter("path IS NOT NULL").groupBy(folded.alias("_folded")).agg(F.count(F.lit(1)).alias("_holders"))
    cancelled = located.filter(F.exists("annotations", lambda a: F.coalesce(a["was_cancelled"], F.lit(False))))
    joined = cancelled.withColumn("_folded", folded).join(holders, "_folded", "left")
    completed = F.exists("annotations", lambda a: ~F.coalesce(a["was_cancelled"], F.lit(False)))
    reason = (
        F.when(completed, COMPLETED)
        .when(F.col("path").isNull(), NO_PATH)
        .when(F.col("_holders") > 1, F.format_string(FILE_HOLDERS, F.col("_holders"), paths.basename(F.col("path"))))
    )
    kept = reason.isNotNull()
    return joined.select(
        "task_id",
        F.when(kept, "keep").otherwise("delete").alias("verdict"),
        (~kept & F.col("on_disk")).alias("with_image"),
        reason.alias("reason"),
    )


def sweep_totals(repair: DataFrame, skipped: DataFrame) -> DataFrame:
    """Both plans' totals, a row per plan."""
    zero = F.lit(0).cast("long")
    first = repair.agg(
        F.count_if(F.col("verdict") == "move").alias("moves"),
        F.coalesce(F.sum("annotations"), zero).cast("long").alias("annotations"),
        F.count_if(F.col("verdict") == "delete").alias("deletions"),
        zero.alias("images"),
        F.count_if(F.col("verdict") == "left").alias("kept"),
    )
    second = skipped.agg(
        zero.alias("moves"),
        zero.alias("annotations"),
        F.count_if(F.col("verdict") == "delete").alias("deletions"),
        F.count_if("with_image").alias("images"),
        F.count_if(F.col("verdict") == "keep").alias("kept"),
    )
    return first.withColumn("plan", F.lit("repair")).unionByName(second.withColumn("plan", F.lit("skipped")))


def doomed_ids(repair: DataFrame, skipped: DataFrame) -> DataFrame:
    """Every task either plan destroys: the moved and the deleted."""
    gone = repair.filter(F.col("verdict").isin("move", "delete")).select("task_id")
    return gone.union(skipped.filter(F.col("verdict") == "delete").select("task_id")).distinct()


def moved_annotations(tasks: DataFrame, repair: DataFrame) -> DataFrame:
    """Annotations to recreate on their new task, with the defaults the receiving side needs.

    ``completed_by`` is an id or a user object; the id is what is kept.
    """
    moves = repair.filter(F.col("verdict") == "move").select("task_id", "target_id")
    given = tasks.join(moves, "task_id").select("task_id", "target_id", F.posexplode("annotations").alias("place", "a"))
    who = F.coalesce(F.get_json_object("a.completed_by", "$.id"), F.when(~F.col("a.completed_by").startswith("{"), F.col("a.completed_by")))
    return given.select(
        "task_id",
        "target_id",
        "place",
        F.coalesce("a.result", F.lit("[]")).alias("result"),
        F.coalesce("a.was_cancelled", F.lit(False)).alias("was_cancelled"),
        F.coalesce("a.ground_truth", F.lit(False)).alias("ground_truth"),
        F.col("a.lead_time").alias("lead_time"),
        who.alias("completed_by"),
    )


def prediction_scores(tasks: DataFrame, detections: DataFrame) -> DataFrame:
    """Mean region score of each task, 0.0 where nothing was found."""
    means = detections.groupBy("task_id").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("regions"))
    joined = tasks.select("task_id").join(means, "task_id", "left")
    return joined.select("task_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("regions", F.lit(0).cast("long")).alias("regions"))


def region_result(polygon_px: Column, label: Column, score: Column, width: Column, height: Column) -> Column:
    """One detection as the annotation server imports it."""
    points = F.transform(geometry.pixel_to_percent(polygon_px, width, height), lambda p: F.array(p["x"], p["y"]))
    return F.struct(
        F.lit("label").alias("from_name"),
        F.lit("image").alias("to_name"),
        F.lit("polygonlabels").alias("type"),
        width.alias("original_width"),
        height.alias("original_height"),
        score.alias("score"),
        F.struct(points.alias("points"), F.array(label).alias("polygonlabels")).alias("value"),
    )


def preview(rows: DataFrame, order: list[str], n: int) -> tuple[DataFrame, int]:
    """The first *n* rows of a plan, and how many more there are."""
    return rows.orderBy(*order).limit(n), max(rows.count() - n, 0)
