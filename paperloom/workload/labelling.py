"""Annotation tasks over the pages table, predictions over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import geometry
from paperloom.operators import labelling
from paperloom.sources import documents, sinks
from paperloom.workload.views import Tables

ROOT = "/srv/data"


def tasks(spark, folder):
    """A task per page: three tasks share a file name, in three folders, one of which was synced."""
    i = F.col("page_id")
    rel = F.concat(F.lit("d"), (i % 3).cast("string"), F.lit("%5C"), F.when(i % 13 == 0, "PG%20").otherwise("pg%20"), F.floor(i / 3).cast("string"), F.lit(".jpg"))
    param = F.when(i % 5 == 0, "file").otherwise("d")
    uri = F.when(i % 7 == 5, F.col("url")).otherwise(F.concat(F.lit("/data/local-files/?"), param, F.lit("="), rel))
    data = F.when(i % 11 == 4, F.create_map(F.lit("page"), F.col("url"), F.lit("$undefined$"), uri)).otherwise(
        F.create_map(F.lit("$undefined$"), F.col("url"), F.lit("image"), uri)
    )

    def note(cancelled: bool, by):
        return F.struct(
            F.when(i % 9 != 0, F.lit("[1]")).alias("result"),
            F.lit(cancelled).alias("was_cancelled"),
            F.when(i % 6 == 1, F.lit(True)).alias("ground_truth"),
            (i / 2).alias("lead_time"),
            by.alias("completed_by"),
        )

    plain, nested = (i % 50).cast("string"), F.concat(F.lit('{"id": '), (i % 40).cast("string"), F.lit("}"))
    notes = (
        F.when(i % 4 == 0, F.array(note(True, plain)))
        .when(i % 4 == 1, F.array(note(True, plain), note(False, nested)))
        .when(i % 4 == 3, F.array(note(False, nested)))
    )
    return Tables(spark, folder).read("pages").select(
        i.alias("task_id"),
        data.alias("data"),
        i.bitwiseAND(1).cast("boolean").alias("is_labeled"),
        F.coalesce(notes, F.filter(F.array(note(True, plain)), lambda _: F.lit(False))).alias("annotations"),
        F.slice(F.array(F.struct((i / 100.0).alias("score"), F.lit("v1").alias("model_version"))), 1, (i % 3 == 0).cast("int")).alias("predictions"),
    )


def manifest(spark, folder):
    i = F.col("page_id")
    here = Tables(spark, folder).read("pages").filter((i % 3 == 0) | (i % 10 == 1))
    return here.select(F.concat(F.lit(f"{ROOT}/d"), (i % 3).cast("string"), F.lit("/"), F.when(i % 13 == 0, "PG ").otherwise("pg "), F.floor(i / 3).cast("string"), F.lit(".jpg")).alias("path"))


def located(spark, folder):
    return labelling.task_images(tasks(spark, folder), manifest(spark, folder), ROOT)


def task_paths(spark, folder):
    return located(spark, folder).select("task_id", "path", "resolved", "on_disk")


def unlabelled_tasks(spark, folder):
    return labelling.unlabelled(tasks(spark, folder)).select("task_id")


def stranded_tasks(spark, folder):
    return labelling.repair_plan(located(spark, folder))


def skipped_tasks(spark, folder):
    return labelling.skipped_plan(located(spark, folder))


def sweep_totals(spark, folder):
    found = located(spark, folder)
    return labelling.sweep_totals(labelling.repair_plan(found), labelling.skipped_plan(found))


def doomed_tasks(spark, folder):
    found = located(spark, folder)
    ids = labelling.doomed_ids(labelling.repair_plan(found), labelling.skipped_plan(found))
    return sinks.doomed_tasks(tasks(spark, folder), ids).select("task_id", "is_labeled")


def move_preview(spark, folder):
    """The first moves of the repair plan as a report shows them."""
    moves = stranded_tasks(spark, folder).filter("verdict = 'move'")
    shown, more = labelling.preview(moves, ["task_id"], labelling.MOVES_SHOWN)
    return shown.select("task_id", "target_id", F.lit(more).cast("long").alias("more"))


def moved_annotations(spark, folder):
    return labelling.moved_annotations(tasks(spark, folder), stranded_tasks(spark, folder))


def polygons(spark, folder):
    """A polygon per embedding: consecutive values are the points of a ring on a 1000 x 800 page."""
    v = F.col("embedding")
    at = F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1)
    norm = F.transform(at, lambda j: F.struct(
        (F.get(v, j * 2).cast("double") * 0.5 + 0.5).alias("x"), (F.get(v, j * 2 + 1).cast("double") * 0.5 + 0.5).alias("y")))
    return Tables(spark, folder).read("embeddings").select(
        "vec_id", F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"), norm.alias("polygon_norm")
    )


def _detections(spark, folder):
    shapes = polygons(spark, folder)
    pixels = geometry.normalised_to_pixel(F.col("polygon_norm"), F.lit(1000), F.lit(800))
    return shapes.select(
        "vec_id", (F.col("vec_id") % 40).alias("task_id"), "label", pixels.alias("polygon_px"), (F.col("vec_id") % 100 / 100.0).alias("score")
    )


def prediction_scores(spark, folder):
    scores = labelling.prediction_scores(tasks(spark, folder), _detections(spark, folder))
    return scores.withColumn("score", F.round("score", 6))


def prediction_payloads(spark, folder):
    """Each detection as an import payload, told by its sizes and points."""
    result = labelling.region_result(F.col("polygon_px"), F.col("label"), F.col("score"), F.lit(1000), F.lit(800))
    sent = _detections(spark, folder).select("vec_id", result.alias("r"))
    points = F.array_join(F.transform("r.value.points", lambda p: F.format_string("%.3f,%.3f", p[0], p[1])), " ")
    return sent.select("vec_id", "r.type", "r.original_width", "r.original_height", "r.score", F.element_at("r.value.polygonlabels", 1).alias("label"), F.md5(points).alias("points"))


def polygon_bounds(spark, folder):
    box = geometry.bounds(F.col("polygon_px"))
    return _detections(spark, folder).select("vec_id", box["left"].alias("left_x"), box["top"].alias("top_y"), box["right"].alias("right_x"), box["bottom"].alias("bottom_y"))


def export_regions(spark, folder):
    """Annotated images as exported, with regions that lost their label or points."""
    shapes = polygons(spark, folder)
    i = F.col("vec_id")
    pairs = F.transform("polygon_norm", lambda p: F.array(p["x"] * 100.0, p["y"] * 100.0))
    bad = F.struct(F.when(i % 2 == 0, F.array(F.lit("x"))).alias("polygonlabels"), F.when(i % 2 == 1, pairs).alias("points"))
    good = F.struct(F.array("label").alias("polygonlabels"), pairs.alias("points"))
    image = F.when(i % 9 == 2, F.lit("s3://bucket/a.jpg")).otherwise(F.concat(F.lit("/data/local-files/?d=batch%5Cimg%20"), i.cast("string"), F.lit(".jpg")))
    exported = shapes.select(image.alias("image"), F.when(i % 4 == 0, F.array(bad, good)).otherwise(F.array(good)).alias("label"))
    found = documents.usable_regions(exported)
    first = F.element_at("regions", 1)
    return found.select("filename", F.size("regions").cast("long").alias("kept"), F.col("dropped_regions").cast("long").alias("dropped"),
                        first["label"].alias("label"), F.round(F.element_at(first["polygon_norm"], 1)["x"], 6).alias("x0"))


QUERIES = {
    f.__name__: f
    for f in (
        task_paths,
        unlabelled_tasks,
        stranded_tasks,
        skipped_tasks,
        sweep_totals,
        doomed_tasks,
        move_preview,
        moved_annotations,
        prediction_scores,
        prediction_payloads,
        polygon_bounds,
        export_regions,
    )
}

_TASKS = """tasks AS (SELECT page_id AS task_id, page_id & 1 = 1 AS is_labeled,
    CASE WHEN page_id % 7 <> 5 THEN 'd' || (page_id % 3)::VARCHAR || '/' || CASE WHEN page_id % 13 = 0 THEN 'PG ' ELSE 'pg ' END
      || (page_id // 3)::VARCHAR || '.jpg' END AS path,
    page_id % 3 = 0 OR page_id % 10 = 1 AS synced, page_id % 4 IN (0, 1) AS cancelled, page_id % 4 IN (1, 3) AS completed,
    CASE page_id % 4 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS held FROM pages),
  located AS (SELECT *, coalesce(synced AND path IS NOT NULL, false) AS on_disk, string_split(path, '/')[-1] AS file FROM tasks),
  twins AS (SELECT file, count(*) AS live, min(task_id) AS twin FROM located WHERE on_disk GROUP BY 1),
  judged AS (SELECT l.*, coalesce(t.live, 0) AS live, t.twin FROM located l LEFT JOIN twins t USING (file)),
  repair AS (SELECT task_id, verdict, CASE WHEN verdict = 'move' THEN twin END AS target_id,
    CASE WHEN path IS NULL THEN 'no local-file URI in the task' WHEN verdict = 'left' THEN live::VARCHAR || ' live tasks hold ' || file END AS reason,
    CASE WHEN verdict = 'move' THEN held ELSE 0 END AS annotations FROM (
      SELECT *, CASE WHEN path IS NULL THEN 'left' WHEN on_disk THEN CASE WHEN live > 1 THEN 'left' ELSE 'live' END
        WHEN live <> 1 THEN 'left' WHEN held > 0 THEN 'move' ELSE 'delete' END AS verdict FROM judged)),
  holders AS (SELECT lower(path) AS folded, count(*) AS n FROM located WHERE path IS NOT NULL GROUP BY 1),
  skipped AS (SELECT task_id, CASE WHEN reason IS NULL THEN 'delete' ELSE 'keep' END AS verdict,
    reason IS NULL AND on_disk AS with_image, reason FROM (
      SELECT l.*, CASE WHEN completed THEN 'also holds a completed annotation' WHEN path IS NULL THEN 'no local-file URI in the task'
        WHEN h.n > 1 THEN h.n::VARCHAR || ' tasks hold ' || file END AS reason
      FROM located l LEFT JOIN holders h ON h.folded = lower(l.path) WHERE cancelled))"""
_RINGS = """rings AS (SELECT vec_id, 'c' || label::VARCHAR AS label, list_transform(range(len(embedding) // 2),
    lambda j: {'x': embedding[j * 2 + 1]::DOUBLE * 0.5 + 0.5, 'y': embedding[j * 2 + 2]::DOUBLE * 0.5 + 0.5}) AS ring FROM embeddings),
  pixels AS (SELECT vec_id, label, list_transform(ring, lambda p: trunc(p.x * 1000)::INT) AS xs,
    list_transform(ring, lambda p: trunc(p.y * 800)::INT) AS ys FROM rings)"""

SQL = {
    "task_paths": f"WITH {_TASKS} SELECT task_id, path, '/srv/data/' || path AS resolved, on_disk FROM located",
    "unlabelled_tasks": "SELECT page_id AS task_id FROM pages WHERE page_id % 2 = 0 AND page_id % 3 <> 0",
    "stranded_tasks": f"WITH {_TASKS} SELECT * FROM repair",
    "skipped_tasks": f"WITH {_TASKS} SELECT * FROM skipped",
    "sweep_totals": f"""WITH {_TASKS}
        SELECT 'repair' AS plan, count(*) FILTER (verdict = 'move') AS moves, sum(annotations)::BIGINT AS annotations,
          count(*) FILTER (verdict = 'delete') AS deletions, 0 AS images, count(*) FILTER (verdict = 'left') AS kept FROM repair
        UNION ALL SELECT 'skipped', 0, 0, count(*) FILTER (verdict = 'delete'), count(*) FILTER (with_image),
          count(*) FILTER (verdict = 'keep') FROM skipped""",
    "doomed_tasks": f"""WITH {_TASKS} SELECT task_id, is_labeled FROM tasks WHERE task_id IN (
        SELECT task_id FROM repair WHERE verdict IN ('move', 'delete') UNION SELECT task_id FROM skipped WHERE verdict = 'delete')""",
    "move_preview": f"""WITH {_TASKS}, m AS (SELECT * FROM repair WHERE verdict = 'move')
        SELECT task_id, target_id, greatest((SELECT count(*) FROM m) - 5, 0) AS more FROM m ORDER BY task_id LIMIT 5""",
    "moved_annotations": f"""WITH {_TASKS}, notes AS (
        SELECT page_id AS task_id, 0 AS place, page_id % 4 <> 3 AS was_cancelled, page_id FROM pages WHERE page_id % 4 <> 2
        UNION ALL SELECT page_id, 1, false, page_id FROM pages WHERE page_id % 4 = 1)
        SELECT n.task_id, r.target_id, n.place, CASE WHEN page_id % 9 <> 0 THEN '[1]' ELSE '[]' END AS result, n.was_cancelled,
          page_id % 6 = 1 AS ground_truth, page_id / 2 AS lead_time,
          CASE WHEN n.was_cancelled THEN (page_id % 50)::VARCHAR ELSE (page_id % 40)::VARCHAR END AS completed_by
        FROM notes n JOIN repair r USING (task_id) WHERE r.verdict = 'move'""",
    "prediction_scores": """WITH m AS (SELECT vec_id % 40 AS task_id, avg(vec_id % 100 / 100.0) AS score, count(*) AS regions FROM embeddings GROUP BY 1)
        SELECT p.page_id AS task_id, round(coalesce(m.score, 0.0)::DOUBLE, 6) AS score, coalesce(m.regions, 0) AS regions
        FROM pages p LEFT JOIN m ON m.task_id = p.page_id""",
    "prediction_payloads": f"""WITH {_RINGS}
        SELECT vec_id, 'polygonlabels' AS type, 1000 AS original_width, 800 AS original_height, (vec_id % 100 / 100.0)::DOUBLE AS score, label,
          md5(array_to_string(list_transform(range(len(xs)), lambda j:
            printf('%.3f', xs[j + 1] / 1000 * 100.0) || ',' || printf('%.3f', ys[j + 1] / 800 * 100.0)), ' ')) AS points FROM pixels""",
    "polygon_bounds": f"""WITH {_RINGS}
        SELECT vec_id, list_min(xs) AS left_x, list_min(ys) AS top_y, list_max(xs) AS right_x, list_max(ys) AS bottom_y FROM pixels""",
    "export_regions": f"""WITH {_RINGS}
        SELECT 'img ' || vec_id::VARCHAR || '.jpg' AS filename, 1 AS kept, (vec_id % 4 = 0)::BIGINT AS dropped, label,
          round(ring[1].x * 100.0 / 100.0, 6) AS x0 FROM rings WHERE vec_id % 9 <> 2""",
}
