"""Training data over the embeddings and documents tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import dataset, draws
from paperloom.workload.labelling import _RINGS, polygons
from paperloom.workload.scalars import PAGE_KEYS_SQL, page_keys
from paperloom.workload.views import Tables


def _annotated(spark, folder):
    """An annotated image per embedding; names repeat, one in eleven has no regions."""
    i = F.col("vec_id")
    region = F.array(F.struct("label", "polygon_norm"))
    return polygons(spark, folder).select(
        i.alias("ord"),
        F.concat(F.lit("p"), (i % 397).cast("string"), F.lit(".jpg")).alias("filename"),
        F.filter(region, lambda _: i % 11 != 3).alias("regions"),
    )


def class_map(spark, folder):
    shown = _annotated(spark, folder).select(F.explode("regions").alias("r")).select("r.label")
    return dataset.class_map(shown)


def _labels(spark, folder):
    return dataset.label_files(_annotated(spark, folder), class_map(spark, folder))


def label_files(spark, folder):
    return _labels(spark, folder).select("filename", "first_seen", "copies", F.md5("label_text").alias("label_text"))


def dataset_split(spark, folder):
    names = Tables(spark, folder).read("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("filename"))
    return draws.split_dataset(names, "filename", 0.8, "seed0")


def _built(spark, folder):
    i = F.col("vec_id")
    here = Tables(spark, folder).read("embeddings").filter(i % 5 != 1).select(F.concat(F.lit("p"), (i % 397).cast("string"), F.lit(".jpg")).alias("filename"))
    return dataset.build_dataset(_labels(spark, folder), here, 0.8, "seed0")


def dataset_missing(spark, folder):
    return _built(spark, folder).filter(~F.col("present")).select("filename")


def dataset_counts(spark, folder):
    return dataset.split_counts(_built(spark, folder))


def sample_pages(spark, folder):
    return draws.sample_rows(page_keys(spark, folder).select("doc_id", "object_key"), "doc_id", 100, "pool")


def _outcomes(spark, folder):
    keys = page_keys(spark, folder)
    i = F.col("doc_id")
    listed = keys.select(i.alias("ord"), F.col("object_key").alias("path"), (i % 9 == 4).alias("missing"))
    held = keys.filter(i % 10 == 3).select(F.concat(F.split("object_key", "/")[0], F.lit("_"), F.split("object_key", "/")[3], F.lit("_page_"), i.cast("string"), F.lit(".jpg")).alias("name"))
    return dataset.pool_outcomes(listed, held)


def pool_pages(spark, folder):
    return _outcomes(spark, folder)


def pool_outcomes(spark, folder):
    return dataset.outcome_counts(_outcomes(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (class_map, label_files, dataset_split, dataset_missing, dataset_counts, sample_pages, pool_pages, pool_outcomes)
}

_CLASSES = f"""{_RINGS}, annotated AS (SELECT vec_id AS ord, 'p' || (vec_id % 397)::VARCHAR || '.jpg' AS filename, label, ring,
    vec_id % 11 <> 3 AS drawn FROM rings),
  classes AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS class_id FROM (SELECT DISTINCT label FROM annotated WHERE drawn)),
  last_seen AS (SELECT filename, min(ord) AS first_seen, max(ord) AS ord, count(*) AS copies FROM annotated GROUP BY 1),
  texts AS (SELECT s.filename, s.first_seen, s.copies, CASE WHEN a.drawn THEN c.class_id::VARCHAR || ' ' || array_to_string(
      list_transform(a.ring, lambda p: printf('%.6f', p.x) || ' ' || printf('%.6f', p.y)), ' ') ELSE '' END AS label_text
    FROM last_seen s JOIN annotated a USING (filename, ord) LEFT JOIN classes c USING (label))"""


def _split(source: str) -> str:
    return f"""split AS (SELECT filename, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train'
      WHEN rn <= floor(n * 0.8::DOUBLE) + floor(n * (0.6::DOUBLE * (1.0::DOUBLE - 0.8::DOUBLE))) THEN 'val' ELSE 'test' END AS split FROM (
        SELECT filename, row_number() OVER (ORDER BY md5('seed0|' || filename), filename) AS rn, count(*) OVER () AS n FROM {source}))"""


_BUILT = f"""{_CLASSES}, {_split('texts')}, built AS (SELECT s.*, EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id % 5 <> 1
    AND 'p' || (e.vec_id % 397)::VARCHAR || '.jpg' = s.filename) AS present FROM split s)"""
_POOL = f"""{PAGE_KEYS_SQL}, o AS (SELECT doc_id AS ord, object_key AS path, doc_id % 9 = 4 AS missing, string_split(object_key, '/') AS p FROM page_keys),
  t AS (SELECT ord, path, missing, CASE WHEN NOT missing AND p[3] = 'pages'
      THEN p[1] || '_' || p[4] || '_' || regexp_replace(p[5], '\\.[^.]*$', '') || '.jpg' END AS target FROM o),
  held AS (SELECT DISTINCT p[1] || '_' || p[4] || '_page_' || ord::VARCHAR || '.jpg' AS target FROM o WHERE ord % 10 = 3),
  outcomes AS (SELECT ord, path, target, CASE WHEN missing THEN 'missing' WHEN target IS NULL THEN 'unrecognised'
      WHEN target IN (SELECT target FROM held) OR row_number() OVER (PARTITION BY target ORDER BY ord) > 1 THEN 'already present'
      ELSE 'saved' END AS outcome FROM t)"""

SQL = {
    "class_map": f"WITH {_CLASSES} SELECT class_id, label FROM classes",
    "label_files": f"WITH {_CLASSES} SELECT filename, first_seen, copies, md5(label_text) AS label_text FROM texts",
    "dataset_split": f"WITH names AS (SELECT 'd' || doc_id::VARCHAR AS filename FROM documents), {_split('names')} SELECT filename, split FROM split",
    "dataset_missing": f"WITH {_BUILT} SELECT filename FROM built WHERE NOT present",
    "dataset_counts": f"WITH {_BUILT} SELECT split, count(*) FILTER (present) AS images, count(*) FILTER (NOT present) AS missing FROM built GROUP BY 1",
    "sample_pages": f"WITH {PAGE_KEYS_SQL} SELECT doc_id, object_key FROM page_keys ORDER BY md5('pool|' || doc_id::VARCHAR), doc_id LIMIT 100",
    "pool_pages": f"WITH {_POOL} SELECT * FROM outcomes",
    "pool_outcomes": f"WITH {_POOL} SELECT outcome, count(*) AS pages FROM outcomes GROUP BY 1",
}
