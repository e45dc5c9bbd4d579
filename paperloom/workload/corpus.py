"""The corpus catalogue: walks, page order, renames, topics, reconciling."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import paths
from paperloom.operators import corpus
from paperloom.sources import files
from paperloom.workload.scalars import IMAGE_SQL, NATURAL_SQL, PAGE_KEYS_SQL, page_keys
from paperloom.workload.views import Tables, with_views


def walk_pages(spark, folder):
    return files.book_pages(page_keys(spark, folder), "processed")


def page_numbers(spark, folder):
    pages = files.book_pages(page_keys(spark, folder), "processed").select("object_key").distinct()
    return corpus.number_pages(pages).select("object_key", "directory", "number", "target")


def _scans(spark, folder):
    """A raw scan per document; half of the names are already page numbers, a tenth has no twin."""
    i = F.col("doc_id")
    stem = F.when(i % 2 == 0, F.format_string("%03d", F.floor(i / 50) + 1)).otherwise(F.concat(F.lit("scan"), i.cast("string")))
    place = F.concat_ws("/", "source", (i % 4 + 2016).cast("string"))
    suffix = F.when(i % 3 == 0, "png").otherwise("jpg")
    scans = Tables(spark, folder).read("documents").select("doc_id", place.alias("place"), stem.alias("stem"), suffix.alias("suffix"))
    raw = scans.filter(i % 7 != 3).select(F.concat_ws("/", "place", F.concat("stem", F.lit("."), "suffix")).alias("object_key")).distinct()
    twins = scans.filter(i % 10 != 0).select(F.col("place").alias("directory"), "stem").distinct()
    return raw, twins


def rename_plan(spark, folder):
    raw, twins = _scans(spark, folder)
    return corpus.plan_renames(corpus.number_pages(raw), twins).select("object_key", "target", "outcome")


def pending_scans(spark, folder):
    keys = page_keys(spark, folder).filter(paths.is_image(F.col("object_key"))).select("doc_id", "object_key")
    as_raw = keys.select(F.regexp_replace("object_key", "/processed/", "/raw/").alias("object_key")).distinct()
    done = keys.filter((F.col("doc_id") % 3 == 0) & (F.col("object_key").contains("/processed/"))).select(
        F.regexp_replace("object_key", r"\.[^./]+$", ".png").alias("object_key")
    )
    return corpus.pending_scans(as_raw, done)


def pending_years(spark, folder):
    where = paths.page_subject_year(F.col("object_key"))
    years = files.book_pages(page_keys(spark, folder), "processed").select(where["subject"].alias("subject"), where["year"].alias("year")).distinct()
    done = years.filter(F.col("year") % 2 == F.length("subject") % 2).select("subject", F.col("year").alias("identifier"))
    return corpus.pending_years(years, done)


def question_tree(spark, folder):
    """One file per part under subject/year/option/part, with the strays a hand-edited tree has."""
    i = F.col("p_partkey")
    year = F.when(i % 40 == 7, "misc").otherwise((F.floor(i / 250) % 7 + 2018).cast("string"))
    option = F.concat((i % 10 + 1).cast("string"), F.when(i % 50 == 13, "a").otherwise(""))
    part = F.when(F.col("p_size") % 3 == 0, "B").when(F.col("p_size") % 25 == 1, "a").otherwise("A")
    stem = F.concat(F.when(i % 30 == 11, "n").otherwise(""), (F.floor(i / 10) % 25 + 1).cast("string"), F.when(i % 300 == 200, "9" * 20).otherwise(""))
    suffix = F.when(i % 20 == 5, "txt").when(i % 2 == 0, "png").otherwise("JPG")
    subject = F.concat(F.lit("subject"), (F.floor(i / 1750)).cast("string"))
    # Dealt out first: a file of few row groups would have one task work out and take apart every path.
    dealt = Tables(spark, folder).read("part").select("p_partkey", "p_size").repartition("p_partkey")
    return dealt.select(F.concat_ws("/", subject, year, option, part, F.concat(stem, F.lit("."), suffix)).alias("object_key"))


def question_images(spark, folder):
    return files.question_images(question_tree(spark, folder))


def seedable_images(spark, folder):
    return files.seedable_images(files.question_images(question_tree(spark, folder)))


def highest_numbers(spark, folder):
    return corpus.highest_numbers(files.question_images(question_tree(spark, folder)), ["subject", "year", "option", "part"])


def slots_taken(spark, folder):
    images = files.question_images(question_tree(spark, folder))
    i = F.col("p_partkey")
    wanted = Tables(spark, folder).read("part").select(
        "p_partkey",
        F.concat(F.lit("subject"), F.floor(i / 1750).cast("string")).alias("subject"),
        (i % 7 + 2018).cast("string").alias("year"),
        (i % 10 + 1).cast("string").alias("option"),
        F.lit("A").alias("part"),
        (F.col("p_size") % 25 + 1).alias("number"),
    )
    return corpus.slots_taken(wanted, images, ["subject", "year", "option", "part"]).select("p_partkey", "number")


def image_listing(spark, folder):
    return corpus.image_listing(Tables(spark, folder).images)


def _topic_map(t: Tables):
    """A hand-written map: a row per part names its topic, year, exam type and key."""
    i = F.col("p_partkey")
    names = t.subjects.select((F.col("subject_id")).alias("_s"), F.col("name").alias("subject"))
    return t.read("part").select(
        (i % 5).alias("_s"),
        F.concat(F.lit("topic "), F.col("p_type")).alias("topic"),
        (i % 6 + 2020).cast("int").alias("year"),
        F.when(i % 3 == 0, "CE").when(i % 11 == 0, "XX").otherwise("CT").alias("exam_type"),
        F.concat(F.when(F.col("p_size") % 2 == 0, " а").otherwise("B"), F.floor(i / 25 + 1).cast("string")).alias("raw_key"),
    ).join(names, "_s").drop("_s")


def topic_expansion(spark, folder):
    t = Tables(spark, folder)
    books = t.books.withColumn("year_value", F.col("year_value").cast("int"))
    return corpus.expand_topics(_topic_map(t), t.subjects, books, t.options, t.questions)


def mapping_counts(spark, folder):
    t = Tables(spark, folder)
    return corpus.mapping_counts(t.question_topics, t.topics)


def _sides(spark, folder):
    i = F.col("doc_id")
    d = Tables(spark, folder).read("documents").select(
        "doc_id", F.concat_ws("/", "source", "lang", F.concat(i.cast("string"), F.lit(".jpg"))).alias("object_key"), F.sha2("text", 256).alias("h")
    )
    rows = d.filter(i % 7 != 0).select("object_key", F.when(i % 11 == 0, F.reverse("h")).otherwise(F.col("h")).alias("content_hash"))
    found = d.filter(i % 13 != 0).select("object_key", F.col("h").alias("content_hash"))
    return rows, found


def reconcile_manifest(spark, folder):
    return corpus.reconcile(*_sides(spark, folder))


def reconcile_tree(spark, folder):
    rows, found = _sides(spark, folder)
    return corpus.reconcile_tree(rows, found.select("object_key"), found)


def seed_loads(spark, folder):
    """Seedable images with the keys their answers give them, and the load counts."""
    return corpus.load_counts(_admitted(spark, folder))


def admitted_answers(spark, folder):
    return _admitted(spark, folder).select("object_key", "answer", "keyed", "warning")


def _admitted(spark, folder):
    images = files.seedable_images(files.question_images(question_tree(spark, folder)))
    # The typed answers: an entry for two images in three, some blank, some not numbers.
    n = F.col("number") + F.col("option")
    typed = images.filter(n % 3 != 0).select(
        "subject", "year", F.col("option").cast("string").alias("option"), F.concat("part", F.col("number").cast("string")).alias("raw_key"),
        F.when(n % 5 == 0, "").when(n % 7 == 0, "x").when(n % 11 == 0, " ").otherwise((n % 5 + 1).cast("string")).alias("answer"),
    ).distinct()
    return corpus.admit_answers(images, typed)


QUERIES = {
    f.__name__: f
    for f in (
        walk_pages,
        page_numbers,
        rename_plan,
        pending_scans,
        pending_years,
        question_images,
        seedable_images,
        highest_numbers,
        slots_taken,
        image_listing,
        topic_expansion,
        mapping_counts,
        reconcile_manifest,
        reconcile_tree,
        admitted_answers,
        seed_loads,
    )
}

_WALK = f"""{PAGE_KEYS_SQL}, walked AS (SELECT * FROM page_keys WHERE split_part(object_key, '/', 2) = 'processed'
    AND split_part(object_key, '/', 3) = 'pages' AND {IMAGE_SQL.format('object_key')})"""
_STEM = "regexp_replace(split_part({0}, '/', -1), '\\.[^.]*$', '')"


def _numbered(source: str) -> str:
    """Numbering of the paths in *source* by directory, in natural order."""
    key = NATURAL_SQL.format(_STEM.format("object_key"))
    return f"""numbered AS (SELECT object_key, directory, number,
        directory || '/' || printf('%03d', number) || regexp_extract(object_key, '\\.[^.]*$') AS target FROM (
          SELECT object_key, directory, row_number() OVER (PARTITION BY directory ORDER BY natural_key, object_key) AS number FROM (
            SELECT object_key, regexp_replace(object_key, '/[^/]*$', '') AS directory, {key} AS natural_key FROM {source})))"""


QUESTION_TREE_SQL = r"""tree AS (SELECT 'subject' || (p_partkey // 1750)::VARCHAR || '/'
    || CASE WHEN p_partkey % 40 = 7 THEN 'misc' ELSE ((p_partkey // 250) % 7 + 2018)::VARCHAR END || '/'
    || (p_partkey % 10 + 1)::VARCHAR || CASE WHEN p_partkey % 50 = 13 THEN 'a' ELSE '' END || '/'
    || CASE WHEN p_size % 3 = 0 THEN 'B' WHEN p_size % 25 = 1 THEN 'a' ELSE 'A' END || '/'
    || CASE WHEN p_partkey % 30 = 11 THEN 'n' ELSE '' END || ((p_partkey // 10) % 25 + 1)::VARCHAR
    || CASE WHEN p_partkey % 300 = 200 THEN repeat('9', 20) ELSE '' END || '.'
    || CASE WHEN p_partkey % 20 = 5 THEN 'txt' WHEN p_partkey % 2 = 0 THEN 'png' ELSE 'JPG' END AS object_key FROM part),
  tree_images AS (SELECT split_part(object_key, '/', 1) AS subject, split_part(object_key, '/', 2) AS year,
    split_part(object_key, '/', 3) AS option, split_part(object_key, '/', 4) AS part,
    try_cast(regexp_extract(object_key, '/(\d+)\.[^./]+$', 1) AS BIGINT) AS number, regexp_extract(object_key, '/(\d+)\.[^./]+$', 1) AS digits, object_key
    FROM tree WHERE regexp_matches(object_key, '/\d+\.(png|JPG)$')),
  seedable AS (SELECT * REPLACE (year::INT AS year, option::INT AS option) FROM tree_images
    WHERE regexp_matches(year, '^\d+$') AND regexp_matches(option, '^\d+$') AND part IN ('A', 'B') AND number IS NOT NULL)"""
_SIDES = """d AS (SELECT doc_id, source || '/' || lang || '/' || doc_id::VARCHAR || '.jpg' AS object_key, sha256(text) AS h FROM documents),
  stored AS (SELECT object_key, CASE WHEN doc_id % 11 = 0 THEN reverse(h) ELSE h END AS h FROM d WHERE doc_id % 7 <> 0),
  found AS (SELECT object_key, h FROM d WHERE doc_id % 13 <> 0)"""
_RECONCILE = f"""WITH {_SIDES}
    SELECT object_key, 'missing' AS status FROM stored WHERE object_key NOT IN (SELECT object_key FROM found)
    UNION ALL SELECT object_key, 'orphaned' FROM found WHERE object_key NOT IN (SELECT object_key FROM stored)
    UNION ALL SELECT s.object_key, 'stale' FROM stored s JOIN found f USING (object_key) WHERE s.h <> f.h"""
_ADMITTED = f"""{QUESTION_TREE_SQL}, n AS (SELECT *, number + option AS n FROM seedable),
  typed AS (SELECT *, CASE WHEN n % 3 = 0 THEN NULL WHEN n % 5 = 0 THEN '' WHEN n % 7 = 0 THEN 'x' WHEN n % 11 = 0 THEN ' '
                           ELSE (n % 5 + 1)::VARCHAR END AS raw FROM n),
  admitted AS (SELECT subject, year, object_key,
    coalesce(raw <> '' AND (part = 'B' OR regexp_full_match(raw, '\\d+')), false) AS keyed,
    CASE WHEN raw <> '' AND (part = 'B' OR regexp_full_match(raw, '\\d+')) THEN raw END AS answer,
    CASE WHEN raw <> '' AND part = 'A' AND NOT regexp_full_match(raw, '\\d+') THEN 'part A answer is not a number' END AS warning
    FROM typed)"""

SQL = {
    "walk_pages": f"WITH {_WALK} SELECT doc_id, object_key FROM walked",
    "page_numbers": f"WITH {_WALK}, once AS (SELECT DISTINCT object_key FROM walked), {_numbered('once')} SELECT * FROM numbered",
    "rename_plan": f"""
        WITH RECURSIVE scans AS (SELECT doc_id, source || '/' || (doc_id % 4 + 2016)::VARCHAR AS place,
            CASE WHEN doc_id % 2 = 0 THEN printf('%03d', doc_id // 50 + 1) ELSE 'scan' || doc_id::VARCHAR END AS stem,
            CASE WHEN doc_id % 3 = 0 THEN 'png' ELSE 'jpg' END AS suffix FROM documents),
        raw AS (SELECT DISTINCT place || '/' || stem || '.' || suffix AS object_key FROM scans WHERE doc_id % 7 <> 3),
        twins AS (SELECT DISTINCT place AS directory, stem FROM scans WHERE doc_id % 10 <> 0),
        {_numbered('raw')},
        facts AS (SELECT n.*, n.object_key <> n.target AS changed,
            (SELECT max(o.number) FROM numbered o WHERE o.object_key = n.target) AS held_by,
            EXISTS (SELECT 1 FROM twins t WHERE t.directory = n.directory AND t.stem = {_STEM.format('n.object_key')})
              AND EXISTS (SELECT 1 FROM twins t WHERE t.directory = n.directory AND t.stem = printf('%03d', n.number)) AS risk,
            (SELECT min(m.number) FROM numbered m WHERE m.directory = n.directory
               AND {_STEM.format('m.object_key')} = printf('%03d', n.number)) AS mover
            FROM numbered n),
        blocked AS (
            SELECT directory, number FROM facts
            WHERE changed AND (coalesce(held_by > number, false) OR (risk AND coalesce(mover > number, true)))
            UNION SELECT f.directory, f.number FROM facts f JOIN blocked b ON f.directory = b.directory AND f.mover = b.number
                  WHERE f.changed AND f.risk)
        SELECT object_key, target, CASE WHEN NOT changed THEN 'unchanged'
            WHEN (directory, number) IN (SELECT (directory, number) FROM blocked) THEN 'taken' ELSE 'renamed' END AS outcome
        FROM facts""",
    "pending_scans": f"""
        WITH {PAGE_KEYS_SQL}, images AS (SELECT * FROM page_keys WHERE {IMAGE_SQL.format('object_key')}),
        done AS (SELECT regexp_replace(object_key, '\\.[^./]+$', '.png') AS twin FROM images
                 WHERE doc_id % 3 = 0 AND contains(object_key, '/processed/')),
        raw AS (SELECT DISTINCT replace(object_key, '/processed/', '/raw/') AS object_key FROM images),
        planned AS (SELECT object_key, regexp_replace(replace(object_key, '/raw/', '/processed/'), '\\.[^./]+$', '.png') AS twin FROM raw)
        SELECT object_key, twin, twin IN (SELECT twin FROM done) AS skipped FROM planned""",
    "pending_years": f"""
        WITH {_WALK}, years AS (SELECT DISTINCT split_part(object_key, '/', 1) AS subject, split_part(object_key, '/', 4) AS year FROM walked)
        SELECT * FROM years WHERE year::INT % 2 <> length(subject) % 2""",
    "question_images": f"WITH {QUESTION_TREE_SQL} SELECT * FROM tree_images",
    "seedable_images": f"WITH {QUESTION_TREE_SQL} SELECT * FROM seedable",
    "highest_numbers": f"WITH {QUESTION_TREE_SQL} SELECT subject, year, option, part, max(number) AS highest FROM tree_images GROUP BY ALL",
    "slots_taken": f"""WITH {QUESTION_TREE_SQL}
        SELECT p_partkey, p_size % 25 + 1 AS number FROM part WHERE EXISTS (SELECT 1 FROM tree_images t
          WHERE t.subject = 'subject' || (p_partkey // 1750)::VARCHAR AND t.year = (p_partkey % 7 + 2018)::VARCHAR
            AND t.option = (p_partkey % 10 + 1)::VARCHAR AND t.part = 'A' AND t.number = p_size % 25 + 1)""",
    "image_listing": with_views("images", "SELECT object_key, content_hash FROM images ORDER BY object_key"),
    "topic_expansion": with_views(
        "books options questions",
        """named AS (SELECT p_partkey % 5 AS subject_id, 'topic ' || p_type AS topic, p_partkey % 6 + 2020 AS year_value,
             CASE WHEN p_partkey % 3 = 0 THEN 'CE' WHEN p_partkey % 11 = 0 THEN 'XX' ELSE 'CT' END AS exam_type,
             CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS part, p_partkey // 25 + 1 AS question_number FROM part)
           SELECT DISTINCT n.subject_id, n.topic, q.question_id FROM named n
           JOIN books b ON b.subject_id = n.subject_id AND b.year_value = n.year_value
           JOIN options o ON o.book_id = b.book_id AND o.exam_type = n.exam_type
           JOIN questions q ON q.option_id = o.option_id AND q.part = n.part AND q.question_number = n.question_number""",
    ),
    "mapping_counts": with_views(
        "topics question_topics",
        """per AS (SELECT t.subject_id, count(*) AS mappings FROM question_topics m JOIN topics t USING (topic_id) GROUP BY 1)
           SELECT subject_id, mappings FROM per UNION ALL SELECT NULL, sum(mappings)::BIGINT FROM per""",
    ),
    "reconcile_manifest": _RECONCILE,
    "reconcile_tree": _RECONCILE,
    "admitted_answers": f"WITH {_ADMITTED} SELECT object_key, answer, keyed, warning FROM admitted",
    "seed_loads": f"WITH {_ADMITTED} SELECT subject, year, count(*) AS questions, count(*) FILTER (keyed) AS keyed FROM admitted GROUP BY 1, 2",
}
