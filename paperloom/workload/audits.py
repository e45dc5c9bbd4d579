"""Censuses and answer-key checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import audit
from paperloom.sources import documents, files
from paperloom.workload.corpus import QUESTION_TREE_SQL, question_tree
from paperloom.workload.views import Tables


def _images(spark, folder):
    return files.question_images(question_tree(spark, folder))


def census_parts(spark, folder):
    return audit.part_counts(_images(spark, folder))


def census_years(spark, folder):
    return audit.year_census(audit.part_counts(_images(spark, folder)))


def census_subjects(spark, folder):
    return audit.subject_census(audit.year_census(audit.part_counts(_images(spark, folder))))


def _answer_entries(spark, folder):
    """The answers of a year: 200 parts make a year, ten options of twenty questions."""
    i = F.col("p_partkey")
    part = F.when(F.floor(i / 10) % 3 == 0, "B").otherwise("A")
    number = (F.floor(i / 10) % 20 + 1).cast("string")
    answer = F.when(part == "A", (F.col("p_size") % 5 + 1).cast("string")).when(F.col("p_size") % 3 == 0, "Б4").otherwise("х")
    return Tables(spark, folder).read("part").filter((F.col("p_size") > 2) | (F.floor(i / 200) % 4 == 1)).select(
        F.floor(i / 200).alias("y"),
        ((i * 7) % 10 + 1).cast("int").alias("option"),
        (i % 10).alias("written"),
        i.alias("id"),
        F.concat(part, number).alias("label"),
        answer.alias("answer"),
    )


def _documents(spark, folder):
    """One answers file per year of a subject; some are missing, cut off or hold bare numbers.

    A file's entries come from 200 consecutive part keys, so no group is larger than that.
    """
    entries = _answer_entries(spark, folder)
    quoted = F.concat(F.lit('"'), F.col("label"), F.lit('": "'), F.col("answer"), F.lit('"'))
    per_option = entries.groupBy("y", "written", "option").agg(F.array_sort(F.collect_list(F.struct("id", quoted.alias("t")))).alias("e"))
    option = F.concat(F.lit('"'), F.col("option").cast("string"), F.lit('": {'), F.array_join(F.transform("e", lambda e: e["t"]), ", "), F.lit("}"))
    per_year = per_option.groupBy("y").agg(F.array_sort(F.collect_list(F.struct("written", option.alias("t")))).alias("o"))
    text = F.concat(F.lit("{"), F.array_join(F.transform("o", lambda o: o["t"]), ", "), F.lit("}"))
    broken = F.when(F.col("y") % 7 == 3, F.substring(text, 1, 40)).when(F.col("y") % 7 == 5, F.replace(text, F.lit('"2"'), F.lit("2"))).otherwise(text)
    return per_year.filter(F.col("y") % 9 != 4).select(
        F.concat(F.lit("s"), (F.col("y") % 3).cast("string")).alias("subject"), F.col("y").cast("string").alias("year"), broken.alias("document")
    )


def _pictures(spark, folder):
    i = F.col("p_partkey")
    return Tables(spark, folder).read("part").filter(i % 17 != 2).select(
        F.concat(F.lit("s"), (F.floor(i / 200) % 3).cast("string")).alias("subject"),
        F.floor(i / 200).cast("string").alias("year"),
        F.when(F.floor(i / 10) % 3 == 0, "b").otherwise("A").alias("part"),
        (F.floor(i / 10) % 20 + 1 + F.when(i % 200 == 7, 30).otherwise(0)).alias("number"),
    )


def _checked(spark, folder):
    return documents.check_answer_maps(_documents(spark, folder))


def validate_years(spark, folder):
    images = _pictures(spark, folder)
    return audit.validate_years(images.select("subject", "year").distinct(), _checked(spark, folder), images)


def validation_issues(spark, folder):
    return audit.issue_totals(validate_years(spark, folder))


def key_differences(spark, folder):
    return audit.key_differences(_checked(spark, folder), _pictures(spark, folder))


def listed_differences(spark, folder):
    return audit.listed(key_differences(spark, folder), ["subject", "year", "side"], "key", 3)


def answer_maps(spark, folder):
    """Every answer of the readable files, a row each."""
    checked = _checked(spark, folder).filter("valid")
    options = checked.select("subject", "year", F.explode("answers").alias("option", "labels"))
    return options.select("subject", "year", "option", F.explode("labels").alias("label", "answer"))


QUERIES = {
    f.__name__: f
    for f in (
        census_parts,
        census_years,
        census_subjects,
        answer_maps,
        key_differences,
        listed_differences,
        validate_years,
        validation_issues,
    )
}

_CENSUS = f"""{QUESTION_TREE_SQL},
  counts AS (SELECT subject, year, option, part, count(*) AS images FROM tree_images GROUP BY ALL),
  shared AS (SELECT *, count(*) OVER (PARTITION BY subject, year, part, images) AS n FROM counts),
  parts AS (SELECT subject, year, option, part, images, n < max(n) OVER (PARTITION BY subject, year, part) AS off_mode FROM shared),
  years AS (SELECT subject, year, count(DISTINCT option) AS options, count(*) AS folders, sum(images)::BIGINT AS images,
      count(*) FILTER (off_mode) AS off_mode_parts, count(DISTINCT option) < 10 AS missing_options,
      count(DISTINCT option) >= 10 AND NOT bool_or(off_mode) AS complete FROM parts GROUP BY 1, 2)"""
_ENTRIES = """entries AS (SELECT p_partkey // 200 AS y, (p_partkey * 7) % 10 + 1 AS option, p_partkey % 10 AS written,
    CASE WHEN (p_partkey // 10) % 3 = 0 THEN 'B' ELSE 'A' END || ((p_partkey // 10) % 20 + 1)::VARCHAR AS label,
    CASE WHEN (p_partkey // 10) % 3 <> 0 THEN (p_size % 5 + 1)::VARCHAR WHEN p_size % 3 = 0 THEN 'Б4' ELSE 'х' END AS answer
    FROM part WHERE p_size > 2 OR (p_partkey // 200) % 4 = 1),
  files AS (SELECT y, bool_or(answer = '2') AS has_two FROM entries GROUP BY y),
  docs AS (SELECT y, 's' || (y % 3)::VARCHAR AS subject, y::VARCHAR AS year, y % 7 <> 3 AND NOT (y % 7 = 5 AND has_two) AS valid
           FROM files WHERE y % 9 <> 4),
  good AS (SELECT d.subject, d.year, e.* FROM docs d JOIN entries e USING (y) WHERE d.valid),
  pictures AS (SELECT 's' || ((p_partkey // 200) % 3)::VARCHAR AS subject, (p_partkey // 200)::VARCHAR AS year,
     CASE WHEN (p_partkey // 10) % 3 = 0 THEN 'B' ELSE 'A' END
       || ((p_partkey // 10) % 20 + 1 + CASE WHEN p_partkey % 200 = 7 THEN 30 ELSE 0 END)::VARCHAR AS key
     FROM part WHERE p_partkey % 17 <> 2),
  answered AS (SELECT DISTINCT subject, year, label AS key FROM good),
  pictured AS (SELECT DISTINCT p.subject, p.year, p.key FROM pictures p JOIN docs d ON d.year = p.year WHERE d.valid),
  differences AS (
    SELECT *, 'missing in answers' AS side FROM (SELECT * FROM pictured EXCEPT SELECT * FROM answered)
    UNION ALL SELECT *, 'missing in images' FROM (SELECT * FROM answered EXCEPT SELECT * FROM pictured))"""
_VALIDATED = f"""{_ENTRIES},
  sets AS (SELECT y, option, min(written) AS written, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
      bool_or(label LIKE 'B%' AND contains(answer, 'Б')) AS has_b FROM good GROUP BY 1, 2),
  firsts AS (SELECT y, arg_min(labels, written) AS labels FROM sets GROUP BY y),
  per_file AS (SELECT s.y, count(*) FILTER (s.labels <> f.labels) AS options_differing, count(*) FILTER (has_b) AS options_with_b,
      count(*) AS total_options FROM sets s JOIN firsts f USING (y) GROUP BY s.y),
  verdicts AS (SELECT DISTINCT p.subject, p.year, d.y IS NOT NULL AS file_present, coalesce(d.valid, true) AS file_valid,
    (SELECT count(*) FROM answered a WHERE a.year = p.year AND a.key LIKE 'A%') AS a_count,
    (SELECT count(*) FROM answered a WHERE a.year = p.year AND a.key LIKE 'B%') AS b_count,
    (SELECT count(*) FROM answered a WHERE a.year = p.year) AS answer_question_count,
    (SELECT count(*) FROM pictured a WHERE a.year = p.year) AS image_question_count,
    (SELECT count(*) FROM differences x WHERE x.year = p.year AND x.side = 'missing in answers') AS missing_in_answers,
    (SELECT count(*) FROM differences x WHERE x.year = p.year AND x.side = 'missing in images') AS missing_in_images,
    coalesce(f.options_differing, 0) AS options_differing, coalesce(f.options_with_b, 0) AS options_with_b,
    coalesce(f.total_options, 0) AS total_options
    FROM pictures p LEFT JOIN docs d ON d.year = p.year LEFT JOIN per_file f ON f.y = d.y),
  judged AS (SELECT *,
    CASE WHEN options_with_b = 0 THEN 'none' WHEN options_with_b < total_options THEN 'partial' ELSE 'all' END AS part_b_coverage,
    file_present AND file_valid AND missing_in_answers + missing_in_images = 0 AND options_differing = 0
      AND options_with_b = total_options AS is_clean,
    CASE WHEN NOT file_present THEN 'NOT FOUND' WHEN NOT file_valid THEN 'IS UNREADABLE'
         WHEN missing_in_answers + missing_in_images > 0 THEN 'MISMATCH' WHEN options_differing > 0 THEN 'OPTIONS DIFFER'
         ELSE 'OK' END AS status FROM verdicts)"""

SQL = {
    "census_parts": f"WITH {_CENSUS} SELECT * FROM parts",
    "census_years": f"WITH {_CENSUS} SELECT * FROM years",
    "census_subjects": f"""WITH {_CENSUS} SELECT subject, count(*) AS years, sum(images)::BIGINT AS images,
        sum(folders)::BIGINT AS folders, count(*) FILTER (complete) AS complete_years FROM years GROUP BY 1""",
    "answer_maps": f"WITH {_ENTRIES} SELECT subject, year, option::VARCHAR AS option, label, answer FROM good",
    "key_differences": f"WITH {_ENTRIES} SELECT * FROM differences",
    "listed_differences": f"""WITH {_ENTRIES}, ranked AS (SELECT *,
          row_number() OVER (PARTITION BY subject, year, side ORDER BY key) AS place,
          count(*) OVER (PARTITION BY subject, year, side) AS n FROM differences)
        SELECT subject, year, side, place, key, greatest(n - 3, 0) AS more FROM ranked WHERE place <= 3""",
    "validate_years": f"WITH {_VALIDATED} SELECT * FROM judged",
    "validation_issues": f"WITH {_VALIDATED} SELECT subject, count(*) AS years, count(*) FILTER (NOT is_clean) AS issues FROM judged GROUP BY 1",
}
