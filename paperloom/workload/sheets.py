"""Answer sheets: a sheet per document, its reading failed where the document's label says so."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import sheets
from paperloom.sources import sinks
from paperloom.workload.views import Tables


def _sheets(spark, folder):
    t = Tables(spark, folder)
    i = F.col("doc_id")
    year = (F.floor(i / 5) % 200 + 1900).cast("string")
    stem = F.when(i % 97 == 5, F.concat(F.lit("scan"), i.cast("string"))).otherwise(F.concat(year, F.lit("_"), i.cast("string")))
    failed = t.read("labels").filter("quality = 0").select("doc_id", F.lit(True).alias("_failed")).distinct()
    named = t.read("documents").select("doc_id", F.col("source").alias("subject"), F.concat(stem, F.lit(".jpg")).alias("sheet"))
    joined = named.join(failed, "doc_id", "left")
    return sheets.with_year(joined.select("doc_id", "subject", "sheet", F.col("_failed").isNotNull().alias("unreadable")))


def _written(spark, folder):
    """Years whose key file exists already."""
    return _sheets(spark, folder).filter("year % 10 = 7").select("subject", "year").distinct()


def _pending(spark, folder):
    return sheets.pending_sheets(_sheets(spark, folder), _written(spark, folder))


def _normalised(spark, folder):
    i = F.col("doc_id")
    labels = F.array(F.lit(" а1"), F.lit("В2 "), F.when(i % 31 == 9, F.lit("C3")).otherwise(F.lit("a3")), F.lit("B2"))
    read = _pending(spark, folder).filter(~F.col("unreadable")).select("doc_id", "subject", "year", "sheet", F.posexplode(labels).alias("place", "raw_label"))
    answers = read.select(
        "subject", "year", "sheet", "place", "raw_label",
        (i % 40 + F.floor(F.col("place") / 3) * 10 + 1).cast("string").alias("raw_option"),
        F.concat(F.lit("TEXT"), (i % 6).cast("string"), F.col("place").cast("string")).alias("raw_answer"),
    )
    return sheets.normalise_answers(answers)


def sheet_answers(spark, folder):
    return _normalised(spark, folder)


def sheet_outcomes(spark, folder):
    return sheets.sheet_outcomes(_pending(spark, folder), _normalised(spark, folder))


def pending_sheets(spark, folder):
    return _pending(spark, folder).select("doc_id", "sheet", "year")


def merge_sheets(spark, folder):
    merged = sheets.merge_sheets(_normalised(spark, folder), sheet_outcomes(spark, folder))
    return sheets.in_answer_order(merged)


def answer_documents(spark, folder):
    merged = sheets.merge_sheets(_normalised(spark, folder), sheet_outcomes(spark, folder))
    return sinks.sorted_answer_documents(merged)


def answers_report(spark, folder):
    return sheets.answers_report(sheet_outcomes(spark, folder), _written(spark, folder))


QUERIES = {f.__name__: f for f in (pending_sheets, sheet_answers, sheet_outcomes, merge_sheets, answer_documents, answers_report)}

_SHEETS = """named AS (SELECT doc_id, source AS subject, CASE WHEN doc_id % 97 = 5 THEN 'scan' || doc_id::VARCHAR || '.jpg'
      ELSE ((doc_id // 5) % 200 + 1900)::VARCHAR || '_' || doc_id::VARCHAR || '.jpg' END AS sheet,
    CASE WHEN doc_id % 97 <> 5 THEN (doc_id // 5) % 200 + 1900 END AS year,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS unreadable FROM documents),
  written AS (SELECT DISTINCT subject, year FROM named WHERE year % 10 = 7),
  pending AS (SELECT * FROM named n WHERE NOT EXISTS (SELECT 1 FROM written w WHERE w.subject = n.subject AND w.year = n.year)),
  entries AS (SELECT subject, year, sheet, place, ((doc_id % 40 + (place // 3) * 10 + 1) - 1) % 10 + 1 AS option,
    CASE WHEN place IN (0, 2) THEN 'A' ELSE 'B' END AS part, [1, 2, 3, 2][place + 1] AS number,
    'ТЕХТ' || (doc_id % 6)::VARCHAR || place::VARCHAR AS answer, place = 2 AND doc_id % 31 = 9 AS bad
    FROM pending, (SELECT unnest([0, 1, 2, 3]) AS place) WHERE NOT unreadable),
  judged AS (SELECT p.subject, p.sheet, p.year, CASE WHEN p.year IS NULL THEN 'invalid filename' WHEN p.unreadable THEN 'unreadable'
      WHEN EXISTS (SELECT 1 FROM entries e WHERE e.sheet = p.sheet AND e.subject = p.subject AND e.bad) THEN 'invalid question label' END AS reason FROM pending p),
  complete AS (SELECT subject, year FROM judged WHERE year IS NOT NULL GROUP BY 1, 2 HAVING bool_and(reason IS NULL)),
  merged AS (SELECT subject, year, option, part, number, arg_max(answer, sheet || ' ' || place::VARCHAR) AS answer
    FROM entries JOIN complete USING (subject, year) GROUP BY ALL)"""

SQL = {
    "pending_sheets": f"WITH {_SHEETS} SELECT doc_id, sheet, year FROM pending",
    "sheet_answers": f"""WITH {_SHEETS} SELECT subject, year, sheet, place, option, CASE WHEN NOT bad THEN part END AS part,
        CASE WHEN NOT bad THEN number END AS number, answer, CASE WHEN bad THEN 'invalid question label' END AS fault FROM entries""",
    "sheet_outcomes": f"WITH {_SHEETS} SELECT subject, sheet, year, reason IS NULL AS ok, reason FROM judged",
    "merge_sheets": f"WITH {_SHEETS} SELECT * FROM merged ORDER BY ALL",
    "answer_documents": f"""WITH {_SHEETS},
        per_option AS (SELECT subject, year, option, '{{' || string_agg('"' || part || number::VARCHAR || '":"' || answer || '"', ','
          ORDER BY part, number) || '}}' AS labels FROM merged GROUP BY ALL)
        SELECT subject, year, '{{' || string_agg('"' || option::VARCHAR || '":' || labels, ',' ORDER BY option) || '}}' AS document
        FROM per_option GROUP BY ALL""",
    "answers_report": f"""WITH {_SHEETS},
        years AS (SELECT subject, year, bool_and(reason IS NULL) AS ok FROM judged WHERE year IS NOT NULL GROUP BY 1, 2),
        s AS (SELECT DISTINCT subject FROM named)
        SELECT subject, (SELECT count(*) FROM years y WHERE y.subject = s.subject AND ok) AS years_written,
          (SELECT count(*) FROM years y WHERE y.subject = s.subject AND NOT ok) AS years_failed,
          (SELECT count(*) FROM written w WHERE w.subject = s.subject) AS years_skipped,
          (SELECT count(*) FROM judged j WHERE j.subject = s.subject AND reason IS NOT NULL) AS sheets_failed,
          NOT EXISTS (SELECT 1 FROM judged j WHERE j.subject = s.subject AND reason IS NOT NULL) AS clean FROM s""",
}
