"""Counts of broken rules, worked out without a row for each."""

from paperloom.operators import quality
from paperloom.workload import quality as queries


def counts(df):
    return sorted((r["table"], r.rule, r.violations) for r in df.collect())


def test_counts_spell_out_no_keys(spark, small):
    plan = queries.violation_counts(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan and "array(cast(" not in plan


def test_counts_are_those_of_the_rows(spark, small):
    tables = queries._tables(spark, small)
    assert counts(quality.counted_violations(tables)) == counts(quality.violation_counts(quality.violations(tables)))


def test_counts_of_odd_keys(spark):
    """Null keys and references, repeated parents, a reference of another width or of text, tables without faults or rows."""
    tables = {
        "subjects": spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (None, None), (3, "b")], "subject_id int, name string"),
        "books": spark.createDataFrame([(1, 1, 2020), (2, 7, 2020), (3, None, None), (4, None, None)], "book_id long, subject_id long, year_value int"),
        "options": spark.createDataFrame([(1, "1", 3, "CE"), (2, "01", 11, "XX"), (3, None, None, None)], "option_id long, book_id string, option_number int, exam_type string"),
        "questions": spark.createDataFrame([], "question_id long, option_id long, part string, question_number int, answer string"),
    }
    got = counts(quality.counted_violations(tables))
    assert got == counts(quality.violation_counts(quality.violations(tables)))
    assert ("books", "subject_id refers to subjects", 1) in got and ("options", "book_id refers to books", 1) in got
    assert ("options", "option number range", 1) in got and not [r for r in got if r[0] == "questions"]
