"""Answer sheets: normalising, merging and writing a year only when all of it was read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import exam, paths, text


def with_year(sheets: DataFrame) -> DataFrame:
    """Sheets with the year their name says; null where the name is no sheet name."""
    return sheets.withColumn("year", paths.sheet_year_number(paths.stem(F.col("sheet")))["year"])


def pending_sheets(sheets: DataFrame, written_years: DataFrame) -> DataFrame:
    """Sheets of years without a key file. A written year is never read again."""
    return sheets.join(written_years.select("subject", "year"), ["subject", "year"], "left_anti")


def normalise_answers(answers: DataFrame) -> DataFrame:
    """Answers with folded option, key and script; ``fault`` says what could not be read.

    *answers* holds (subject, year, sheet, place, raw_option, raw_label, raw_answer), ``place`` being
    the entry's position on its sheet.
    """
    option = exam.fold_option(text.whole_number(text.unicode_trim(F.col("raw_option")))).cast("int")
    key = text.question_key(F.col("raw_label"))
    fault = F.when(option.isNull(), "invalid option").when(key.isNull(), "invalid question label").when(key["number"].isNull(), "question number out of range")
    return answers.select(
        "subject", "year", "sheet", "place", option.alias("option"), key["part"].alias("part"), key["number"].alias("number"),
        text.answer_script(F.col("raw_answer")).alias("answer"), fault.alias("fault"),
    )


def sheet_outcomes(sheets: DataFrame, normalised: DataFrame) -> DataFrame:
    """Sheets with ``ok``: the name parsed, the reading worked and every label on it was good."""
    faults = normalised.filter("fault IS NOT NULL").groupBy("subject", "sheet").agg(F.min(F.struct("place", "fault")).getField("fault").alias("fault"))
    joined = sheets.join(faults, ["subject", "sheet"], "left")
    reason = F.when(F.col("year").isNull(), "invalid filename").when(F.col("unreadable"), "unreadable").otherwise(F.col("fault"))
    return joined.select("subject", "sheet", "year", reason.isNull().alias("ok"), reason.alias("reason"))


def complete_years(outcomes: DataFrame) -> DataFrame:
    """Years all of whose sheets were read."""
    named = outcomes.filter("year IS NOT NULL")
    return named.groupBy("subject", "year").agg(F.bool_and("ok").alias("ok")).filter("ok").select("subject", "year")


def merge_sheets(normalised: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One answer per (subject, year, option, key) of the complete years.

    Sheets are taken in name order and a later answer replaces an earlier one; the replacement is a
    grouped maximum, combined before the shuffle.
    """
    kept = normalised.join(complete_years(outcomes), ["subject", "year"], "left_semi")
    order = F.struct("sheet", "place", "answer")
    merged = kept.groupBy("subject", "year", "option", "part", "number").agg(F.max(order).alias("last"))
    return merged.select("subject", "year", "option", "part", "number", F.col("last.answer").alias("answer"))


def in_answer_order(merged: DataFrame) -> DataFrame:
    return merged.repartition("subject", "year").sortWithinPartitions("subject", "year", "option", "part", "number")


def answers_report(outcomes: DataFrame, skipped_years: DataFrame) -> DataFrame:
    """Per subject: years written, failed and skipped, and sheets that failed."""
    years = outcomes.filter("year IS NOT NULL").groupBy("subject", "year").agg(F.bool_and("ok").alias("ok"))
    per_year = years.groupBy("subject").agg(F.count_if("ok").alias("years_written"), F.count_if(~F.col("ok")).alias("years_failed"))
    per_sheet = outcomes.groupBy("subject").agg(F.count_if(~F.col("ok")).alias("sheets_failed"))
    skipped = skipped_years.groupBy("subject").agg(F.count_distinct("year").alias("years_skipped"))
    joined = per_sheet.join(per_year, "subject", "full_outer").join(skipped, "subject", "full_outer")
    return joined.na.fill(0).withColumn("clean", F.col("sheets_failed") == 0)
