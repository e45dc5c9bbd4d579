"""Audits: image counts per year, and answer keys against the images they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.exam import OPTIONS_PER_BOOK
from paperloom.functions.text import question_key_text
from paperloom.plans.ordered import top_of_group

# What an answer with a Part B key mentions, and how many keys a report names.
PART_B_LETTER = "Б"
LISTED = 12

# A year's status, first that applies.
NOT_FOUND = "NOT FOUND"
UNREADABLE = "IS UNREADABLE"
MISMATCH = "MISMATCH"
OPTIONS_DIFFER = "OPTIONS DIFFER"
OK = "OK"


def part_counts(images: DataFrame) -> DataFrame:
    """Images per option and part of a year, flagged when the count is not one of its part's modes.

    A part's modes are the counts most of its options share; all tied counts are modes.
    """
    counts = images.groupBy("subject", "year", "option", "part").agg(F.count(F.lit(1)).alias("images"))
    group = ["subject", "year", "part"]
    shared = counts.groupBy(*group, "images").agg(F.count(F.lit(1)).alias("_options"))
    most = shared.groupBy(*group).agg(F.max("_options").alias("_options"))
    modes = shared.join(most, [*group, "_options"]).select(*group, "images", F.lit(True).alias("_modal"))
    flagged = counts.join(modes, [*group, "images"], "left")
    return flagged.select("subject", "year", "option", "part", "images", F.col("_modal").isNull().alias("off_mode"))


def year_census(parts: DataFrame) -> DataFrame:
    """A year's options, folders and images, and whether its counts hang together."""
    totals = parts.groupBy("subject", "year").agg(
        F.count_distinct("option").alias("options"),
        F.count(F.lit(1)).alias("folders"),
        F.sum("images").alias("images"),
        F.count_if("off_mode").alias("off_mode_parts"),
    )
    missing = F.col("options") < OPTIONS_PER_BOOK
    return totals.withColumn("missing_options", missing).withColumn(
        "complete", ~missing & (F.col("off_mode_parts") == 0)
    )


def subject_census(years: DataFrame) -> DataFrame:
    """Years that hold images, with their images and folders."""
    return years.groupBy("subject").agg(
        F.count(F.lit(1)).alias("years"),
        F.sum("images").alias("images"),
        F.sum("folders").alias("folders"),
        F.count_if("complete").alias("complete_years"),
    )


def _labels(answers: Column) -> Column:
    """Distinct labels of one document's options."""
    return F.array_distinct(F.flatten(F.transform(F.map_values(answers), F.map_keys)))


def _carries_part_b(labels: Column) -> Column:
    return F.exists(F.map_entries(labels), lambda e: e["key"].startswith("B") & e["value"].contains(PART_B_LETTER))


def differing_options(answers: Column) -> Column:
    """Names of the options whose labels are not those of the first option as written."""
    entries = F.map_entries(answers)
    first = F.array_sort(F.map_keys(F.try_element_at(entries, F.lit(1))["value"]))
    unlike = F.filter(entries, lambda e: F.array_sort(F.map_keys(e["value"])) != first)
    return F.transform(unlike, lambda e: e["key"])


def key_differences(documents: DataFrame, images: DataFrame) -> DataFrame:
    """Keys of readable years pictured but not answered, or answered but not pictured, a row each."""
    readable = documents.filter("valid")
    answered = readable.select("subject", "year", F.explode(_labels(F.col("answers"))).alias("key"))
    years = readable.select("subject", "year")
    pictured = pictured_keys(images).join(years, ["subject", "year"], "left_semi")
    sides = answered.withColumn("_a", F.lit(True)).join(pictured.withColumn("_p", F.lit(True)), ["subject", "year", "key"], "full_outer")
    where = F.when(F.col("_a").isNull(), "missing in answers").when(F.col("_p").isNull(), "missing in images")
    return sides.select("subject", "year", "key", where.alias("side")).filter(F.col("side").isNotNull())


def pictured_keys(images: DataFrame) -> DataFrame:
    number = F.col("digits" if "digits" in images.columns else "number")
    return images.select("subject", "year", question_key_text(F.upper("part"), number).alias("key")).distinct()


def validate_years(years: DataFrame, documents: DataFrame, images: DataFrame) -> DataFrame:
    """One verdict per year: counts on both sides, differences, Part B coverage and a status.

    *documents* holds (subject, year, valid, answers), one row per answer file; everything about one
    file is worked out inside its row. Only the keys themselves are shuffled.
    """
    answers = F.col("answers")
    facts = documents.select(
        "subject",
        "year",
        "valid",
        F.lit(True).alias("_present"),
        _labels(answers).alias("_labels"),
        F.size(differing_options(answers)).cast("long").alias("options_differing"),
        F.size(F.filter(F.map_values(answers), _carries_part_b)).cast("long").alias("options_with_b"),
        F.size(F.map_keys(answers)).cast("long").alias("total_options"),
    ).select(
        "*",
        F.size("_labels").cast("long").alias("answer_question_count"),
        F.size(F.filter("_labels", lambda k: k.startswith("A"))).cast("long").alias("a_count"),
        F.size(F.filter("_labels", lambda k: k.startswith("B"))).cast("long").alias("b_count"),
    )
    pictured = pictured_keys(images).groupBy("subject", "year").agg(F.count(F.lit(1)).alias("_pictured"))
    sides = (
        key_differences(documents, images)
        .groupBy("subject", "year")
        .agg(
            F.count_if(F.col("side") == "missing in answers").alias("missing_in_answers"),
            F.count_if(F.col("side") == "missing in images").alias("missing_in_images"),
        )
    )
    keys = ["subject", "year"]
    joined = years.join(facts, keys, "left").join(pictured, keys, "left").join(sides, keys, "left")
    readable = F.coalesce(F.col("valid"), F.lit(False))

    def count(name: str, source: str | None = None) -> Column:
        return F.when(readable, F.coalesce(F.col(source or name), F.lit(0))).otherwise(0).cast("long").alias(name)

    counted = joined.select(
        *keys,
        F.col("_present").isNotNull().alias("file_present"),
        (F.col("_present").isNull() | readable).alias("file_valid"),
        *[count(n) for n in ("a_count", "b_count", "answer_question_count")],
        count("image_question_count", "_pictured"),
        *[count(n) for n in ("missing_in_answers", "missing_in_images", "options_differing", "options_with_b", "total_options")],
    )
    mismatch = (F.col("missing_in_answers") + F.col("missing_in_images")) > 0
    differ = F.col("options_differing") > 0
    coverage = (
        F.when(F.col("options_with_b") == 0, "none").when(F.col("options_with_b") < F.col("total_options"), "partial").otherwise("all")
    )
    status = (
        F.when(~F.col("file_present"), NOT_FOUND)
        .when(~F.col("file_valid"), UNREADABLE)
        .when(mismatch, MISMATCH)
        .when(differ, OPTIONS_DIFFER)
        .otherwise(OK)
    )
    clean = F.col("file_present") & F.col("file_valid") & ~mismatch & ~differ & (F.col("options_with_b") == F.col("total_options"))
    return counted.withColumns({"part_b_coverage": coverage, "is_clean": clean, "status": status})


def issue_totals(validated: DataFrame) -> DataFrame:
    return validated.groupBy("subject").agg(
        F.count(F.lit(1)).alias("years"), F.count_if(~F.col("is_clean")).alias("issues")
    )


def listed(rows: DataFrame, keys: list[str], value: str, n: int = LISTED) -> DataFrame:
    """The first *n* values of each group in text order, with how many more there are."""
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    named = top_of_group(rows, keys, [value], n, rank="place")
    return named.join(totals, keys).select(
        *keys, "place", value, F.greatest(F.col("_all") - n, F.lit(0)).alias("more")
    )
