"""The corpus: page order and names, pending work, topics, reconciling rows with files."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import exam, paths, text
from paperloom.operators import rename
from paperloom.plans.ordered import running
from paperloom.plans.session import cut_lineage

# Sent to the workers with the job, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(rename)


def number_pages(pages: DataFrame) -> DataFrame:
    """Canonical 1..n numbering of each directory in natural order, with the name that goes with it."""
    path = F.col("object_key")
    placed = pages.withColumns({"_dir": paths.parent(path), "_natural": text.natural_sort_key(paths.stem(path))})
    ranked = running(placed, ["_dir"], ["_natural", "object_key"], rank="number")
    name = paths.page_name(F.col("number"), paths.suffix(path))
    return ranked.withColumn("target", F.concat_ws("/", "_dir", name)).drop("_natural").withColumnRenamed("_dir", "directory")


def plan_renames(numbered: DataFrame, processed: DataFrame) -> DataFrame:
    """Which pages are renamed, unchanged, or blocked because a name is taken.

    Pages move in number order and take their processed twin along, so a name frees up once the page
    holding it has moved. A page is blocked while its target, or its twin's target, is taken. Most pages
    meet nobody: their target is no page's and no twin's name, and nothing can come to stand in their
    way. Only the rest depend on what moved before them and are walked in order.

    *processed* holds the twins' keys (``directory``, ``stem``), directories spelled as in *numbered*.
    """
    stem = paths.stem(F.col("object_key"))
    page = numbered.select("directory", "number", "object_key", "target", stem.alias("stem")).withColumn(
        "target_stem", F.format_string("%03d", F.col("number"))
    )
    yes = F.lit(True)
    twins = processed.select("directory", "stem").distinct()
    stems = page.groupBy("directory", "stem").agg(F.count(F.lit(1)).alias("_pages"))
    sizes = page.groupBy("directory").agg(F.max("number").alias("_top"))
    facts = (
        page.join(page.select(F.col("object_key").alias("target"), F.col("number").alias("held_by")), "target", "left")
        .join(twins.withColumn("has_twin", yes), ["directory", "stem"], "left")
        .join(twins.select("directory", F.col("stem").alias("target_stem"), yes.alias("twin_target")), ["directory", "target_stem"], "left")
        .join(stems, ["directory", "stem"])
        .join(stems.select("directory", F.col("stem").alias("target_stem"), yes.alias("_met")), ["directory", "target_stem"], "left")
        .join(sizes, "directory")
        .withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in ("has_twin", "twin_target", "_met")})
    )
    # Another page's number: that page may bring its twin to this page's name.
    own = text.whole_number(F.col("stem"))
    awaited = F.coalesce((F.length("stem") >= 3) & own.between(1, F.col("_top")), F.lit(False))
    entangled = F.col("twin_target") | F.col("_met") | (F.col("_pages") > 1) | awaited
    marked = cut_lineage(facts.select(*rename.COLUMNS, entangled.alias("_entangled")))
    free = marked.filter(~F.col("_entangled")).select("directory", "number", "object_key", "target", F.lit("renamed").alias("outcome"))
    walked = marked.filter("_entangled").select(*rename.COLUMNS).repartition("directory").sortWithinPartitions("directory", "number")
    return free.unionByName(walked.mapInArrow(rename.rename_in_order, rename.PLANNED))


def pending_scans(raw: DataFrame, processed: DataFrame, force: bool = False) -> DataFrame:
    """Raw scans (keys under ``{subject}/raw``) with their processed twin and whether to skip them."""
    twin = F.regexp_replace(F.regexp_replace("object_key", r"^([^/]+)/raw/", "$1/processed/"), r"\.[^./]+$", ".png")
    planned = raw.select("object_key", twin.alias("twin"))
    if force:
        return planned.withColumn("skipped", F.lit(False))
    done = processed.select(F.col("object_key").alias("twin"), F.lit(True).alias("_done")).distinct()
    return planned.join(done, "twin", "left").select("object_key", "twin", F.col("_done").isNotNull().alias("skipped"))


def pending_years(years: DataFrame, completed: DataFrame) -> DataFrame:
    """Years of subjects the completion log does not name."""
    done = completed.select("subject", F.col("identifier").alias("year"))
    return years.join(done, ["subject", "year"], "left_anti")


def expand_topics(topic_rows: DataFrame, subjects: DataFrame, books: DataFrame, options: DataFrame, questions: DataFrame) -> DataFrame:
    """Mapping rows (subject_id, topic, question_id) of a hand-written topic map.

    A key names the question of that part and number in every option of the year and exam type; years
    and keys the corpus does not hold map nothing.
    """
    key = text.question_key(F.col("raw_key"))
    named = topic_rows.select("subject", "topic", F.col("year").alias("year_value"), exam.valid_exam_type(F.col("exam_type")).alias("exam_type"), text.worked_out(key).alias("_key"))
    named = named.filter("exam_type IS NOT NULL AND _key IS NOT NULL").select(
        "subject", "topic", "year_value", "exam_type", F.col("_key.part").alias("part"), F.col("_key.number").alias("question_number")
    )
    where = (
        options.select("option_id", "book_id", "exam_type")
        .join(books.select("book_id", "subject_id", "year_value"), "book_id")
        .join(subjects.select("subject_id", F.col("name").alias("subject")), "subject_id")
    )
    asked = named.join(where, ["subject", "year_value", "exam_type"])
    found = asked.join(questions.select("question_id", "option_id", "part", "question_number"), ["option_id", "part", "question_number"])
    return found.select("subject_id", "topic", "question_id").dropDuplicates()


def mapping_counts(mapped: DataFrame, topics: DataFrame) -> DataFrame:
    """Mappings per subject, and over all of them as the row without a subject."""
    per_subject = mapped.join(topics.select("topic_id", "subject_id"), "topic_id")
    return per_subject.rollup("subject_id").agg(F.count(F.lit(1)).alias("mappings"))


def reconcile(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Where stored rows and files disagree: missing, orphaned or stale keys."""
    stored = rows.select("object_key", F.col("content_hash").alias("_stored"), F.lit(True).alias("_row"))
    found = files.select("object_key", F.col("content_hash").alias("_found"), F.lit(True).alias("_file"))
    both = stored.join(found, "object_key", "full_outer")
    status = (
        F.when(F.col("_file").isNull(), "missing")
        .when(F.col("_row").isNull(), "orphaned")
        .when(~F.col("_stored").eqNullSafe(F.col("_found")), "stale")
    )
    return both.select("object_key", status.alias("status")).filter(F.col("status").isNotNull())


def reconcile_tree(rows: DataFrame, manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """:func:`reconcile` hashing only the keys on both sides.

    Presence is settled on the cheap manifest; digests are then joined for the matched keys alone.
    """
    present = manifest.select("object_key", F.lit(True).alias("_file"))
    stored = rows.select("object_key", "content_hash", F.lit(True).alias("_row"))
    sides = stored.join(present, "object_key", "full_outer")
    gone = sides.filter("_file IS NULL").select("object_key", F.lit("missing").alias("status"))
    stray = sides.filter("_row IS NULL").select("object_key", F.lit("orphaned").alias("status"))
    matched = sides.filter("_row AND _file").select("object_key", "content_hash")
    hashed = matched.join(digests.select("object_key", F.col("content_hash").alias("_now")), "object_key")
    stale = hashed.filter("NOT content_hash <=> _now").select("object_key", F.lit("stale").alias("status"))
    return gone.unionByName(stray).unionByName(stale)


def load_counts(rows: DataFrame) -> DataFrame:
    """Questions loaded and keys among them, per subject and year."""
    return rows.groupBy("subject", "year").agg(
        F.count(F.lit(1)).alias("questions"), F.count_if("keyed").alias("keyed")
    )


def admit_answers(images: DataFrame, answers: DataFrame) -> DataFrame:
    """Every question image with the key its year's answers give it, or none.

    *answers* holds (subject, year, option, raw_key, answer) with option numbers as text.
    """
    wanted = images.withColumns(
        {"option_text": F.col("option").cast("string"), "raw_key": text.question_key_text(F.col("part"), F.col("number"))}
    )
    typed = answers.select("subject", "year", F.col("option").alias("option_text"), "raw_key", F.col("answer").alias("_raw"))
    joined = wanted.join(typed, ["subject", "year", "option_text", "raw_key"], "left")
    admitted = exam.admitted_key(F.col("part"), F.col("_raw"))
    return joined.withColumn("_a", admitted).select(*images.columns, "_a.answer", "_a.keyed", "_a.warning")


def image_listing(images: DataFrame) -> DataFrame:
    return images.select("object_key", "content_hash").orderBy("object_key")


def highest_numbers(images: DataFrame, keys: list[str]) -> DataFrame:
    """Highest question number of each folder; a folder that holds none has no row and counts as 0."""
    return images.groupBy(*keys).agg(F.max("number").alias("highest"))


def slots_taken(wanted: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted (folder, number) slots a file of any format already holds."""
    return wanted.join(images.select(*keys, "number"), [*keys, "number"], "left_semi")
