"""Numbering: labelled page regions become (option, part, number), book by book.

The rule is sequential: an option marker counts only when it is the next option, so what a marker does
depends on everything before it. A book is therefore folded in page order. Most books are folded whole,
many at a time. A book that holds much of the table is folded in segments: each segment is first summed up as
a table "entered in this state, it leaves in that one", the tables of a book are chained (one short row
per segment), and then every segment is folded from the state it is really entered in.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions import exam, geometry
from paperloom.functions.text import natural_sort_key
from paperloom.operators import fold
from paperloom.operators.fold import FOLDED, NO_DETECTIONS, DISCARDED, STATE, SUMMARY
from paperloom.operators.fold import FOLDED_NAMES, FOLDER_STEP, HEADER_STEP, INPUT, REGION_STEP, STATE_STEP
from paperloom.plans.ordered import _SLICE, running, sliced
from paperloom.plans.session import cut_lineage

# Sent to the workers with the job, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(fold)

KNOWN_LABELS = ("option", "part", "question")
MIN_RING = 3
MIN_BOX_SIDE = 5
PIECE_GAP = 16

# ---- regions -----------------------------------------------------------------


def usable_detections(boxes: DataFrame, class_names: dict[int, str], width: Column, height: Column) -> DataFrame:
    """Paired boxes and outlines as detections, and per page how many were dropped.

    *boxes* holds (page, class_ids, scores, outlines) arrays; only what lines up is paired, an unknown
    class is "unknown", and fewer than three points make no region.
    """
    names = F.create_map(*[F.lit(x) for pair in class_names.items() for x in pair])
    paired = F.least(F.size("class_ids"), F.size("outlines"))
    cut = boxes.withColumn("_pairs", F.slice(F.arrays_zip("class_ids", "scores", "outlines"), F.lit(1), paired))
    shaped = F.transform(
        "_pairs",
        lambda d: F.struct(
            F.coalesce(F.try_element_at(names, d["class_ids"]), F.lit("unknown")).alias("label"),
            geometry.normalised_to_pixel(d["outlines"], width, height).alias("polygon_px"),
            d["scores"].alias("score"),
        ),
    )
    kept = F.filter(shaped, lambda d: F.size(d["polygon_px"]) >= MIN_RING)
    return cut.withColumn("detections", kept).withColumn("dropped", paired - F.size("detections")).drop("_pairs")


def in_reading_order(detections: DataFrame) -> DataFrame:
    """Detections with ``place``: top to bottom, left to right, ties as detected."""
    keyed = detections.withColumns({"_y": geometry.min_y(F.col("polygon_px")), "_x": geometry.min_x(F.col("polygon_px"))})
    return running(keyed, ["page"], ["_y", "_x", "ord"], rank="place").drop("_y", "_x")


def known_regions(regions: DataFrame) -> DataFrame:
    return regions.filter(F.col("label").isin(*KNOWN_LABELS))


def ignored_regions(regions: DataFrame) -> DataFrame:
    """Regions with a label the numbering has no use for, counted per page."""
    strays = regions.filter(~F.col("label").isin(*KNOWN_LABELS))
    return strays.groupBy("book", "page").agg(F.count(F.lit(1)).alias("ignored"))


def label_counts(regions: DataFrame) -> DataFrame:
    return regions.groupBy("book", "page", "label").agg(F.count(F.lit(1)).alias("regions"))


def apply_corrections(regions: DataFrame, corrections: DataFrame) -> DataFrame:
    """Reviewed regions: a correction row (book, page, ord, ...) per region it changes.

    ``new_label`` clears the reading, and the join unless the region is now a question. A reading is
    replaced when ``set_reading`` is true. Only questions can join the next piece. ``new_ord`` moves a
    region in the reading order; ``deleted`` drops it.
    """
    joined = regions.alias("r").join(corrections.alias("c"), ["book", "page", "ord"], "left")
    label = F.coalesce("new_label", "label")
    relabelled = F.col("new_label").isNotNull()
    replaced = F.coalesce(F.col("set_reading"), F.lit(False))

    def reading(name: str) -> Column:
        return F.when(replaced, F.col(f"new_{name}")).when(~relabelled, F.col(f"r.{name}")).alias(name)

    joins = F.coalesce("new_joins_next", "joins_next") & (label == "question")
    changed = {"ord", "label", "reading_option", "reading_part", "joins_next"}
    return joined.filter(~F.coalesce("deleted", F.lit(False))).select(
        *[F.col(f"r.{c}") for c in regions.columns if c not in changed],
        F.coalesce("new_ord", "ord").alias("ord"),
        label.alias("label"),
        reading("reading_option"),
        reading("reading_part"),
        F.coalesce(joins, F.lit(False)).alias("joins_next"),
    )


def drawn_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes a reviewer drew, corners in either order; one with a side under five pixels is a stray click."""
    left, right = F.least("x0", "x1"), F.greatest("x0", "x1")
    top, bottom = F.least("y0", "y1"), F.greatest("y0", "y1")
    big = (right - left >= MIN_BOX_SIDE) & (bottom - top >= MIN_BOX_SIDE)

    def corner(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    ring = F.array(corner(left, top), corner(right, top), corner(right, bottom), corner(left, bottom))
    keep = [c for c in boxes.columns if c not in ("x0", "x1", "y0", "y1")]
    return boxes.filter(big).select(*keep, ring.alias("polygon_px"))


def moved(polygon: Column, dx: Column, dy: Column) -> Column:
    return F.transform(polygon, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


# ---- pieces ------------------------------------------------------------------


def piece_groups(regions: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Question regions with the question they are a piece of: (question_index, piece, pieces).

    Consecutive pieces belong together whatever markers stand between them. ``pieces`` is 0 for a run
    the page does not finish. *carried* holds (book, page, carried) counts that belong to a page's first
    question.
    """
    questions = regions.filter(F.col("label") == "question").select("book", "page", "ord", "joins_next")
    closes = (~F.col("joins_next")).cast("long")
    placed = running(questions, ["book", "page"], ["ord"], rank="_rank", sums={"_closed": closes})
    indexed = placed.withColumn("question_index", F.col("_closed") - closes)
    group = ["book", "page", "question_index"]
    sizes = indexed.groupBy(*group).agg(
        F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_size"), F.bool_or(~F.col("joins_next")).alias("_done")
    )
    joined = indexed.join(sizes, group)
    extra = F.lit(0).cast("long")
    if carried is not None:
        joined = joined.join(carried.select("book", "page", "carried"), ["book", "page"], "left")
        extra = F.when(F.col("question_index") == 0, F.coalesce("carried", F.lit(0))).otherwise(0)
    return joined.select(
        *group, "ord",
        (F.col("_rank") - F.col("_first") + 1 + extra).alias("piece"),
        F.when(F.col("_done"), F.col("_size") + extra).otherwise(0).alias("pieces"),
    )


def entry_group_sizes(regions: DataFrame) -> DataFrame:
    """Questions before a page's first marker, joined pieces counted once, unfinished ones too."""
    marker = F.col("label").isin("option", "part")
    first = regions.groupBy("book", "page").agg(F.min(F.when(marker, F.col("ord"))).alias("_first_marker"))
    before = regions.join(first, ["book", "page"]).filter(
        (F.col("label") == "question") & (F.col("_first_marker").isNull() | (F.col("ord") < F.col("_first_marker")))
    )
    groups = before.groupBy("book", "page").agg(
        F.count_if(~F.col("joins_next")).alias("_closed"), F.max_by("joins_next", "ord").alias("_open")
    )
    size = F.coalesce(F.col("_closed") + F.col("_open").cast("long"), F.lit(0)).alias("entry_group")
    return first.select("book", "page").join(groups, ["book", "page"], "left").select("book", "page", size)


def stack_layout(pieces: DataFrame, gap: int = PIECE_GAP) -> DataFrame:
    """Where each piece of a stacked question sits, and the canvas it needs.

    *pieces* holds (stack, place, width, height, dx, dy). Nudges carry the pieces below along; the first
    piece has nothing to be nudged against; everything is shifted to non-negative coordinates.
    """
    first = pieces.groupBy("stack").agg(F.min(F.struct("place", "dx", "dy")).alias("_f"))
    sums = {"_x": F.col("dx"), "_y": F.col("dy") + gap + F.col("height")}
    run = running(pieces, ["stack"], ["place"], sums=sums).join(first.select("stack", "_f.dx", F.col("_f.dy").alias("_dy0")).withColumnRenamed("dx", "_dx0"), "stack")
    placed = run.withColumns({"_x": F.col("_x") - F.col("_dx0"), "_y": F.col("_y") - F.col("height") - F.col("_dy0") - gap})
    frame = placed.groupBy("stack").agg(
        F.min("_x").alias("_left"),
        F.min("_y").alias("_top"),
        F.max(F.col("_x") + F.col("width")).alias("_right"),
        F.max(F.col("_y") + F.col("height")).alias("_bottom"),
    )
    return placed.join(frame, "stack").select(
        "stack", "place",
        (F.col("_x") - F.col("_left")).alias("x"), (F.col("_y") - F.col("_top")).alias("y"),
        (F.col("_right") - F.col("_left")).alias("canvas_width"), (F.col("_bottom") - F.col("_top")).alias("canvas_height"),
    )


# ---- folding books ----------------------------------------------------------


def fold_rows(pages: DataFrame, regions: DataFrame, folders: DataFrame | None = None, decisions: DataFrame | None = None) -> DataFrame:
    """The rows a fold reads: per page a header, then its known regions; per book its folders' highest numbers.

    *pages* holds (book, page, detected); *folders* (book, option, part, highest) as already written;
    *decisions* (book, page, skip, discard, entry_option, entry_part, entry_question) of a reviewer.
    """
    headers = pages.select(F.col("book").cast("string").alias("book"), "page", "detected").withColumn("_step", F.lit(HEADER_STEP))
    if decisions is not None:
        chosen = decisions.withColumn("book", F.col("book").cast("string"))
        headers = headers.join(chosen, ["book", "page"], "left")
    rows = headers.unionByName(
        known_regions(regions).select(
            F.col("book").cast("string").alias("book"), "page", F.col("ord").cast("long").alias("ord"), "label", "reading_option", "reading_part",
            "joins_next", F.lit(REGION_STEP).alias("_step"),
        ),
        allowMissingColumns=True,
    )
    stem = F.regexp_replace("page", r"(?<=.)\.[^.]*$", "")
    rows = rows.withColumn("page_key", natural_sort_key(stem))
    if folders is not None:
        rows = rows.unionByName(
            folders.select(
                F.col("book").cast("string").alias("book"), F.lit("").alias("page_key"), F.lit("").alias("page"), F.lit(FOLDER_STEP).alias("_step"),
                F.col("option").alias("reading_option"), F.col("part").alias("reading_part"), F.col("highest").cast("long").alias("entry_question"),
            ),
            allowMissingColumns=True,
        )
    types = {"skip": "boolean", "discard": "boolean", "entry_option": "int", "entry_part": "string", "entry_question": "long", "_state": "string", "_seg": "long"}
    for name, kind in types.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(0 if name == "_seg" else None).cast(kind))
    defaults = {"skip": F.lit(False), "discard": F.lit(False), "joins_next": F.lit(False), "detected": F.lit(False), "ord": F.lit(-1).cast("long")}
    rows = rows.withColumns({n: F.coalesce(F.col(n), d) for n, d in defaults.items()})
    # A marker names one of ten options and part A or B; what else it may read is folded, or says nothing.
    read = F.col("_step") == REGION_STEP
    rows = rows.withColumns(
        {
            "reading_option": F.when(read, exam.fold_option(F.col("reading_option"))).otherwise(F.col("reading_option")).cast("int"),
            "reading_part": F.when(~read | F.col("reading_part").isin(*exam.PARTS), F.col("reading_part")),
        }
    )
    return rows.select(*INPUT)


_WITHIN = ("page_key", "page", "_step", "ord")


def number_books(rows: DataFrame) -> DataFrame:
    """Fold books into question and page rows (see ``FOLDED``).

    Books are folded whole, many at a time, but for those that hold much of the table (``ordered.sliced``): these are cut at page
    boundaries, and again where a reviewer moved the numbering. Their segments are summed up as tables from entry state to exit state,
    the tables of a book are chained, and the segments are folded from the states they are really entered in, in the same pass as the
    other books: one plan, whatever the sizes. The fold is the costly step and every report reads it, so it is written once and read
    from there.
    """
    hot = sliced(rows, ["book"], ["page_key", "page"], "inner")
    moves = (F.col("_step") == HEADER_STEP) & F.col("entry_option").isNotNull() & F.col("detected") & ~F.col("skip")
    by = W.partitionBy("book", _SLICE).orderBy(*_WITHIN).rowsBetween(W.unboundedPreceding, W.currentRow)
    segment = (F.col(_SLICE) + 1).cast("long") * F.lit(2**32) + F.sum(moves.cast("long")).over(by)
    cut = hot.withColumn("_seg", segment).select(*INPUT)
    whole = sliced(rows, ["book"], ["page_key", "page"], "left_anti").withColumn("_seg", F.lit(0).cast("long")).select(*INPUT)

    ordered = ["book", "_seg", *_WITHIN]
    summaries = cut.repartition("book", "_seg").sortWithinPartitions(*ordered).mapInArrow(fold.sum_up_segments(exam.OPTIONS_PER_BOOK, True), SUMMARY)
    # One short row per segment: a book has at most as many as there are slices and reviewer moves.
    chained = summaries.repartition("book").sortWithinPartitions("book", "_seg")
    states = chained.mapInArrow(fold.chain_segments(exam.OPTIONS_PER_BOOK), STATE)
    marked = states.select(
        "book", "_seg", "_state", F.lit(STATE_STEP).alias("_step"), F.lit("").alias("page_key"), F.lit("").alias("page"),
    )
    every = whole.unionByName(cut).unionByName(marked, allowMissingColumns=True)
    every = every.withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in ("skip", "discard", "joins_next", "detected")})
    every = every.withColumn("ord", F.coalesce("ord", F.lit(-1).cast("long"))).select(*INPUT)
    folded = every.repartition("book", "_seg").sortWithinPartitions(*ordered).mapInArrow(fold.fold_books, FOLDED)
    return cut_lineage(folded)


# ---- reading the fold --------------------------------------------------------


def placements(folded: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Placed questions, each written or a collision with a file that was there first.

    *taken* holds the (book, option, part, number) slots already on disk. Within a run the first
    placement of a slot writes it.
    """
    slot = ["book", "option", "part", "number"]
    order = F.struct("page_key", "page", "ord")
    questions = folded.filter("kind = 'question'").select(*slot, "page_key", "page", "ord", "position", "pieces", "carried")
    first = questions.groupBy(*slot).agg(F.min(order).alias("_first"))
    joined = questions.join(first, slot)
    clash = F.col("_first") < order
    if taken is not None:
        held = taken.select(F.col("book").cast("string").alias("book"), "option", "part", F.col("number").cast("long").alias("number"), F.lit(True).alias("_held"))
        joined = joined.join(held.distinct(), slot, "left")
        clash = clash | F.col("_held").isNotNull()
    return joined.select(
        "book", "page", "ord", "position", "option", "part", "number", "pieces", "carried",
        F.when(clash, "collision").otherwise("written").alias("outcome"),
    )


def page_outcomes(folded: DataFrame) -> DataFrame:
    names = [n for n in FOLDED_NAMES if n not in ("kind", "ord", "position", "option", "part", "number", "pieces", "page_key")]
    return folded.filter("kind = 'page'").select("page_key", *names)


def carry_fates(outcomes: DataFrame) -> DataFrame:
    """What became of the pieces each page held: joined, lost or still unfinished at the book's end."""
    return carried_into(outcomes).drop("into")


def carried_into(outcomes: DataFrame) -> DataFrame:
    """The fate of the pieces each page held, and the page that decided it (null at the book's end).

    The deciding page is the first later one that placed a question or was refused with the carry in
    hand: a page with *k* deciding pages up to and with it waits for the book's next, the *k + 1*-th.
    """
    decides = (
        F.when(F.col("cause") == DISCARDED, "lost")
        .when((F.col("outcome") == "read") & (F.col("questions") > 0), "joined")
        .when((F.col("outcome") == "failed") & (F.col("cause") != NO_DETECTIONS), "lost")
    )
    pages = outcomes.select("book", "page_key", "page", "held", decides.alias("_decides"))
    count = F.col("_decides").isNotNull().cast("long")
    counted = running(pages, ["book"], ["page_key", "page"], sums={"_k": count})
    deciding = counted.filter("_decides IS NOT NULL").select("book", F.col("_k").alias("_next"), F.col("_decides").alias("fate"), F.col("page").alias("into"))
    waiting = counted.filter("held > 0").select("book", "page", "held", (F.col("_k") + 1).alias("_next"))
    joined = waiting.join(deciding, ["book", "_next"], "left")
    return joined.select("book", "page", "held", F.coalesce("fate", F.lit("unfinished")).alias("fate"), "into")


def page_faults(outcomes: DataFrame) -> DataFrame:
    """Pages whose numbers collide with their folder: position, placement, free number, and whether
    moving the entry state helps."""
    return outcomes.filter("fault_position IS NOT NULL").select(
        "book", "page", "fault_position", "fault_option", "fault_part", "fault_number", "fault_free", "continue_helps"
    )


def book_reports(outcomes: DataFrame, placed: DataFrame, unfinished: DataFrame) -> DataFrame:
    """Per book: pages through, failures, collisions and pieces left; clean and complete."""
    pages = outcomes.groupBy("book").agg(
        F.count_if(F.col("outcome") != "failed").alias("pages"), F.count_if(F.col("outcome") == "failed").alias("failures")
    )
    clashes = placed.groupBy("book").agg(F.count_if(F.col("outcome") == "collision").alias("collisions"))
    left = unfinished.filter("fate = 'unfinished'").groupBy("book").agg(F.sum("held").alias("unfinished"))
    joined = pages.join(clashes, "book", "left").join(left, "book", "left")
    joined = joined.withColumns({n: F.coalesce(F.col(n), F.lit(0)).cast("long") for n in ("collisions", "unfinished")})
    clean = F.col("failures") == 0
    return joined.withColumns({"clean": clean, "complete": clean & (F.col("pages") > 0)})


def subject_reports(books: DataFrame) -> DataFrame:
    """Books with a ``subject`` rolled up; what they reported is gathered, not merged."""
    return books.groupBy("subject").agg(
        F.count(F.lit(1)).alias("books"),
        F.sum("pages").alias("pages"),
        F.sum("failures").alias("failures"),
        F.sum("collisions").alias("collisions"),
        F.sum("unfinished").alias("unfinished"),
        F.bool_and("clean").alias("clean"),
        F.count_if("complete").alias("complete_books"),
    )


def page_summaries(outcomes: DataFrame, placed: DataFrame, regions: DataFrame) -> DataFrame:
    """Per page read: questions, markers, pieces held, first and last placement, misnumbered."""
    where = F.concat_ws("/", F.col("option").cast("string"), "part", F.col("number").cast("string"))
    spans = placed.groupBy("book", "page").agg(F.min_by(where, "position").alias("first"), F.max_by(where, "position").alias("last"))
    markers = regions.filter(F.col("label").isin("option", "part")).groupBy(F.col("book").cast("string").alias("book"), "page").agg(F.count(F.lit(1)).alias("markers"))
    read = outcomes.filter("outcome = 'read'").select("book", "page", "questions", "held", F.col("fault_position").isNotNull().alias("misnumbered"))
    return read.join(spans, ["book", "page"], "left").join(markers, ["book", "page"], "left").withColumn(
        "markers", F.coalesce("markers", F.lit(0).cast("long"))
    )


def run_starts(placed: DataFrame) -> DataFrame:
    """Placements that begin a run: the folder differs from the placement before on the page."""
    folder = F.struct("option", "part")
    marked = running(placed, ["book", "page"], ["position"], lags={"_before": folder})
    return marked.filter(F.col("_before").isNull() | (F.col("_before") != folder)).drop("_before")


def continue_counters(starts: DataFrame, folders: DataFrame) -> DataFrame:
    """The entry counter that lands each page's first question on its folder's free slot."""
    first = starts.filter("position = 0").join(folders.withColumn("book", F.col("book").cast("string")), ["book", "option", "part"], "left")
    return first.select("book", "page", "option", "part", F.greatest(F.coalesce("highest", F.lit(0)), F.lit(0)).cast("long").alias("counter"))


def median_skew(hocr: DataFrame) -> DataFrame:
    """Correction angle of each crop: the exact median of its baselines' slopes, in degrees; 0 without any."""
    slopes = F.array_sort(F.transform(F.regexp_extract_all("hocr", F.lit(r"baseline (-?[\d.]+) -?[\d.]+")), lambda s: s.try_cast("double")))
    n = F.size("_slopes")
    low = F.try_element_at("_slopes", F.floor((n + 1) / 2).cast("int"))
    high = F.try_element_at("_slopes", (F.floor(n / 2) + 1).cast("int"))
    angle = F.when(n > 0, F.degrees(F.atan((low + high) / 2))).otherwise(0.0)
    return hocr.withColumn("_slopes", slopes).withColumn("angle", angle).drop("_slopes")
