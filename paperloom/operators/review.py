"""Review: a page's regions with its reviewer's edits applied, from an ordered log of them.

Edits stand in the order of ``seq``. What a region ends up as needs no replay, page by page: a field has the value of the last edit
that wrote it, moves add up, and a join is toggled as often as it was since the region last ceased to be a question. Order matters to
two things only, the label a toggle meets and the place of a page's last sort, and both are running values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions import geometry
from paperloom.operators.numbering import drawn_boxes, moved, piece_groups
from paperloom.plans.ordered import running
from paperloom.plans.session import cut_lineage

#: The columns of a log. What each action reads beside book, page and seq:
#: ``draw`` ord label x y x1 y1 (a region of its own, corners in either order), ``move`` ord x y (added to the outline),
#: ``relabel`` ord label, ``read`` ord reading_option reading_part, ``join`` ord (toggles), ``offset`` ord x y (against the piece above),
#: ``place`` ord place, ``delete`` ord; for the whole page ``sort``, ``enter`` reading_option reading_part question, ``skip``, ``discard``.
EDITS = (
    "book long, page string, seq long, action string, ord long, label string, reading_option int, reading_part string, "
    "question long, x long, y long, x1 long, y1 long, place double"
)
ORIGINS = ("read in", "draw")
POLYGON = "array<struct<x:long,y:long>>"
_PAGE, _REGION = ["book", "page"], ["book", "page", "ord"]


def page_decisions(edits: DataFrame) -> DataFrame:
    """(book, page, skip, discard, entry_option, entry_part, entry_question): the last entry state, and whether a page was skipped
    or refused what was carried to it."""
    entry = F.struct("reading_option", "reading_part", "question")
    last = edits.filter(F.col("action").isin("skip", "discard", "enter")).groupBy(*_PAGE).agg(
        F.bool_or(F.col("action") == "skip").alias("skip"),
        F.bool_or(F.col("action") == "discard").alias("discard"),
        F.max_by(entry, F.when(F.col("action") == "enter", F.col("seq"))).alias("_entry"),
    )
    names = zip(("reading_option", "reading_part", "question"), ("entry_option", "entry_part", "entry_question"), strict=True)
    return last.select(*_PAGE, "skip", "discard", *(F.col(f"_entry.{a}").alias(b) for a, b in names))


def _histories(regions: DataFrame, edits: DataFrame) -> DataFrame:
    """Every region's origin and the edits that reach it, in one table: its label then, and how often it ceased to be a question."""
    boxes = drawn_boxes(edits.filter("action = 'draw'").withColumnsRenamed({"x": "x0", "y": "y0"}))
    fixed = {"joins_next": F.lit(False), "reading_option": F.lit(None).cast("int"), "reading_part": F.lit(None).cast("string")}
    drawn = boxes.select(*_REGION, "seq", "action", "label", F.col("polygon_px").cast(POLYGON).alias("polygon_px")).withColumns(fixed)
    given = regions.withColumns({"seq": F.lit(-1).cast("long"), "action": F.lit("read in"), "polygon_px": F.col("polygon_px").cast(POLYGON)})
    touch = edits.filter(F.col("action").isin("move", "relabel", "read", "join", "offset", "place", "delete")).drop("x1", "y1", "question")
    rows = given.unionByName(drawn, allowMissingColumns=True).unionByName(touch, allowMissingColumns=True)
    # A window per region, over what its reviewer did to it.
    so_far = W.partitionBy(*_REGION).orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    origin = F.col("action").isin(*ORIGINS)
    begun = rows.withColumn("_origins", F.sum(origin.cast("long")).over(so_far))
    # Edits of what does not exist (yet) and a second origin of the same region count for nothing.
    live = begun.filter((F.col("_origins") == 1) | ((F.col("_origins") > 1) & ~origin))
    named = F.when(origin | (F.col("action") == "relabel"), F.col("label"))
    labelled = live.withColumn("_label", F.last(named, ignorenulls=True).over(so_far))
    toggles = ((F.col("action") == "join") & (F.col("_label") == "question")).cast("long")
    return labelled.withColumn("_toggles", F.sum(toggles).over(so_far))


def _last(value: Column, when: Column) -> Column:
    return F.max_by(value, F.when(when, F.col("seq")))


def reviewed_regions(regions: DataFrame, edits: DataFrame) -> DataFrame:
    """Regions as their reviewer leaves them, with ``place`` (their order on the page, from 1), ``offset_x`` and ``offset_y``.

    *regions* holds (book, page, ord, label, reading_option, reading_part, joins_next, polygon_px); *edits* the columns of ``EDITS``,
    seq unique within a page. A drawn box with a side under five pixels is a stray click. A relabelled region loses its reading, and,
    unless it is a question now, its join and offset. ``place`` puts a region among the others by its number, which is ``ord`` at
    first. A page's last ``sort`` takes all regions there at place 0, in the reading order of their outlines then; what is drawn later
    stands behind. Edits of regions that do not exist, and joins of what is no question, do nothing.

    What the edits make of each region is written once, and so is the result: both the fold and the layout read it.
    """
    sorts = edits.filter("action = 'sort'").groupBy(*_PAGE).agg(F.max("seq").alias("_sorted"))
    rows = _histories(regions, edits).join(sorts, _PAGE, "left")
    act = F.col("action")
    origin, relabel = act.isin(*ORIGINS), act == "relabel"
    ceased = (origin | relabel) & (F.col("label") != "question")
    reading = F.struct(*(F.when(~relabel, F.col(c)).alias(c) for c in ("reading_option", "reading_part")))
    zero = F.lit(0).cast("long")
    offset = F.struct(F.when(act == "offset", F.col("x")).otherwise(zero).alias("x"), F.when(act == "offset", F.col("y")).otherwise(zero).alias("y"))
    early = (act == "move") & (F.col("seq") < F.col("_sorted"))

    def shift(c: str, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(c))), zero)

    told = rows.groupBy(*_REGION).agg(
        F.max_by("label", F.when(origin | relabel, F.col("seq"))).alias("label"),
        _last(reading, origin | relabel | (act == "read")).alias("_reading"),
        F.bool_or(origin & F.col("joins_next") & (F.col("label") == "question")).alias("_joined"),
        F.bool_or(ceased).alias("_ceased"),
        (F.max("_toggles") - F.coalesce(F.max(F.when(ceased, F.col("_toggles"))), zero)).alias("_toggles"),
        _last(offset, origin | ceased | (act == "offset")).alias("_offset"),
        F.min_by("polygon_px", F.when(origin, F.col("seq"))).alias("_ring"),
        F.min(F.when(origin, F.col("seq"))).alias("_since"),
        F.max("_sorted").alias("_sorted"),
        shift("x", act == "move").alias("_x"), shift("y", act == "move").alias("_y"),
        shift("x", early).alias("_early_x"), shift("y", early).alias("_early_y"),
        _last(F.col("place"), (act == "place") & (F.col("_sorted").isNull() | (F.col("seq") > F.col("_sorted")))).alias("_place"),
        F.bool_or(act == "delete").alias("_deleted"),
    ).filter(~F.col("_deleted"))
    toggled = F.col("_toggles") % 2 == 1
    joins = F.coalesce((F.col("_joined") & ~F.col("_ceased")) != toggled, F.lit(False))
    by_reading = F.col("_place").isNull() & (F.col("_since") < F.col("_sorted"))
    then = moved(F.col("_ring"), F.col("_early_x"), F.col("_early_y"))
    start = F.when(F.col("_sorted").isNull(), F.col("ord").cast("double")).when(by_reading, 0.0).otherwise(float("inf"))
    keyed = told.select(
        *_REGION,
        "label",
        F.col("_reading.reading_option").alias("reading_option"),
        F.col("_reading.reading_part").alias("reading_part"),
        joins.alias("joins_next"),
        moved(F.col("_ring"), F.col("_x"), F.col("_y")).alias("polygon_px"),
        F.col("_offset.x").alias("offset_x"),
        F.col("_offset.y").alias("offset_y"),
        F.coalesce("_place", start).alias("_place"),
        F.coalesce(F.when(by_reading, geometry.min_y(then)), zero).alias("_top"),
        F.coalesce(F.when(by_reading, geometry.min_x(then)), zero).alias("_left"),
    )
    # Ordering a page reads these rows three times, the hot keys and their slices ahead of the rows themselves.
    return cut_lineage(running(cut_lineage(keyed), _PAGE, ["_place", "_top", "_left", "ord"], rank="place").drop("_place", "_top", "_left"))


def question_pieces(regions: DataFrame, outcomes: DataFrame, carried: DataFrame) -> DataFrame:
    """Pieces of placed questions, carried ones ahead: (book, page, position, place, width, height, dx, dy), for ``stack_layout``.

    *regions* are reviewed ones, *outcomes* the pages of their fold, *carried* ``numbering.carried_into(outcomes)``. place is where a piece
    stands: its own page's key and name, and its place on it.
    """
    read = outcomes.filter("outcome = 'read'").select("book", "page", "page_key")
    shaped = regions.filter("label = 'question'").select(
        F.col("book").cast("string").alias("book"), "page", F.col("place").alias("ord"), "joins_next",
        (geometry.max_x(F.col("polygon_px")) - geometry.min_x(F.col("polygon_px"))).alias("width"),
        (geometry.max_y(F.col("polygon_px")) - geometry.min_y(F.col("polygon_px"))).alias("height"),
        F.col("offset_x").alias("dx"), F.col("offset_y").alias("dy"),
    ).join(read, ["book", "page"])
    grouped = piece_groups(shaped.withColumn("label", F.lit("question"))).select("book", "page", "ord", F.col("question_index").alias("position"), "pieces")
    pieces = shaped.join(grouped, ["book", "page", "ord"])
    into = carried.filter("fate = 'joined'").select("book", "page", "into")
    placed = F.struct("page_key", "page", "ord").alias("place")
    size = ["width", "height", "dx", "dy"]
    own = pieces.filter("pieces > 0").select("book", "page", "position", placed, *size)
    handed = pieces.filter("pieces = 0").join(into, ["book", "page"]).select("book", F.col("into").alias("page"), F.lit(0).cast("long").alias("position"), placed, *size)
    return cut_lineage(own.unionByName(handed))
