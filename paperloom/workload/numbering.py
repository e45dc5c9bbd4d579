"""Numbering over the events table: a book per user, a page per day, a region per event."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import corpus, numbering, review
from paperloom.workload.labelling import _RINGS
from paperloom.workload.views import Tables, with_views


def _pages(t: Tables):
    """Pages with detections, but for the 7th, 14th, ... of a month, where the detector found nothing."""
    day = F.substring("page", 9, 2).cast("int")
    return t.regions.select("book", "page").distinct().withColumn("detected", day % 7 != 0)


def _folders(t: Tables):
    """What earlier runs left: up to three questions in option 1, part A of a book."""
    books = t.regions.select("book").distinct().filter(F.col("book") % 4 > 0)
    return books.select("book", F.lit(1).alias("option"), F.lit("A").alias("part"), (F.col("book") % 4).alias("highest"))


def _taken(t: Tables):
    return _folders(t).select("book", "option", "part", F.explode(F.sequence(F.lit(1).cast("long"), "highest")).alias("number"))


def folded(t: Tables):
    return numbering.number_books(numbering.fold_rows(_pages(t), t.regions, _folders(t)))


def place_questions(spark, folder):
    t = Tables(spark, folder)
    return numbering.placements(folded(t), _taken(t))


def page_outcomes(spark, folder):
    outcomes = numbering.page_outcomes(folded(Tables(spark, folder)))
    return outcomes.select(
        "book", "page", "outcome", "cause", "questions", "held", "carried_out", "entry_option", "entry_part", "entry_question",
        "exit_option", "exit_part", "exit_question",
    )


def held_pieces(spark, folder):
    return numbering.carry_fates(numbering.page_outcomes(folded(Tables(spark, folder))))


def page_faults(spark, folder):
    return numbering.page_faults(numbering.page_outcomes(folded(Tables(spark, folder))))


def _reports(t: Tables):
    fold = folded(t)
    outcomes = numbering.page_outcomes(fold)
    return numbering.book_reports(outcomes, numbering.placements(fold, _taken(t)), numbering.carry_fates(outcomes))


def book_rollup(spark, folder):
    return _reports(Tables(spark, folder))


def subject_rollup(spark, folder):
    subject = F.concat(F.lit("s"), (F.col("book").cast("long") % 7).cast("string"))
    return numbering.subject_reports(_reports(Tables(spark, folder)).withColumn("subject", subject))


def page_summary(spark, folder):
    t = Tables(spark, folder)
    fold = folded(t)
    return numbering.page_summaries(numbering.page_outcomes(fold), numbering.placements(fold, _taken(t)), t.regions)


def run_starts(spark, folder):
    t = Tables(spark, folder)
    return numbering.run_starts(numbering.placements(folded(t), _taken(t))).select("book", "page", "position", "option", "part", "number")


def continue_counters(spark, folder):
    t = Tables(spark, folder)
    placed = numbering.placements(folded(t), _taken(t))
    held = corpus.highest_numbers(_taken(t), ["book", "option", "part"])
    return numbering.continue_counters(numbering.run_starts(placed), held)


def piece_groups(spark, folder):
    t = Tables(spark, folder)
    carried = numbering.page_outcomes(folded(t)).select("book", "page", "carried")
    return numbering.piece_groups(t.regions, carried)


def entry_groups(spark, folder):
    return numbering.entry_group_sizes(numbering.known_regions(Tables(spark, folder).regions))


def label_counts(spark, folder):
    return numbering.label_counts(Tables(spark, folder).regions)


def ignored_regions(spark, folder):
    return numbering.ignored_regions(Tables(spark, folder).regions)


def _corrections(t: Tables):
    """A reviewer's corrections: every ninth region relabelled, moved, re-read, joined or deleted."""
    k = F.col("event_id") % 90
    return t.events.filter(F.col("event_id") % 9 == 4).select(
        F.col("user_id").alias("book"),
        F.date_format("ts", "yyyy-MM-dd").alias("page"),
        F.col("event_id").alias("ord"),
        F.when(k % 2 == 0, F.when(k % 4 == 0, "question").otherwise("option")).alias("new_label"),
        (k % 5 == 1).alias("set_reading"),
        F.when(k % 5 == 1, (k % 3 + 1).cast("int")).alias("new_reading_option"),
        F.lit(None).cast("string").alias("new_reading_part"),
        F.when(k % 3 == 0, k % 2 == 0).alias("new_joins_next"),
        F.when(k % 7 == 2, F.col("event_id") * 10).alias("new_ord"),
        (k % 10 == 3).alias("deleted"),
    )


def corrected_regions(spark, folder):
    t = Tables(spark, folder)
    return numbering.apply_corrections(t.regions, _corrections(t))


def _outlined(t: Tables):
    """Regions with an outline: a box that the id places and sizes."""
    i = F.col("ord")
    x, y = i % 500, i * 7 % 700
    corner = lambda cx, cy: F.struct(cx.alias("x"), cy.alias("y"))
    right, bottom = x + 20 + i % 90, y + 10 + i % 50
    return t.regions.withColumn("polygon_px", F.array(corner(x, y), corner(right, y), corner(right, bottom), corner(x, bottom)))


#: Ids that drawn regions take, beyond those of the given ones.
_DRAWN = 10_000_000
_EDIT_OF = {0: "relabel", 1: "relabel", 2: "read", 3: "join", 4: "offset", 5: "move", 6: "place", 7: "draw", 8: "delete"}


def _edits(t: Tables):
    """A reviewer's log: up to three edits of every fourth region, and now and then a sort, an entry state, a skip or a dropped carry."""
    i, j = F.col("i"), F.col("j")
    who = [F.col("user_id").alias("book"), F.date_format("ts", "yyyy-MM-dd").alias("page")]
    ids = t.events.select(*who, F.col("event_id").alias("i"))
    each = ids.filter(i % 4 == 1).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(i / 4) % 3)))
    code = (F.floor(i / 4) + j * 5) % 9
    code = F.when((code == 7) & (j > 0), 3).when((code == 8) & (j < 2), 5).otherwise(code)
    names = F.create_map(*[F.lit(x) for pair in _EDIT_OF.items() for x in pair])
    each = each.withColumn("code", code.cast("int")).withColumn("action", F.try_element_at(names, "code"))

    def by_action(**values):
        column = F.lit(None)
        for action, value in values.items():
            column = F.when(F.col("action") == action, value).otherwise(column)
        return column

    drawn = (F.floor(i / 4) % 9 == 7).cast("long") * _DRAWN
    region = each.select(
        "book", "page", (i * 10 + j).alias("seq"), "action", (i + drawn).alias("ord"),
        by_action(relabel=F.when(F.col("code") == 0, "question").otherwise("option"), draw=F.when(i % 3 == 0, "option").otherwise("question")).alias("label"),
        by_action(read=F.when(i % 2 == 0, i % 3 + 1)).cast("int").alias("reading_option"),
        by_action(read=F.when(i % 2 == 1, F.lit("B"))).alias("reading_part"),
        F.lit(None).cast("long").alias("question"),
        by_action(offset=i % 31 - 15, move=i % 41 - 20, draw=i % 600).alias("x"),
        by_action(offset=i % 17 - 8, move=i % 37 - 18, draw=i % 700).alias("y"),
        by_action(draw=i % 600 + i % 40 - 3).alias("x1"),
        by_action(draw=i % 700 + 30 - i % 29).alias("y1"),
        by_action(place=(i + (i % 7 - 3) * 40).cast("double")).alias("place"),
    )
    page = ids.select(
        "book", "page", "i",
        F.explode(F.array(
            F.when(i % 40 == 9, F.lit("sort")), F.when(i % 23 == 3, F.lit("enter")), F.when(i % 61 == 5, F.lit("skip")), F.when(i % 29 == 6, F.lit("discard")),
        )).alias("action"),
    ).filter(F.col("action").isNotNull())
    place = F.array_position(F.array(*map(F.lit, ("sort", "enter", "skip", "discard"))), F.col("action"))
    enter = F.col("action") == "enter"
    pages = page.select(
        "book", "page", (i * 10 + 4 + place).alias("seq"), "action",
        F.when(enter, i % 4 + 1).cast("int").alias("reading_option"), F.when(enter, F.when(i % 2 == 0, "A").otherwise("B")).alias("reading_part"),
        F.when(enter, i % 3).alias("question"),
    )
    return region.unionByName(pages, allowMissingColumns=True)


def _reviewed(t: Tables):
    return review.reviewed_regions(_outlined(t), _edits(t))


def reviewed_rows(t: Tables, reviewed=None):
    in_order = (_reviewed(t) if reviewed is None else reviewed).drop("ord").withColumnRenamed("place", "ord")
    return numbering.fold_rows(_pages(t), in_order, _folders(t), review.page_decisions(_edits(t)))


def reviewed_regions(spark, folder):
    """Regions as a reviewer's log leaves them: labels, readings, joins, offsets, outlines and order."""
    ring = F.array_join(F.transform("polygon_px", lambda p: F.format_string("%d,%d", p["x"], p["y"])), " ")
    return _reviewed(Tables(spark, folder)).withColumn("polygon_px", ring)


def page_decisions(spark, folder):
    return review.page_decisions(_edits(Tables(spark, folder)))


def reviewed_books(spark, folder):
    """Books numbered with a reviewer's edits and decisions applied; pages that would leave a gap are refused."""
    t = Tables(spark, folder)
    return numbering.placements(numbering.number_books(reviewed_rows(t)), _taken(t))


def reviewed_layout(spark, folder):
    """Every placed question's pieces stacked as the reviewer lined them up, carried ones on top."""
    t = Tables(spark, folder)
    reviewed = _reviewed(t)
    outcomes = numbering.page_outcomes(numbering.number_books(reviewed_rows(t, reviewed)))
    pieces = review.question_pieces(reviewed, outcomes, numbering.carried_into(outcomes))
    laid = numbering.stack_layout(pieces.withColumn("stack", F.struct("book", "page", "position")))
    return laid.select("stack.*", F.col("place.page").alias("piece_page"), F.col("place.ord").alias("piece"), "x", "y", "canvas_width", "canvas_height")


def drawn_boxes(spark, folder):
    i = F.col("l_orderkey")
    boxes = Tables(spark, folder).read("lineitem").select(
        i.alias("box"), F.col("l_partkey").alias("x0"), F.col("l_suppkey").alias("y0"),
        (F.col("l_partkey") + F.col("l_linenumber") * 3 - 9).alias("x1"), (F.col("l_suppkey") - F.col("l_quantity").cast("long")).alias("y1"),
    )
    ring = numbering.drawn_boxes(boxes)
    turned = numbering.moved(F.col("polygon_px"), F.lit(3), F.lit(-2))
    return ring.select("box", F.array_join(F.transform(turned, lambda p: F.format_string("%d,%d", p["x"], p["y"])), " ").alias("ring"))


def stack_layout(spark, folder):
    """A stacked image per order, a piece per line."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    pieces = Tables(spark, folder).read("lineitem").select(
        F.col("l_orderkey").alias("stack"),
        F.struct(*order).alias("place"),
        (F.col("l_partkey") % 700 + 50).alias("width"),
        (F.col("l_suppkey") % 300 + 20).alias("height"),
        (F.col("l_partkey") % 41 - 20).alias("dx"),
        (F.col("l_suppkey") % 61 - 40).alias("dy"),
    )
    laid = numbering.stack_layout(pieces)
    return laid.select("stack", "place.l_linenumber", "place.l_partkey", "place.l_suppkey", "x", "y", "canvas_width", "canvas_height")


def _boxes(spark, folder):
    """A prediction per embedding: three classes, two or three outlines of 0 to all points that its values make."""
    v, i = F.col("embedding"), F.col("vec_id")
    points = F.floor(F.size(v) / 2).cast("int")

    def outline(n):
        at = F.filter(F.sequence(F.lit(0), points - 1), lambda j: j < n)
        return F.transform(at, lambda j: F.struct((F.get(v, j * 2).cast("double") * 0.5 + 0.5).alias("x"), (F.get(v, j * 2 + 1).cast("double") * 0.5 + 0.5).alias("y")))

    classes = F.array((i % 4).cast("int"), ((i + 1) % 4).cast("int"), ((i + 2) % 4).cast("int"))
    outlines = F.array(outline(i % 33), outline((i + 4) % 33), outline(points))
    return Tables(spark, folder).read("embeddings").select(
        i.cast("string").alias("page"),
        classes.alias("class_ids"),
        F.array(F.lit(0.9), F.lit(0.8), F.lit(0.7)).alias("scores"),
        F.slice(outlines, F.lit(1), (i % 2 + 2).cast("int")).alias("outlines"),
    )


def _usable(spark, folder):
    return numbering.usable_detections(_boxes(spark, folder), {0: "option", 1: "part", 2: "question"}, F.lit(1000), F.lit(800))


def usable_detections(spark, folder):
    labels = F.array_join(F.transform("detections", lambda d: d["label"]), ",")
    return _usable(spark, folder).select("page", F.size("detections").alias("kept"), "dropped", labels.alias("labels"))


def reading_order(spark, folder):
    flat = _usable(spark, folder).select("page", F.posexplode("detections").alias("ord", "d")).select("page", "ord", "d.*")
    return numbering.in_reading_order(flat).select("page", "ord", "place")


def median_skew(spark, folder):
    """The baselines of a crop: a line of text for each embedding value."""
    lines = F.array_join(F.transform("embedding", lambda x: F.concat(F.lit("baseline "), F.format_string("%.4f", x.cast("double")), F.lit(" -3"))), "\n")
    hocr = F.when(F.col("vec_id") % 10 == 7, "no text").otherwise(lines)
    crops = Tables(spark, folder).read("embeddings").select("vec_id", hocr.alias("hocr"))
    return numbering.median_skew(crops).select("vec_id", F.round("angle", 6).alias("angle"))


QUERIES = {
    f.__name__: f
    for f in (
        place_questions,
        page_outcomes,
        held_pieces,
        page_faults,
        book_rollup,
        subject_rollup,
        page_summary,
        run_starts,
        continue_counters,
        piece_groups,
        entry_groups,
        label_counts,
        ignored_regions,
        corrected_regions,
        reviewed_regions,
        page_decisions,
        reviewed_books,
        reviewed_layout,
        drawn_boxes,
        stack_layout,
        usable_detections,
        reading_order,
        median_skew,
    )
}

_WALK = """ordered AS (SELECT *, substr(page, 9, 2)::INT % 7 <> 0 AS detected,
      row_number() OVER (PARTITION BY book ORDER BY page, ord) AS rn FROM regions),
  walk AS (
    SELECT DISTINCT book, 0::BIGINT AS rn, ''::VARCHAR AS page, 0::BIGINT AS ord, true AS detected, 0 AS o, ''::VARCHAR AS p, 0 AS q,
      0 AS eo, ''::VARCHAR AS ep, 0 AS eq, false AS failed, 0 AS pend, 0 AS pieces, 0 AS placed, false AS hit, 0 AS npieces, 0 AS ncarried,
      0 AS took FROM regions
    UNION ALL
    SELECT book, rn, page, ord, detected,
      CASE WHEN acc_o THEN ro ELSE o1 END, CASE WHEN acc_o THEN 'A' WHEN acc_p THEN rp ELSE p1 END,
      CASE WHEN acc_o OR acc_p THEN 0 WHEN ok THEN q1 + 1 ELSE q1 END, eo1, ep1, eq1, failed1 OR (closes AND NOT ok),
      CASE WHEN ok THEN 0 ELSE pend1 END, CASE WHEN ok THEN 0 WHEN isq THEN pieces1 + 1 ELSE pieces1 END,
      placed1 + ok::INT, ok, pieces1 + 1, pend1, took1
    FROM (
      SELECT *, live AND label = 'option' AND coalesce(ro = o1 + 1, false) AS acc_o, live AND label = 'part' AND coalesce(rp <> p1, false) AS acc_p,
        live AND label = 'question' AS isq, live AND label = 'question' AND NOT joins AS closes,
        live AND label = 'question' AND NOT joins AND (placed1 > 0 OR (o1 > 0 AND p1 <> '')) AS ok
      FROM (
        SELECT *, detected AND NOT failed1 AS live, CASE WHEN fresh THEN o1 ELSE eo END AS eo1, CASE WHEN fresh THEN p1 ELSE ep END AS ep1,
          CASE WHEN fresh THEN q1 ELSE eq END AS eq1, CASE WHEN fresh THEN pend1 ELSE took END AS took1
        FROM (
          SELECT r.book, r.rn, r.page, r.ord, r.detected, r.label, r.reading_option AS ro, r.reading_part AS rp, r.joins_next AS joins,
            r.page <> w.page AS fresh, w.eo, w.ep, w.eq, w.took,
            CASE WHEN r.page <> w.page AND (w.failed OR NOT w.detected) THEN w.eo ELSE w.o END AS o1,
            CASE WHEN r.page <> w.page AND (w.failed OR NOT w.detected) THEN w.ep ELSE w.p END AS p1,
            CASE WHEN r.page <> w.page AND (w.failed OR NOT w.detected) THEN w.eq ELSE w.q END AS q1,
            CASE WHEN r.page = w.page OR NOT w.detected THEN w.pend WHEN w.failed THEN 0 ELSE w.pend + w.pieces END AS pend1,
            r.page = w.page AND w.failed AS failed1, CASE WHEN r.page = w.page THEN w.pieces ELSE 0 END AS pieces1,
            CASE WHEN r.page = w.page THEN w.placed ELSE 0 END AS placed1
          FROM walk w JOIN ordered r ON r.book = w.book AND r.rn = w.rn + 1)))),
  placed AS (SELECT book::VARCHAR AS book, page, ord, row_number() OVER (PARTITION BY book, page ORDER BY ord) - 1 AS position,
      o AS option, p AS part, q AS number, npieces AS pieces, ncarried AS carried,
      CASE WHEN (o = 1 AND p = 'A' AND q <= book % 4) OR row_number() OVER (PARTITION BY book, o, p, q ORDER BY page, ord) > 1
           THEN 'collision' ELSE 'written' END AS outcome FROM walk WHERE hit),
  ends AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY rn DESC) AS back FROM walk WHERE rn > 0) WHERE back = 1),
  outcomes AS (SELECT book::VARCHAR AS book, page, CASE WHEN failed OR NOT detected THEN 'failed' ELSE 'read' END AS outcome,
      CASE WHEN NOT detected THEN 'No detections found on page'
           WHEN failed THEN 'Question detected before any option/part marker was read' END AS cause,
      CASE WHEN detected AND NOT failed THEN placed END AS questions, CASE WHEN detected AND NOT failed THEN pieces END AS held,
      CASE WHEN NOT detected THEN pend WHEN failed THEN 0 ELSE pend + pieces END AS carried_out,
      CASE WHEN detected THEN eo END AS entry_option, CASE WHEN detected THEN ep END AS entry_part, CASE WHEN detected THEN eq END AS entry_question,
      CASE WHEN failed THEN eo ELSE o END AS exit_option, CASE WHEN failed THEN ep ELSE p END AS exit_part, CASE WHEN failed THEN eq ELSE q END AS exit_question,
      CASE WHEN detected THEN took ELSE 0 END AS carried FROM ends),
  fates AS (SELECT book, page, held, coalesce(first_value(decides IGNORE NULLS) OVER (PARTITION BY book ORDER BY page
        ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 'unfinished') AS fate
      FROM (SELECT *, CASE WHEN outcome = 'read' AND questions > 0 THEN 'joined'
                           WHEN outcome = 'failed' AND cause NOT LIKE 'No%' THEN 'lost' END AS decides FROM outcomes)),
  starts AS (SELECT * EXCLUDE (bo, bp) FROM (SELECT *, lag(option) OVER w AS bo, lag(part) OVER w AS bp FROM placed
      WINDOW w AS (PARTITION BY book, page ORDER BY position)) WHERE bo IS NULL OR bo <> option OR bp <> part),
  free AS (SELECT s.*, greatest(coalesce((SELECT max(number) FROM placed e WHERE e.book = s.book AND e.option = s.option AND e.part = s.part
        AND e.page < s.page), 0), CASE WHEN option = 1 AND part = 'A' THEN book::INT % 4 ELSE 0 END) + 1 AS free FROM starts s),
  groups AS (SELECT book::VARCHAR AS book, page, count(*) FILTER (label = 'question' AND before AND NOT joins_next)
        + coalesce(arg_max(joins_next, ord) FILTER (label = 'question' AND before), false)::INT AS entry_group
      FROM (SELECT *, coalesce(ord < min(CASE WHEN label IN ('option', 'part') THEN ord END) OVER (PARTITION BY book, page), true) AS before
            FROM regions WHERE label <> 'figure') GROUP BY 1, 2),
  faults AS (SELECT f.book, f.page, f.position AS fault_position, f.option AS fault_option, f.part AS fault_part, f.number AS fault_number,
      f.free AS fault_free, f.position < g.entry_group AS continue_helps
      FROM (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY position) AS nth FROM free WHERE number <> free) f
      JOIN groups g USING (book, page) WHERE nth = 1),
  reports AS (SELECT book, count(*) FILTER (outcome <> 'failed') AS pages, count(*) FILTER (outcome = 'failed') AS failures,
      (SELECT count(*) FROM placed p WHERE p.book = o.book AND p.outcome = 'collision') AS collisions,
      coalesce((SELECT sum(held) FROM fates f WHERE f.book = o.book AND f.fate = 'unfinished' AND held > 0), 0)::BIGINT AS unfinished,
      count(*) FILTER (outcome = 'failed') = 0 AS clean, count(*) FILTER (outcome = 'failed') = 0 AND count(*) > 0 AS complete
      FROM outcomes o GROUP BY book)"""


#: A reviewer's log, and every region replayed through it edit by edit; then pages row by row, with what each folder holds.
_EDITED = """ids AS (SELECT user_id AS book, strftime(ts, '%Y-%m-%d') AS page, event_id AS i FROM ev),
  codes AS (SELECT *, CASE WHEN c = 7 AND j > 0 THEN 3 WHEN c = 8 AND j < 2 THEN 5 ELSE c END AS code
    FROM (SELECT *, (i // 4 + j * 5) % 9 AS c FROM (SELECT *, unnest(range(i // 4 % 3 + 1)) AS j FROM ids WHERE i % 4 = 1))),
  edits AS (SELECT book, page, i * 10 + j AS seq, i + CASE WHEN i // 4 % 9 = 7 THEN 10000000 ELSE 0 END AS ord,
      ['relabel', 'relabel', 'read', 'join', 'offset', 'move', 'place', 'draw', 'delete'][code + 1] AS act,
      CASE code WHEN 0 THEN 'question' WHEN 1 THEN 'option' WHEN 7 THEN CASE WHEN i % 3 = 0 THEN 'option' ELSE 'question' END END AS lab,
      CASE WHEN code = 2 AND i % 2 = 0 THEN i % 3 + 1 END AS ro, CASE WHEN code = 2 AND i % 2 = 1 THEN 'B' END AS rp,
      CASE code WHEN 4 THEN i % 31 - 15 WHEN 5 THEN i % 41 - 20 WHEN 7 THEN i % 600 ELSE 0 END AS x,
      CASE code WHEN 4 THEN i % 17 - 8 WHEN 5 THEN i % 37 - 18 WHEN 7 THEN i % 700 ELSE 0 END AS y,
      i % 600 + i % 40 - 3 AS x1, i % 700 + 30 - i % 29 AS y1, (i + (i % 7 - 3) * 40)::DOUBLE AS place FROM codes),
  sorts AS (SELECT book, page, max(i * 10 + 5) AS s FROM ids WHERE i % 40 = 9 GROUP BY ALL),
  decisions AS (SELECT book, page, bool_or(i % 61 = 5) AS skip, bool_or(i % 29 = 6) AS discard,
      (max(i) FILTER (i % 23 = 3) % 4 + 1)::INT AS entry_option, CASE WHEN max(i) FILTER (i % 23 = 3) % 2 = 0 THEN 'A' WHEN max(i) FILTER (i % 23 = 3) % 2 = 1 THEN 'B' END AS entry_part,
      max(i) FILTER (i % 23 = 3) % 3 AS entry_question FROM ids WHERE i % 23 = 3 OR i % 61 = 5 OR i % 29 = 6 GROUP BY book, page),
  origins AS (
    SELECT book, page, ord, -1::BIGINT AS since, label, reading_option AS ro, reading_part AS rp, joins_next AS j, ord % 500 AS l, ord * 7 % 700 AS t,
      ord % 500 + 20 + ord % 90 AS r, ord * 7 % 700 + 10 + ord % 50 AS b FROM regions
    UNION ALL SELECT book, page, ord, seq, lab, NULL, NULL, false, least(x, x1), least(y, y1), greatest(x, x1), greatest(y, y1) FROM edits
      WHERE act = 'draw' AND abs(x1 - x) >= 5 AND abs(y1 - y) >= 5),
  log AS (SELECT book, page, ord, list({'act': act, 'lab': lab, 'ro': ro::INT, 'rp': rp, 'j': false, 'x': x, 'y': y, 'ox': 0::BIGINT, 'oy': 0::BIGINT,
      'ex': CASE WHEN seq < s THEN x ELSE 0 END, 'ey': CASE WHEN seq < s THEN y ELSE 0 END,
      'place': CASE WHEN s IS NULL OR seq > s THEN place END, 'gone': false} ORDER BY seq) AS steps
    FROM edits LEFT JOIN sorts USING (book, page) WHERE act <> 'draw' GROUP BY ALL),
  ended AS (SELECT o.*, s, list_reduce(list_prepend({'act': '', 'lab': o.label, 'ro': o.ro::INT, 'rp': o.rp, 'j': o.j AND o.label = 'question', 'x': 0::BIGINT, 'y': 0::BIGINT,
      'ox': 0::BIGINT, 'oy': 0::BIGINT, 'ex': 0::BIGINT, 'ey': 0::BIGINT, 'place': NULL::DOUBLE, 'gone': false}, coalesce(steps, [])), lambda a, e: {
        'act': '', 'lab': CASE e.act WHEN 'relabel' THEN e.lab ELSE a.lab END,
        'ro': CASE e.act WHEN 'read' THEN e.ro WHEN 'relabel' THEN NULL ELSE a.ro END, 'rp': CASE e.act WHEN 'read' THEN e.rp WHEN 'relabel' THEN NULL ELSE a.rp END,
        'j': CASE WHEN e.act = 'relabel' AND e.lab <> 'question' THEN false WHEN e.act = 'join' AND a.lab = 'question' THEN NOT a.j ELSE a.j END,
        'x': a.x + CASE e.act WHEN 'move' THEN e.x ELSE 0 END, 'y': a.y + CASE e.act WHEN 'move' THEN e.y ELSE 0 END,
        'ox': CASE WHEN e.act = 'offset' THEN e.x WHEN e.act = 'relabel' AND e.lab <> 'question' THEN 0 ELSE a.ox END,
        'oy': CASE WHEN e.act = 'offset' THEN e.y WHEN e.act = 'relabel' AND e.lab <> 'question' THEN 0 ELSE a.oy END,
        'ex': a.ex + CASE e.act WHEN 'move' THEN e.ex ELSE 0 END, 'ey': a.ey + CASE e.act WHEN 'move' THEN e.ey ELSE 0 END,
        'place': CASE WHEN e.act = 'place' AND e.place IS NOT NULL THEN e.place ELSE a.place END, 'gone': a.gone OR e.act = 'delete'}) AS z
    FROM origins o LEFT JOIN log USING (book, page, ord) LEFT JOIN sorts USING (book, page)),
  reviewed AS MATERIALIZED (SELECT book, page, ord, z.lab AS label, z.ro AS reading_option, z.rp AS reading_part, z.j AS joins_next, l + z.x AS l, t + z.y AS t, r + z.x AS r, b + z.y AS b,
      z.ox AS offset_x, z.oy AS offset_y, row_number() OVER (PARTITION BY book, page ORDER BY
        coalesce(z.place, CASE WHEN s IS NULL THEN ord::DOUBLE WHEN since < s THEN 0 ELSE 'inf'::DOUBLE END),
        CASE WHEN z.place IS NULL AND since < s THEN t + z.ey ELSE 0 END, CASE WHEN z.place IS NULL AND since < s THEN l + z.ex ELSE 0 END, ord) AS place
    FROM ended WHERE NOT z.gone)"""
_REVIEW_WALK = f"""{_EDITED},
  rows AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page, ord) AS rn FROM (
    SELECT DISTINCT book, page, 0::BIGINT AS ord, 'page' AS label, NULL::INT AS ro, NULL::VARCHAR AS rp, false AS joins,
      substr(page, 9, 2)::INT % 7 <> 0 AND NOT coalesce(skip, false) AS reads, coalesce(discard, false) AS discard, entry_option, entry_part, entry_question
      FROM regions LEFT JOIN decisions USING (book, page)
    UNION ALL SELECT book, page, place, label, reading_option, reading_part, joins_next, NULL, NULL, NULL, NULL, NULL FROM reviewed WHERE label <> 'figure')),
  walk AS (
    SELECT DISTINCT book, 0::BIGINT AS rn, ''::VARCHAR AS page, 0::BIGINT AS ord, false AS live, false AS failed, 0 AS o, ''::VARCHAR AS p, 0::BIGINT AS q,
      0 AS eo, ''::VARCHAR AS ep, 0::BIGINT AS eq, []::VARCHAR[] AS kept, []::VARCHAR[] AS cur, 0 AS placed, false AS hit, []::VARCHAR[] AS got, 0 AS ncarried,
      list_transform(range(20), lambda n: CASE WHEN n = 0 THEN book % 4 ELSE 0 END) AS highs, list_transform(range(20), lambda n: 0::BIGINT) AS fresh FROM regions
    UNION ALL
    SELECT book, rn, page, ord, live1, failed1 OR (closes AND NOT ok),
      CASE WHEN acc_o THEN ro ELSE o1 END, CASE WHEN acc_o THEN 'A' WHEN acc_p THEN rp ELSE p1 END, CASE WHEN acc_o OR acc_p THEN 0 WHEN ok THEN q1 + 1 ELSE q1 END,
      eo1, ep1, eq1, CASE WHEN ok THEN [] ELSE kept1 END, CASE WHEN ok THEN [] WHEN isq THEN list_append(cur1, page || '|' || ord::VARCHAR) ELSE cur1 END,
      placed1 + ok::INT, ok, CASE WHEN ok THEN list_concat(kept1, list_append(cur1, page || '|' || ord::VARCHAR)) ELSE [] END, len(kept1)::INT,
      highs1, CASE WHEN ok THEN list_transform(fresh1, lambda n, k: CASE WHEN k = folder THEN greatest(n, q1 + 1) ELSE n END) ELSE fresh1 END
    FROM (
      SELECT *, live1 AND NOT failed1 AND label = 'option' AND coalesce(ro = o1 + 1, false) AS acc_o, live1 AND NOT failed1 AND label = 'part' AND coalesce(rp <> p1, false) AS acc_p,
        live1 AND NOT failed1 AND label = 'question' AS isq, live1 AND NOT failed1 AND label = 'question' AND NOT joins AS closes,
        live1 AND NOT failed1 AND label = 'question' AND NOT joins
          AND (placed1 > 0 OR (o1 > 0 AND p1 <> '' AND q1 + 1 <= coalesce(highs1[folder], 0) + 1)) AS ok
      FROM (
        SELECT *, (o1 - 1) * 2 + CASE p1 WHEN 'B' THEN 2 ELSE 1 END AS folder,
          CASE WHEN head THEN o1 ELSE weo END AS eo1, CASE WHEN head THEN p1 ELSE wep END AS ep1, CASE WHEN head THEN q1 ELSE weq END AS eq1
        FROM (
          SELECT r.book, r.rn, r.page, r.ord, r.label, r.ro, r.rp, r.joins, head, w.eo AS weo, w.ep AS wep, w.eq AS weq,
            CASE WHEN head THEN r.reads ELSE w.live END AS live1, NOT head AND w.failed AS failed1,
            CASE WHEN head AND r.reads AND r.entry_option IS NOT NULL THEN r.entry_option WHEN head AND w.live AND w.failed THEN w.eo ELSE w.o END AS o1,
            CASE WHEN head AND r.reads AND r.entry_option IS NOT NULL THEN r.entry_part WHEN head AND w.live AND w.failed THEN w.ep ELSE w.p END AS p1,
            CASE WHEN head AND r.reads AND r.entry_option IS NOT NULL THEN r.entry_question WHEN head AND w.live AND w.failed THEN w.eq ELSE w.q END AS q1,
            CASE WHEN NOT head THEN w.kept WHEN r.reads AND r.discard THEN [] WHEN w.live AND w.failed THEN [] WHEN w.live THEN list_concat(w.kept, w.cur) ELSE w.kept END AS kept1,
            CASE WHEN head THEN [] ELSE w.cur END AS cur1, CASE WHEN head THEN 0 ELSE w.placed END AS placed1,
            CASE WHEN head AND w.live AND NOT w.failed THEN list_transform(w.highs, lambda n, k: greatest(n, w.fresh[k])) ELSE w.highs END AS highs1,
            CASE WHEN head THEN list_transform(w.highs, lambda n: 0::BIGINT) ELSE w.fresh END AS fresh1
          FROM (SELECT *, label = 'page' AS head FROM rows) r JOIN walk w ON r.book = w.book AND r.rn = w.rn + 1)))),
  hits AS (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY ord) - 1 AS position FROM walk WHERE hit)"""


def _walk(select: str) -> str:
    return with_views("regions", f"{_WALK} {select}", recursive=True)


SQL = {
    "place_questions": _walk("SELECT * FROM placed"),
    "page_outcomes": _walk("SELECT * EXCLUDE (carried) FROM outcomes"),
    "held_pieces": _walk("SELECT * FROM fates WHERE held > 0"),
    "page_faults": _walk("SELECT * FROM faults"),
    "book_rollup": _walk("SELECT * FROM reports"),
    "subject_rollup": _walk(
        """SELECT 's' || (book::INT % 7)::VARCHAR AS subject, count(*) AS books, sum(pages)::BIGINT AS pages, sum(failures)::BIGINT AS failures,
           sum(collisions)::BIGINT AS collisions, sum(unfinished)::BIGINT AS unfinished, bool_and(clean) AS clean,
           count(*) FILTER (complete) AS complete_books FROM reports GROUP BY 1"""
    ),
    "page_summary": _walk(
        """SELECT o.book, o.page, o.questions, o.held, f.page IS NOT NULL AS misnumbered,
             (SELECT count(*) FROM regions r WHERE r.book::VARCHAR = o.book AND r.page = o.page AND label IN ('option', 'part')) AS markers,
             s.first, s.last FROM outcomes o LEFT JOIN faults f USING (book, page)
           LEFT JOIN (SELECT book, page, arg_min(option::VARCHAR || '/' || part || '/' || number::VARCHAR, position) AS first,
             arg_max(option::VARCHAR || '/' || part || '/' || number::VARCHAR, position) AS last FROM placed GROUP BY 1, 2) s USING (book, page)
           WHERE o.outcome = 'read'"""
    ),
    "run_starts": _walk("SELECT book, page, position, option, part, number FROM starts"),
    "continue_counters": _walk(
        """SELECT book, page, option, part, CASE WHEN option = 1 AND part = 'A' THEN book::INT % 4 ELSE 0 END AS counter
           FROM starts WHERE position = 0"""
    ),
    "piece_groups": _walk(
        """SELECT book, page, question_index, ord,
             row_number() OVER (PARTITION BY book, page, question_index ORDER BY ord) + extra AS piece,
             CASE WHEN bool_or(NOT joins_next) OVER (PARTITION BY book, page, question_index)
                  THEN count(*) OVER (PARTITION BY book, page, question_index) + extra ELSE 0 END AS pieces
           FROM (SELECT q.*, CASE WHEN question_index = 0 THEN coalesce(o.carried, 0) ELSE 0 END AS extra FROM (
             SELECT *, coalesce(sum((NOT joins_next)::INT) OVER (PARTITION BY book, page ORDER BY ord
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS question_index FROM regions WHERE label = 'question') q
             LEFT JOIN outcomes o ON o.book = q.book::VARCHAR AND o.page = q.page)"""
    ),
    "entry_groups": _walk("SELECT book::BIGINT AS book, page, entry_group FROM groups"),
    "label_counts": with_views("regions", "SELECT book, page, label, count(*) AS regions FROM regions GROUP BY 1, 2, 3"),
    "ignored_regions": with_views("regions", "SELECT book, page, count(*) AS ignored FROM regions WHERE label = 'figure' GROUP BY 1, 2"),
    "corrected_regions": with_views(
        "regions",
        """fixes AS (SELECT event_id AS ord, event_id % 90 AS k FROM events WHERE event_id % 9 = 4),
           fixed AS (SELECT r.*, f.k, CASE WHEN f.k % 2 = 0 THEN CASE WHEN f.k % 4 = 0 THEN 'question' ELSE 'option' END ELSE r.label END AS new_label
                     FROM regions r LEFT JOIN fixes f USING (ord))
           SELECT book, page, CASE WHEN k % 7 = 2 THEN ord * 10 ELSE ord END AS ord, new_label AS label,
             CASE WHEN k % 5 = 1 THEN k % 3 + 1 WHEN k IS NULL OR k % 2 = 1 THEN reading_option END AS reading_option,
             CASE WHEN k IS NULL OR (k % 2 = 1 AND k % 5 <> 1) THEN reading_part END AS reading_part,
             CASE WHEN k % 3 = 0 THEN k % 2 = 0 ELSE joins_next END AND new_label = 'question' AS joins_next
           FROM fixed WHERE k IS NULL OR k % 10 <> 3""",
    ),
    "reviewed_regions": with_views(
        "regions",
        f"""{_EDITED} SELECT * EXCLUDE (l, t, r, b), concat_ws(' ', concat_ws(',', l, t), concat_ws(',', r, t), concat_ws(',', r, b), concat_ws(',', l, b)) AS polygon_px
            FROM reviewed""",
    ),
    "page_decisions": with_views("regions", f"{_EDITED} SELECT * FROM decisions"),
    "reviewed_books": with_views(
        "regions",
        f"""{_REVIEW_WALK} SELECT book::VARCHAR AS book, page, ord, position, o AS option, p AS part, q AS number, len(got) - ncarried AS pieces, ncarried AS carried,
              CASE WHEN (o = 1 AND p = 'A' AND q <= book % 4) OR row_number() OVER (PARTITION BY book, o, p, q ORDER BY page, ord) > 1
                THEN 'collision' ELSE 'written' END AS outcome FROM hits""",
        recursive=True,
    ),
    "reviewed_layout": with_views(
        "regions",
        f"""{_REVIEW_WALK}, pieces AS (
              SELECT h.book, h.page, h.position, n, v.page AS piece_page, v.place AS piece, v.r - v.l AS width, v.b - v.t AS height, offset_x AS dx, offset_y AS dy
              FROM (SELECT book, page, position, unnest(got) AS g, unnest(range(len(got))) AS n FROM hits) h
              JOIN reviewed v ON v.book = h.book AND v.page || '|' || v.place::VARCHAR = g),
            run AS (SELECT *, sum(CASE WHEN n > 0 THEN dx ELSE 0 END) OVER w AS rx, sum(height + CASE WHEN n > 0 THEN 16 + dy ELSE 0 END) OVER w - height AS ry FROM pieces
              WINDOW w AS (PARTITION BY book, page, position ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
            SELECT book::VARCHAR AS book, page, position, piece_page, piece, (rx - min(rx) OVER s)::BIGINT AS x, (ry - min(ry) OVER s)::BIGINT AS y,
              (max(rx + width) OVER s - min(rx) OVER s)::BIGINT AS canvas_width, (max(ry + height) OVER s - min(ry) OVER s)::BIGINT AS canvas_height
            FROM run WINDOW s AS (PARTITION BY book, page, position)""",
        recursive=True,
    ),
    "drawn_boxes": """
        WITH b AS (SELECT l_orderkey AS box, least(l_partkey, l_partkey + l_linenumber * 3 - 9) + 3 AS x0, greatest(l_partkey, l_partkey + l_linenumber * 3 - 9) + 3 AS x1,
          l_suppkey - trunc(l_quantity)::BIGINT - 2 AS y0, l_suppkey - 2 AS y1 FROM lineitem)
        SELECT box, concat_ws(' ', concat_ws(',', x0, y0), concat_ws(',', x1, y0), concat_ws(',', x1, y1), concat_ws(',', x0, y1)) AS ring
        FROM b WHERE x1 - x0 >= 5 AND y1 - y0 >= 5""",
    "stack_layout": """
        WITH p AS (SELECT *, row_number() OVER w AS n, l_partkey % 700 + 50 AS width, l_suppkey % 300 + 20 AS height FROM lineitem
            WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)),
        run AS (SELECT *, sum(CASE WHEN n > 1 THEN l_partkey % 41 - 20 ELSE 0 END) OVER w AS rx,
            sum(height + CASE WHEN n > 1 THEN 16 + l_suppkey % 61 - 40 ELSE 0 END) OVER w - height AS ry FROM p
            WINDOW w AS (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT l_orderkey AS stack, l_linenumber, l_partkey, l_suppkey, (rx - min(rx) OVER s)::BIGINT AS x, (ry - min(ry) OVER s)::BIGINT AS y,
          (max(rx + width) OVER s - min(rx) OVER s)::BIGINT AS canvas_width, (max(ry + height) OVER s - min(ry) OVER s)::BIGINT AS canvas_height
        FROM run WINDOW s AS (PARTITION BY l_orderkey)""",
    "usable_detections": """
        WITH d AS (SELECT vec_id, j, (vec_id + j) % 4 AS class, CASE j WHEN 0 THEN vec_id % 33 WHEN 1 THEN (vec_id + 4) % 33 ELSE len(embedding) // 2 END AS points
                   FROM embeddings, (SELECT unnest([0, 1, 2]) AS j) WHERE j < vec_id % 2 + 2)
        SELECT vec_id::VARCHAR AS page, count(*) FILTER (points >= 3) AS kept, count(*) FILTER (points < 3) AS dropped,
          coalesce(string_agg(['option', 'part', 'question', 'unknown'][class + 1], ',' ORDER BY j) FILTER (points >= 3), '') AS labels
        FROM d GROUP BY 1""",
    "reading_order": f"""
        WITH {_RINGS}, d AS (SELECT vec_id, j, CASE j WHEN 0 THEN vec_id % 33 WHEN 1 THEN (vec_id + 4) % 33 ELSE len(xs) END AS n, xs, ys
                   FROM pixels, (SELECT unnest([0, 1, 2]) AS j) WHERE j < vec_id % 2 + 2),
        kept AS (SELECT vec_id, j, list_min(xs[1:n]) AS mx, list_min(ys[1:n]) AS my, row_number() OVER (PARTITION BY vec_id ORDER BY j) - 1 AS ord
                 FROM d WHERE n >= 3)
        SELECT vec_id::VARCHAR AS page, ord, row_number() OVER (PARTITION BY vec_id ORDER BY my, mx, ord) AS place FROM kept""",
    "median_skew": """
        SELECT vec_id, CASE WHEN vec_id % 10 = 7 THEN 0 ELSE round(degrees(atan(list_median(list_transform(embedding,
          lambda x: printf('%.4f', x::DOUBLE)::DOUBLE)))), 6) END AS angle FROM embeddings""",
}
