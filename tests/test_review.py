"""Review logs: against a replay, edit by edit, of each page."""

import random

import pytest

from paperloom.operators import numbering as nb
from paperloom.operators import review

REGIONS = (
    "book long, page string, ord long, label string, reading_option int, reading_part string, joins_next boolean, polygon_px array<struct<x:int,y:int>>"
)


def box(x, y, x1, y1):
    return [(x, y), (x1, y), (x1, y1), (x, y1)]


def replay(regions, edits):
    """One page's regions after its edits, in order: (ord, label, option, part, joins, ring, offset)."""
    state = {o: dict(label=la, ro=ro, rp=rp, joins=j and la == "question", ring=list(ring), off=(0, 0), key=(float(o), 0, 0)) for o, la, ro, rp, j, ring in regions}
    ever = set(state)
    is_sorted = False
    for _, action, o, label, ro, rp, x, y, x1, y1, place in sorted(edits, key=lambda e: e[0]):
        r = state.get(o)
        if action == "draw" and o not in ever and abs(x1 - x) >= 5 and abs(y1 - y) >= 5:
            ring = box(min(x, x1), min(y, y1), max(x, x1), max(y, y1))
            state[o] = dict(label=label, ro=None, rp=None, joins=False, ring=ring, off=(0, 0), key=(float("inf") if is_sorted else float(o), 0, 0))
            ever.add(o)
        elif action == "sort":
            is_sorted = True
            for s in state.values():
                s["key"] = (0.0, min(p[1] for p in s["ring"]), min(p[0] for p in s["ring"]))
        elif r is None:
            continue
        elif action == "move":
            r["ring"] = [(a + x, b + y) for a, b in r["ring"]]
        elif action == "relabel":
            r.update(label=label, ro=None, rp=None)
            if label != "question":
                r.update(joins=False, off=(0, 0))
        elif action == "read":
            r.update(ro=ro, rp=rp)
        elif action == "join" and r["label"] == "question":
            r["joins"] = not r["joins"]
        elif action == "offset":
            r["off"] = (x, y)
        elif action == "place":
            r["key"] = (place, 0, 0)
        elif action == "delete":
            del state[o]
    order = sorted(state, key=lambda o: (*state[o]["key"], o))
    return [(o, s["label"], s["ro"], s["rp"], s["joins"], s["ring"], s["off"]) for o in order for s in [state[o]]]


def random_page(rng):
    regions = [
        (o, rng.choice(["question", "question", "option", "part"]), rng.choice([None, 1, 2]), rng.choice([None, "A"]), rng.random() < 0.3, box(x, y, x + 30, y + 20))
        for o in range(rng.randint(0, 5))
        for x, y in [(rng.randint(0, 99), rng.randint(0, 99))]
    ]
    edits = []
    for seq in range(rng.randint(0, 25)):
        action = rng.choice(["draw", "move", "relabel", "read", "join", "join", "offset", "place", "delete", "sort"])
        if action == "sort" and rng.random() < 0.7:
            continue
        edits.append((
            seq, action, None if action == "sort" else rng.randint(0, 8),
            rng.choice(["question", "option", "part"]) if action in ("draw", "relabel") else None, rng.choice([None, 3]) if action == "read" else None,
            rng.choice([None, "B"]) if action == "read" else None, rng.randint(-30, 30), rng.randint(-30, 30), rng.randint(-30, 30), rng.randint(-30, 30),
            rng.choice([-1.0, 0.5, 2.5, 7.0]),
        ))
    return regions, edits


def frames(spark, pages):
    regions = [(1, page, *r) for page, (found, _) in pages.items() for r in found]
    edits = [(1, page, s, a, o, la, ro, rp, None, *rest) for page, (_, log) in pages.items() for s, a, o, la, ro, rp, *rest in log]
    return spark.createDataFrame(regions, REGIONS), spark.createDataFrame(edits, review.EDITS)


def test_matches_a_replay(spark):
    rng = random.Random(11)
    pages = {f"p{n}": random_page(rng) for n in range(120)}
    got = {}
    for r in sorted(review.reviewed_regions(*frames(spark, pages)).collect(), key=lambda r: r.place):
        ring = [(p.x, p.y) for p in r.polygon_px]
        got.setdefault(r.page, []).append((r.ord, r.label, r.reading_option, r.reading_part, r.joins_next, ring, (r.offset_x, r.offset_y)))
        assert r.place == len(got[r.page])
    assert got == {page: want for page, (found, log) in pages.items() if (want := replay(found, log))}


@pytest.mark.parametrize(
    ("log", "label", "reading", "joins", "offset"),
    [
        ([("relabel", "question")], "question", None, False, (0, 0)),
        ([("relabel", "question"), ("join", None), ("relabel", "part"), ("relabel", "question")], "question", None, False, (0, 0)),
        ([("join", None)], "option", 2, False, (0, 0)),
        ([("relabel", "question"), ("join", None), ("offset", None)], "question", None, True, (4, -3)),
        ([("relabel", "question"), ("offset", None), ("relabel", "option"), ("join", None)], "option", None, False, (0, 0)),
        ([("relabel", "question"), ("join", None), ("join", None)], "question", None, False, (0, 0)),
    ],
)
def test_a_marker_read_as_two(spark, log, label, reading, joins, offset):
    found = [(5, "option", 2, None, False, box(0, 0, 9, 9))]
    edits = [(i, a, 5, la, None, None, 4, -3, None, None, None) for i, (a, la) in enumerate(log)]
    r = review.reviewed_regions(*frames(spark, {"p": (found, edits)})).first()
    assert (r.label, r.reading_option, r.joins_next, (r.offset_x, r.offset_y)) == (label, reading, joins, offset)


def test_the_last_entry_state_counts(spark):
    rows = [(1, "p", 3, "enter", 2, "A", 7), (1, "p", 1, "enter", 5, "B", 0), (1, "p", 2, "discard", None, None, None), (1, "q", 1, "skip", None, None, None)]
    edits = spark.createDataFrame(rows, "book long, page string, seq long, action string, reading_option int, reading_part string, question long")
    got = {r.page: tuple(r)[2:] for r in review.page_decisions(edits).collect()}
    assert got == {"p": (False, True, 2, "A", 7), "q": (True, False, None, None, None)}


def test_edits_reach_fold_and_layout(spark):
    """A question over two pages: a box is drawn, joined to the next page's and lined up against it; a moved entry leaves a gap."""
    found = {
        "1": [(0, "option", 1, None, False, box(0, 0, 9, 9)), (1, "question", None, None, False, box(0, 20, 100, 60))],
        "2": [(0, "question", None, None, False, box(5, 0, 85, 30)), (1, "question", None, None, False, box(5, 50, 85, 90))],
        "3": [(0, "question", None, None, False, box(0, 0, 50, 50))],
    }
    log = {
        "1": [(0, "draw", 7, "question", None, None, 60, 100, 0, 70, None), (1, "join", 7, None, None, None, None, None, None, None, None)],
        "2": [(0, "offset", 0, None, None, None, 6, -10, None, None, None)],
        "3": [],
    }
    regions, edits = frames(spark, {p: (found[p], log[p]) for p in found})
    moved = spark.createDataFrame([(1, "3", 1, "enter", 1, "A", 9)], "book long, page string, seq long, action string, reading_option int, reading_part string, question long")
    reviewed = review.reviewed_regions(regions, edits)
    pages = regions.selectExpr("book", "page", "true AS detected").distinct()
    rows = nb.fold_rows(pages, reviewed.drop("ord").withColumnRenamed("place", "ord"), None, review.page_decisions(edits.unionByName(moved, allowMissingColumns=True)))
    folded = nb.number_books(rows)
    outcomes = nb.page_outcomes(folded)
    assert {r.page: (r.outcome, r.cause) for r in outcomes.collect()} == {"1": ("read", None), "2": ("read", None), "3": ("failed", nb.fold.GAP)}
    pieces = review.question_pieces(reviewed, outcomes, nb.carried_into(outcomes))
    laid = nb.stack_layout(pieces.selectExpr("struct(page, position) AS stack", "place", "width", "height", "dx", "dy"))
    got = sorted((r.stack.page, r.stack.position, r.place.page, r.place.ord, r.x, r.y, r.canvas_width, r.canvas_height) for r in laid.collect())
    assert got == [
        ("1", 0, "1", 2, 0, 0, 100, 40),
        ("2", 0, "1", 3, 0, 0, 86, 66),
        ("2", 0, "2", 1, 6, 36, 86, 66),
        ("2", 1, "2", 2, 0, 0, 80, 40),
    ]
