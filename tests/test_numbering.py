"""The numbering fold: against a plain re-statement of the rules, whole and in segments."""

import random

import pytest

from paperloom.operators import numbering as nb
from paperloom.plans import ordered
from paperloom.workload import numbering as work
from paperloom.workload.views import Tables

CUT = {"HOT": 1, "THIN": 1, "PER_PARTITION": 400}  # every book is cut where a row of it is sampled
WHOLE = {"HOT": 10**9}


def sizes(monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(ordered, name, value)


REGIONS = "book string, page string, ord long, label string, reading_option int, reading_part string, joins_next boolean"
DECISIONS = "book string, page string, skip boolean, discard boolean, entry_option int, entry_part string, entry_question long"


def by_hand(pages, regions, highs, decisions):
    """One book, page by page with whole-page lists: {page: (outcome, placements, held, carried out, state)}."""
    option, part, question, carry = 0, "", 0, 0
    highs, out = dict(highs), {}
    for page, detected in pages:
        skip, discard, moved = decisions.get(page, (False, False, None))
        if not detected:
            out[page] = ("failed", [], None, carry, (option, part, question))
            continue
        if skip:
            out[page] = ("skipped", [], None, carry, (option, part, question))
            continue
        if moved:
            option, part, question = moved
        pending, carry = (0 if discard else carry), 0
        o, p, q, held, placed, bad = option, part, question, 0, [], False
        for label, ro, rp, joins in regions.get(page, []):
            if label == "option":
                if ro == o + 1:
                    o, p, q = ro, "A", 0
            elif label == "part":
                if rp is not None and rp != p:
                    p, q = rp, 0
            else:
                held += 1
                if joins:
                    continue
                if not o or not p:
                    bad = True
                    break
                q += 1
                placed.append((o, p, q, held))
                held = 0
        if not bad:
            before = None
            for o2, p2, n, _ in placed:
                if (o2, p2) != before:
                    before = (o2, p2)
                    free = highs.get(before, 0) + 1
                    if n != free:
                        bad = n > free
                        break
        if bad:
            out[page] = ("failed", [], None, 0, (option, part, question))
            continue
        option, part, question = o, p, q
        done = []
        for o2, p2, n, size in placed:
            done.append((o2, p2, n, size, pending))
            pending = 0
            highs[(o2, p2)] = max(highs.get((o2, p2), 0), n)
        carry = pending + held
        out[page] = ("read", done, held, carry, (option, part, question))
    return out


def random_book(rng, pages, moves):
    listed, regions, decisions = [], {}, {}
    for i in range(pages):
        name = f"p{i}.png"
        listed.append((name, rng.random() > 0.08))
        rows = []
        for _ in range(rng.randint(0, 7)):
            kind = rng.random()
            if kind < 0.2:
                rows.append(("option", rng.choice([1, 2, 3, 4, 5, None]), None, False))
            elif kind < 0.35:
                rows.append(("part", None, rng.choice(["A", "B", None]), False))
            else:
                rows.append(("question", None, None, rng.random() < 0.25))
        regions[name] = rows
        if rng.random() < 0.25:
            moved = None
            if moves and rng.random() < 0.6:
                moved = (rng.randint(0, 12), rng.choice(["A", "B", ""]), rng.randint(0, 9))
            decisions[name] = (rng.random() < 0.2, rng.random() < 0.3, moved)
    return listed, regions, decisions


@pytest.fixture(scope="module", params=[False, True], ids=["plain", "moved"])
def books(request):
    rng = random.Random(7)
    made = {}
    for b in range(6):
        made[f"b{b}"] = (*random_book(rng, 60 if b == 0 else 12, request.param), {(1, "A"): b} if b else {})
    return made


def frames(spark, books):
    pages, regions, decisions, folders = [], [], [], []
    for book, (listed, found, chosen, highs) in books.items():
        for page, detected in listed:
            pages.append((book, page, detected))
            for i, (label, ro, rp, joins) in enumerate(found[page]):
                regions.append((book, page, i, label, ro, rp, joins))
        for page, (skip, discard, moved) in chosen.items():
            decisions.append((book, page, skip, discard, *(moved or (None, None, None))))
        for (o, p), n in highs.items():
            folders.append((book, o, p, n))
    return (
        spark.createDataFrame(pages, "book string, page string, detected boolean"),
        spark.createDataFrame(regions, REGIONS),
        spark.createDataFrame(folders, "book string, option int, part string, highest long"),
        spark.createDataFrame(decisions, DECISIONS),
    )


@pytest.mark.parametrize("settings", [WHOLE, CUT], ids=["whole", "segments"])
def test_fold_follows_the_rules(spark, books, settings, monkeypatch):
    sizes(monkeypatch, settings)
    folded = nb.number_books(nb.fold_rows(*frames(spark, books))).collect()
    got_pages = {(r.book, r.page): r for r in folded if r.kind == "page"}
    placed = {}
    for r in sorted((r for r in folded if r.kind == "question"), key=lambda r: r.position):
        placed.setdefault((r.book, r.page), []).append((r.option, r.part, r.number, r.pieces, r.carried))
    assert len(got_pages) == sum(len(b[0]) for b in books.values())
    for book, (listed, regions, decisions, highs) in books.items():
        for page, (outcome, done, held, carry, state) in by_hand(listed, regions, highs, decisions).items():
            row = got_pages[(book, page)]
            assert row.outcome == outcome, (book, page, row)
            assert placed.get((book, page), []) == done
            assert row.carried_out == carry
            assert row.held == held
            assert (row.exit_option, row.exit_part, row.exit_question) == state


@pytest.mark.parametrize("settings", [WHOLE, CUT], ids=["whole", "segments"])
def test_odd_readings_fold_alike_whole_and_in_segments(spark, settings, monkeypatch):
    sizes(monkeypatch, settings)
    pages = spark.createDataFrame([("b", f"{n:03d}.jpg", True) for n in range(1, 7)], "book string, page string, detected boolean")
    odd = [("option", 100_001, None), ("part", None, "C"), ("question", None, None), ("part", None, "B"), ("question", None, None)]
    plain = [("option", 1, None), ("part", None, None), ("question", None, None), ("part", None, "B"), ("question", None, None)]
    outcomes = []
    for readings in (odd, plain):
        made = [("b", f"{n:03d}.jpg", i, *r, False) for n in range(1, 7) for i, r in enumerate(readings)]
        folded = nb.number_books(nb.fold_rows(pages, spark.createDataFrame(made, REGIONS)))
        outcomes.append(sorted(map(str, folded.collect())))
    assert outcomes[0] == outcomes[1]


def test_negative_control(spark, books):
    """The comparison can fail: another reading order gives other placements."""
    pages, regions, folders, decisions = frames(spark, books)
    straight = nb.number_books(nb.fold_rows(pages, regions, folders, decisions)).filter("kind = 'question'")
    turned = regions.selectExpr("book", "page", "-ord AS ord", "label", "reading_option", "reading_part", "joins_next")
    other = nb.number_books(nb.fold_rows(pages, turned, folders, decisions)).filter("kind = 'question'")
    columns = ["book", "page", "option", "part", "number", "pieces"]
    assert straight.select(columns).exceptAll(other.select(columns)).count() > 0


@pytest.mark.parametrize(
    ("entry", "regions", "expected"),
    [
        ((0, "", 0), [("option", 1, None), ("part", None, "A"), ("question", None, None), ("question", None, None)], ["1/A/1", "1/A/2"]),
        ((2, "A", 0), [("option", None, None), ("part", None, None), ("question", None, None)], ["2/A/1"]),
        ((1, "A", 4), [("question", None, None), ("question", None, None)], ["1/A/5", "1/A/6"]),
    ],
)
def test_single_pages(spark, entry, regions, expected):
    pages = spark.createDataFrame([("b", "1.png", True)], "book string, page string, detected boolean")
    rows = spark.createDataFrame([("b", "1.png", i, *r, False) for i, r in enumerate(regions)], REGIONS)
    start = spark.createDataFrame([("b", "1.png", False, False, *entry)], DECISIONS)
    held = spark.createDataFrame([("b", entry[0], entry[1] or "A", entry[2])], "book string, option int, part string, highest long")
    folded = nb.number_books(nb.fold_rows(pages, rows, held, start))
    found = [f"{r.option}/{r.part}/{r.number}" for r in folded.filter("kind = 'question'").orderBy("position").collect()]
    assert found == expected


def test_faults(spark):
    """A folder holding 1..5: 6 continues it, 3 collides with 6 free, 9 would leave a gap."""
    for counter, outcome, fault in ((5, "read", None), (2, "read", (0, 3, 6)), (8, "failed", None)):
        pages = spark.createDataFrame([("b", "1.png", True)], "book string, page string, detected boolean")
        rows = spark.createDataFrame([("b", "1.png", i, "question", None, None, False) for i in range(2)], REGIONS)
        start = spark.createDataFrame([("b", "1.png", False, False, 1, "A", counter)], DECISIONS)
        held = spark.createDataFrame([("b", 1, "A", 5)], "book string, option int, part string, highest long")
        page = nb.page_outcomes(nb.number_books(nb.fold_rows(pages, rows, held, start))).first()
        assert page.outcome == outcome
        got = None if page.fault_position is None else (page.fault_position, page.fault_number, page.fault_free)
        assert got == fault


@pytest.mark.parametrize("reviewed", [False, True])
def test_segments_agree_on_the_tables(spark, small, reviewed, monkeypatch):
    t = Tables(spark, small)
    rows = work.reviewed_rows(t) if reviewed else nb.fold_rows(work._pages(t), t.regions, work._folders(t))
    found = []
    for settings in (WHOLE, CUT):
        sizes(monkeypatch, settings)
        found.append(sorted(map(str, nb.number_books(rows).collect())))
    assert found[0] == found[1] and found[0]

