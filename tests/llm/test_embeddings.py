import random

import numpy as np

from small import as_rows, groups_of

from paperloom.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n string, size string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "x", "x") for i, v in rows], SCHEMA).repartition(3)


def plain(rows):
    """(id, n_links, component_id, kept), every pair compared."""
    unit = []
    for _, v in rows:
        a = None if v is None or not v or any(x is None for x in v) else np.array(v, np.float32).astype(np.float64)
        unit.append(a / np.linalg.norm(a) if a is not None and np.isfinite(a).all() and a.any() else None)
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9
    ]
    group = groups_of(links, range(len(rows)))
    members = {}
    for i, g in group.items():
        members.setdefault(g, []).append(rows[i][0])
    out = []
    for i, (own, _) in enumerate(rows):
        least = min((m for m in members[group[i]] if m is not None), default=None)
        out.append((own, sum(i in p for p in links), least, own == least))
    return sorted(out, key=repr)


def clusters(seed, sizes, dim=32, spread=0.12, lone=150):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(lone)]
    for size in sizes:
        base = rng.normal(size=dim)
        base /= np.linalg.norm(base)
        rows += [(base + rng.normal(size=dim) * spread / np.sqrt(dim)) * rng.uniform(0.1, 9) for _ in range(size)]
    ids = random.Random(seed).sample(range(10_000), len(rows))
    return [(i, [float(np.float32(x)) for x in r]) for i, r in zip(ids, rows)]


def test_matches_brute_force(spark):
    # The largest group is beyond the longest list and is counted in blocks.
    rows = clusters(3, [2, 2, 3, 9, 30, 200])
    rows += [(20_000 + i, rows[-1][1]) for i in range(5)] + [(20_010, rows[0][1]), (rows[3][0], rows[3][1])]
    assert as_rows(embeddings.near_vectors(vectors(spark, rows))) == plain(rows)


def test_vectors_that_link_with_nothing(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
        (7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0]), (10, [1.0, 1.0, 1.0]), (None, [1.0, 1.01]), (None, None), (7, [5.0, -5.0]), (7, [1.0, 1.0]),
        (11, [1e-30, 1e-30]), (12, [3e38, 3e38]),
    ]
    assert as_rows(embeddings.near_vectors(vectors(spark, rows))) == plain(rows)


def test_empty_table(spark):
    assert embeddings.near_vectors(vectors(spark, [])).count() == 0


def test_audit_sees_what_is_missing(spark):
    rows = clusters(4, [6], lone=10)
    df = spark.createDataFrame([(i, 1, len(v), v) for i, v in rows], "node long, n long, size int, vector array<float>")
    exact = {i: n for i, n, _, _ in plain(rows)}
    full = spark.createDataFrame(list(exact.items()), "node long, links long")
    assert embeddings.audit(df, full) == 1.0
    assert embeddings.audit(df, full.where("links = 0")) == 0.0


def test_blocks_count_every_pair(spark, monkeypatch):
    rows = clusters(5, [40], lone=0)
    df = spark.createDataFrame([(7, i, 1 + i % 2, v) for i, v in rows], "component long, node long, n long, vector array<float>")
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    unit = {i: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for i, v in rows}
    want = sorted((a, sum(1 + b % 2 for b in unit if b != a and unit[a] @ unit[b] >= 0.9)) for a in unit)
    assert sorted(tuple(r) for r in embeddings.count_in_blocks(df).collect()) == want


def bridged(seed, size=200, dim=32):
    """Two groups with cosines above 0.98 inside and a few at 0.9 across."""
    rng = np.random.default_rng(seed)
    base, other = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
    angle = np.arccos(0.86)
    centres = [base, np.cos(angle) * base + np.sin(angle) * other]
    rows = [c + rng.normal(size=dim) * 0.12 / np.sqrt(dim) for c in centres for _ in range(size)]
    return [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(rows)]


def test_crowded_groups_linked_by_what_full_lists_leave_out(spark):
    rows = bridged(8)
    want = plain(rows)
    assert {r[2] for r in want} == {0} and any(r[1] == 199 for r in want)
    assert as_rows(embeddings.near_vectors(vectors(spark, rows))) == want


def test_cuts_grow_with_the_table():
    for bits in range(1, 21):
        together = (1 - np.arccos(embeddings.THRESHOLD) / np.pi) ** bits
        assert 1 - (1 - together) ** embeddings.trees_for(bits) >= 0.99


def test_large_cells_are_cut_again(spark):
    rng = np.random.default_rng(9)
    codes = [(i, 8, 0, int(c)) for i, c in enumerate(rng.integers(0, 2**40, 900) * 4)]  # the first two bits are the same
    df = spark.createDataFrame(codes, "node long, size int, tree long, code long")
    held = {}
    for r in embeddings.recut(df, 2).collect():
        held.setdefault((r.depth, r.cell), []).append(r.node)
    code = {i: c for i, _, _, c in codes}
    assert max(map(len, held.values())) <= embeddings.LEAF and sum(map(len, held.values())) == 900
    assert all(code[i] % 2**depth == cell for (depth, cell), own in held.items() for i in own)


def test_lone_pairs_that_no_cut_finds(spark, monkeypatch):
    rows = clusters(6, [2] * 20 + [100], lone=40)
    graph = embeddings.neighbour_graph

    def blind(*args):
        lists, nodes = graph(*args)
        degree = lists.where("link").groupBy("u").count().where("count > 20").select("u")
        return embeddings.settle(lists.join(degree, "u", "left_semi")), nodes

    monkeypatch.setattr(embeddings, "neighbour_graph", blind)
    assert as_rows(embeddings.near_vectors(vectors(spark, rows))) == plain(rows)
