import random
import re
from collections import Counter

import pytest
from small import DOCUMENTS, document_rows, documents

from paperloom.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), epochs=3):
    """Share, stop at the limit, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {s: 0.0 for s in order}, set(order)
    while free:
        rest = total - sum(target[s] for s in order if s not in free)
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if share[s] > epochs * sizes[s]}
        target |= {s: float(epochs * sizes[s]) for s in above} if above else share
        free = free - above if above else set()
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_match_sharing_again_and_again(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 10, 1000, 50_000]) for s in [*"abcdefgé", None]}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = plain_targets(sizes)
    assert {r.source: r.target for r in got} == pytest.approx(want)


def check_mix(rows, got):
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    by_source = Counter()
    for r, s in zip(rows, sizes):
        by_source[r[3]] += s
    target = plain_targets(dict(by_source))
    assert sorted((r.doc_id is None, r.doc_id, r["size"]) for r in got) == sorted((r[0] is None, r[0], s) for r, s in zip(rows, sizes))
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"] and r.source_size == by_source[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for source, words in taken.items():
        assert abs(words - target[source]) <= 0.5


def test_mix_of_awkward_documents(spark):
    rows = document_rows()
    first = mixing.mix(mixing.sized(documents(spark))).collect()
    check_mix(rows, first)
    assert sorted(map(repr, first)) == sorted(map(repr, mixing.mix(mixing.sized(documents(spark).repartition(5)), block_words=1024).collect()))


def test_block_length_does_not_change_what_is_taken(spark):
    small = mixing.mix(mixing.sized(documents(spark)), block_words=7).drop("first_turn").collect()
    large = mixing.mix(mixing.sized(documents(spark)), block_words=100_000).drop("first_turn").collect()
    assert sorted(map(repr, small)) == sorted(map(repr, large))


def test_schedule_is_even_all_along(spark):
    quotas = {"a": 500, "b": 200, "c": 100, "d": 1, None: 33}
    got = mixing.schedule(spark.createDataFrame(list(quotas.items()), "source string, blocks long")).collect()
    assert len({r.turn for r in got}) == len(got) == sum(quotas.values())
    for source, blocks in quotas.items():
        mine = [r for r in got if r.source == source]
        assert sorted(r.block for r in mine) == list(range(blocks))
        assert [r.block for r in sorted(mine, key=lambda r: r.turn)] == list(range(blocks))
        for upto in range(50, sum(quotas.values()), 50):
            assert abs(sum(r.turn < upto for r in mine) - upto * blocks / sum(quotas.values())) < 6


def test_documents_of_the_mix(spark):
    docs = documents(spark)
    taken = {(r.doc_id, r.source): r for r in mixing.mix(mixing.sized(docs)).collect()}
    times = Counter((r.doc_id, r.source) for r in mixing.mix_documents(docs).collect())
    for key, r in taken.items():
        assert abs(times[key] - (r.taken / r["size"] if r["size"] else 0)) <= 0.5 or key[0] in (None, 205)
    assert mixing.mix_documents(docs).columns == docs.columns


def test_empty_table_and_no_words(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert mixing.mix(mixing.sized(empty)).count() == 0 and mixing.mix_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, None, *[None] * 7), (2, " ", *[None] * 7)], DOCUMENTS)
    assert [(r.taken, r.target) for r in mixing.mix(mixing.sized(blank)).collect()] == [(0, 0.0)] * 2


def test_long_runs_of_equal_rows(spark):
    rows = spark.range(200_000).selectExpr("CAST(NULL AS bigint) AS doc_id", "'s' AS source", "'a b c' AS text")
    other = spark.range(3000).selectExpr("CAST(NULL AS bigint) AS doc_id", "IF(id % 2 = 0, 's', 't') AS source", "CONCAT('text ', id) AS text")
    got = mixing.mix(mixing.sized(rows.unionByName(other)), block_words=4)
    sums = {r.source: r for r in got.groupBy("source").agg({"*": "count", "size": "sum", "taken": "sum", "target": "max"}).collect()}
    assert {s: r["count(1)"] for s, r in sums.items()} == {"s": 201_500, "t": 1500}
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 1 for r in sums.values())


def test_points_of_late_turns_do_not_overflow(spark):
    t = 2**32 - 5
    high, low = t // 65536, t % 65536
    assert (high * mixing.GOLDEN % mixing.CIRCLE * 65536 + low * mixing.GOLDEN) % mixing.CIRCLE == t * mixing.GOLDEN % mixing.CIRCLE
    assert max(high * mixing.GOLDEN, mixing.CIRCLE * 65536 + low * mixing.GOLDEN) < 2**63


def test_turns_differ_where_several_sources_are_late(spark):
    quotas = {"a": 100_000, "b": 3, "c": 2, None: 1}
    got = mixing.schedule(spark.createDataFrame(list(quotas.items()), "source string, blocks long")).collect()
    assert len({r.turn for r in got}) == len(got) == sum(quotas.values())
