import random
import re

import pytest
import xxhash
from small import DOCUMENTS, as_rows, documents, groups_of

from paperloom.llm import simhash
from paperloom.llm.graph import components


def plain_fingerprint(text):
    spaces = " \t\n\r\v\f"
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = "".join("\0" if c in spaces else c for c in text).split("\0")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_match_brute_force(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    group = groups_of(links, range(len(rows)))
    members = {}
    for i, g in group.items():
        members.setdefault(g, []).append(rows[i].doc_id)
    least = {g: min((m for m in ids if m is not None), default=None) for g, ids in members.items()}
    want = sorted(((rows[i].doc_id, prints[i], least[group[i]]) for i in range(len(rows))), key=repr)
    got = simhash.near_duplicates(docs)
    assert as_rows(got) == sorted(((d, p - (p >> 63 << 64), c) for d, p, c in want), key=repr)


def test_no_link_is_missed_and_none_is_wrong(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        prints |= {base} | {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(12)}
    prints = [p - (p >> 63 << 64) for p in prints]
    want = sorted((a, b) for a in prints for b in prints if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2)
    got = simhash.link_fingerprints(spark.createDataFrame([(p,) for p in prints], "fp long"))
    assert as_rows(got) == sorted(want, key=repr) and want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_exploded_table_is_not_broadcast(spark):
    plan = plan_of(simhash.link_fingerprints(spark.range(5).selectExpr("id AS fp")))
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_the_table_of_all_rows_is_not_broadcast(spark):
    copies = spark.range(2000).selectExpr("id AS doc_id", "sha(cast(id % 600 AS string)) AS text")
    told = simhash.near_duplicates(copies)
    assert sorted(r.component_id for r in told.collect()) == sorted(i % 600 for i in range(2000))
    assert not re.search(r"HashJoin \[fp#\w+\], \[fp#\w+\], \w+, BuildLeft", plan_of(told))


def test_documents_are_not_broadcast_when_one_of_each_group_is_kept(spark):
    copies = spark.range(2000).selectExpr("id AS doc_id", "sha(cast(id % 600 AS string)) AS text")
    kept = simhash.keep_one(copies)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(600))
    assert not re.search(r"HashJoin \[coalesce\(doc_id#[^\n]*BuildLeft", plan_of(kept))


def test_references_are_32_bits_apart():
    rows = [r & (2**64 - 1) for r in simhash.references(63)]
    assert {bin(a ^ b).count("1") for a in rows for b in rows if a != b} == {32}


def test_sparks_hash_is_the_same(spark):
    words = ["", "a", "ab c", "ein längerer Text, der über zweiunddreißig Bytes geht"]
    df = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("xxhash64(w) h", "w")
    assert all(r.h % 2**64 == xxhash.xxh64_intdigest(r.w.encode(), 42) for r in df.collect())


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark)
    told = simhash.grouped(docs, "doc_id", "text").collect()
    least = {}
    for r in told:
        least[r.root] = r.component_id
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(least.values(), key=repr)
    assert None in least.values() and set(map(repr, kept.collect())) <= set(map(repr, docs.collect()))


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "loops"])
def test_components(spark, shape):
    rng = random.Random(1)
    if shape == "chain":
        order = rng.sample(range(400), 400)
        pairs = list(zip(order, order[1:]))
    elif shape == "star":
        pairs = [(0, i) for i in range(1, 300)] + [(500 + i, 501 + i) for i in range(0, 20, 2)]
    else:
        pairs = [(i, i) for i in range(5)] + [(1, 2), (2, 1), (1, 2), (7, 3)]
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    got = components(spark.createDataFrame(pairs, "a long, b long"))
    want = groups_of(pairs, {n for p in pairs for n in p})
    assert as_rows(got) == sorted(((n, want[n]) for n in nodes), key=repr)
