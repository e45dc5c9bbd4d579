import random
import zlib

from small import DOCUMENTS, document_rows, documents

from paperloom.llm import sharding


def test_digest_of_awkward_documents(spark):
    rows = document_rows()
    got = sharding.shard_digest(documents(spark)).collect()
    sizes = sorted((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows if r[0] is not None)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got if r.doc_id is not None) == sizes
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    for shard in {r.shard for r in got}:
        places = sorted(r.slot for r in got if r.shard == shard)
        assert places == list(range(len(places))) and 0 <= shard < 24


def test_shards_come_out_near_equal(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.choice([5, 50, 500, 5000]), *[None] * 7) for i in range(4000)]
    got = sharding.shard_digest(spark.createDataFrame(rows, DOCUMENTS)).groupBy("shard").sum("size").collect()
    loads = [r[1] for r in got]
    assert len(loads) == 24 and max(loads) - min(loads) <= 5008 and max(loads) < 1.03 * min(loads)


def test_growing_moves_only_what_fills_the_new_shard(spark):
    rng = random.Random(3)
    records = spark.createDataFrame([(rng.randrange(512), rng.randint(1, 99)) for _ in range(5000)], "vslot int, size long")
    stored, sizes = sharding.balanced_map(records, 8, 512)
    assert {r.version for r in stored.select("version").distinct().collect()} == {1, 2}
    second = stored.where("version = 2")
    third = sharding.edit_map(second, sizes, 9)
    weight = {r.vslot: r.bytes for r in sizes.collect()}
    old, new = ({r.vslot: r.shard for r in m.collect()} for m in (second, third))
    moved = sum(weight[s] for s in old if old[s] != new[s])
    loads = [sum(weight[s] for s in new if new[s] == k) for k in range(9)]
    assert len(new) == 512 and max(loads) - min(loads) < 2 * max(weight.values()) and moved < 1.35 * sum(weight.values()) / 9


def test_documents_keep_their_columns(spark):
    docs = documents(spark)
    got = sharding.shard_documents(docs, 5)
    assert got.count() == docs.count() and set(docs.columns) <= set(got.columns) and {r.shard for r in got.collect()} <= set(range(5))
    assert sharding.shard_documents(docs.limit(0), 5).count() == 0 and sharding.shard_digest(docs.limit(0)).count() == 0


def test_long_runs_and_null_ids(spark):
    """More equal rows than a piece holds, and many null ids with different texts, which share no slot."""
    run = spark.range(300_000).selectExpr("CAST(NULL AS bigint) AS doc_id", "CAST(NULL AS string) AS text")
    texts = spark.range(5000).selectExpr("CAST(NULL AS bigint) AS doc_id", "CONCAT('text ', id) AS text")
    got = sharding.shard_digest(run.unionByName(texts)).groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    assert sum(r["count(1)"] for r in got) == 305_000 and all(r["max(slot)"] == r["count(1)"] - 1 for r in got)
    slots = sharding.shard_digest(texts).groupBy("vslot").count().collect()
    assert len(slots) > 3000 and max(r["count"] for r in slots) < 12
