import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import types as T
from small import DOCUMENTS, as_rows, document_rows, documents, sentence

import __spark_entry__ as entry
from paperloom.llm import resample


def features(text, longest):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(rows, target, longest=1, least=20, percent=10, seed=2024):
    """(id, n_features, weight, score, rank) by the rules alone; repeated rows are interchangeable."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for r in rows for f in features(r[1], longest)[1])
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for r in rows:
        words, own = features(r[1], longest)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in map(bucket, own)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append((r[0], len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words) >= least))
    best = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = best[: percent * len(best) // 100]
    rest = list(out)
    for x in drawn:
        rest.remove(x)
    return sorted([(*x[:4], i + 1) for i, x in enumerate(drawn)] + [(*x[:4], None) for x in rest], key=repr)


TARGET = ["Some words, of the KAlo mi tus", None, "", "42 renö\x00vo"] * 3


def target_of(spark):
    return spark.createDataFrame([(t,) for t in TARGET], "text string")


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (1, 55), (3, 30), (2, 100), (1, 0)])
def test_matches_brute_force(spark, longest, percent):
    rows = document_rows(5)
    got = resample.resample(documents(spark, rows), target_of(spark), longest=longest, percent=percent)
    assert as_rows(got) == plain(rows, TARGET, longest, percent=percent)


def test_registered_query_and_drawn_documents(spark, tmp_path):
    rows = document_rows(6, 300)
    docs = documents(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    target_of(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    want = plain(rows, TARGET)
    assert as_rows(entry.queries()["op12_importance_resampling"](spark, str(tmp_path))) == want
    drawn = resample.draw(docs, target_of(spark))
    assert drawn.columns == [c for c in docs.columns if c != "score"]
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(x[0] for x in want if x[4])


def test_pieces_of_long_texts_change_nothing(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice(["Ab", "é", "9", " ", "-", "\x00", "日本", "\n", "~"]) for _ in range(3000)).encode()
    whole = {n: [x for _, part in resample.buckets_of(text, n) for x in part.tolist()] for n in (1, 2, 3)}
    for size in (1, 7, 100):
        monkeypatch.setattr(resample, "PIECE", size)
        for n, want in whole.items():
            parts = list(resample.buckets_of(text, n))
            assert len(parts) > 1 and Counter(x for _, part in parts for x in part.tolist()) == Counter(want)
            assert sum(words for words, _ in parts) == len(features(text.decode(), 1)[0])


def test_widens_a_bracket_that_misses_the_cutoff(spark, monkeypatch):
    rows = [(i, (i * 7919) % 1000, i, i) for i in range(1000)]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "score", "_tkey", "_row")])
    scored = spark.createDataFrame(rows, schema)
    n, found = resample.brackets(scored, 10)
    assert n == 1000 and found[-1] == (None, None) and found[0][0] <= 900 <= found[0][1] and found[0][1] - found[0][0] < 20
    for wrong in ([(0, 5), (880, 910), (None, None)], [(950, 990), (None, None)]):
        monkeypatch.setattr(resample, "brackets", lambda *_: (1000, wrong))
        assert sorted(r.score for r in scored.where(resample.cutoff(scored)).collect()) == list(range(900, 1000))


def test_many_equal_rows_are_cut_at_the_right_count(spark):
    text = sentence(random.Random(1), 25)
    rows = [(None, text, *[None] * 7)] * 400 + [(i, text, *[None] * 7) for i in range(200)]
    got = resample.resample(documents(spark, rows), target_of(spark), percent=33).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 199))
    assert as_rows(resample.resample(documents(spark, rows), target_of(spark), percent=33)) == plain(rows, TARGET, percent=33)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert resample.resample(empty, target_of(spark)).count() == 0 and resample.draw(empty, target_of(spark)).count() == 0
    rows = document_rows(5, 30)
    assert as_rows(resample.resample(documents(spark, rows), target_of(spark).where("false"))) == plain(rows, [])
