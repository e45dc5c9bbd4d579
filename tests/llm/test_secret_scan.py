import hashlib
import random
import re

import numpy as np
import pytest
from small import DOCUMENTS, as_rows, document_rows, documents, sentence

import __spark_entry__ as entry
from paperloom.llm import secret_scan


def plain_base(text):
    """(start, kind, end) by the rules over code points; letters outside ASCII never match a keyword."""
    text = text or ""
    found = []
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [(m.start(), 0, m.end())] * (len(m.group(2)) >= 8)
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(found)


def listed(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans)


AWKWARD = [
    'é token = "0123456789abcdef0123456789abcdef" ü', "token: secret: abcdefghijk", "PassWD='x y' api_key=12345678 APIKEY:1234567", "toKen=abcdefgh",
    "AKIAABCDEFGHIJKL AKIAABCDEFGHIJK xAKIA0000000000001", "日本" * 9 + "deadbeef" * 5 + "g" + "0" * 31, "secret=" * 5, "token=token=abcdefgh",
    "password = ghp_aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1vW3x", "a" * 16, "0" * 100_000, "x" * 70_000 + "1 " + "Ab1" * 50_000, "secret\n=\nabcdefgh",
]


def rows_of():
    return document_rows(8) + [(600 + i, t, *[None] * 7) for i, t in enumerate(AWKWARD)]


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    w = secret_scan.new_weights(1, np.float64)
    examples = secret_scan.made_up([], 4, 5)
    x, part, lengths = secret_scan.laid_rows(examples)
    labels = np.array([e[3] for e in examples])
    _, g = secret_scan.gradients(w, x, part, lengths, labels)
    for name, values in w.items():
        flat = np.flatnonzero(np.abs(g[name]) > 1e-7)
        for k in rng.choice(flat, min(10, len(flat)), replace=False):
            at = np.unravel_index(k, values.shape)
            kept, losses = values[at], []
            for step in (1e-6, -1e-6):
                values[at] = kept + step
                losses.append(secret_scan.gradients(w, x, part, lengths, labels)[0])
            values[at] = kept
            assert (losses[0] - losses[1]) / 2e-6 == pytest.approx(g[name][at], rel=5e-3, abs=1e-8)


def test_rows_of_work_change_no_answer(monkeypatch):
    w = secret_scan.new_weights(2)
    examples = [*secret_scan.made_up([], 30, 3), (b"", b"q" * 5000 + b"Z9" * 700, b"end", 0), (b"x", b"1", b"", 0)]
    want = secret_scan.logits(w, examples)
    x, part, lengths = secret_scan.laid_rows([e for e in examples if len(e[1]) <= secret_scan.SAMPLE_BYTES])
    act = secret_scan.activations(w, x)
    pooled = [np.where((part == s)[:, :, None], act, 0).max(1) for s in secret_scan.SEGMENTS]
    mean = np.where((part == 2)[:, :, None], act, 0).sum(1) / lengths[:, None]
    plain = secret_scan.head(w, np.concatenate([*pooled, mean, (np.log2(lengths) / 8)[:, None]], 1))[0]
    short = [i for i, e in enumerate(examples) if len(e[1]) <= secret_scan.SAMPLE_BYTES]
    assert want[short] == pytest.approx(plain, abs=1e-4)
    for row, rows in ((32, 3), (128, 1)):
        monkeypatch.setattr(secret_scan, "ROW", row)
        monkeypatch.setattr(secret_scan, "ROWS", rows)
        assert secret_scan.logits(w, examples) == pytest.approx(want, abs=1e-4)


@pytest.fixture(scope="module")
def model():
    return secret_scan.train([])


def test_finds_made_up_secrets_it_has_not_seen(model):
    fresh = secret_scan.made_up([], 400, seed=77)
    _, reached = secret_scan.judged(model, fresh)
    label = np.array([e[3] for e in fresh])
    assert reached[label == 1].mean() > 0.9 and reached[label == 0].mean() < 0.03


def test_thresholds_and_calibration():
    p = np.linspace(0, 1, 100)
    assert (p >= secret_scan.threshold(p, 0.95)).sum() == 95 and secret_scan.threshold(p, 1.0) == 0
    assert secret_scan.threshold(np.array([]), 0.9) == np.inf
    rng = np.random.default_rng(1)
    z = rng.normal(0, 2, 4000)
    slope, shift = secret_scan.calibration(z, (rng.random(4000) < 1 / (1 + np.exp(-(2 * z - 1)))).astype(int))
    assert slope == pytest.approx(2, rel=0.15) and shift == pytest.approx(-1, abs=0.25)


def test_base_spans_match_brute_force(spark, model):
    rows = rows_of()
    got = secret_scan.scan_secrets(documents(spark, rows), model=model).collect()
    told = sorted((repr(r.doc_id), listed([(s.start, secret_scan.KINDS.index(s.kind), s.end) for s in r.findings if s.kind != "learned"])) for r in got)
    assert told == sorted((repr(r[0]), listed(plain_base(r[1]))) for r in rows)
    for r in got:
        learned = [s for s in r.findings if s.kind == "learned"]
        others = [s for s in r.findings if s.kind != "learned"]
        assert [(s.start, secret_scan.KINDS.index(s.kind)) for s in r.findings] == sorted((s.start, secret_scan.KINDS.index(s.kind)) for s in r.findings)
        assert all(0 <= s.score <= 1 for s in learned) and all(s.score is None for s in others)
        assert not any(a.start < b.end and b.start < a.end for a in learned for b in others)


def test_adds_what_the_rules_miss_and_leaves_prose_alone(spark, model):
    rng = random.Random(2)
    secret = "ghp_aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1vW3x"
    rows = [(i, sentence(rng, 40), *[None] * 7) for i in range(50)]
    rows.append((90, f"é {sentence(rng, 5)} Authorization: Bearer {secret}, fin", *[None] * 7))
    got = {r.doc_id: r.findings for r in secret_scan.scan_secrets(documents(spark, rows), model=model).collect()}
    start = rows[-1][1].index(secret)
    assert [(s.kind, s.start, s.end) for s in got.pop(90)] == [("learned", start, start + len(secret))]
    assert not any(got.values())


def test_registered_query(spark, tmp_path):
    rows = rows_of()
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.queries()["op13_secret_cnn"](spark, str(tmp_path))
    want = []
    for r in rows:
        base = plain_base(r[1])
        counts = [sum(k == i for _, k, _ in base) for i in range(3)]
        want.append((r[0], *counts, hashlib.sha256(listed(base).encode()).hexdigest()))
    assert as_rows(got.drop("spans")) == sorted(want, key=repr)
    held = {repr(r.doc_id): r.spans.split(",") for r in got.collect()}
    assert all(set(listed(plain_base(r[1])).split(",")) <= {*held[repr(r[0])], ""} for r in rows)


def test_whole_table_against_its_own_model(spark):
    """The query's answer on a given table is the model's verdict on every candidate, sought without Spark."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = secret_scan.train(secret_scan.findings(secret_scan.gather(docs)))
    want = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        spans = secret_scan.base_spans(raw)
        other = [c for c in secret_scan.candidates(raw, spans) if not any(s < c[1] and c[0] < e for s, _, e in spans)]
        near = [(raw[max(s - 24, 0) : s], raw[s:e], raw[e : e + 24]) for s, e, _ in other]
        spans += [(s, 3, e) for (s, e, _), ok in zip(other, secret_scan.judged(model, near)[1]) if ok]
        text = lambda at: len(raw[:at].decode())  # noqa: E731, B023
        want.append((r.doc_id, listed([(text(s), k, text(e)) for s, k, e in sorted(spans)])))
    assert as_rows(entry.queries()["op13_secret_cnn"](spark, sf).select("doc_id", "spans")) == sorted(want, key=repr)


def test_sample_is_bounded_and_holds_different_findings(spark):
    keys = [f"token = {hashlib.md5(str(i).encode()).hexdigest()}" for i in range(40)]
    rows = [(i, keys[i % 40], *[None] * 7) for i in range(400)] + [(1000 + i, f"card {10**15 + i} ok", *[None] * 7) for i in range(50)]
    gathered = secret_scan.gather(documents(spark, rows))
    sample = secret_scan.findings(gathered, 30, 20)
    assert len(set(sample)) == len(sample) == 50 and sum(s[3] for s in sample) == 30
    assert len(secret_scan.findings(gathered, 500, 500)) == 90


def test_empty_table(spark, model):
    assert secret_scan.scan_secrets(spark.createDataFrame([], DOCUMENTS), model=model).count() == 0


def candidates_of(gathered):
    rows = gathered.selectExpr("explode(others) AS c").select("c.*").distinct().collect()
    return sorted({(bytes(r.before), bytes(r.inside), bytes(r.after), int(r.found)) for r in rows})


def test_model_comes_from_every_candidate(spark):
    """More different candidates than a bounded sample would hold: scores are those of the model of all of them."""
    md5 = [hashlib.md5(str(i).encode()).hexdigest() for i in range(9000)]
    rows = [(i, f"at {md5[i][:6]} token = {md5[i]}", *[None] * 7) for i in range(2500)]
    rows += [(10_000 + i, f"of {md5[i][:5]} card {10**15 + i} ok", *[None] * 7) for i in range(5000)]
    missed = [e[1].decode() for e in secret_scan.made_up([], 30, 99) if e[3]]
    rows += [(20_000 + i, f"use {x} now", *[None] * 7) for i, x in enumerate(missed)]
    docs = documents(spark, rows)
    every = candidates_of(secret_scan.gather(docs))
    assert len(every) > 7500
    scored = [(r.doc_id, s.score) for r in secret_scan.scan_secrets(docs).collect() for s in r.findings if s.kind == "learned"]
    p, reached = secret_scan.judged(secret_scan.train(every), every)
    want = sorted(float(x) for x, ok, e in zip(p, reached, every, strict=True) if ok and not e[3])
    assert want and sorted(x for _, x in scored) == want


def test_shards_take_part_whole_and_in_any_order(spark):
    rows = [(i, f"token = {hashlib.md5(str(i).encode()).hexdigest()} card {10**15 + i} ok", *[None] * 7) for i in range(200)]
    gathered = secret_scan.gather(documents(spark, rows))
    model = secret_scan.learn(gathered, 150, 40, shard=60)
    again = secret_scan.learn(gathered.unionByName(gathered).repartition(5), 150, 40, shard=60)
    assert model["limits"] == again["limits"] and all((w == again["weights"][n]).all() for n, w in model["weights"].items())
    one = secret_scan.learn(gathered, 150, 40)
    want = secret_scan.train(candidates_of(gathered), 150, 40)
    assert one["limits"] == want["limits"] and all((w == want["weights"][n]).all() for n, w in one["weights"].items())
    assert any((w != want["weights"][n]).any() for n, w in model["weights"].items())


def test_every_byte_and_every_example_is_learned_from():
    rng = random.Random(3)
    inside = [bytes(rng.choices(b"abcDEF0123", k=n)) for n in (16, 95, 96, 97, 5000)]
    for raw in inside:
        cut = secret_scan.pieces((b"x", raw, b"y", 1))
        assert b"".join(i for _, i, _, _ in cut) == raw and {(b, a, k) for b, _, a, k in cut} == {(b"x", b"y", 1)}
        assert max(len(i) for _, i, _, _ in cut) <= secret_scan.SAMPLE_BYTES and min(len(i) for _, i, _, _ in cut) >= 16
    sample = [(b"", raw, b"", k % 2) for k, raw in enumerate(inside)]
    learned, kept = secret_scan.examples_of(sample, 5, 0, 0)
    assert all(any(e[1].startswith(i) for _, i, _, _ in learned) or e in kept for e in sample)
    for ones in (1, 7, 3000):
        labels = np.array([1] * ones + [0] * 100)
        plan = secret_scan.schedule(labels, 5, np.random.default_rng(0))
        assert set(plan.ravel().tolist()) == set(range(len(labels))) and len(plan) % secret_scan.ROUNDS == 0
        assert (labels[plan].sum(1) == secret_scan.BATCH // 2).all()


def test_counted_thresholds_and_calibration_are_those_of_single_scores():
    rng = np.random.default_rng(4)
    z, n = rng.integers(-9, 9, 40), rng.integers(1, 9, 40)
    labels = (rng.random(40) < 0.5).astype(int)
    many = np.repeat(np.arange(40), n)
    assert secret_scan.calibration(z, labels, n) == pytest.approx(secret_scan.calibration(z[many], labels[many]))
    for recall in (0.3, 0.95, 1.0):
        assert secret_scan.threshold(z / 9, recall, n) == secret_scan.threshold(z[many] / 9, recall)
