import zlib

import numpy as np
import pytest
from small import DOCUMENTS, documents

import __spark_entry__ as entry
from paperloom.llm import langid


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    w = langid.new_model(["a", "b", "c"], 3, np.float64)["weights"]
    x, labels = rng.integers(97, 105, (14, 5)), rng.integers(0, 3, 5)
    _, g = langid.gradients(w, x, labels, 6)
    checked = 0
    for name, values in w.items():
        flat = np.flatnonzero(np.abs(g[name]) > 1e-6) if values.size > 600 else np.arange(values.size)
        for k in rng.choice(flat, min(12, len(flat)), replace=False):
            at = np.unravel_index(k, values.shape)
            kept, losses = values[at], []
            for step in (1e-6, -1e-6):
                values[at] = kept + step
                losses.append(langid.gradients(w, x, labels, 6)[0])
            values[at] = kept
            assert (losses[0] - losses[1]) / 2e-6 == pytest.approx(g[name][at], rel=2e-3, abs=1e-7)
            checked += 1
    assert checked > 40


def test_windows_label_every_byte_once():
    model = langid.new_model(["a", "b"], 1, np.float64)
    rng = np.random.default_rng(2)
    texts = [rng.integers(32, 127, n).astype(np.uint8).tobytes() for n in (0, 1, 95, 96, 97, 500)]
    got = langid.pooled(model, texts)
    for text, row in zip(texts, got):
        parts = []
        for start in range(0, len(text), langid.CORE):
            padded = b"\0" * langid.EDGE + text + b"\0" * (langid.CORE + langid.EDGE)
            x = np.frombuffer(padded[start : start + langid.CORE + 2 * langid.EDGE], np.uint8)[:, None]
            p, _ = langid.probabilities(model["weights"], x, langid.CORE)
            parts.append(p[: len(text) - start, 0])
        want = np.concatenate(parts).mean(0) if parts else np.zeros(2)
        assert row == pytest.approx(want) and (not parts or sum(row) == pytest.approx(1))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = entry.queries()["op8_byte_bigru"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(lang)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_awkward_documents(spark):
    docs = documents(spark)
    model = langid.learn(docs)
    told = langid.predict(docs, model)
    assert told.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"]
    for r in told.collect():
        unread = r.text is None or not any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == unread and (r.score == 0) == unread and r.lang_pred in ("en", "fr", "und")
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns
    assert {200, 201, 202, 203}.isdisjoint(r.doc_id for r in kept.collect()) and kept.count() == docs.count() - 5


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert langid.predict(empty, langid.learn(empty)).count() == 0
    one = spark.createDataFrame([(1, "some text", None, *[None] * 6)], DOCUMENTS)
    assert [(r.lang_pred, r.score) for r in langid.predict(one, langid.learn(one)).collect()] == [("und", 0.0)]


def test_sample_is_bounded_and_holds_no_held_out_document(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 5)
    docs = documents(spark)
    sample = langid.training_sample(docs)
    held = {r.text for r in docs.where(langid.fold(docs.doc_id) == 1).collect()}
    open_texts = {r.text for r in docs.where(langid.fold(docs.doc_id) != 1).collect()}
    assert len(sample) == 10 and all(len(s.decode()) <= langid.SAMPLE_CHARS for _, s in sample)
    assert all(any(s.decode() in t for t in open_texts if t) for _, s in sample)
    assert {s.decode() for _, s in sample} - (held - open_texts) == {s.decode() for _, s in sample}


def test_repeated_texts_are_sampled_once(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 300)
    rows = [(i, "the same text" if i % 2 else f"text {i}", "en", *[None] * 6) for i in range(3000)]
    sample = langid.training_sample(spark.createDataFrame(rows, DOCUMENTS))
    assert len(sample) == len(set(sample)) == 300
