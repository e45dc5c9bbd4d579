"""The pipeline against the stages' brute-force versions, one after the other."""

import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from small import documents, document_rows, groups_of
from test_lines import plain_drops, words_of
from test_mixing import check_mix
from test_simhash import plain_fingerprint

import corpus_pipeline
from paperloom.llm import langid, mixing
from paperloom.llm.common import settle


def test_stages_in_order(spark, tmp_path):
    docs = documents(spark, [r for r in document_rows() if r[0] not in (None, 205)])
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "simhash_near_dedup", "source_mix", "byte_bpe"]

    told = settle(stages["language_id"](spark, docs, ""))
    model = langid.learn(docs)
    rows = [tuple(r) for r in docs.collect()]
    scores = langid.pooled(model, [(r[1] or "").encode() for r in rows]).max(1)
    rows = [r for r, s in zip(rows, scores) if r[1] and any(c.isalpha() for c in r[1]) and s >= langid.MIN_SCORE]
    assert sorted(r.doc_id for r in told.collect()) == sorted(r[0] for r in rows) and told.columns == names

    thinned = settle(stages["line_dedup"](spark, told, ""))
    drops = plain_drops(rows)
    kept = []
    for r in rows:
        gone = drops[r[0], r[1]]
        text = "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone)
        if words_of(text):
            kept.append((r[0], text, *r[2:4], len(text)))
    assert sorted((r.doc_id, r.text, r.n_chars) for r in thinned.collect()) == sorted((k[0], k[1], k[4]) for k in kept)

    single = settle(stages["simhash_near_dedup"](spark, thinned, ""))
    prints = [plain_fingerprint(k[1]) for k in kept]
    group = groups_of([(i, j) for i in range(len(kept)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2], range(len(kept)))
    least = {}
    for i, g in group.items():
        least[g] = min(least.get(g, kept[i][0]), kept[i][0])
    assert sorted(r.doc_id for r in single.collect()) == sorted(least.values()) and single.columns == names

    mixed = settle(stages["source_mix"](spark, single, ""))
    left = [tuple(r) for r in single.collect()]
    taken = mixing.mix(mixing.sized(single)).collect()
    check_mix(left, taken)
    times = Counter(r.doc_id for r in mixed.collect())
    assert all(abs(times[r.doc_id] - r.taken / r["size"]) <= 0.5 for r in taken) and mixed.columns == names

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in mixed.collect():
        ids = encoding.encode_ordinary(r.text)
        packed = np.array(ids, "<u4").tobytes()
        want.append((r.doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest(), ids))
    final = stages["byte_bpe"](spark, mixed, "")
    assert sorted(tuple(r) for r in final.collect()) == sorted(want)

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(want)


def test_empty_table(spark, tmp_path):
    documents(spark, document_rows()).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
