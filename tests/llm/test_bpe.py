import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from small import DOCUMENTS, as_rows, document_rows, documents, sentence

from paperloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_ranks(PATH))


@pytest.fixture(scope="module")
def encoding():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_right(vocabulary):
    assert sorted(vocabulary.ranks.tolist()) == list(range(len(vocabulary.keys)))
    assert vocabulary.find_all(vocabulary.keys) == list(range(len(vocabulary.keys)))
    assert [vocabulary.look_up(k) for k in vocabulary.keys] == list(range(len(vocabulary.keys)))
    rng = random.Random(0)
    strange = [rng.randbytes(rng.randint(1, 9)) for _ in range(5000)]
    known = {k: i for i, k in enumerate(vocabulary.keys)}
    assert vocabulary.find_all(strange) == [known.get(s, -1) for s in strange] == [vocabulary.look_up(s) for s in strange]


def test_ids_are_those_of_the_public_library(vocabulary, encoding):
    encode = bpe.encoder(vocabulary, public_tokenizers.PATTERN)
    rng = random.Random(1)
    texts = ["", " ", "\n\n  x", "<|endoftext|>", "a" * 5000, "'s'S I'll we're", "x" + " " * 300 + "y", "日本語のテキスト", "\U0001f600́"]
    texts += [sentence(rng, 200), "".join(chr(rng.choice([*range(1, 0xD800), *range(0xE000, 0x10FFFF)])) for _ in range(3000))]
    texts += ["".join(f"{chr(c)}a{chr(c)} " for c in range(start, start + 3000)) for start in range(0, 0xD800 - 3000, 3000)]
    texts += ["".join(rng.choices("ab '\n\t\x1c1²", k=400)) for _ in range(50)]
    for text in texts:
        ids = encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(text)
        assert bpe.decode(vocabulary, ids) == text.encode()


def test_memory_started_afresh_changes_nothing(vocabulary, encoding, monkeypatch):
    for name, value in {"REMEMBERED": 40, "MEMORY": 9000, "KEPT": 5, "PORTION": 700, "AT_A_TIME": 30}.items():
        monkeypatch.setattr(bpe, name, value)
    fresh = bpe.Vocabulary(vocabulary.keys)
    encode, text = bpe.encoder(fresh, public_tokenizers.PATTERN), sentence(random.Random(2), 3000)
    for part in (text[:5000], text):
        assert np.frombuffer(encode(part), "<u4").tolist() == encoding.encode_ordinary(part)


def test_memory_does_not_grow_with_the_texts(vocabulary, monkeypatch):
    fresh = bpe.Vocabulary(vocabulary.keys)
    encode, rng = bpe.encoder(fresh, public_tokenizers.PATTERN), random.Random(3)
    for _ in range(3):
        encode("".join(rng.choices("abcdefgh", k=10_000)))
    assert not fresh.known and fresh.held == 0
    monkeypatch.setattr(bpe, "MEMORY", 1 << 20)
    for _ in range(6):
        encode(" ".join("".join(rng.choices("abcdefghijklmnop", k=12)) for _ in range(2000)))
        assert sum(len(w) + len(ids) + bpe.EACH for w, ids in fresh.known.items()) <= bpe.MEMORY
    assert len(fresh.pieces) <= bpe.REMEMBERED and max(map(len, fresh.pieces)) <= fresh.longest


def test_a_vocabulary_without_some_bytes():
    small = bpe.Vocabulary([b"a", b"b", b"ab", b"abab"])
    assert small.merge(b"ababab") == [3, 2] and small.find_all([b"ab", b"x"]) == [2, -1]


def test_digest_and_round_trip(spark, encoding):
    docs = documents(spark)
    want = []
    for row in document_rows():
        ids = encoding.encode_ordinary(row[1] or "")
        packed = np.array(ids, "<u4").tobytes()
        want.append((row[0], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest()))
    assert as_rows(bpe.token_digest(docs, PATH, public_tokenizers.PATTERN)) == sorted(want, key=repr)
    encoded = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN)
    decoded = bpe.decode_ids(encoded, PATH)
    assert sorted((r.doc_id or -1, bytes(r.bytes)) for r in decoded.collect()) == sorted((r[0] or -1, (r[1] or "").encode()) for r in document_rows())


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert bpe.token_digest(empty, PATH, public_tokenizers.PATTERN, with_ids=True).count() == 0
