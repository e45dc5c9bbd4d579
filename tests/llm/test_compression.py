import os
import random
import re
from collections import Counter

import zstandard
from small import DOCUMENTS, as_rows, document_rows, documents, sentence

from paperloom.llm import compression


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    doubled = len(lines) - len(set(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), doubled, len(inside)


def test_counts_match_brute_force(spark):
    rng = random.Random(4)
    extra = ["a b c a b c a b c", "a b c x a b c", "a a a a", "x\nx\n\n\ny\nx ", "# <b> & | %$*", "a\x0bb\x0cc\r\n d", "w " * 60 + "end"]
    rows = document_rows() + [(300 + i, t, *[None] * 7) for i, t in enumerate(extra)]
    rows += [(400 + i, " ".join(rng.choices("abcd", k=rng.randint(0, 80))), *[None] * 7) for i in range(30)]
    got = compression.judge(documents(spark, rows))
    want = []
    for r in rows:
        counts = plain_counts(r[1])
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        want.append((r[0], *counts, failed))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert as_rows(got.select(columns)) == sorted(want, key=repr)
    assert all(not (r.kept and r.base_failed) for r in got.collect())


def verdict(text):
    return compression.within_bands(text.encode(), zstandard.ZstdCompressor(level=3).compress)[2]


def test_bands():
    rng = random.Random(1)
    prose = "\n".join(sentence(rng, 30) for _ in range(40))
    assert verdict("") and verdict("short") and verdict(prose) and verdict(prose[:300])
    assert not verdict("the same again. " * 200)
    assert not verdict(os.urandom(6000).hex() and "".join(map(chr, rng.choices(range(33, 127), k=6000))))
    # Half of the chunks repeat, though the whole does not.
    assert not verdict(prose * 1 + "".join("spam and eggs " * 73 for _ in range(len(prose) // 1024 or 1)))


def test_the_rest_behind_full_chunks_is_judged():
    rng = random.Random(2)
    prose = sentence(rng, 400).encode("ascii", "ignore")[:1024].decode()
    junk = "".join(map(chr, rng.choices(range(33, 127), k=1000)))
    compress = zstandard.ZstdCompressor(level=3).compress
    ratio, share, fits = compression.within_bands((prose + junk).encode(), compress)
    assert 0.34 <= ratio <= 0.80 and share > compression.CHUNK_SHARE and not fits
    assert verdict(prose)


def test_empty_table(spark):
    assert compression.judge(spark.createDataFrame([], DOCUMENTS)).count() == 0
