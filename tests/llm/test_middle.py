import hashlib
import random
import re

import numpy as np
import pytest
from small import DOCUMENTS, as_rows, document_rows, documents

import __spark_entry__ as entry
from paperloom.llm import middle


def plain(text, doc_id, seed=7, rate=100, first=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < first else f"<P>{p}<S>{s}<M>{m}"
    return len(lines), "spm" if h[3] % 100 < first else "psm", len(p), len(m), out


AWKWARD = [
    "\n", "\n\n\n", "a\n", "\na", "no end", "x<P>y\nz", "<S>", "a<M>\n", "<\n>P\n<<P", "<P\n", "<", "é\n日本\n x\r\ny\x0bz\n", "\x00\n\x00",
    "\n" * 200_000, "ab\n" * 70_000, "line\n\n" * 30_000 + "end", "x" * 65_535 + "\n" + "y" * 65_536 + "\n\n", "é" * 90_000 + "\nq",
]


def rows_of():
    return document_rows(3) + [(500 + i, t, *[None] * 7) for i, t in enumerate(AWKWARD)]


@pytest.mark.parametrize(("rate", "first"), [(100, 50), (40, 0), (100, 100), (0, 50)])
def test_matches_brute_force(spark, rate, first):
    rows = rows_of()
    got = middle.fill_in_middle(documents(spark, rows), rate=rate, suffix_first=first)
    assert got.columns == [c for c in DOCUMENTS.fieldNames() if c != "n"] + list(middle.ADDED)
    assert as_rows(got.select("doc_id", "text", *middle.ADDED)) == sorted(((r[0], r[1], *plain(r[1], r[0], 7, rate, first)) for r in rows), key=repr)
    back = got.select("text", middle.restored(got.output, got.form).alias("again")).collect()
    assert all((r.text or "") == r.again for r in back)


def test_registered_query(spark, tmp_path):
    rows = rows_of()
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(r[0], *(p := plain(r[1], r[0]))[:4], sha(p[4]), sha(r[1] or "")) for r in rows]
    assert as_rows(entry.queries()["op11_fill_in_middle"](spark, str(tmp_path))) == sorted(want, key=repr)


@pytest.mark.parametrize("make", [
    lambda r: r.sample(range(300_000), 900),
    lambda r: r.sample(range(300_000), 150_000),
    lambda r: [*range(5, 140_000), 200_000, *range(210_000, 210_900)],
    lambda r: [i for i in range(200_000) if i % 2],
    lambda r: [65_535, 65_536, 131_071, 131_072],
    lambda r: [0],
])
def test_select_in_every_kind_of_container(make):
    offsets = np.array(sorted(make(random.Random(1))))
    found = middle.BoundarySet()
    for key in range(int(offsets[-1]) // middle.SPAN + 1):
        inside = offsets[offsets // middle.SPAN == key]
        found.add(key, inside - key * middle.SPAN)
    assert len(found) == len(offsets)
    assert [found.select(k) for k in range(0, len(offsets), 37)] == offsets[::37].tolist() and found.select(len(offsets) - 1) == offsets[-1]
    for k in (-1, len(offsets)):
        with pytest.raises(IndexError):
            found.select(k)


def test_containers_take_the_smallest_form():
    kind = lambda x: type(middle.container(np.array(x, np.uint16)))
    assert kind(range(0, 60_000, 100)) is middle.ArrayContainer
    assert kind(range(1000, 60_000)) is middle.RunContainer
    assert kind(range(0, 60_000, 3)) is middle.BitmapContainer


def test_sentinels_that_cannot_be_told_from_text_are_refused(spark):
    docs = documents(spark)
    for bad in (("<P>", "<P>", "<M>"), ("ab", "ba", "cd"), ("x", "<S>", "<M>")):
        with pytest.raises(ValueError, match="sentinels"):
            middle.fill_in_middle(docs, sentinels=bad)


def test_empty_table(spark):
    assert middle.fill_in_middle(spark.createDataFrame([], DOCUMENTS)).count() == 0
