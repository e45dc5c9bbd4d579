import random
import re

from small import DOCUMENTS, as_rows, document_rows, documents, sentence
from pyspark.sql import functions as F

from paperloom.llm import lines


def words_of(line):
    return tuple(re.findall(r"[^\x20\x09-\x0D]+", line))


def near(a, b):
    if max(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_drops(rows):
    """{(doc_id, text): {line number: edits}}, every line against every earlier one. Equal rows are one document."""
    seen, out = [], {}
    for doc_id, text in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        drops = out.setdefault((doc_id, text), {})
        for i, line in enumerate(text.split("\n")):
            own = words_of(line)
            if len(own) < 3:
                continue
            if own in seen:
                drops[i] = 0
            elif any(near(own, s) for s in seen):
                drops[i] = 1
            seen.append(own)
    return out


def mixed_rows(seed):
    rng = random.Random(seed)
    stock = [sentence(rng, n).split(" ") for n in (2, 3, 4, 4, 5, 5, 6, 9, 20, 60)]
    rows = []
    for i in range(50):
        chosen = []
        for _ in range(rng.randint(0, 5)):
            w = list(rng.choice(stock))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(w) + 1)
                rng.choice([lambda: w.insert(k, "new"), lambda: w.pop(min(k, len(w) - 1)) if len(w) > 1 else None, lambda: w.__setitem__(min(k, len(w) - 1), rng.choice(["other", "third"]))])()
            chosen.append(rng.choice([" ", "  ", "\t"]).join(w))
        rows.append((i, "\n".join(chosen), *[None] * 7))
    return rows


def check(spark, rows):
    # Documents that share an id stand in the order of a hash of their texts, which plain_drops does not know: none here.
    drops = plain_drops(rows)
    want = []
    for r in rows:
        d = drops.get((r[0], r[1]), {})
        n = len(r[1].split("\n")) if r[1] is not None else 0
        want.append((r[0], n, sum(e == 0 for e in d.values()), sum(d.values()), ",".join(map(str, sorted(d)))))
    assert as_rows(lines.line_digest(documents(spark, rows))) == sorted(want, key=repr)
    return drops


def test_matches_brute_force(spark):
    assert any(e == 1 for d in check(spark, mixed_rows(1)).values() for e in d.values())


def test_awkward_documents(spark):
    rows = document_rows()
    drops = check(spark, rows)
    docs = documents(spark)
    got = lines.dedup_lines(docs, length_col="n_chars")
    assert got.columns == docs.columns
    want = []
    for r in rows:
        gone = drops.get((r[0], r[1]), {})
        text = r[1] if not gone else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone)
        if not gone or words_of(text):
            want.append((r[0], text, *r[2:4], r[4] if not gone else len(text), *r[5:]))
    assert as_rows(got) == sorted(want, key=repr)


def test_one_line_that_very_many_share(spark):
    rng = random.Random(6)
    base = sentence(rng, 12).split(" ")
    rows = [(i, " ".join([*base[:5], f"v{i}", *base[6:]]), *[None] * 7) for i in range(500)]
    assert lines.line_digest(documents(spark, rows)).where("n_near = 1").count() == 499


def test_keys_are_those_of_the_shorter_line(spark):
    rng = random.Random(7)
    long = [sentence(rng, 30).split(" ") for _ in range(20)]
    made = [(k, 0, w) for k, w in enumerate(long)] + [(100 + k, i, w[:i] + w[i + 1 :]) for k, w in enumerate(long) for i in (0, 7, 29)]
    at = "struct<doc_id:long,tkey:long,line_no:int>"
    df = spark.createDataFrame([(k * 100 + i, 0, (k, 0, 0), w) for k, i, w in made], f"k1 long, k2 long, at {at}, words array<string>")
    keys = lines.variants(df).collect()
    left_out = {(r.k1, r.i): r.left_out for r in keys}
    whole = {r.k1: r.whole for r in keys}
    for k, i, _ in made[20:]:
        assert left_out[(k - 100) * 100, i] == whole[k * 100 + i]


def test_verification(spark):
    cases = [("a b c d e", "a b c d e"), ("a b c d e", "a b x d e"), ("a b c d e", "b c d e"), ("a b c d", "a b c d e"), ("a b c d e", "x b c d y"), ("a b c d e", "b a c d e"), ("a b c", "c a b")]
    df = spark.createDataFrame([(a.split(), b.split()) for a, b in cases], "a array<string>, b array<string>")
    got = [r.ok for r in df.select(lines.within_one(F.col("a"), F.col("b")).alias("ok")).collect()]
    assert got == [True, True, True, True, False, False, False]


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert lines.line_digest(empty).count() == 0 and lines.dedup_lines(empty).count() == 0
