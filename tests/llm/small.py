"""Small inputs with the awkward cases, and plain helpers."""

import random

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.IntegerType()),
        # Names that operators use themselves.
        T.StructField("fp", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("n", T.StringType()),
    ]
)
SYLLABLES = ["ka", "lo", "mi", "ren", "tus", "vo", "shi", "dra", "pel", "ön", "q", "bé"]


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(words))


def document_rows(seed: int = 0, count: int = 60) -> list[tuple]:
    """Prose, exact and near copies, shared lines, nulls in every column, empty and blank texts, one long text, repeated rows."""
    rng = random.Random(seed)
    rows = []
    shared = sentence(rng, 12)
    for i in range(count):
        text = "\n".join([sentence(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 5))] + [shared] * (i % 3 == 0))
        rows.append([i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", "c", None])])
    for i in range(0, 12, 2):
        rows.append([100 + i, rows[i][1], "en", "a"])  # exact copies
        words = rows[i + 1][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append([101 + i, " ".join(words), "fr", "b"])  # near copies
    rows += [
        [200, None, "en", "a"],
        [201, "", None, "b"],
        [202, " \t\n\r\n ", "fr", None],
        [203, "12 34 -- !!", "en", "b"],
        [204, sentence(rng, 30_000), "en", "c"],
        [None, sentence(rng, 20), "en", "a"],
        [None, None, None, None],
        [205, "one two three", "en", "zz"],
        [205, "one two three", "en", "zz"],  # a repeated row
        [206, " ideographic　space\x1cand\x85controls ÀB", "en", "é"],
    ]
    return [tuple([*r, None if r[1] is None else len(r[1]), "x", "x", "x", "x"]) for r in rows]


def documents(spark, rows=None):
    return spark.createDataFrame(document_rows() if rows is None else rows, DOCUMENTS).repartition(3)


def as_rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def groups_of(pairs, nodes) -> dict:
    """The smallest node reachable from each."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
