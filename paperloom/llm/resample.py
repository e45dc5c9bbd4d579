"""Importance resampling towards a target distribution: hashed n-gram gains, Gumbel noise, and a cutoff found in a bracket."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from paperloom.llm.common import settle, slices, travels

travels(__name__)

#: Buckets that features are hashed into: the bound of what is collected and sent to every task.
BUCKETS = 10_000
#: Words of the longest feature, fewest words of a document that can be drawn, documents drawn of a hundred.
LONGEST, LEAST_WORDS, PERCENT = 1, 20, 10
SEED = 2024
#: Ranks are told by the sketch to within one part in so many; brackets reach twice that to either side, then eight times as far.
ACCURACY, WIDER = 10_000, 8
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20
ADDED = ("n_features", "weight", "score")
#: A-Z in lower case, every other ASCII character but 0-9 and a-z a space, all bytes of other characters as they are.
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def buckets_of(raw: bytes, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them) for one piece of a UTF-8 text after the other.

    A feature is a run of up to *longest* words with a space between them, its bucket its crc32 modulo BUCKETS.
    """
    start, held = 0, []
    while start < len(raw):
        stop = start + PIECE
        while stop < len(raw) and LOWERED[raw[stop]] != 32:  # a piece ends with a word
            stop += 1
        words = raw[start:stop].translate(LOWERED).split()
        start = stop
        found = [np.fromiter(map(crc32, words), np.uint32, len(words))]
        every = held + words
        for n in range(2, longest + 1):
            grams = [b" ".join(every[i - n + 1 : i + 1]) for i in range(max(len(held), n - 1), len(every))]
            found.append(np.fromiter(map(crc32, grams), np.uint32, len(grams)))
        held = every[len(every) - longest + 1 :] if longest > 1 else []
        yield len(words), np.concatenate(found) % BUCKETS


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task sends one count a bucket; BUCKETS sums are collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, "text"):
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                for _, found in buckets_of(text or b"", longest):
                    counts += np.bincount(found, minlength=BUCKETS)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])

    sums = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS, np.int64)
    for r in sums.collect():
        counts[r.bucket] = r.n
    return counts


def gains_of(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's share in the target to its share in the corpus, one added to every count."""
    s_all, t_all = float(own.sum()), float(target.sum())
    pairs = zip(own.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS)))) for s, t in pairs], np.int64)


def noise(doc_id: str | None, seed: int) -> int:
    """A Gumbel draw in thousandths, which seed and id decide; a null id counts as empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gains: np.ndarray, id_col="doc_id", text_col="text", longest=LONGEST, seed=SEED) -> DataFrame:
    """docs with n_words, n_features, weight (floored mean gain, 0 without features) and score (weight plus noise)."""
    rest = docs.drop("n_words", *ADDED)
    given = rest.columns
    added = ["n_words", *ADDED]
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in slices(batches, text_col):
            rows = []
            for text, own in zip(batch.column(text_col).cast(pa.binary()).to_pylist(), batch.column("_id").to_pylist(), strict=True):
                words = features = total = 0
                for n, found in buckets_of(text or b"", longest):
                    words, features, total = words + n, features + len(found), total + int(gain[found].sum())
                weight = total // features if features else 0
                rows.append((words, features, weight, weight + noise(own, seed)))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            kept = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "_id"]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*given, *added])

    schema = T.StructType([*rest.schema.fields, *(T.StructField(n, T.LongType()) for n in added)])
    return rest.withColumn("_id", F.col(id_col).cast("string")).mapInArrow(run, schema)


def _order(id_col: str) -> list[Column]:
    """Best score first, then smaller id (null last), then text hash; what still ties are equal rows, told apart by place."""
    return [-F.col("score"), F.col(id_col).isNull(), F.col(id_col), F.col("_tkey"), F.col("_row")]


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place in *order*, from 1. Dealt by ranges and sorted within them; ranges are set off by the rows ahead."""
    dealt = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_ahead"))
    placed = dealt.withColumn("_part", part).join(offsets, "_part")
    return placed.select(*rows.columns, (F.col("_ahead") + inside + 1).alias(name))


def brackets(scored: DataFrame, percent: int, accuracy: int = ACCURACY) -> tuple[int, list[tuple[int | None, int | None]]]:
    """(rows, brackets of scores around the one that *percent* of a hundred rows reach, each wider than the one before).

    From one quantile sketch over all rows. The last bracket is open, so one of them always holds the cutoff.
    """
    reach, at = [2 / accuracy], 1 - percent / 100
    while reach[-1] < 1:
        reach.append(reach[-1] * WIDER)
    ends = [min(max(at + sign * r, 0.0), 1.0) for r in reach for sign in (-1, 1)]
    r = scored.agg(F.count("*").alias("n"), F.percentile_approx("score", ends, accuracy).alias("ends")).first()
    found = list(zip(r.ends[::2], r.ends[1::2], strict=True)) if r.ends else []
    return r.n, [*found, (None, None)]


def cutoff(scored: DataFrame, id_col="doc_id", percent=PERCENT, accuracy=ACCURACY) -> Column | None:
    """Whether a row of *scored* is among the best *percent* of a hundred (rounded down); None where no row is.

    The rows outside every bracket are counted exactly; the narrowest bracket that holds the last drawn row is sorted, and
    nothing else. Rows must come from a written table, so that every job sees the same.
    """
    n, found = brackets(scored, percent, accuracy)
    take = percent * n // 100
    if not take:
        return None
    s = F.col("score")
    above = [F.count_if(s > high) if high is not None else F.lit(0) for _, high in found]
    upto = [F.count_if(s >= low) if low is not None else F.count("*") for low, _ in found]
    r = scored.agg(*(c.alias(f"a{i}") for i, c in enumerate(above)), *(c.alias(f"u{i}") for i, c in enumerate(upto))).first()
    held = next(i for i in range(len(found)) if r[f"a{i}"] < take <= r[f"u{i}"])
    low, high = found[held]
    inside = scored.select(id_col, "score", "_tkey", "_row")
    inside = inside if low is None else inside.where(s.between(low, high))
    last = numbered(inside, _order(id_col), "_place").where(F.col("_place") == take - r[f"a{held}"]).first()
    kind = scored.schema[id_col].dataType
    limit = [F.lit(-last.score), F.lit(last[id_col] is None), F.lit(last[id_col]).cast(kind), F.lit(last._tkey), F.lit(last._row)]
    return F.struct(*(c.alias(f"k{i}") for i, c in enumerate(_order(id_col)))) <= F.struct(*(c.alias(f"k{i}") for i, c in enumerate(limit)))


def scored_table(docs: DataFrame, target: DataFrame, columns: list[str], id_col: str, text_col: str, longest: int, seed: int) -> DataFrame:
    """The scores of all rows, written, with *columns*, a text hash and a number for each row."""
    gains = gains_of(bucket_counts(docs, text_col, longest), bucket_counts(target, "text", longest))
    thin = docs.select(*dict.fromkeys([*columns, id_col, text_col])).drop("_tkey", "_row", "n_words", *ADDED)
    told = score(thin.withColumn("_tkey", F.xxhash64(text_col)), gains, id_col, text_col, longest, seed)
    kept = [c for c in told.columns if c != text_col or c in columns]
    return settle(told.select(*kept).withColumn("_row", F.monotonically_increasing_id()))


def resample(
    docs: DataFrame, target: DataFrame, id_col="doc_id", text_col="text", longest=LONGEST, least_words=LEAST_WORDS, percent=PERCENT, seed=SEED
) -> DataFrame:
    """(id, n_features, weight, score, rank) per row; rank counts the drawn rows from 1 and is null for all others.

    Drawn are the *percent* of a hundred (rounded down) best scored of the rows with *least_words* words or more; ties go to the
    smaller id, a null id last, then by the text's hash; rows equal in all of it are drawn as they come. A null text has no words and
    weight 0, a null id the noise of empty text. target: a table with the column text. Other columns are not read.
    """
    scored = scored_table(docs, target, [id_col], id_col, text_col, longest, seed)
    fits = scored.where(F.col("n_words") >= least_words)
    drawn = cutoff(fits, id_col, percent)
    out = [id_col, *ADDED]
    if drawn is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    best = numbered(fits.where(drawn), _order(id_col), "rank").select(*out, "rank")
    rest = scored.where(~((F.col("n_words") >= least_words) & drawn))
    return best.unionByName(rest.select(*out, F.lit(None).cast("long").alias("rank")))


def draw(
    docs: DataFrame, target: DataFrame, id_col="doc_id", text_col="text", longest=LONGEST, least_words=LEAST_WORDS, percent=PERCENT, seed=SEED
) -> DataFrame:
    """The drawn rows themselves, columns as given (bar n_words, n_features, weight and score, which are this operator's)."""
    names = [c for c in docs.columns if c not in ("_tkey", "_row", "n_words", *ADDED)]
    scored = scored_table(docs, target, names, id_col, text_col, longest, seed)
    fits = scored.where(F.col("n_words") >= least_words)
    drawn = cutoff(fits, id_col, percent)
    return fits.where(F.lit(False) if drawn is None else drawn).select(*names)


def op12(spark, sf_dir):
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs.select("doc_id", "text"), target.select("text"))


QUERIES = {"op12_importance_resampling": op12}

#: crc32 is folded over the bytes of every different word; ranks come from one window.
SQL = {
    "op12_importance_resampling": """
WITH poly AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS b))),
texts AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
w AS (
  SELECT kind, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM texts),
c AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM w), poly),
n AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM w JOIN c USING (word) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM n) + 10000))::DOUBLE
    / ((s + 1) * ((SELECT sum(t) FROM n) + 10000))::DOUBLE))::BIGINT AS gain FROM n),
m AS (
  SELECT id AS doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM w JOIN c USING (word) JOIN g USING (bucket) WHERE kind = 0 GROUP BY id),
p AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
      + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN m USING (doc_id)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) OVER (PARTITION BY n_features >= 20) AS eligible FROM p)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * eligible // 100 THEN place END AS rank FROM r
"""
}
