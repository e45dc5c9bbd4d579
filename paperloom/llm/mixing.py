"""Mixing sources to target weights along a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.common import each_copy, each_number, settle, word_count

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
EPOCHS = 3
#: Words a turn of the schedule takes.
BLOCK_WORDS = 1024
#: Points of the schedule are multiples of the golden ratio modulo this; each run of as many turns meets every point once.
CIRCLE = 2**32
GOLDEN = 2654435769
#: Cells of the circle in which a point looks for its source, pieces a source's documents are ordered in, and turns that
#: are counted together when turns are ranked per source. None of them changes a result.
CELLS, PIECES, TURNS = 1024, 4096, 65536


def targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    A target is the weight's share of all words, at most *epochs* times the source. The excess is shared again by weight
    until no target is above: with sources in order of that limit over weight, the level at each is what the sources before
    it leave over the weights from it on, and the limited ones are those whose limit is below that level.
    """
    every = Window.partitionBy(F.lit(0))  # one row per source
    by_ratio = every.orderBy("ratio", "place")
    numbered = sizes.withColumn("place", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = numbered.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ).withColumn("most", epochs * F.col("source_size"))
    level = (
        weighed.withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("spent", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(every) - F.col("spent")) / F.col("left"))
        .withColumn("limited", F.col("level") >= F.col("ratio"))
        .withColumn("common", F.max(F.when(~F.col("limited"), F.col("level"))).over(every))
    )
    target = F.when(F.col("limited"), F.col("most").cast("double")).otherwise(F.col("common") * F.col("weight"))
    return level.select("source", "source_size", target.alias("target"))


def positions(docs: DataFrame) -> DataFrame:
    """(source, doc_id, tkey, size, n, start): each source's documents in shuffled order, as runs of equal rows.

    start is the first word's position in its source. Order: md5 of the id, or of the text's hash where that is null, then the id,
    then the text's hash. A source is ordered in pieces by the leading digits of that md5, so the largest one is never in one task.
    """
    runs = settle(
        docs.groupBy("source", "doc_id", "tkey", "size")
        .agg(F.count("*").alias("n"))
        .withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("tkey").cast("string"), F.lit("")).cast("binary")))
        .withColumn("piece", (F.conv(F.substring("order", 1, 3), 16, 10)).cast("int"))
    )
    held = F.sum(F.col("size") * F.col("n"))
    pieces = runs.groupBy("source", "piece").agg(held.alias("words"))
    ahead = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("source", "piece", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "piece").orderBy("order", "doc_id", "tkey").rowsBetween(Window.unboundedPreceding, -1)
    return (
        runs.withColumn("inside", F.coalesce(held.over(inside), F.lit(0)))
        .join(offsets.withColumnRenamed("source", "s").withColumnRenamed("piece", "p"), F.col("source").eqNullSafe(F.col("s")) & (F.col("piece") == F.col("p")))
        .select("source", "doc_id", "tkey", "size", "n", (F.col("offset") + F.col("inside")).alias("start"))
    )


def schedule(quotas: DataFrame) -> DataFrame:
    """(turn, source, block): which source has each turn, and the how-manieth of its turns it is, from (source, blocks).

    Turn t stands at t times the golden ratio on a circle; the sources own arcs in proportion to their blocks. Points of the
    sequence fill every arc evenly, so any stretch of the mix holds the sources in nearly their final shares. Turns beyond
    a source's blocks are skipped; blocks that the sequence has not reached follow at the end.
    """
    spark = quotas.sparkSession
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())  # one row per source
    total = F.sum("blocks").over(Window.partitionBy(F.lit(0)))
    arcs = settle(
        quotas.where("blocks > 0")
        .withColumn("upto", F.sum("blocks").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .select(
            "source",
            "blocks",
            (F.row_number().over(ordered) - 1).alias("place"),
            F.count("*").over(Window.partitionBy(F.lit(0))).alias("many"),
            F.floor((F.col("upto") - F.col("blocks")) / total * CIRCLE).cast("long").alias("low"),
            F.floor(F.col("upto") / total * CIRCLE).cast("long").alias("high"),
        )
    )
    turns = arcs.agg(F.sum("blocks").alias("n")).first().n or 0
    cell = CIRCLE // CELLS
    by_cell = arcs.where("high > low").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell)))
    )
    # The product modulo CIRCLE by halves: as a whole it does not fit into a long.
    high, low = F.floor(F.col("id") % CIRCLE / 65536), F.col("id") % 65536
    points = spark.range(turns).select(F.col("id").alias("turn"), ((high * GOLDEN % CIRCLE * 65536 + low * GOLDEN) % CIRCLE).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / cell))
    owned = settle(
        points.join(by_cell, "cell")
        .where("point >= low and point < high")
        .select("turn", "source", "blocks", F.floor(F.col("turn") / TURNS).alias("stretch"))
    )
    counted = owned.groupBy("source", "stretch").agg(F.count("*").alias("rows"))
    ahead = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(
        F.col("source").alias("s"), F.col("stretch").alias("c"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("before")
    )
    inside = F.row_number().over(Window.partitionBy("source", "stretch").orderBy("turn")) - 1
    ranked = (
        owned.withColumn("inside", inside)
        .join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("c")))
        .select("turn", "source", (F.col("before") + F.col("inside")).alias("block"), "blocks")
        .where("block < blocks")
        .drop("blocks")
    )
    reached = owned.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("reached"))
    waiting = arcs.join(reached, F.col("source").eqNullSafe(F.col("s")), "left")
    late = each_number(waiting, F.coalesce("reached", F.lit(0)), F.col("blocks") - 1, "block").select(
        (F.lit(turns) + F.col("block") * F.col("many") + F.col("place")).alias("turn"), "source", "block"
    )
    return ranked.unionByName(late)


def mix_parts(placed: DataFrame, goals: DataFrame, block_words: int = BLOCK_WORDS, epochs: int = EPOCHS) -> DataFrame:
    """(turn, source, block, doc_id, tkey, size, n, start, epoch, first, last): the run of words each turn takes from a document.

    A source is its shuffled documents over and over, cut into blocks of equal words up to its target.
    """
    quotas = goals.select(
        "source", "source_size", F.least(F.round("target").cast("long"), epochs * F.col("source_size")).alias("quota")
    ).withColumn("blocks", F.ceil(F.col("quota") / block_words).cast("long"))
    turns = schedule(quotas.select("source", "blocks"))
    goal = quotas.select(F.col("source").alias("s"), "source_size", "quota")
    length = F.col("size") * F.col("n")
    runs = (
        placed.where("size > 0")
        .join(goal, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("epoch", F.explode(F.array(*map(F.lit, range(epochs)))))
        .withColumn("low", F.col("start") + F.col("epoch") * F.col("source_size"))
        .where("low < quota")
        .withColumn("high", F.least(F.col("low") + length, F.col("quota")))
    )
    spread = (
        each_number(runs, F.floor(F.col("low") / block_words), F.floor((F.col("high") - 1) / block_words), "block")
        .withColumn("first", F.greatest(F.col("low"), F.col("block") * block_words))
        .withColumn("last", F.least(F.col("high"), (F.col("block") + 1) * block_words))
        .drop("s", "low", "high", "source_size", "quota")
    )
    turns = turns.select("turn", F.col("source").alias("s"), F.col("block").alias("b"))
    return spread.join(turns, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")


def mix(docs: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, source, tkey, size, source_size, target, taken, first_turn) per row, from (doc_id, source, tkey, size).

    taken: words the mix takes from the document, repeats counted, up to *epochs* times its size. first_turn: when it first
    comes up, null if never. Documents without words, or of a null text, take no part and get 0. A null source is a source
    of its own. Rows equal in all four columns share their run's words evenly. An empty table gives no rows.
    """
    placed = settle(positions(docs.select("source", "doc_id", "tkey", "size")))
    sizes = placed.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = settle(targets(sizes, weights, epochs))
    parts = mix_parts(placed, goals, block_words, epochs)
    used = parts.groupBy("source", "start").agg(
        F.sum(F.col("last") - F.col("first")).alias("words"), F.min("turn").alias("first_turn")
    )
    used = used.withColumnRenamed("source", "us").withColumnRenamed("start", "ustart")
    goals = goals.withColumnRenamed("source", "gs")
    share = F.floor(F.col("words") / F.col("n")) + F.when(F.col("copy") < F.col("words") % F.col("n"), 1).otherwise(0)
    runs = (
        placed.join(goals, F.col("source").eqNullSafe(F.col("gs")))
        .join(used, F.col("source").eqNullSafe(F.col("us")) & (F.col("start") == F.col("ustart")) & (F.col("size") > 0), "left")
        .withColumn("words", F.coalesce("words", F.lit(0)))
        .select("doc_id", "source", "tkey", "size", "n", "source_size", "target", "words", "first_turn")
    )
    return each_copy(runs, "n", "copy").select("doc_id", "source", "tkey", "size", "source_size", "target", share.cast("long").alias("taken"), "first_turn"
    )


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("source", "doc_id", F.xxhash64("text").alias("tkey"), word_count(F.col("text")).alias("size"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS, epochs: int = EPOCHS) -> DataFrame:
    """The documents of the mix: each as often as the mix takes it, to the nearest whole number; columns as given.

    A document that is taken for less than half of its words is left out. Documents without words are not in a mix.
    """
    taken = mix(sized(docs), weights, block_words, epochs).where("2 * taken >= size and size > 0")
    times = taken.groupBy("source", "doc_id", "tkey").agg(
        F.min(F.round(F.col("taken") / F.col("size")).cast("int")).alias("_times")
    )
    times = times.select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("tkey").alias("_t"), "_times")
    same = F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_t"))
    return docs.join(times, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select(*docs.columns)


def op5(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(sized(docs)).select("doc_id", "size", "source_size", "target", "taken", "first_turn")


QUERIES = {"op5_low_discrepancy_mix": op5}

#: taken sums whole rounds and the rest in closed form; the schedule is walked for the turn in which a document first comes up.
SQL = {
    "op5_low_discrepancy_mix": """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 3 * source_size AS most, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
    (SELECT sum(source_size) FROM s)::BIGINT AS total FROM s),
l AS (
  SELECT *, (total - coalesce(sum(most) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW r AS (ORDER BY most / weight, source NULLS LAST)),
g AS (
  SELECT source, source_size, CASE WHEN level >= most / weight THEN most::DOUBLE
    ELSE weight * (SELECT max(level) FROM l WHERE level < most / weight) END AS target FROM l),
p AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
q AS (
  SELECT p.doc_id, p.source, p.size, p.start, g.source_size, g.target, least(round(g.target)::BIGINT, 3 * g.source_size) AS quota
  FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source),
b AS (SELECT DISTINCT source, ceil(quota / 1024)::BIGINT AS blocks FROM q WHERE quota > 0),
arcs AS (
  SELECT source, blocks, row_number() OVER w - 1 AS place, count(*) OVER () AS many,
    floor((sum(blocks) OVER w - blocks)::DOUBLE / sum(blocks) OVER () * 4294967296) AS low,
    floor((sum(blocks) OVER w)::DOUBLE / sum(blocks) OVER () * 4294967296) AS high FROM b
  WINDOW w AS (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
turns AS (SELECT t AS turn, (t::HUGEINT * 2654435769 % 4294967296)::DOUBLE AS point FROM (SELECT unnest(range((SELECT sum(blocks) FROM b)::BIGINT)) AS t)),
owned AS (
  SELECT turn, source, blocks, row_number() OVER (PARTITION BY source ORDER BY turn) - 1 AS block
  FROM turns JOIN arcs ON point >= low AND point < high),
late AS (
  SELECT (SELECT count(*) FROM turns) + block * many + place AS turn, source, block FROM (
    SELECT source, many, place, unnest(range(coalesce((SELECT count(*) FROM owned o WHERE o.source IS NOT DISTINCT FROM arcs.source), 0), blocks)) AS block FROM arcs)),
y AS (SELECT turn, source, block FROM owned WHERE block < blocks UNION ALL SELECT turn, source, block FROM late)
SELECT doc_id, size, source_size, target, (CASE WHEN source_size = 0 THEN 0 ELSE
    quota // source_size * size + least(size, greatest(0, quota % source_size - start)) END)::BIGINT AS taken,
  y.turn::BIGINT AS first_turn
FROM q LEFT JOIN y ON y.source IS NOT DISTINCT FROM q.source AND y.block = start // 1024 AND size > 0 AND start < quota
"""
}
