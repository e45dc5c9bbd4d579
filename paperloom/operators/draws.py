"""Seeded draws: every choice is fixed by its seed and independent of partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions.exam import seeded_hash, seeded_number

#: Bits below the digit that a selection counts by, level by level.
DIGITS = (42, 21, 0)
#: Hex digits of a seeded hash that a split counts by.
CELL_DIGITS = 4


def draw_one(candidates: DataFrame, keys: list[str], seed: str) -> DataFrame:
    """One question of each group: the one whose seeded hash is smallest.

    A minimum combines before the shuffle, so the size of a group does not matter.
    """
    place = F.struct(seeded_hash(seed, F.col("question_id")).alias("h"), F.col("question_id"))
    return candidates.groupBy(*keys).agg(F.min(place).getField("question_id").alias("question_id"))


def kth_of_group(candidates: DataFrame, keys: list[str], seed: str) -> DataFrame:
    """Count the group, then take the question at a seeded offset in id order.

    Found digit by digit: the ids of a group are counted by their leading bits, the block that holds the wanted place is kept, and its
    ids are counted by the next bits. Counts combine before the shuffle, so no group is ever ranked.
    """
    counts = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    wanted = counts.withColumn("k", 1 + F.pmod(seeded_number(seed, *[F.col(c) for c in keys]), F.col("n")))
    found = wanted.withColumns({"_left": F.col("k"), "_at": F.lit(0).cast("long")})
    names = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    for shift, above in zip(DIGITS, (64, *DIGITS)):
        rows = candidates.select(*names, F.shiftright("question_id", shift).alias("_digit"))
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        if above < 64:
            same.append(F.col("_at") == F.shiftright("_digit", above - shift))
        blocks = found.join(rows, same).groupBy(*keys, "n", "k", "_left", "_digit").agg(F.count(F.lit(1)).alias("_rows"))
        so_far = W.partitionBy(*keys).orderBy("_digit").rowsBetween(W.unboundedPreceding, W.currentRow)
        upto = blocks.withColumn("_upto", F.sum("_rows").over(so_far))
        held = upto.filter((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_rows") < F.col("_left")))
        left = F.col("_left") - (F.col("_upto") - F.col("_rows"))
        found = held.select(*keys, "n", "k", left.alias("_left"), F.col("_digit").alias("_at"))
    return found.select(*keys, "n", "k", F.col("_at").alias("question_id"))


def choose_for_round(wishes: DataFrame, by_topic: DataFrame, by_part: DataFrame) -> DataFrame:
    """What each wish draws: its topic's question if a topic is set, else its part's, else nothing.

    *by_topic* holds (subject_id, name, question_id); *by_part* (subject_id, part, exam_type, question_id)
    with a null exam type for "either".
    """
    topical = by_topic.select("subject_id", F.col("name").alias("topic_name"), F.col("question_id").alias("_topic_q"))
    parted = by_part.select(
        "subject_id",
        F.col("part").alias("random_part"),
        F.col("exam_type").alias("_type"),
        F.col("question_id").alias("_part_q"),
    )
    same = (
        (F.col("w.subject_id") == F.col("p.subject_id"))
        & (F.col("w.random_part") == F.col("p.random_part"))
        & F.col("w.exam_type").eqNullSafe(F.col("p._type"))
    )
    joined = wishes.join(topical, ["subject_id", "topic_name"], "left")
    joined = joined.alias("w").join(parted.alias("p"), same, "left")
    chosen = F.when(F.col("w.topic_name").isNotNull(), F.col("w._topic_q")).otherwise(F.col("p._part_q"))
    return joined.select(*[F.col(f"w.{c}") for c in wishes.columns], chosen.alias("question_id"))


def sample_rows(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """min(n, size) rows without replacement: the first *n* in seeded order. An empty source is an error."""
    if df.isEmpty():
        raise ValueError("nothing to sample from")
    return df.orderBy(seeded_hash(seed, F.col(key)), key).limit(n)


def split_dataset(names: DataFrame, key: str, train: float, seed: str) -> DataFrame:
    """Train, val and test cut from a seeded order.

    train = int(n * s), val = int(n * (0.6 * (1 - s))), rest test; doubles as written. Rows are counted by the leading digits of their
    hash, which tells for all but two of these cells on which side of the cuts they lie; only the rows of those two are ranked.
    """
    hashed = names.withColumn("_hash", seeded_hash(seed, F.col(key))).withColumn("_cell", F.substring("_hash", 1, CELL_DIGITS))
    counts = hashed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_rows"))  # at most 16 ** CELL_DIGITS rows
    so_far = W.orderBy("_cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy(F.lit(0))
    sized = counts.withColumns({"_upto": F.sum("_rows").over(so_far), "_n": F.sum("_rows").over(every)})
    first = F.floor(F.col("_n") * F.lit(train))
    second = first + F.floor(F.col("_n") * F.lit(0.6 * (1 - train)))
    cells = sized.select(
        F.col("_cell").alias("_c"), (F.col("_upto") - F.col("_rows")).alias("_before"), "_upto", first.alias("_first"), second.alias("_second")
    )
    placed = hashed.join(F.broadcast(cells), F.col("_cell") == F.col("_c"))
    cut = F.lit(False)
    for at in ("_first", "_second"):
        cut = cut | ((F.col("_before") < F.col(at)) & (F.col(at) < F.col("_upto")))
    clear = placed.filter(~cut).withColumn("_rank", F.col("_before") + 1)
    inside = F.row_number().over(W.partitionBy("_cell").orderBy("_hash", key))
    ranked = placed.filter(cut).withColumn("_rank", F.col("_before") + inside)
    split = F.when(F.col("_rank") <= F.col("_first"), "train").when(F.col("_rank") <= F.col("_second"), "val").otherwise("test")
    return clear.unionByName(ranked).select(*names.columns, split.alias("split"))
