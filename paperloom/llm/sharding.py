"""Sharding through fixed virtual slots and a stored, versioned slot-to-shard map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.common import each_copy, hashed, settle

#: Slots never change in number; only their shard does. A map has this many rows whatever the data.
SLOTS = 8192


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a record: a hash of its key, the same in every version of the map. Null counts as empty text."""
    return (hashed(key) % slots).cast("int")


def spread_key(key: Column, text_hash: Column) -> Column:
    """The key that decides a record's slot: its id, or where that is null its text, so that null ids share no slot."""
    return F.coalesce(key.cast("string"), F.concat(F.lit("~"), text_hash.cast("string")))


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes) for every slot, empty ones included, from records with vslot and size."""
    held = records.groupBy("vslot").agg(F.sum("size").alias("bytes"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(held, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def first_map(spark, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt in turn, before anything is known of their sizes."""
    return spark.range(slots).select(
        F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard")
    )


def edit_map(current: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map: as few slots as possible change shard, and shards come out near equal in bytes.

    Every shard keeps its largest slots up to the equal share. The slots beyond it, and those of shards that are gone,
    are placed largest first, each on the shard with the fewest bytes (the lowest number on a tie). New shards start
    empty, so growing takes only what is needed to fill them. Works on one row per slot, never on records; the placing
    is a fold over an array no longer than the fixed number of slots.
    """
    share = F.sum("bytes").over(Window.partitionBy(F.lit(0))) / shards  # one row per slot
    largest = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    held = (
        current.join(sizes, "vslot")
        .withColumn("share", share)
        .withColumn("stays", (F.sum("bytes").over(largest) <= F.col("share")) & (F.col("shard") < shards))
    )
    empty = current.sparkSession.range(shards).select(
        F.col("id").cast("int").alias("shard"), F.lit(True).alias("stays"), F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("int").alias("vslot")
    )
    slot = F.struct((-F.col("bytes")).alias("minus"), "vslot")
    by_shard = (
        held.select("shard", "stays", "bytes", "vslot")
        .unionByName(empty)
        .groupBy("shard")
        .agg(F.sum(F.when(F.col("stays"), F.col("bytes")).otherwise(0)).alias("load"), F.collect_list(F.when(~F.col("stays"), slot)).alias("moved"))
    )
    state = by_shard.agg(
        F.sort_array(F.collect_list(F.when(F.col("shard") < shards, F.struct("shard", "load")))).alias("loads"),
        F.sort_array(F.flatten(F.collect_list("moved"))).alias("moved"),
    )

    def place(state, slot):
        least = F.array_position(state["loads"], F.array_min(state["loads"])) - 1
        return F.struct(
            F.transform(state["loads"], lambda x, i: F.when(i == least, x - slot["minus"]).otherwise(x)).alias("loads"),
            F.concat(state["placed"], F.array(least.cast("int"))).alias("placed"),
        )

    start = F.struct(F.transform("loads", lambda x: x["load"]).alias("loads"), F.lit([]).cast("array<int>").alias("placed"))
    placed = (
        state.select("moved", F.aggregate("moved", start, place)["placed"].alias("placed"))
        .select(F.explode(F.arrays_zip("moved", "placed")).alias("x"))
        .select(F.col("x.moved.vslot").alias("vslot"), F.col("x.placed").alias("placed"))
    )
    return held.join(placed, "vslot", "left").select(
        (F.col("version") + 1).alias("version"), "vslot", F.coalesce(F.col("placed"), F.col("shard")).alias("shard")
    )


def balanced_map(records: DataFrame, shards: int, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(map, sizes): versions 1 and 2 of the map of new records, stored as one table, and the bytes of each slot."""
    sizes = settle(slot_bytes(records, slots))
    first = first_map(records.sparkSession, shards, slots)
    stored = settle(first.unionByName(edit_map(first, sizes, shards)))
    return stored, sizes


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Documents with vslot, version and shard, placed by the stored map.

    Size: UTF-8 bytes of the text plus 8; a null text has no bytes. Where the id is null the text decides. Repeated rows and
    rows that share an id go to one slot. Columns of these names in the input are replaced. An empty table stays empty.
    """
    sized = docs.drop("vslot", "version", "shard").withColumn(
        "vslot", slot_of(spread_key(F.col(id_col), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))), slots)
    )
    records = sized.select("vslot", (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"))
    stored, _ = balanced_map(records, shards, slots)
    latest = stored.where("version = 2")
    return sized.join(latest, "vslot")


def shard_digest(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot (its place in the shard), grown_shard, vslot.

    The law is `bytes`. Places are counted within each virtual slot and set off by the slots before it in the shard, so
    no shard is ever ranked as a whole; rows that agree in id, size and checksum are numbered as one run.
    """
    thin = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    runs = settle(
        thin.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")).withColumn("vslot", slot_of(spread_key(F.col("doc_id"), F.col("text_crc32"))))
    )
    stored, _ = balanced_map(runs.select("vslot", (F.col("size") * F.col("n")).alias("size")), shards)
    latest = stored.where("version = 2")
    rows = runs.groupBy("vslot").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = latest.join(rows, "vslot").withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    within = Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        runs.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(offsets.drop("rows"), "vslot")
        .withColumn("first", F.col("before") + F.col("inside"))
    )
    return each_copy(placed, "n", "copy").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("copy")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
    )


QUERIES = {"op4_virtual_slots": lambda spark, sf_dir: shard_digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))}

#: The fold that places slots is a recursion here, over the slots that hold bytes; empty slots carry no rows. The checksum
#: is folded over the bytes of the text.
SQL = {
    "op4_virtual_slots": """
WITH RECURSIVE poly AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS b))),
runs AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '~' || text_crc32)), 1, 8))::BIGINT % 8192)::INT AS vslot
  FROM documents, poly),
sizes AS (SELECT vslot, sum(size)::BIGINT AS bytes, count(*) AS n FROM runs GROUP BY vslot),
held AS (
  SELECT *, vslot % 24 AS shard0,
    sum(bytes) OVER (PARTITION BY vslot % 24 ORDER BY bytes DESC, vslot ROWS UNBOUNDED PRECEDING)
      <= (SELECT sum(bytes) FROM sizes) / 24.0 AS stays FROM sizes),
moved AS (SELECT vslot, bytes, row_number() OVER (ORDER BY bytes DESC, vslot) AS k FROM held WHERE NOT stays),
fold AS (
  SELECT 0::BIGINT AS k, -1 AS vslot, -1 AS placed,
    (SELECT list(coalesce(load, 0)::BIGINT ORDER BY s) FROM (SELECT unnest(range(24)) AS s)
       LEFT JOIN (SELECT shard0, sum(bytes) AS load FROM held WHERE stays GROUP BY shard0) ON s = shard0) AS loads
  UNION ALL
  SELECT m.k, m.vslot, (list_position(loads, list_min(loads)) - 1)::INT,
    list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + m.bytes ELSE x END)
  FROM fold f JOIN moved m ON m.k = f.k + 1),
mapped AS (SELECT h.vslot, coalesce(f.placed, h.shard0)::INT AS shard FROM held h LEFT JOIN fold f ON f.vslot = h.vslot)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY vslot, doc_id, size, text_crc32) - 1 AS slot,
  NULL::INT AS grown_shard, vslot
FROM runs JOIN mapped USING (vslot)
"""
}
