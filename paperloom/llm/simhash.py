"""SimHash near-duplicates through tables of distances to reference fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import settle, slices, travels
from paperloom.llm.graph import components

travels(__name__)

SHINGLE = 3
SEED = 42
#: Fingerprints link at this many differing bits or fewer.
BITS = 2
#: Reference fingerprints: rows of the 64 x 64 Hadamard matrix, any two of which differ in 32 bits.
REFERENCES = 32
#: References whose distance, in cells of CELL, is part of the join key.
KEYED, CELL = 2, 5
#: First bit and width of the parts of a fingerprint; of BITS + 1 parts, two linked fingerprints share at least one.
PARTS = ((0, 21), (21, 21), (42, 22))


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a UTF-8 text as a signed number; 0 for a null text or one without words."""
    words = (text or b"").lower().split()  # of bytes: only A-Z, and the six ASCII white-space characters
    if not words:
        return 0
    shingles = max(1, len(words) - SHINGLE + 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, shingles, 65536):
        stretch = words[start : start + 65536 + SHINGLE - 1]
        if len(words) < SHINGLE:
            hashes = [digest(b" ".join(stretch), SEED)]
        else:
            hashes = [digest(b" ".join(s), SEED) for s in zip(stretch, stretch[1:], stretch[2:])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > shingles, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tkey, fp long) per row, over whole texts; a long text is taken in stretches. tkey is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            prints = [fingerprint(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tkey"), pa.array(prints, pa.int64())], ["id", "tkey", "fp"])

    thin = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tkey"), F.col(text_col).cast("binary").alias("text"))
    kind = thin.schema["id"].dataType.simpleString()
    return thin.mapInArrow(run, f"id {kind}, tkey long, fp long")


def references(count: int = REFERENCES) -> list[int]:
    """Reference fingerprints as signed numbers: bit j of row i is the parity of the bits that i and j have in common."""
    rows = [sum((bin(i & j).count("1") & 1) << j for j in range(64)) for i in range(1, count + 1)]
    return [r - (1 << 64) if r >> 63 else r for r in rows]


def distance_table(prints: DataFrame, count: int = REFERENCES) -> DataFrame:
    """fp with its Hamming distances p0, p1, ... to the references."""
    return prints.select(
        "fp", *[F.bit_count(F.col("fp").bitwiseXOR(F.lit(r))).cast("tinyint").alias(f"p{i}") for i, r in enumerate(references(count))]
    )


def _part(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def link_fingerprints(prints: DataFrame, count: int = REFERENCES) -> DataFrame:
    """(a, b), a < b: the pairs of distinct fingerprints that differ in BITS bits or fewer. None is missed.

    A reference's distances to two linked fingerprints differ by BITS at most. So of the table of distances some coordinates
    go, in cells, into the join key, next to one equal part: the larger fingerprint of a pair looks in every cell
    within BITS of its own. What meets there is discarded if any other coordinate differs by more, and what is left is verified.
    The cells split a part that very many fingerprints share.
    """
    pivots = distance_table(prints.select("fp").distinct(), count)
    names = [f"p{i}" for i in range(count)]
    parts = F.array(*[F.struct(F.lit(i).alias("part"), _part(F.col("fp"), *p).alias("value")) for i, p in enumerate(PARTS)])
    spread = pivots.withColumn("x", F.explode(parts)).select("fp", *names, "x.part", "x.value")
    keyed = names[:KEYED]
    left = spread.select(
        F.col("fp").alias("a"), "part", "value", *[F.floor(F.col(p) / CELL).alias(f"c{p}") for p in keyed], *[F.col(p).alias(f"a{p}") for p in names]
    )
    right = spread
    for p in keyed:
        cells = F.array_distinct(F.array(F.floor((F.col(p) - BITS) / CELL), F.floor((F.col(p) + BITS) / CELL)))
        right = right.withColumn(f"c{p}", F.explode(cells))
    right = right.withColumnRenamed("fp", "b")
    close = reduce(lambda x, y: x & y, [F.abs(F.col(f"a{p}") - F.col(p)) <= BITS for p in names])
    # Spark sizes an exploded table as it was before: unhinted, it would broadcast several hundred MB as less than 10.
    met = left.join(right.hint("merge"), ["part", "value", *[f"c{p}" for p in keyed]]).where((F.col("a") < F.col("b")) & close)
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select("a", "b").distinct()


def grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tkey, fp, root, component_id) per row; root is the smallest fingerprint of the group."""
    prints = settle(fingerprints(docs, id_col, text_col))
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    groups = components(link_fingerprints(distinct)).withColumnRenamed("node", "fp")
    rooted = settle(distinct.join(groups, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    # Every row has its match. The outer join keeps the table of all rows from being broadcast: copies take next to no room in its file.
    return prints.join(named, "fp", "left").select("id", "tkey", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) per row: the smallest id reachable through links, the row's own included.

    Rows with equal fingerprints, repeated rows among them, are one node of the graph. Null texts and texts without words have
    fingerprint 0. Null ids take part but never name a component that holds another id; other columns are not read.
    """
    return grouped(docs, id_col, text_col).select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group: the one whose id names the group, and of rows that share that id one. Columns as given."""
    naming = grouped(docs, id_col, text_col).where(F.col("id").eqNullSafe(F.col("component_id")))
    counted = naming.groupBy("root", "id", "tkey").agg(F.count("*").alias("n"))
    chosen = counted.groupBy("root").agg(F.min(F.struct("tkey", "id", "n")).alias("_x"))
    chosen = chosen.select(F.col("_x.id").alias("_id"), F.col("_x.tkey").alias("_tkey"), F.col("_x.n").alias("_n"))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_tkey"))
    # Semi joins: the table of all rows is never the one that is broadcast.
    single = docs.join(chosen.where("_n = 1"), same, "left_semi")
    repeated = docs.join(chosen.where("_n > 1"), same, "left_semi")
    first = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row")
    return single.unionByName(repeated.groupBy(id_col, F.xxhash64(text_col).alias("_tkey")).agg(first).select("_row.*"))


def op2(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash_pivots": op2}
SQL: dict[str, str] = {}
