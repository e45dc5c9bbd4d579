"""Fill-in-middle transformation: texts cut at two line ends, found in a compressed set of boundaries."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import slices, travels

travels(__name__)

#: What stands before the prefix, the suffix and the middle in an output.
SENTINELS = ("<P>", "<S>", "<M>")
#: Texts of a hundred that are transformed, and of those, the ones whose suffix comes first.
RATE, SUFFIX_FIRST = 100, 50
SEED = 7
#: Offsets of one container: those that agree above the low 16 bits.
SPAN = 1 << 16
NEWLINE = 10
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


class ArrayContainer:
    """Sorted low halves, two bytes each."""

    def __init__(self, low: np.ndarray):
        self.low = low

    def select(self, k: int) -> int:
        return int(self.low[k])


class RunContainer:
    """Starts of runs of consecutive offsets and how many offsets lie ahead of each."""

    def __init__(self, low: np.ndarray, starts: np.ndarray):
        self.starts, self.ahead = low[starts], starts.astype(np.uint32)

    def select(self, k: int) -> int:
        run = int(self.ahead.searchsorted(k, "right")) - 1
        return int(self.starts[run]) + k - int(self.ahead[run])


class BitmapContainer:
    """A bit for each offset of the span, with the set bits ahead of every 64."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, bool)
        bits[low] = True
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.uint32)
        self.ahead = np.cumsum(counts, dtype=np.uint32) - counts

    def select(self, k: int) -> int:
        at = int(self.ahead.searchsorted(k, "right")) - 1
        word = int(self.words[at])
        for _ in range(k - int(self.ahead[at])):
            word &= word - 1  # clears the lowest set bit
        return at * 64 + (word & -word).bit_length() - 1


def container(low: np.ndarray):
    """The smallest container for sorted, different low halves: 2 bytes an offset, 8 bytes a run, or a fixed bitmap."""
    if len(low) <= 4:
        return ArrayContainer(low)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(low) != 1) + 1])
    sizes = (2 * len(low), 8 * len(starts), SPAN // 8 * 3 // 2)
    return (ArrayContainer, lambda x: RunContainer(x, starts), BitmapContainer)[sizes.index(min(sizes))](low)


class BoundarySet:
    """Increasing offsets, kept by containers with cumulative cardinalities; built span by span, so never spelled out whole."""

    def __init__(self):
        self.keys: list[int] = []
        self.containers: list = []
        self.ahead = [0]

    def add(self, key: int, low: np.ndarray) -> None:
        """The offsets of one span, given by their low halves; spans come in order."""
        if len(low):
            self.keys.append(key)
            self.containers.append(container(low.astype(np.uint16)))
            self.ahead.append(self.ahead[-1] + len(low))

    def __len__(self) -> int:
        return self.ahead[-1]

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0: the container by its cumulative cardinality, then a local select."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.ahead, k, "right")) - 1
        return self.keys[at] * SPAN + self.containers[at].select(k - self.ahead[at])


def line_boundaries(raw: bytes) -> BoundarySet:
    """0 and the end of every line of a UTF-8 text, in bytes: one more than it has lines (``[^\\n]*\\n|[^\\n]+``)."""
    found = BoundarySet()
    ends = np.frombuffer(raw, np.uint8) == NEWLINE
    for key in range(len(raw) // SPAN + 1):
        start = key * SPAN
        low = np.flatnonzero(ends[max(start - 1, 0) : start + SPAN - 1])
        if key == 0:
            low = np.concatenate([[0], low + 1])
        if start <= len(raw) < start + SPAN and len(raw) and not ends[-1]:
            low = np.append(low, len(raw) - start)
        found.add(key, low)
    return found


def hashes(doc_id: str | None, seed: int) -> list[int]:
    """Four numbers that the seed and the id decide; a null id counts as empty text."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def points(piece: bytes) -> int:
    """Code points of valid UTF-8."""
    return len(piece) if piece.isascii() else int(np.count_nonzero((np.frombuffer(piece, np.uint8) & 0xC0) != 0x80))


def transform(raw: bytes, doc_id: str | None, seed: int, rate: int, suffix_first: int, sentinels: tuple, banned: re.Pattern) -> tuple:
    """(lines, form, prefix_chars, middle_chars, output) of one text."""
    h1, h2, h3, h4 = hashes(doc_id, seed)
    bounds = line_boundaries(raw)
    n = len(bounds) - 1
    if not raw or banned.search(raw) or h3 % 100 >= rate:
        return n, "plain", None, None, raw
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = bounds.select(low), bounds.select(high)
    prefix, middle, suffix = raw[:first], raw[first:second], raw[second:]
    p, s, m = sentinels
    if h4 % 100 < suffix_first:
        return n, "spm", points(prefix), points(middle), b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", points(prefix), points(middle), b"".join((p, prefix, s, suffix, m, middle))


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Outputs can be read back if every sentinel starts with a character that none holds elsewhere: none then begins in a text
    and ends in a sentinel."""
    tails = {c for s in sentinels for c in s[1:]}
    if len(set(sentinels)) != 3 or any(len(s) < 2 or s[0] in tails for s in sentinels):
        raise ValueError(f"sentinels {sentinels} cannot be told from text")


def fill_in_middle(
    docs: DataFrame, id_col="doc_id", text_col="text", seed=SEED, rate=RATE, suffix_first=SUFFIX_FIRST, sentinels=SENTINELS
) -> DataFrame:
    """docs with n (lines), form, prefix_chars, middle_chars (code points) and output.

    The cuts are two of the n + 1 line boundaries, drawn by the sha256 of seed and id. Form: `plain` (the text itself, cuts null) for
    an empty text, one that holds a sentinel, and rows beyond *rate* of a hundred; `spm` (suffix, prefix, middle) for
    *suffix_first* of a hundred of the rest; else `psm`. A null text counts as empty, a null id as empty text. Rows that agree in
    both are treated alike, whatever else they hold. Columns of the five names in the input are replaced, all others passed on.
    """
    check_sentinels(sentinels)
    rest = docs.drop(*ADDED)
    given = rest.columns
    coded = tuple(s.encode() for s in sentinels)
    banned = re.compile(b"|".join(map(re.escape, coded)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            ids = batch.column("_id").to_pylist()
            rows = [transform(t or b"", i, seed, rate, suffix_first, coded, banned) for t, i in zip(texts, ids, strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            added = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            kept = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "_id"]
            yield pa.RecordBatch.from_arrays([*kept, *added], [*given, *ADDED])

    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    schema = T.StructType([*rest.schema.fields, *(T.StructField(n, k) for n, k in zip(ADDED, kinds, strict=True))])
    return rest.withColumn("_id", F.col(id_col).cast("string")).mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels=SENTINELS) -> Column:
    """The text again, from an output and its form alone."""
    pieces = F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels), -1)
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    joined = {f: F.concat(*(F.get(pieces, F.lit(i)) for i in places)) for f, places in order.items()}
    return F.when(form == "psm", joined["psm"]).when(form == "spm", joined["spm"]).otherwise(output)


def op11(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fill_in_middle(docs).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES = {"op11_fill_in_middle": op11}

#: Cuts by slices of the list of lines; the restored text is the input.
SQL = {
    "op11_fill_in_middle": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS lines,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS digits FROM documents),
h AS (
  SELECT *, len(lines) AS n, ('0x' || substr(digits, 1, 8))::BIGINT AS h1, ('0x' || substr(digits, 9, 8))::BIGINT AS h2,
    ('0x' || substr(digits, 17, 8))::BIGINT AS h3, ('0x' || substr(digits, 25, 8))::BIGINT AS h4 FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle,
    array_to_string(lines[b + 1:], '') AS suffix FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
}
