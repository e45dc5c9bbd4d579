"""Quality rules with compression bands: zstandard ratios of whole texts and of fixed chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import slices, travels

travels(__name__)

LEVEL = 3
#: Limits of compressed over plain size for texts from so many bytes on. Below the first, repetitive; above the second,
#: incompressible. Shorter texts repeat less and carry the frame's own bytes, so their limits are wider or none.
BANDS = (
    (0, 0.0, 9.9),
    (64, 0.55, 9.9),
    (128, 0.45, 1.2),
    (256, 0.40, 0.95),
    (512, 0.38, 0.85),
    (1024, 0.34, 0.80),
    (2048, 0.32, 0.76),
    (4096, 0.30, 0.74),
    (8192, 0.28, 0.72),
    (16384, 0.26, 0.72),
    (65536, 0.22, 0.72),
)
#: Bytes of a chunk, its limits, and the share of chunks beyond them that a text may have.
CHUNK, CHUNK_BAND, CHUNK_SHARE = 1024, (0.30, 0.80), 0.2
#: The base rules: fewest words, and the most words in repeated windows in a hundred.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\v\f"


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words found twice or more, the first of them included. Exact: words are numbered,
    and windows numbered pair by pair."""
    if len(words) < WINDOW:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    windows = ids[: len(ids) - WINDOW + 1]
    for k in range(1, WINDOW):
        windows = np.unique(windows, return_inverse=True)[1] * len(numbers) + ids[k : len(ids) - WINDOW + 1 + k]
    _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = count[place] > 1
    inside = np.zeros(len(ids), bool)
    for k in range(WINDOW):
        inside[k : len(ids) - WINDOW + 1 + k] |= twice
    return int(inside.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text; a null text counts as empty."""
    text = text or ""
    words = text.encode().split()
    seen: set[str] = set()
    doubled = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            doubled += line in seen
            seen.add(line)
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    return len(words), word_chars, sum(text.count(c) for c in SYMBOLS), doubled, repeated_words(words)


def within_bands(raw: bytes, compress) -> tuple[float, float, bool]:
    """(ratio of the whole text, share of its chunks beyond the chunk limits, whether both are within the limits).

    Where full chunks leave a rest, the text's last CHUNK bytes are one more chunk. The ratio of an empty text is 1. A text of less
    than a chunk has none: its ratio is judged by the limits of its length.
    """
    ratio = len(compress(raw)) / len(raw) if raw else 1.0
    low, high = next((low, high) for least, low, high in reversed(BANDS) if len(raw) >= least)
    starts = list(range(0, len(raw) - CHUNK + 1, CHUNK))
    if starts and len(raw) % CHUNK:
        starts.append(len(raw) - CHUNK)
    chunks = len(starts)
    beyond = sum(not CHUNK_BAND[0] <= len(compress(raw[i : i + CHUNK])) / CHUNK <= CHUNK_BAND[1] for i in starts)
    share = beyond / chunks if chunks else 0.0
    return ratio, share, low <= ratio <= high and share <= CHUNK_SHARE


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, chunk_share, kept) per row.

    kept: the base rules hold and the text is within its bands. A null text counts as empty and fails for want of words. Repeated
    rows are judged alike; other columns are not read.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_counts(text)
                failed = base[0] < LEAST_WORDS or 100 * base[4] > MOST_REPEATED * base[0]
                ratio, share, fits = within_bands((text or "").encode(), compress)
                rows.append((*base, failed, ratio, share, fits and not failed))
            columns = zip(*rows, strict=True)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], ["id", *counts, "base_failed", "ratio", "chunk_share", "kept"])

    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = thin.schema["id"].dataType.simpleString()
    schema = f"id {kind}, {', '.join(f'{c} long' for c in counts)}, base_failed boolean, ratio double, chunk_share double, kept boolean"
    return thin.mapInArrow(run, schema).withColumnRenamed("id", id_col)


QUERIES = {"op6_compression_bands": lambda spark, sf_dir: judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
SQL: dict[str, str] = {}
