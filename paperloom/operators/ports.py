"""Plug points for a caller's models. The library fixes what goes in and comes out, nothing else."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from paperloom import schemas

Batches = Iterator[pd.DataFrame]
RegionDetector = Callable[[Batches], Batches]
TextReader = Callable[[Batches], Batches]


def detect_regions(images: DataFrame, detector: RegionDetector) -> DataFrame:
    """Run a detector over (page, content) rows.

    The callable gets an iterator of batches per partition, so a model is loaded once per task, and
    yields rows of the detections table.
    """
    return images.select("page", "content").mapInPandas(detector, schemas.DETECTIONS)


def read_markers(crops: DataFrame, reader: TextReader) -> DataFrame:
    """Run a text reader over (page, ord, content) crops; yields rows of the marker-text table."""
    return crops.select("page", "ord", "content").mapInPandas(reader, schemas.MARKER_TEXT)
