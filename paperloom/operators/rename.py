"""The sequential part of renaming pages, as it runs inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

COLUMNS = ("directory", "number", "object_key", "target", "stem", "target_stem", "held_by", "has_twin", "twin_target")
PLANNED = "directory string, number long, object_key string, target string, outcome string"
_SCHEMA = pa.schema(
    [("directory", pa.string()), ("number", pa.int64()), ("object_key", pa.string()), ("target", pa.string()), ("outcome", pa.string())]
)


def rename_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk pages sorted by (directory, number), keeping what earlier renames changed.

    ``held_by`` is the number of the page now called *target*; the twin flags say which processed names
    exist before anything moves.
    """
    at, moved, stuck = None, {}, set()
    for batch in batches:
        out = []
        for row in zip(*(batch.column(name).to_pylist() for name in COLUMNS)):
            directory, number, key, target, stem, target_stem, held_by, has_twin, twin_target = row
            if directory != at:
                at, moved, stuck = directory, {}, set()
            twin = moved.get(stem, has_twin)
            occupied = held_by is not None and (held_by > number or target in stuck)
            if key == target:
                outcome = "unchanged"
            elif occupied or (twin and moved.get(target_stem, twin_target)):
                outcome = "taken"
                stuck.add(key)
            else:
                outcome = "renamed"
                if twin:
                    moved[stem], moved[target_stem] = False, True
            out.append((directory, number, key, target, outcome))
        columns = zip(*out) if out else ([] for _ in _SCHEMA)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)
