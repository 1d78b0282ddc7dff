"""Small helpers for ``mapInArrow`` kernels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Characters of text that a kernel holds at once; one longer text is held alone.
CHUNK_CHARS = 4_000_000


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of ``column`` (or one row)."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as strings, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
