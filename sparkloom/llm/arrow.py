"""Reading nested message columns batch by batch, without pandas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def message_rows(batch: pa.RecordBatch, column: str = "messages") -> Iterator[list[tuple[str | None, str | None]] | None]:
    """For each row its (role, content) pairs; None where the array is null. A null message counts as one with null role and content."""
    array = batch.column(batch.schema.get_field_index(column))
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    flat = array.values
    roles, contents = flat.field("role").to_pylist(), flat.field("content").to_pylist()
    if flat.null_count:
        gone = flat.is_null().to_pylist()
        roles = [None if g else r for r, g in zip(roles, gone)]
        contents = [None if g else c for c, g in zip(contents, gone)]
    pairs = list(zip(roles, contents))
    offsets = array.offsets.to_pylist()
    valid = array.is_valid().to_pylist() if array.null_count else None
    for i in range(len(array)):
        yield None if valid is not None and not valid[i] else pairs[offsets[i] : offsets[i + 1]]
