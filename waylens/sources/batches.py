"""Files in tasks: one content at a time in, batches of bounded rows and bytes out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: What a task gathers of its results before it passes them on.
ROWS, BYTES = 4096, 1 << 20


def contents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, bytes | None]]:
    """``path, content`` of the files; only one content at a time is a Python object."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            yield path.as_py(), content.as_py()


def gathered(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most ROWS, each passed on when its texts and bytes come to more than BYTES."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str | bytes))
        if len(held) >= ROWS or size > BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
