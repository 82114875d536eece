"""Arrow batches of bounded work for the Python plug-ins.

Spark hands a task thousands of rows at a time, however long their arrays are.
What a plug-in makes of them, often a Python object for every element, would
grow with them; so batches are cut by the elements that they hold. At a task's
end freed memory goes back to the system, as Spark keeps its workers."""

from __future__ import annotations

from contextlib import contextmanager

# --- Fixed values -----------------------------------------------------------
MAX_ELEMENTS = 1 << 16   # array elements handed to a plug-in at once, or one row
TEXT_BYTES = 4 << 20     # bytes of text split into tokens at once, or one row
NUMBER_ROWS = {"spark.sql.execution.arrow.maxBytesPerBatch": str((1 << 31) - 1),   # no limit
               "spark.sql.execution.arrow.maxRecordsPerBatch": "65536"}
# -----------------------------------------------------------------------------


def release() -> None:
    """Hand freed memory of Arrow's pool and of the C heap back."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@contextmanager
def all_batches(spark):
    """While rows of a few numbers each are handed to Python by a job inside:
    without the test of a batch's bytes, which Spark makes at every row and
    which costs more than the row, and with more rows a batch."""
    held = {k: spark.conf.get(k, None) for k in NUMBER_ROWS}
    try:
        for k, v in NUMBER_ROWS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _offsets(column):
    """Where the rows of a list or string array begin and end."""
    import numpy as np
    import pyarrow as pa

    if not pa.types.is_string(column.type):
        return column.offsets.to_numpy().astype(np.int64)
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)


def lists(column) -> list[list]:
    """Rows of a list array as Python lists, a null row as an empty one.
    The elements become objects together: ``to_pylist`` makes an Arrow scalar
    of each first."""
    flat, ends = column.values.to_numpy(zero_copy_only=False).tolist(), column.offsets.to_numpy().tolist()
    return [flat[a:b] if ok else [] for a, b, ok in zip(ends, ends[1:], column.is_valid().to_numpy(zero_copy_only=False))]


def int_lists(rows, none: int | None = None):
    """``array<int>`` of rows that are lists, with None for null, or all of
    them integer arrays, in which ``none`` and less stands for null."""
    import numpy as np
    import pyarrow as pa

    if not rows or not all(isinstance(r, np.ndarray) for r in rows):
        return pa.array(rows, pa.list_(pa.int32()))
    flat = np.concatenate(rows)
    values = pa.array(flat.astype(np.int32), mask=None if none is None else flat <= none)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), values)


def words(text):
    """Lists of the tokens of single-spaced texts: none of an empty or null one."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    cut = pc.split_pattern(text, " ")
    values, sizes = cut.values, np.diff(cut.offsets.to_numpy())
    empty = pc.fill_null(pc.equal(text, ""), False).to_numpy(zero_copy_only=False)
    if empty.any():   # split into one empty token
        values, sizes = values.filter(pa.array(np.repeat(~empty, sizes))), np.where(empty, 0, sizes)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)


def bounded(batches, column: str, elements: int = MAX_ELEMENTS):
    """The batches in parts whose lists in ``column`` hold at most so many
    elements (texts: bytes), or a single row that holds more."""
    import numpy as np

    try:
        for rb in batches:
            ends = _offsets(rb.column(column))
            at = 0
            while at < rb.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + elements, "right")) - 1)
                yield rb.slice(at, to - at)
                at = to
    finally:
        release()
