"""Helpers the text operators share: batches of bounded size, UTF-8 columns, fixed identifiers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Text bytes that one step of a task holds at once.
SLICE_BYTES = 2 << 20

_resident: dict[tuple, object] = {}


def resident(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept by the worker until another operator asks for something else."""
    if key not in _resident:
        release()
        _resident[key] = make()
    return _resident[key]


def release() -> None:
    """Let go of what the worker keeps for an earlier operator."""
    _resident.clear()
    give_back()


def give_back() -> None:
    """Return freed memory to the system, which an earlier stage in this worker may have left fragmented."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def whole_text(name: str = "text"):
    """A text column with NULL read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """``name`` with underscores before it until no column of ``df`` has it."""
    while name in df.columns:
        name = f"_{name}"
    return name


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``limit`` bytes; one row is never cut."""
    n = batch.num_rows
    if not n:
        return
    offsets = text_offsets(batch.column(column))
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


def text_offsets(array: pa.Array) -> np.ndarray:
    """Byte offsets (n + 1) of a string or binary array."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(array.buffers()[1], kind, len(array) + 1, array.offset * np.dtype(kind).itemsize).astype(np.int64)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in a row, and the n + 1 offsets of the rows in them; NULL is not expected."""
    offsets = text_offsets(array)
    data = array.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def map_batches(
    df: DataFrame,
    column: str,
    work: Callable[[pa.RecordBatch], dict[str, pa.Array]],
    added: StructType,
    drop: tuple[str, ...] = (),
    limit: int = SLICE_BYTES,
    tables: bool = False,
) -> DataFrame:
    """Append the columns that ``work`` makes from each slice of rows; ``drop`` names columns not carried on.

    Workers are used again by later stages: unless ``work`` asks for :func:`resident` ``tables``, those of an earlier
    operator are let go first.
    """
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = StructType(kept + list(added.fields))
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back() if tables else release()
        for batch in batches:
            for part in slices(batch, column, limit):
                made = work(part)
                arrays = [part.column(n) for n in names] + [made[f.name] for f in added.fields]
                yield pa.RecordBatch.from_arrays(arrays, names + [f.name for f in added.fields])

    return df.mapInArrow(run, schema)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list array of rows with ``counts`` values each."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + size), one run after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)


def long_field(name: str) -> StructField:
    return StructField(name, LongType())


def word_slices(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without ASCII white space) of the texts ``data[bounds[k] : bounds[k + 1]]``.

    Returns the words' bytes with A-Z in lower case and one space between words of a text, begin and end of each
    word in them, and the number of words of each text.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(len(bounds) - 1, np.int64)
    blank = (data == 32) | (data - np.uint8(9) <= 4)
    first = np.zeros(len(data), bool)
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = ~blank
    kept, ends = starts.copy(), starts.copy()
    starts[1:] &= blank[:-1] | first[1:]
    ends[:-1] &= blank[1:] | first[1:]
    at, after = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sizes = after - at
    spaced = np.zeros(len(at), bool)  # words with a blank after them
    inner = after[: len(after) - int(len(after) > 0 and after[-1] == len(data))]
    spaced[: len(inner)] = blank.take(inner) & ~first.take(inner)
    kept[after[spaced]] = True
    plain = data[kept]
    plain |= (plain - np.uint8(65) < 26).view(np.uint8) << 5
    begin = np.cumsum(sizes + spaced) - sizes - spaced
    end = begin + sizes
    plain[end[spaced]] = 32
    return plain, begin, end, np.diff(np.searchsorted(at, bounds))
