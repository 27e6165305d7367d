"""Sums by pair of two codes, and values found by pair, in arrays: a row is read once for all pairs and not multiplied by them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CELLS = 1 << 22  # cells of all pairs that a task counts in arrays: 28 bytes each with two targets
VALUES = 1 << 18  # values of a column that a task numbers before it hands on what it counted
SLICE = 1 << 16  # rows handed on at once


def text(column: str) -> str:
    """The column that holds a code as text."""
    return f"_text_{column}"


class Codes:
    """Numbers of the values of a column."""

    def __init__(self, values: Iterable[str] = ()):
        self.places = {v: i for i, v in enumerate(values)}

    def numbers(self, column: pa.Array, grow: bool = False) -> np.ndarray:
        """The number of each row's value; a new value gets the next one, or -1 if they do not ``grow``."""
        found = column.dictionary_encode()
        values, places = found.dictionary.to_pylist(), self.places
        if grow:
            for value in values:
                places.setdefault(value, len(places))
        numbers = np.fromiter((places.get(v, -1) for v in values), np.int64, len(values))
        return numbers[found.indices.to_numpy(zero_copy_only=False)]

    @property
    def room(self) -> int:
        return 1 << max(len(self.places) - 1, 0).bit_length()


def _filled(column: pa.Array) -> tuple[np.ndarray, np.ndarray | None]:
    """Values with 0 for missing ones, and the places of these."""
    if not column.null_count:
        return column.to_numpy(), None
    return column.fill_null(0.0).to_numpy(), np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False))


class _Sums:
    """Number of rows, and sum and missing values of each target, by cell of a grid that grows."""

    def __init__(self, targets: int):
        self.shape = (0, 0)
        self.arrays = [np.zeros(0, kind) for kind in (np.int32, *[np.float64] * targets, *[np.int32] * targets)]

    def grow(self, shape: tuple[int, int]) -> None:
        if shape == self.shape:
            return
        for i, old in enumerate(self.arrays):
            new = np.zeros(shape, old.dtype)
            new[: self.shape[0], : self.shape[1]] = old.reshape(self.shape)
            self.arrays[i] = new.ravel()
        self.shape = shape

    def add(self, at: np.ndarray, targets: Sequence[tuple[np.ndarray, np.ndarray | None]]) -> None:
        cells, kinds = len(self.arrays[0]), len(targets)

        def count(array: np.ndarray, at: np.ndarray, values: np.ndarray | None = None) -> None:
            if cells <= 4 * len(at):
                array += np.bincount(at, values, cells).astype(array.dtype, copy=False)
            else:
                np.add.at(array, at, np.ones(len(at), array.dtype) if values is None else values)

        count(self.arrays[0], at)
        for i, (values, missing) in enumerate(targets):
            count(self.arrays[1 + i], at, values)
            if missing is not None:
                count(self.arrays[1 + kinds + i], at[missing])


def count_pairs(
    batches: Iterable[pa.RecordBatch], pairs: Sequence[tuple[str, str]], targets: Sequence[str]
) -> Iterator[pa.RecordBatch]:
    """Per pair of columns and of their values: rows, and sum and number of each target; the same values may come several times.

    All pairs are counted in arrays as long as they have ``CELLS`` cells together. The largest ones beyond that are counted batch by
    batch, and a column of more than ``VALUES`` values is numbered afresh, so that a task's memory is bounded.
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    codes, sums, apart = {c: Codes() for c in columns}, {}, set()

    def rows(i: int, entries: pa.Array, groups: pa.Array, counted: Sequence[np.ndarray]) -> pa.RecordBatch:
        n, kinds = counted[0].astype(np.int64), len(targets)
        made = {"_pair": pa.array(np.full(len(n), i, np.int32)), "_entry": entries, "_group": groups, "_n": pa.array(n)}
        for j, t in enumerate(targets):
            made[f"_sum_{t}"], made[f"_count_{t}"] = pa.array(counted[1 + j]), pa.array(n - counted[1 + kinds + j])
        return pa.RecordBatch.from_pydict(made)

    def hand_on(i: int) -> Iterator[pa.RecordBatch]:
        done = sums.pop(i)
        entries, groups = (pa.array(list(codes[c].places), pa.string()) for c in pairs[i])
        every = np.flatnonzero(done.arrays[0])
        for start in range(0, len(every), SLICE):
            at = every[start : start + SLICE]
            entry, group = np.divmod(at, done.shape[1])
            yield rows(i, entries.take(pa.array(entry)), groups.take(pa.array(group)), [a[at] for a in done.arrays])

    for batch in batches:
        if not batch.num_rows:
            continue
        numbers = {c: codes[c].numbers(batch.column(text(c)), grow=True) for c in columns}
        room = {c: codes[c].room for c in columns}
        size = {i: room[e] * room[g] for i, (e, g) in enumerate(pairs) if i not in apart}
        while sum(size.values()) > CELLS:
            largest = max(size, key=size.get)
            del size[largest]
            apart.add(largest)
            if largest in sums:
                yield from hand_on(largest)
        values = [_filled(batch.column(t)) for t in targets]
        for i, (e, g) in enumerate(pairs):
            at = numbers[e] * room[g] + numbers[g]
            if i not in apart:
                held = sums.setdefault(i, _Sums(len(targets)))
                held.grow((room[e], room[g]))
                held.add(at, values)
                continue
            _, first, cell = np.unique(at, return_index=True, return_inverse=True)
            own = _Sums(len(targets))
            own.grow((len(first), 1))
            own.add(cell, values)
            yield rows(i, batch.column(text(e)).take(pa.array(first)), batch.column(text(g)).take(pa.array(first)), own.arrays)
        if max(len(c.places) for c in codes.values()) > VALUES:
            for i in list(sums):
                yield from hand_on(i)
            codes, apart = {c: Codes() for c in columns}, set()
    for i in list(sums):
        yield from hand_on(i)


@dataclass(frozen=True)
class Grid:
    """The values of one pair by ``entry's number * width + group's number``."""

    entry: str
    group: str
    width: int
    absent: np.ndarray | None
    values: Sequence[tuple[np.ndarray, np.ndarray | None]]  # and where they are NULL


def grids(
    table: pa.Table, pairs: Mapping[int, tuple[str, str]], targets: Sequence[str]
) -> tuple[dict[str, Codes], list[Grid]]:
    """Arrays of the rows (_pair, _entry, _group, targets) of some pairs, and the numbers of all values in them."""
    table = table.combine_chunks()
    pair = table["_pair"].to_numpy()
    order = np.argsort(pair, kind="stable")
    ends = {i: np.searchsorted(pair[order], [i, i + 1]) for i in pairs}
    parts = {i: table.take(pa.array(order[a:b])).combine_chunks() for i, (a, b) in ends.items()}
    whole = lambda column: pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    codes: dict[str, Codes] = {}
    numbers = {
        (i, c): codes.setdefault(c, Codes()).numbers(whole(parts[i][side]), grow=True)
        for i, pair_ in pairs.items() for side, c in zip(("_entry", "_group"), pair_)
    }
    made = []
    for i, (e, g) in pairs.items():
        width = len(codes[g].places)
        at, cells = numbers[i, e] * width + numbers[i, g], len(codes[e].places) * width
        absent = np.ones(cells, bool)
        absent[at] = False
        values = []
        for t in targets:
            found, missing = _filled(whole(parts[i][t]))
            array, nulls = np.zeros(cells), None
            array[at] = found
            if missing is not None:
                nulls = np.zeros(cells, bool)
                nulls[at[missing]] = True
            values.append((array, nulls))
        made.append(Grid(e, g, width, absent if absent.any() else None, values))
    return codes, made


def find_pairs(
    batches: Iterable[pa.RecordBatch], held: tuple[dict[str, Codes], list[Grid]], keep: Sequence[str], names: Sequence[str],
    there_already: Iterable[str] = (),
) -> Iterator[pa.RecordBatch]:
    """Kept columns and the results ``names``: those that are columns already, and the grids' values in order for the others.

    Rows of values that are not in the grids drop out.
    """
    codes, tables = held
    for batch in batches:
        numbers = {c: codes[c].numbers(batch.column(text(c))) for c in codes}
        there = np.ones(batch.num_rows, bool)
        for c, found in numbers.items():
            if (found < 0).any():
                there &= found >= 0
                numbers[c] = np.maximum(found, 0)
        values = []
        for grid in tables:
            at = numbers[grid.entry] * grid.width + numbers[grid.group]
            if grid.absent is not None:
                there &= ~grid.absent[at]
            values += [pa.array(array[at], mask=None if nulls is None else nulls[at]) for array, nulls in grid.values]
        rest = iter(values)
        made = [batch.column(n) if n in there_already else next(rest) for n in names]
        out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], [*keep, *names])
        yield out if there.all() else out.filter(pa.array(there))
