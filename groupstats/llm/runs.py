"""Periodic runs of words inside texts, by the branching-tandem test on an enhanced suffix array.

All texts of a slice are sorted as suffixes of words at once; a word's symbol includes its text, so suffixes of two texts
never share a prefix and a match cannot cross texts. Prefix doubling sorts them: in round ``r`` suffixes are
ordered by their first ``2 ** r`` words, and only those still tied are sorted again. The ranks of every round are kept,
since two suffixes share ``2 ** r`` words if their ranks of round ``r`` are equal: so longest common extensions, to the
right and to the left, are read off in a few gathers for many pairs at once.

The longest common prefixes (LCP) of neighbours in the suffix array split every LCP interval of depth ``d`` in two. Each
suffix ``i`` of the smaller side is tested: if ``i + d`` or ``i - d`` lies in the larger side (its inverse suffix array entry
falls there), a square of period ``d`` starts at the lesser of both and its next word breaks the period: a branching tandem
repeat. As only smaller sides are walked, all tests together are at most ``n log n``. Rotating the square to the left
while the words agree gives the run that ends there; runs found again by a multiple of their period are merged.

Every run with a whole second period is found, exactly; ``least_length`` and ``least_periods`` select among them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from groupstats.llm.batches import gather, map_batches, text_bytes, unused, whole_text

#: Suffixes tested at once.
STEP = 1 << 22


def split_words(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words (runs without ASCII white space) of the texts ``data[bounds[k] : bounds[k + 1]]`` as an array of
    bytes, and the number of words of each text."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cuts = bounds[:-1][np.diff(bounds) > 0]
    starts[cuts] = inside[cuts]
    at = np.flatnonzero(starts)
    place = np.cumsum(inside)  # letters up to here
    offsets = np.append(place[at] - 1, place[-1] if len(place) else 0).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return words, np.diff(np.searchsorted(at, bounds))


class SuffixArray:
    """Suffixes of ``symbols``, their order, and the ranks by their first 1, 2, 4, ... symbols."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        _, first, count = np.unique(symbols, return_inverse=True, return_counts=True)
        starts = np.cumsum(count) - count
        rank = starts[first].astype(np.int32)
        self.levels = [rank]
        tied = np.flatnonzero(count[first] > 1)
        width = 1
        while len(tied):
            after = tied + width
            follow = np.where(after < n, rank[np.minimum(after, n - 1)], -1).astype(np.int64) + 1
            key = rank[tied].astype(np.int64) * (n + 1) + follow
            order = np.argsort(key)
            tied, key = tied[order], key[order]
            old = rank[tied]
            new_key = np.ones(len(tied), bool)
            new_key[1:] = key[1:] != key[:-1]
            new_old = np.ones(len(tied), bool)
            new_old[1:] = old[1:] != old[:-1]
            place = np.arange(len(tied))
            head = np.maximum.accumulate(np.where(new_key, place, 0))
            base = np.maximum.accumulate(np.where(new_old, place, 0))
            rank = rank.copy()
            rank[tied] = old + (head - base)
            self.levels.append(rank)
            alone = new_key.copy()
            alone[:-1] &= new_key[1:]
            tied = np.sort(tied[~alone])
            width *= 2
        self.inverse = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes ``a`` and ``b`` (never the same)."""
        n, total = len(self.inverse), np.zeros(len(a), np.int64)
        for r in range(len(self.levels) - 1, -1, -1):
            x, y = a + total, b + total
            good = np.flatnonzero((x < n) & (y < n))
            same = self.levels[r][x[good]] == self.levels[r][y[good]]
            total[good[same]] += 1 << r
        return total

    def common_back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols right before ``a`` and ``b``."""
        total = np.zeros(len(a), np.int64)
        for r in range(len(self.levels) - 1, -1, -1):
            x, y = a - total - (1 << r), b - total - (1 << r)
            good = np.flatnonzero((x >= 0) & (y >= 0))
            same = self.levels[r][x[good]] == self.levels[r][y[good]]
            total[good[same]] += 1 << r
        return total


def split_intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry ``k`` of ``lcp`` above 0: first and one past last suffix of the interval that it splits.

    ``lcp[k]`` is between the suffixes ``k - 1`` and ``k``. Among equal entries the first splits before the others.
    """
    low, high = np.zeros(len(lcp), np.int64), np.zeros(len(lcp), np.int64)
    at = np.flatnonzero(lcp)
    lows: list[int] = []
    stack: list[tuple[int, int, int]] = []  # depth, first suffix, which entry
    expected = -1
    highs = [0] * len(at)
    for which, (k, depth) in enumerate(zip(at.tolist(), lcp[at].tolist())):
        first = k - 1
        if k != expected:
            for _, _, other in stack:
                highs[other] = expected
            stack.clear()
        while stack and stack[-1][0] > depth:
            _, first, other = stack.pop()
            highs[other] = k
        lows.append(first)
        stack.append((depth, first, which))
        expected = k + 1
    for _, _, other in stack:
        highs[other] = expected
    low[at], high[at] = lows, highs
    return low, high


def squares(suffixes: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and period of every branching tandem repeat: a square whose next symbol breaks its period."""
    order, inverse = suffixes.order, suffixes.inverse
    n = len(order)
    lcp = np.zeros(n, np.int64)
    near = np.flatnonzero(suffixes.levels[0][order[1:]] == suffixes.levels[0][order[:-1]]) + 1
    lcp[near] = suffixes.common(order[near - 1], order[near])
    low, high = split_intervals(lcp)
    nodes = np.flatnonzero(lcp)
    begins, periods = [], []
    left = nodes - low[nodes] <= high[nodes] - nodes
    sizes = np.where(left, nodes - low[nodes], high[nodes] - nodes)
    steps = np.cumsum(sizes) // STEP
    for some in np.split(np.arange(len(nodes)), np.flatnonzero(np.diff(steps)) + 1):
        k, on_left = nodes[some], left[some]
        small = np.where(on_left, low[k], k)
        walked = order[gather(small, sizes[some])]
        owner = np.repeat(np.arange(len(some)), sizes[some])
        depth = lcp[k][owner]
        other_low = np.where(on_left, k, low[k])[owner]
        other_high = np.where(on_left, high[k], k)[owner]
        for way in (1, -1):
            target = walked + way * depth
            place = inverse[np.clip(target, 0, n - 1)]
            hit = (target >= 0) & (target < n) & (place >= other_low) & (place < other_high)
            begins.append(np.minimum(walked, target)[hit])
            periods.append(depth[hit])
    return np.concatenate(begins), np.concatenate(periods)


def word_runs(
    symbols: np.ndarray, least_length: int, least_periods: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of the runs, by start and period."""
    if not len(symbols):
        return (np.zeros(0, np.int64),) * 3
    suffixes = SuffixArray(symbols)
    begin, period = squares(suffixes)
    back = suffixes.common_back(begin, begin + period)
    start, length = begin - back, back + 2 * period
    good = length >= np.maximum(least_length, least_periods * period)
    start, length, period = start[good], length[good], period[good]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)  # the same stretch by a multiple of its period comes after it
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((length, period, start))
    return start[order], length[order], period[order]


def find_runs(
    df: DataFrame, text: str = "text", least_length: int = 6, least_periods: int = 4, drop: tuple[str, ...] = ()
) -> DataFrame:
    """Append the runs of each text, and the text without their repeats.

    ``n_words`` counts the words (runs without ASCII white space); ``runs`` holds structs of ``start`` (a word's number from
    0), ``length`` and smallest ``period``, by start and period: the stretches of at least ``least_length`` words and
    ``least_periods`` (2 or more) periods that no neighbouring word extends. ``collapsed`` joins by one space the words that are
    not in a run after its first period.

    NULL and empty texts have no words, no runs and an empty ``collapsed``. Texts are told apart by row, so repeated rows, ids
    and NULL ids do not matter. Columns named like the added ones are replaced; ``drop`` names columns not carried on. A
    text is worked on whole, in some 150 bytes of memory per word.
    """
    run = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])
    added = StructType(
        [StructField("n_words", LongType()), StructField("runs", ArrayType(run)), StructField("collapsed", StringType())]
    )

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data, bounds = text_bytes(batch.column(whole))
        words, counts = split_words(data, bounds)
        coded = words.dictionary_encode()
        ends = np.cumsum(counts)
        rows = np.repeat(np.arange(len(counts)), counts)
        symbols = rows * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
        start, length, period = word_runs(symbols, least_length, least_periods)
        row = rows[start]
        marks = np.zeros(len(words) + 1, np.int64)
        np.add.at(marks, start + period, 1)
        np.add.at(marks, start + length, -1)
        kept = np.flatnonzero(np.cumsum(marks)[:-1] == 0)
        left = np.bincount(rows[kept], minlength=len(counts))
        per_row = np.bincount(row, minlength=len(counts))
        pieces = pa.StructArray.from_arrays(
            [pa.array(start - (ends - counts)[row]), pa.array(length), pa.array(period)], ["start", "length", "period"]
        )
        offsets = np.append(0, np.cumsum(per_row)).astype(np.int32)
        return {
            "n_words": pa.array(counts.astype(np.int64)),
            "runs": pa.ListArray.from_arrays(pa.array(offsets), pieces),
            "collapsed": _joined(words, kept, left),
        }

    gone = {*added.fieldNames(), *drop}
    whole = unused(df, "_text")
    rest = df.select(*[c for c in df.columns if c not in gone], whole_text(text).alias(whole))
    return map_batches(rest, whole, work, added, drop=(whole,))


def _joined(words: pa.Array, kept: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The ``kept`` words of each row joined by one space."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)
    data = np.frombuffer(words.buffers()[2], np.uint8)
    sizes = (offsets[1:] - offsets[:-1])[kept].astype(np.int64)
    ends = np.cumsum(sizes + 1)  # a space after each word
    total = int(ends[-1]) if len(ends) else 0
    out = np.full(total, 32, np.uint8)
    to = gather(ends - sizes - 1, sizes)
    out[to] = data[gather(offsets[:-1][kept].astype(np.int64), sizes)]
    last = np.cumsum(counts)
    marks = np.ones(total, bool)
    filled = np.flatnonzero(counts)
    marks[ends[last[filled] - 1] - 1] = False  # none after a row's last word
    lengths = np.zeros(len(counts), np.int64)
    before = np.append(0, ends)
    lengths[filled] = before[last[filled]] - before[last[filled] - counts[filled]] - 1
    places = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(places), pa.py_buffer(out[marks])])
