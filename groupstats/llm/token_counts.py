"""Token counts from a tokenizer compiled to a deterministic finite-state transducer.

A piece ends a text's encoding exactly if it can follow the last piece of the text before it: two
neighbouring pieces are allowed if encoding both together gives these two back. So the number of tokens of
a text extended by one character follows from the open starts: places from which a longer piece may still
grow, each with the last piece before it and its count relative to the end. These open starts are the
transducer's states; a transition by a character carries the change of the count. States are built when
first met and numbered in a table; a table past its size limit is started afresh, which changes no count.

Every text is cut before runs of space marks. Reading such a mark leads every state to the same one, so a
chunk's state map is constant: no maps are composed, of the prefix scan over maps only adding is left, of the counts of
its chunks. All chunks of a batch advance together, one character a step. For models that merge across
spaces a text is one chunk.

One pass without a shuffle. NULL and empty texts count 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from groupstats.llm.batches import long_field, map_batches, resident, whole_text
from groupstats.llm.piece_model import NO_SCORE, SPACE, PieceModel, load_model

#: Cells of the transition table at most (9 bytes each).
MAX_CELLS = 20_000_000
#: Longer pieces of an open start that are tried to see whether it can be dropped.
LOOKED_AT = 60
_UNKNOWN_SIZES = 5  # classes 0..4: a lone piece, and characters of 1 to 4 bytes without a piece


class Transducer:
    """Transitions ``(state, class) -> (state, change of the count)``, built when first met."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.histories: dict[str, tuple[list[float], list[str], list[str], bool]] = {}
        self.grows: dict[str, list[str]] = {}
        for p in model.ids:
            for k in range(1, len(p)):
                self.grows.setdefault(p[:k], []).append(p)
        self.kinds: dict[tuple[str, object], str] = {}
        joined = {c for p in model.ids if len(p) > 1 for c in p}
        self.lone = np.zeros(0x110000, np.int16)
        points = np.arange(0x110000)
        bytes_of = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        self.lone[:] = bytes_of if model.byte_fallback else 0
        single = {ord(p): i for p, i in model.ids.items() if len(p) == 1}
        self.lone[list(single)] = 0
        self.lone_ids = np.full(0x110000, -1, np.int32)
        self.lone_ids[list(single)] = list(single.values())
        self.piece_sizes = np.zeros(max(model.ids.values()) + 1, np.int64)
        self.piece_sizes[list(model.ids.values())] = [len(p) for p in model.ids]
        self.joined = sorted(joined)
        self.classes = self.lone.copy()
        for c in self.joined:
            self.classes[ord(c)] = -1  # gets a class when first met
        self.size_of_unknown = bytes_of
        self._clear()

    def _clear(self) -> None:
        self.state: dict[tuple, int] = {}
        self.open: list[tuple] = []
        self.symbol: list[str | None] = [None] * _UNKNOWN_SIZES
        for c in self.joined:
            self.classes[ord(c)] = -1
        self.width = 96
        self.next = np.full((1024, self.width), -1, np.int32)
        self.emit = np.zeros((1024, self.width), np.int8)
        self.last = np.full((1024, self.width), -1, np.int32)
        self.start = self._number((("", None, 0),))

    def _number(self, opens: tuple) -> int:
        known = self.state.get(opens)
        if known is None:
            known = self.state[opens] = len(self.open)
            self.open.append(opens)
            if known >= len(self.next):
                more = np.full_like(self.next, -1)
                self.next = np.concatenate([self.next, more])
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
                self.last = np.concatenate([self.last, more])
        return known

    def _class_of(self, point: int) -> int:
        number = len(self.symbol)
        self.symbol.append(chr(point))
        self.classes[point] = number
        if number >= self.width:
            self.next = np.concatenate([self.next, np.full_like(self.next, -1)], axis=1)
            self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)], axis=1)
            self.last = np.concatenate([self.last, np.full_like(self.last, -1)], axis=1)
            self.width *= 2
        return number

    def _history(self, piece: str) -> tuple[list[float], list[str], list[str], bool]:
        """The merges of a piece by itself: their scores in order, the first and the last part before the
        first merge and after each one, and whether they end in the piece."""
        known = self.histories.get(piece)
        if known is None:
            score = self.model.pair_score
            part = list(piece)
            scores, first, last = [], [part[0]], [part[-1]]
            while len(part) > 1:
                found = [score(x, y) for x, y in zip(part, part[1:])]
                best = max(found)
                if best == NO_SCORE:
                    break
                at = found.index(best)
                part[at : at + 2] = [part[at] + part[at + 1]]
                scores.append(best)
                first.append(part[0])
                last.append(part[-1])
            scores.append(NO_SCORE)
            known = self.histories[piece] = scores, first, last, len(part) == 1
        return known

    def _whole(self, piece: str) -> bool:
        return self._history(piece)[3]

    def _follows(self, last: str | None, piece: str) -> bool:
        """Whether encoding both together gives both back: replay their merges side by side, best score
        first and leftmost first, and see whether the parts that touch ever merge."""
        if last is None:
            return True
        left, _, edges, _ = self._history(last)
        right, starts, _, _ = self._history(piece)
        score = self.model.pair_score
        i = j = 0
        while True:
            across = score(edges[i], starts[j])
            a, b = left[i], right[j]
            if across > a and across >= b:
                return False
            if a == b == NO_SCORE:
                return True
            if a >= b:
                i += 1
            else:
                j += 1

    def _kind(self, start: str, last: str | None) -> str | None:
        """A piece that may stand for ``last`` before what grows from ``start``: the first one that the same
        longer pieces can follow. Empty if none can. Starts from which very many pieces grow keep their own."""
        longer = self.grows[start]
        if last is None or len(longer) > LOOKED_AT:
            return last
        known = self.kinds.get((start, last))
        if known is None:
            can = tuple(p for p in longer if self._whole(p) and self._follows(last, p))
            known = self.kinds[start, last] = self.kinds.setdefault((start, can), last) if can else ""
        return known

    def _step(self, state: int, number: int) -> None:
        char = self.symbol[number]
        if char is None:
            self.next[state, number] = self.start
            self.emit[state, number] = max(number, 1)
            return
        opens = [(suffix + char, last, count) for suffix, last, count in self.open[state]]
        if char in self.model.ids:
            for piece, last, count in opens:
                if piece in self.model.ids and self._whole(piece) and self._follows(last, piece):
                    change, end = count + 1, piece
                    break
            else:
                raise ValueError(f"no piece can end after {opens!r}")
        else:  # a character that only pieces hold: by itself it is unknown
            change, end = (int(self.size_of_unknown[ord(char)]) if self.model.byte_fallback else 1), None
        grown = [(s, k, c - change) for s, t, c in opens if s in self.grows and (k := self._kind(s, t)) != ""]
        made = self._number((*grown, ("", end, 0)))
        self.next[state, number] = made
        self.emit[state, number] = change
        self.last[state, number] = -1 if end is None else self.model.ids[end]

    def count(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
        """Tokens of each chunk ``points[start : start + size]``, all chunks stepping together.

        ``last`` receives, for each place, the id of the piece that ends there in the encoding of the chunk
        up to there; -1 where the character there stands alone (a lone piece, or none).
        """
        if len(self.open) * self.width > MAX_CELLS:
            self._clear()
        symbols = self.classes[points]
        if (symbols < 0).any():
            for point in np.unique(points[symbols < 0]):
                self._class_of(int(point))
            symbols = self.classes[points]
        order = np.argsort(-sizes, kind="stable")
        place, size = starts[order], sizes[order]
        state = np.full(len(order), self.start, np.int64)
        total = np.zeros(len(order), np.int64)
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(longest), side="left")  # chunks longer than the step
        for step in range(longest):
            k = int(active[step])
            symbol = symbols[place[:k] + step]
            here = state[:k]
            made = self.next[here, symbol]
            if (made < 0).any():
                missing = np.flatnonzero(made < 0)
                for key in np.unique(here[missing] * 65536 + symbol[missing]):
                    self._step(int(key) >> 16, int(key) & 65535)
                made = self.next[here, symbol]
            total[:k] += self.emit[here, symbol]
            if last is not None:
                last[place[:k] + step] = self.last[here, symbol]
            state[:k] = made
        out = np.empty_like(total)
        out[order] = total
        return out

    def split(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of all chunks end, in order, and at every place the id of the last piece there.

        Read backwards from a chunk's end, the last pieces of its prefixes are its encoding. The id is -1
        for a character without a piece.
        """
        last = np.full(len(points), -1, np.int32)
        self.count(points, starts, sizes, last)
        alone = last < 0
        last[alone] = self.lone_ids[points[alone]]
        step = np.where(last < 0, 1, self.piece_sizes[last])
        is_end = np.zeros(len(points), bool)
        at = starts + sizes - 1
        while len(at):
            is_end[at] = True
            at = at - step[at]
            inside = at >= starts
            at, starts = at[inside], starts[inside]
        return np.flatnonzero(is_end), last

    def chunks(self, points: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of the chunks of texts that start at ``texts``."""
        cut = np.zeros(len(points), bool)
        if self.model.cut_before_space:
            mark = points == ord(SPACE)
            cut[1:] = mark[1:] & ~mark[:-1]
        cut[texts] = True
        starts = np.flatnonzero(cut)
        return starts, np.diff(np.append(starts, len(points)))

    def count_texts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        normal = []
        model = self.model
        for text in texts:
            if model.normalizer.identity:
                normal.append((SPACE + text.replace(" ", SPACE)) if text and model.dummy_prefix else text.replace(" ", SPACE))
            else:
                normal.append(model.normalizer(text)[0])
        sizes = np.array([len(t) for t in normal], np.int64)
        points = np.frombuffer("".join(normal).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(sizes)
        if not len(points):
            return np.zeros(len(texts), np.int64)
        starts, lengths = self.chunks(points, (ends - sizes)[sizes > 0])
        sums = np.concatenate([[0], np.cumsum(self.count(points, starts, lengths))])
        return sums[np.searchsorted(starts, ends)] - sums[np.searchsorted(starts, ends - sizes)]


def transducer(path: str) -> Transducer:
    return resident(("transducer", path), lambda: Transducer(load_model(path)))


def count_tokens(df: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``n_tokens`` of the text, which is dropped; ``keep`` lists the columns to carry along.

    ``model_path`` must be readable on every executor.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    rows = df.select(*[c for c in keep if c not in ("n_tokens", "_text")], whole_text(text).alias("_text"))

    def work(part: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"n_tokens": pa.array(transducer(model_path).count_texts(part.column("_text").to_pylist()))}

    return map_batches(rows, "_text", work, StructType([long_field("n_tokens")]), drop=("_text",), tables=True)
