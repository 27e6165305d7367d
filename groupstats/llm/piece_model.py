"""A SentencePiece model file read from its protobuf form, its merges, and its normaliser with alignment."""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SPACE = "▁"
#: Kinds of pieces in the model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


#: The score of a pair that does not merge.
NO_SCORE = float("-inf")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = 8 if kind == 1 else 4
            value = data[at : at + size]
            at += size
        yield key >> 3, value


def read_char_map(blob: bytes) -> dict[str, str]:
    """The pairs of a compiled character map: a double-array trie and a pool of zero-ended targets.

    Every key of the trie is listed by walking it from the root.
    """
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
    pool = blob[4 + size :]
    base = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
    bytes_ = np.arange(1, 256)
    pairs = {}
    stack = [(base(int(units[0])), b"")]
    while stack:
        node, key = stack.pop()
        children = node ^ bytes_
        inside = np.minimum(children, len(units) - 1)
        for k in np.flatnonzero((units[inside] & 0x800000FF == bytes_) & (children < len(units))).tolist():
            child, unit = int(children[k]), int(units[children[k]])
            below, longer = child ^ base(unit), key + bytes([k + 1])
            if unit & 0x100:
                value = int(units[below]) & 0x7FFFFFFF
                pairs[longer] = pool[value : pool.index(b"\0", value)]
            stack.append((below, longer))
    out = {}
    for key, target in pairs.items():
        try:
            out[key.decode()] = target.decode()
        except UnicodeDecodeError:  # a key inside a character never matches whole text
            continue
    return out


class Normalizer:
    """Longest-prefix rewriting that keeps, for each code point made, the source byte it starts at."""

    def __init__(self, char_map: dict[str, str], dummy_prefix: bool, squeeze: bool, escape: bool):
        self.char_map = char_map
        self.dummy_prefix = dummy_prefix
        self.squeeze = squeeze
        self.space = SPACE if escape else " "
        self.longest: dict[str, int] = {}
        for key in char_map:
            self.longest[key[0]] = max(self.longest.get(key[0], 0), len(key))

    @property
    def identity(self) -> bool:
        return not self.char_map and not self.squeeze and self.space == SPACE

    def _prefix(self, text: str, at: int) -> tuple[str, int]:
        for size in range(min(self.longest.get(text[at], 0), len(text) - at), 0, -1):
            target = self.char_map.get(text[at : at + size])
            if target is not None:
                return target, size
        return text[at], 1

    def __call__(self, text: str) -> tuple[str, list[int]]:
        """The rewritten text, and the source byte offset of each of its code points and of its end."""
        out: list[str] = []
        align: list[int] = []
        byte = at = 0
        size = lambda s: len(s.encode("utf-8", "surrogatepass"))
        if self.squeeze:
            while at < len(text):
                target, used = self._prefix(text, at)
                if target != " ":
                    break
                byte += size(text[at : at + used])
                at += used
        if at >= len(text):
            return "", [byte]
        if self.dummy_prefix:
            out.append(self.space)
            align.append(byte)
        after_space = self.squeeze
        while at < len(text):
            target, used = self._prefix(text, at)
            if after_space:
                target = target.lstrip(" ")
            for char in target:
                out.append(self.space if char == " " else char)
                align.append(byte)
            if target:
                after_space = self.squeeze and target[-1] == " "
            byte += size(text[at : at + used])
            at += used
        if self.squeeze:
            while out and out[-1] == self.space:
                byte = align.pop()
                out.pop()
        align.append(byte)
        return "".join(out), align


class PieceModel:
    """Pieces with scores, merges by score, and bytes for characters without a piece."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        norm: dict[int, object] = {}
        trainer: dict[int, object] = {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
                self.pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                norm = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("only models of the merge kind are read")
        if any(kind in (USER, UNUSED) for _, _, kind in self.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.score = {p: s for p, s, kind in self.pieces if kind == NORMAL}
        self.bytes_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.byte_of = {i: b for b, i in self.bytes_ids.items()}
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown_surface = bytes(trainer.get(44, " ⁇ ".encode())).decode()
        self.dummy_prefix = bool(norm.get(3, 1))
        self.normalizer = Normalizer(
            read_char_map(bytes(norm.get(2, b""))), self.dummy_prefix, bool(norm.get(4, 1)), bool(norm.get(5, 1))
        )
        #: No piece goes from another character into a space mark, so no merge does: text may be cut there.
        self.cut_before_space = not any(SPACE in p.lstrip(SPACE) for p in self.ids)

    def pair_score(self, first: str, second: str) -> float:
        """How early two neighbouring parts merge: higher is earlier."""
        return self.score.get(first + second, NO_SCORE)

    def merge(self, text: str) -> list[str]:
        """Split normalised text: join the neighbours that make the best piece, leftmost first, until none do."""
        score = self.score.get
        part = list(text)
        n = len(part)
        if n <= 24:  # few neighbours: look at all of them
            while n > 1:
                best, at = None, 0
                for i in range(n - 1):
                    s = score(part[i] + part[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if best is None:
                    break
                part[at : at + 2] = [part[at] + part[at + 1]]
                n -= 1
            return part
        before = list(range(-1, n - 1))
        after = list(range(1, n)) + [-1]
        queue = []
        for i in range(n - 1):
            s = score(part[i] + part[i + 1])
            if s is not None:
                queue.append((-s, i, i + 1, part[i] + part[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, j, made = heapq.heappop(queue)
            if after[i] != j or part[j] == "" or part[i] + part[j] != made or part[i] == "":
                continue
            part[i], part[j] = made, ""
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                s = score(made + part[k])
                if s is not None:
                    heapq.heappush(queue, (-s, i, k, made + part[k]))
            h = before[i]
            if h >= 0:
                s = score(part[h] + made)
                if s is not None:
                    heapq.heappush(queue, (-s, h, i, part[h] + made))
        return [p for p in part if p]

    def piece_ids(self, part: str) -> list[int]:
        """Ids of one split part: its piece, the bytes of a character without one, or the unknown id."""
        known = self.ids.get(part)
        if known is not None:
            return [known]
        if self.byte_fallback:
            return [self.bytes_ids[b] for b in part.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def decode(self, ids: list[int]) -> str:
        """Text of ids, with space marks as they are; runs of byte pieces are read as UTF-8."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                raw.append(byte)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            kind = self.pieces[i][2]
            out.append(self.unknown_surface if kind == UNKNOWN else "" if kind == CONTROL else self.pieces[i][0])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)


@lru_cache(maxsize=2)
def load_model(path: str) -> PieceModel:
    """The model at ``path``, read once per worker."""
    with open(path, "rb") as f:
        return PieceModel(f.read())
