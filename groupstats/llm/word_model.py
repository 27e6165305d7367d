"""Ids of a byte-level merge tokenizer whose words carry an end mark, for whole batches of texts.

Words are found by character class on the code points of a batch, and their bytes run through the compiled
transducer of ``token_counts``. Texts with characters whose normal form, case or class is not settled by
the table below (combining marks, other scripts, rare white space) or with special strings are given to the
library itself; both ways give the library's ids.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
from tokenizers import Tokenizer

from groupstats.llm.batches import resident
from groupstats.llm.piece_model import NO_SCORE
from groupstats.llm.token_counts import Transducer

#: What the model file must say for this reader (fixed values of the format).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END_MARK = "</w>"
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = 0, 1, 2, 3, 4
_TABLE = 0x250  # code points below are settled, but for a few


def _byte_chars() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class WordModel:
    """The model file as pieces over 512 symbols: bytes, and bytes that end a word."""

    byte_fallback = False
    cut_before_space = False

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["pattern"]["Regex"] != WORD_PATTERN or spec["model"]["end_of_word_suffix"] != END_MARK:
            raise ValueError("not a tokenizer of the kind this reader knows")
        byte = _byte_chars()

        def symbols(piece: str) -> str:
            ends = piece.endswith(END_MARK)
            codes = [byte[c] for c in (piece[: -len(END_MARK)] if ends else piece)]
            return "".join(chr(c + 256 * (ends and k == len(codes) - 1)) for k, c in enumerate(codes))

        special = {t["content"] for t in spec["added_tokens"]}
        self.special = [t for t in special if t]
        self.ids = {symbols(p): i for p, i in spec["model"]["vocab"].items() if p not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(symbols(a), symbols(b)): -float(k) for k, (a, b) in enumerate(pairs)}
        self._library: Tokenizer | None = None
        self.transducer = Transducer(self)
        self.lower = np.arange(_TABLE)
        self.kind = np.full(_TABLE, _OTHER, np.int8)
        for point in range(_TABLE):
            char = chr(point)
            low = char.lower()
            group = unicodedata.category(char)[0]
            self.kind[point] = _LETTER if group == "L" else _DIGIT if group == "N" else _OTHER
            if len(low) > 1 or ord(low) >= _TABLE or 0x1C <= point <= 0x1F or point in (0x85, 0xA0):
                self.kind[point] = _ODD
            else:
                self.lower[point] = ord(low)
        self.kind[[9, 10, 11, 12, 13, 32]] = _SPACE

    @property
    def library(self) -> Tokenizer:
        """The library's tokenizer, loaded when a text needs it."""
        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
        return self._library

    def pair_score(self, first: str, second: str) -> float:
        return self.rank.get((first, second), NO_SCORE)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the number of ids of each."""
        sizes = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        text_of = np.repeat(np.arange(len(texts)), sizes)
        high = points >= _TABLE
        kind = self.kind[np.where(high, 0, points)]
        kind[high] = _ODD
        odd = np.zeros(len(texts), bool)
        odd[text_of[kind == _ODD]] = True
        for k, text in enumerate(texts):
            if any(s in text for s in self.special):
                odd[k] = True
        usual = ~odd[text_of]
        ids, owner = self._words(points[usual], kind[usual], text_of[usual])
        counts = np.bincount(owner, minlength=len(texts))
        if not odd.any():
            return ids, counts
        rows = np.split(ids, np.cumsum(counts)[:-1])
        where = np.flatnonzero(odd)
        found = self.library.encode_batch_fast([texts[k] for k in where], add_special_tokens=False)
        for k, encoding in zip(where, found):
            rows[k] = np.array(encoding.ids, np.int32)
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)

    def _words(self, points: np.ndarray, kind: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts of settled characters, and the text of each id."""
        low = self.lower[points]
        n = len(low)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        new_text = np.ones(n, bool)
        new_text[1:] = text_of[1:] != text_of[:-1]
        start = new_text | (kind == _DIGIT)
        start[1:] |= kind[1:] != kind[:-1]
        # an apostrophe alone takes the short ending after it: 's 't 'm 'd 're 've 'll
        mark = np.flatnonzero(start[:-1] & (low[:-1] == ord("'")) & (kind[1:] == _LETTER) & ~new_text[1:])
        one = low[mark + 1]
        two = np.where(mark + 2 < n, low[np.minimum(mark + 2, n - 1)], 0)
        inside = (mark + 2 < n) & (kind[np.minimum(mark + 2, n - 1)] == _LETTER) & ~new_text[np.minimum(mark + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = inside & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        for where, size in ((mark[short], 2), (mark[long & ~short], 3)):
            start[where + 1] = False
            after = where + size
            after = after[after < n]
            start[after] = True
        start &= kind != _SPACE
        # bytes of every word; the last byte of a word is its own symbol
        end = np.zeros(n, bool)
        end[:-1] = start[1:] | (kind[1:] == _SPACE) | new_text[1:]
        end[-1] = True
        end &= kind != _SPACE
        wide = low >= 0x80
        size = np.where(kind == _SPACE, 0, 1 + wide)
        place = np.cumsum(size) - size
        symbols = np.zeros(int(size.sum()), np.uint32)
        narrow = (size == 1)
        symbols[place[narrow]] = low[narrow]
        two_bytes = size == 2
        symbols[place[two_bytes]] = 0xC0 | (low[two_bytes] >> 6)
        symbols[place[two_bytes] + 1] = 0x80 | (low[two_bytes] & 63)
        symbols[(place + size - 1)[end]] += 256
        starts = place[start]
        lengths = np.diff(np.append(starts, len(symbols)))
        ends, last = self.transducer.split(symbols, starts, lengths)
        owner_of_symbol = np.repeat(text_of, size)
        return last[ends], owner_of_symbol[ends]


def load_words(path: str) -> WordModel:
    """The model at ``path``, compiled once per worker."""
    return resident(("words", path), lambda: WordModel(path))
