"""Offset-preserving SentencePiece encoding and decoding.

Text is rewritten by the longest matching prefix of the model's compiled character map, keeping for every
rewritten code point the source byte it came from. Merges split the rewritten text into pieces, and the
kept offsets project each piece back to a byte span of the source.

Documents are independent, so this is one pass without a shuffle. A walk with the transducer of
``token_counts`` gives the last piece of every prefix; read backwards from the end they are the encoding.
NULL and empty texts have no pieces. Columns other than the text pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from groupstats.llm.batches import lists, map_batches, resident, whole_text
from groupstats.llm.piece_model import CONTROL, SPACE, UNKNOWN, PieceModel, load_model
from groupstats.llm.token_counts import Transducer

_INTS = ArrayType(IntegerType())
COLUMNS = ["ids", "begins", "ends", "decoded"]


class Encoder:
    """Encodes texts in batches: one walk forward for the last piece at every place, one back for the split."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.transducer = Transducer(model)
        self.byte_ids = np.array([model.bytes_ids.get(b, model.unknown) for b in range(256)], np.int32)
        self.shown = [p for p, _, _ in model.pieces]
        for i, byte in model.byte_of.items():
            self.shown[i] = chr(byte)
        self.long_byte = np.zeros(len(model.pieces), bool)
        self.long_byte[[i for i, byte in model.byte_of.items() if byte > 127]] = True
        self.long_byte[[i for i, (_, _, kind) in enumerate(model.pieces) if kind in (UNKNOWN, CONTROL)]] = True

    def _normal(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all rewritten texts, how many each has, and the source byte before each point and
        at each text's end (one more than points for every text)."""
        normalizer = self.model.normalizer
        if not normalizer.identity:
            made = [normalizer(t) for t in texts]
            points = np.frombuffer("".join(t for t, _ in made).encode("utf-32-le", "surrogatepass"), np.uint32)
            return points, np.array([len(t) for t, _ in made], np.int64), np.array([x for _, a in made for x in a], np.int64)
        dummy = SPACE if self.model.dummy_prefix else ""
        normal = [dummy + t if t else "" for t in texts]
        sizes = np.array([len(t) for t in normal], np.int64)
        points = np.frombuffer("".join(normal).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        width = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        if dummy:
            width[starts] = 0
        points[points == 32] = ord(SPACE)
        ends = np.cumsum(width)
        source = np.zeros(len(points) + len(texts), np.int64)
        place = np.arange(len(points)) + np.repeat(np.arange(len(texts)), sizes)
        base = np.concatenate([[0], ends])[np.cumsum(sizes) - sizes]
        source[place + 1] = ends - np.repeat(base, sizes)
        return points, sizes, source

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, begins and ends of the pieces of all texts in a row, and the number of ids of each text."""
        points, sizes, source = self._normal(texts)
        text_ends = np.cumsum(sizes)
        if not len(points):
            none = np.zeros(0, np.int32)
            return none, none, none, np.zeros(len(texts), np.int64)
        starts, lengths = self.transducer.chunks(points, (text_ends - sizes)[sizes > 0])
        end, last = self.transducer.split(points, starts, lengths)
        piece = last[end]
        # a character without a piece gives its bytes; all but the last of them get an empty span
        bytes_of = np.ones(len(end), np.int64)
        if self.model.byte_fallback:
            odd = points[end[piece < 0]]
            bytes_of[piece < 0] = 1 + (odd >= 0x80) + (odd >= 0x800) + (odd >= 0x10000)
        text_of = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(end, text_ends), prepend=0))
        size = np.where(piece < 0, 1, self.transducer.piece_sizes[piece])
        begins = np.repeat(source[end + 1 - size + text_of], bytes_of)
        closing = np.cumsum(bytes_of) - 1
        ends = begins.copy()
        ends[closing] = source[end + 1 + text_of]
        ids = np.repeat(piece, bytes_of)
        if (piece < 0).any():
            if self.model.byte_fallback:
                raw = "".join(map(chr, odd.tolist())).encode("utf-8", "surrogatepass")
                ids[ids < 0] = self.byte_ids[np.frombuffer(raw, np.uint8)]
            else:
                ids[ids < 0] = self.model.unknown
        counts = np.bincount(np.repeat(text_of, bytes_of), minlength=len(texts))
        return ids, begins.astype(np.int32), ends.astype(np.int32), counts

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces in a row, bytes read as UTF-8, space marks as spaces, no leading dummy."""
        if self.long_byte[ids].any():
            plain = self.model.decode(ids.tolist())
        else:
            plain = "".join(map(self.shown.__getitem__, ids.tolist()))
        plain = plain.replace(SPACE, " ")
        return plain[1:] if self.model.dummy_prefix and plain[:1] == " " else plain


def encoder(path: str) -> Encoder:
    return resident(("encoder", path), lambda: Encoder(load_model(path)))


def encode_pieces(df: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``ids``, ``begins``, ``ends`` (source bytes of each piece) and ``decoded`` (text of the ids).

    ``keep`` lists the columns to carry along (all but the text by default); columns named like the new
    ones are left out. ``model_path`` must be readable on every executor.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    rows = df.select(*[c for c in keep if c not in COLUMNS and c != "_text"], whole_text(text).alias("_text"))
    added = StructType([StructField("ids", _INTS), StructField("begins", _INTS), StructField("ends", _INTS), StructField("decoded", StringType())])

    def work(part: pa.RecordBatch) -> dict[str, pa.Array]:
        own = encoder(model_path)
        ids, begins, ends, counts = own.encode(part.column("_text").to_pylist())
        bounds = np.cumsum(counts) - counts
        decoded = [own.decode(ids[a : a + n]) for a, n in zip(bounds.tolist(), counts.tolist())]
        return {"ids": lists(ids, counts), "begins": lists(begins, counts), "ends": lists(ends, counts), "decoded": pa.array(decoded, pa.string())}

    return map_batches(rows, "_text", work, added, drop=("_text",), tables=True)
