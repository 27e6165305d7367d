"""Personal data in texts: base patterns, and a linear-chain conditional random field over word shapes that adds spans.

**Base.** E-mail addresses, IP addresses, card and phone numbers follow fixed patterns; matches that fail their
check (parts, digits, Luhn sum) are dropped and nothing inside them is tried again. So a phone number right before a card
number hides both. The searches read a text once, whatever it holds.

**Field.** A text's words (runs without ASCII white space) form sentences, which end at line breaks and after words
that end in ``.``, ``!`` or ``?``. Every word has a few features: its shape (letters and digits by class, runs
shortened), a coarser shape, what it passes as (a card number by Luhn sum, an IP address, ...), its brackets, and itself if the
labelled table knows it. A word's score for a label (outside, or begin or inside of a kind) is the sum of weights of its own
features and of those of the words before and after it; neighbouring labels have weights too. The weights maximise the
likelihood of the labelled table with a quadratic penalty, by gradients from forward and backward sums.

Decoding is Viterbi's, in numpy: sentences of a slice advance together, longest first, one word a step. Features are worked out
once per distinct word of a slice. A decoded span is added if it passes the check of its kind and touches no base span.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from groupstats.llm.batches import gather, map_batches, text_bytes, unused, whole_text

#: Kinds in the order in which spans of one start are listed (fixed values).
KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *[f"{place}-{kind}" for kind in KINDS for place in "BI"])
#: Rows of a labelled table that are used at most.
LABELLED = 10_000
#: Penalty of kinds of features, 1 for others.
COSTS = {"shape": 4.0, "word": 10.0}

# ---------------------------------------------------------------- base patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match ends where its digits end, so one that starts inside a run of digits never comes first
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            found.append(("email", start, domain.end()))
            free = domain.end()
        at = text.find("@", max(free, at + 1))
    return found


def is_ip(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def is_card(text: str) -> bool:
    digits = digits_of(text)
    if not 12 <= len(digits) <= 19:
        return False
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value // 10 + value % 10
    return total % 10 == 0


def is_phone(text: str) -> bool:
    return 9 <= len(digits_of(text)) <= 15


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind."""
    found = emails(text)
    if _DIGIT.search(text):
        for kind, pattern, good in (("ip", _IP, is_ip), ("card", _CARD, is_card), ("phone", _PHONE, is_phone)):
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if good(m.group())]
    return sorted(found, key=in_order)


def in_order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


# --------------------------------------------------------------------- features

_OPEN, _CLOSE = "\"'([{<", ".,;:!?\"')]}>"
_ENDS = frozenset(b".!?")
_RUN = re.compile(r"([a-z])\1+|([A-Z])\2+|(9+)")


def _shape(word: str) -> str:
    """Letters as a and A, digits as 9; runs of letters as one, of more than four digits by size class."""
    plain = "".join("9" if "0" <= c <= "9" else "a" if c.islower() else "A" if c.isalpha() else c for c in word[:64])

    def short(run: re.Match) -> str:
        n = len(run[0])
        if run[3] is None:
            return run[0][0]
        return f"{n if n < 5 else 5 if n < 9 else 9 if n < 12 else 12 if n < 20 else 20}d"

    return _RUN.sub(short, plain)


def word_features(word: str) -> tuple[str, ...]:
    """The features of one word, as texts."""
    core = word.strip(_OPEN + _CLOSE) or word
    if core.isalpha():
        shape = "a" if core.islower() else "Aa" if core[1:].islower() else "A"
        coarse = passes = "letters"
    else:
        shape = _shape(core)
        digits = len(digits_of(core))
        coarse = ("@" if "@" in core else "") + ("+" if core[0] == "+" else "") + ("d" if digits == len(core) else "d+" if digits else "s")
        numeric = digits and not re.search(r"[^0-9 .()+-]", core)
        passes = (
            "email" if emails(core)[:1] == [("email", 0, len(core))]
            else "other" if not numeric
            else "ip" if core.count(".") == 3 and is_ip(core)
            else "no ip" if core.count(".") > 1
            else "card" if core[0] != "+" and is_card(core)
            else "no card" if core[0] != "+" and digits >= 12
            else "phone" if is_phone(core) else "number"
        )
    brackets = ("(" if word[0] in "([" else "") + (")" if word.rstrip(".,;:!?")[-1:] in (")", "]") else "")
    return f"shape {shape}", f"coarse {coarse}", f"passes {passes}", f"brackets {brackets}", f"word {core.lower()}"


@dataclass
class Field:
    """Weights of a linear-chain conditional random field."""

    features: dict[str, int]
    own: np.ndarray
    before: np.ndarray  # of the features of the word before
    after: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def word_classes(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of equal known features form a class: each word's class, and (classes + 1, 3, labels) what a word of
        it adds to itself, to the next word and to the one before; the last is no word."""
        known = self.features
        numbers: dict[tuple[int, ...], int] = {}
        plain = [known[f] for f in word_features("a")[:-1] if f in known]
        which = np.empty(len(words), np.int64)
        for place, word in enumerate(words):
            if word.isalpha() and word.islower():
                own = known.get(f"word {word}")
                key = tuple(plain) if own is None else (*plain, own)
            else:
                key = tuple(known[f] for f in word_features(word) if f in known)
            which[place] = numbers.setdefault(key, len(numbers))
        tables = np.stack([self.own, self.before, self.after], axis=1)
        sums = [tables[list(key)].sum(axis=0) for key in [*numbers, (known["none"],)]]
        return which, np.stack(sums)


_BANNED = np.zeros((len(LABELS), len(LABELS)))
for _to, _label in enumerate(LABELS):
    if _label[0] == "I":
        _BANNED[[k for k, was in enumerate(LABELS) if was[1:] != _label[1:]], _to] = -1e6
_BANNED_FIRST = np.array([-1e6 if label[0] == "I" else 0.0 for label in LABELS])


def emissions(scores: np.ndarray, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Label scores of words in a row from the scores of their classes; ``first`` and ``last`` mark ends of sentences."""
    none = len(scores) - 1
    before = np.where(first, none, np.roll(words, 1))
    after = np.where(last, none, np.roll(words, -1))
    return scores[words, 0] + scores[before, 1] + scores[after, 2]


def viterbi(field: Field, scores: np.ndarray, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The best label of each word; sentence ``k`` are the ``sizes[k]`` words from ``starts[k]``."""
    first, last = np.zeros(len(words), bool), np.zeros(len(words), bool)
    first[starts], last[starts + sizes - 1] = True, True
    emitted = emissions(scores, words, first, last)
    moves = (field.moves + _BANNED).T.copy()  # to, from
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")  # longer than t
    back = np.zeros((len(words), len(LABELS)), np.int8)
    best = emitted[starts] + field.first + _BANNED_FIRST
    for t in range(1, len(active)):
        k = active[t]
        ways = best[:k, None, :] + moves
        back[starts[:k] + t] = chosen = ways.argmax(axis=2)
        best[:k] = np.take_along_axis(ways, chosen[:, :, None], 2)[:, :, 0] + emitted[starts[:k] + t]
    labels = np.zeros(len(words), np.int8)
    now = best.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        labels[starts[:k] + t] = now[:k]
        if t:
            now[:k] = back[starts[:k] + t, now[:k]]
    return labels


# --------------------------------------------------------------------- training


@dataclass
class Sentences:
    """Words of all texts in a row, cut into sentences."""

    words: list[str]
    numbers: np.ndarray
    begins: np.ndarray  # bytes, from the begin of all texts
    ends: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray


def read_sentences(data: np.ndarray, bounds: np.ndarray) -> Sentences:
    """Words and sentences of the texts ``data[bounds[k] : bounds[k + 1]]``."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cuts = bounds[:-1][np.diff(bounds) > 0]
    opening, closing = inside.copy(), inside.copy()
    opening[1:] &= ~inside[:-1]
    opening[cuts] = inside[cuts]
    closing[:-1] &= ~inside[1:]
    closing[cuts[1:] - 1] = inside[cuts[1:] - 1]
    begins, ends = np.flatnonzero(opening), np.flatnonzero(closing) + 1
    offsets = np.append(0, np.cumsum(ends - begins)).astype(np.int32)
    array = pa.Array.from_buffers(pa.string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    coded = array.dictionary_encode()
    rows = np.searchsorted(bounds, begins, side="right") - 1
    lines = np.cumsum((data >= 10) & (data <= 13))[begins] if len(begins) else begins
    first = np.ones(len(begins), bool)
    ended = np.isin(data[ends - 1], np.frombuffer(bytes(_ENDS), np.uint8)) if len(begins) else first
    first[1:] = ended[:-1] | (lines[1:] != lines[:-1]) | (rows[1:] != rows[:-1])
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(begins)))
    return Sentences(
        coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), begins, ends, rows, starts, sizes
    )


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points before every byte of a text, and in all of it."""
    return np.append(0, np.cumsum((data & 0xC0) != 0x80))


def train_field(labelled: DataFrame, rounds: int = 120, rate: float = 0.2, penalty: float = 0.05, limit: int = LABELLED) -> Field:
    """A field fitted on ``(text, spans)``, spans being structs of kind, start and end in code points.

    At most ``limit`` rows are used, those of the least texts. Without any row all words stay unlabelled. Weights of single words
    and of shapes cost more than those of coarser features, so that these carry over to words never seen.
    """
    table = labelled.filter("text IS NOT NULL").orderBy("text").limit(limit).select("text", "spans").collect()
    texts = [r["text"].encode() for r in table]
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    read = read_sentences(data, bounds)
    truth = np.zeros(len(read.numbers), np.int64)
    for row, entry in enumerate(table):
        place = code_points(data[bounds[row] : bounds[row + 1]])
        mine = np.flatnonzero(read.rows == row)
        begin, end = place[read.begins[mine] - bounds[row]], place[read.ends[mine] - bounds[row]]
        for span in entry["spans"] or []:
            held = mine[(begin < span["end"]) & (end > span["start"])]
            kind = 1 + 2 * KINDS.index(span["kind"])
            truth[held] = kind + 1
            truth[held[:1]] = kind
    per_word = [word_features(w) for w in read.words]
    features = {f: k for k, f in enumerate(sorted({f for fs in per_word for f in fs} | {"none"}))}
    of_word = np.array([[features[f] for f in fs] for fs in [*per_word, ("none",) * 5]])
    labels = len(LABELS)
    # weights of features for the word itself, the next, the one before; then of moves, then of first labels
    weights = np.zeros((3 * len(features) + labels + 1, labels))
    first = np.zeros(len(truth), bool)
    last = first.copy()
    first[read.starts], last[read.starts + read.sizes - 1] = True, True
    none = len(of_word) - 1
    used = np.concatenate(
        [of_word[read.numbers], of_word[np.where(first, none, np.roll(read.numbers, 1))] + len(features),
         of_word[np.where(last, none, np.roll(read.numbers, -1))] + 2 * len(features)], axis=1
    )
    cost = np.full((len(weights), 1), penalty)
    costs = penalty * np.array([COSTS.get(f.split()[0], 1.0) for f in features])
    cost[: 3 * len(features), 0] = np.tile(costs, 3)
    entries = np.argsort(used, axis=None, kind="stable")  # uses of a feature side by side
    held, heads = np.unique(used.ravel()[entries], return_index=True)
    by_feature = entries // used.shape[1], held, heads
    seen, moment, square = np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(weights)
    np.add.at(seen, (used, truth[:, None]), 1)
    moves, firsts = slice(3 * len(features), -1), -1
    follows = np.flatnonzero(~first)
    np.add.at(seen[moves], (truth[follows - 1], truth[follows]), 1)
    np.add.at(seen[firsts], truth[read.starts], 1)
    for step in range(1, rounds + 1 if len(truth) else 1):
        _, expected = _expectation(weights, used, by_feature, moves, read)
        slope = seen - expected - cost * weights
        moment = 0.9 * moment + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        weights += rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    n = len(features)
    return Field(features, weights[:n], weights[n : 2 * n], weights[2 * n : 3 * n], weights[moves], weights[firsts])


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(values - top).sum(axis=axis))


def _expectation(
    weights: np.ndarray, used: np.ndarray, by_feature: tuple, moves: slice, read: Sentences
) -> tuple[float, np.ndarray]:
    """Sum of the sentences' log partition functions, and its gradient by the weights: expected feature counts.

    ``by_feature`` are the words of all uses, feature by feature, the features, and where the uses of each begin.
    """
    own = weights[used].sum(axis=1)
    move = weights[moves] + _BANNED
    order = np.argsort(-read.sizes, kind="stable")
    starts, sizes = read.starts[order], read.sizes[order]
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # sentences longer than t
    forward, backward = np.zeros_like(own), np.zeros_like(own)
    forward[starts] = own[starts] + weights[-1] + _BANNED_FIRST
    for t in range(1, len(active)):
        at = starts[: active[t]] + t
        forward[at] = own[at] + _log_sum(forward[at - 1][:, :, None] + move, 1)
    for t in range(len(active) - 1, 0, -1):
        at = starts[: active[t]] + t
        backward[at - 1] = _log_sum(move + (own + backward)[at][:, None, :], 2)
    norms = _log_sum(forward[starts + sizes - 1], 1)
    norm = np.empty(len(own))
    norm[gather(starts, sizes)] = np.repeat(norms, sizes)
    marginal = np.exp(forward + backward - norm[:, None])
    later = np.ones(len(own), bool)
    later[starts] = False
    at = np.flatnonzero(later)
    expected = np.zeros_like(weights)
    pairs = forward[at - 1][:, :, None] + move + (own + backward)[at][:, None, :] - norm[at][:, None, None]
    expected[moves] = np.exp(pairs).sum(axis=0)
    expected[-1] = marginal[starts].sum(axis=0)
    users, held, heads = by_feature
    expected[held] += np.add.reduceat(marginal[users], heads, axis=0)
    return float(norms.sum()), expected


# -------------------------------------------------------------------- operator

_SPOKEN = re.compile(
    r"[A-Za-z0-9._%+-]+(?:@| ?[(\[](?:at|@)[)\]] ?| at )[A-Za-z0-9-]+(?:(?:\.| ?[(\[](?:dot|\.)[)\]] ?| dot )[A-Za-z0-9-]+)+"
)
_NUMBER = re.compile(r"\+?\(?[0-9][ ().0-9-]*[0-9]")
_VALID = {"email": lambda t: _SPOKEN.fullmatch(t) is not None, "ip": is_ip, "card": is_card,
          "phone": lambda t: _NUMBER.fullmatch(t) is not None and 7 <= len(digits_of(t)) <= 15}


def tagged_spans(field: Field, data: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
    """Spans that the field finds, by text: kind, begin and end in bytes from the text's begin, outer marks cut off."""
    read = read_sentences(data, bounds)
    if not len(read.numbers):
        return {}
    which, scores = field.word_classes(read.words)
    labels = viterbi(field, scores, which[read.numbers], read.starts, read.sizes)
    found: dict[int, list[tuple[str, int, int]]] = {}
    inside = np.flatnonzero(labels)
    for at in inside[LABELS_BEGIN[labels[inside]]].tolist():
        end = at + 1
        while end < len(labels) and labels[end] == labels[at] + 1 and read.rows[end] == read.rows[at]:
            end += 1
        low, high = int(read.begins[at]), int(read.ends[end - 1])
        span = data[low:high].tobytes()
        kind = LABELS[labels[at]][2:]
        cut = span.rstrip(_CLOSE.encode()) + (b")" if span.rstrip(b".,;:!?")[-1:] == b")" and b"(" in span[1:] else b"")
        opened = len(cut) - len(cut.lstrip(_OPEN.encode() if kind != "phone" else b"\"'[{<"))
        row = int(read.rows[at])
        low -= int(bounds[row])
        found.setdefault(row, []).append((kind, low + opened, low + len(cut)))
    return found


LABELS_BEGIN = np.array([label[0] == "B" for label in LABELS])


def find_private(df: DataFrame, field: Field, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Append ``base``, ``added``: arrays of structs of kind, start and end (code points, end exclusive), by start, then kind.

    ``base`` are the spans of the fixed patterns, ``added`` those of the field that touch none of them. NULL and empty texts have
    none. Every row stands for itself, whatever its id. Columns named like the added ones are replaced; ``drop`` names
    columns not carried on.
    """
    span = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])
    added = StructType([StructField("base", ArrayType(span)), StructField("added", ArrayType(span))])
    gone = {*added.fieldNames(), *drop}
    whole = unused(df, "_text")

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data, bounds = text_bytes(batch.column(whole))
        tagged = tagged_spans(field, data, bounds)
        base, more = [], []
        for row, value in enumerate(batch.column(whole).to_pylist()):
            fixed = base_spans(value)
            extra = []
            if row in tagged:
                place = code_points(data[bounds[row] : bounds[row + 1]])
                for kind, low, high in tagged[row]:
                    start, end = int(place[low]), int(place[high])
                    if _VALID[kind](value[start:end]) and not any(b[1] < end and start < b[2] for b in fixed):
                        extra.append((kind, start, end))
            base.append(fixed)
            more.append(sorted(extra, key=in_order))
        return {"base": _structs(base), "added": _structs(more)}

    rest = df.select(*[c for c in df.columns if c not in gone], whole_text(text).alias(whole))
    return map_batches(rest, whole, work, added, drop=(whole,))


def _structs(rows: list[list[Span]]) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in row] for row in rows], kind)
