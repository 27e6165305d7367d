"""Toxicity of texts by a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

**Kernel.** Two words are alike by the subsequences of ``ORDER`` letters they share, each weighted by
``DECAY`` for every place it spans, so letters put in between or left out lower the likeness but do not end it.
The kernel is normalised and raised to ``POWER``. Case, accents and look-alike signs are folded first, and
letters written apart by spaces or signs are joined. Words are also compared by their beginnings, and those longer than ``LONGEST`` by overlapping windows.

**Training.** Documents with labels give sentences, and sentences words. Landmarks are the words and beginnings of words whose presence
tells toxic from clean documents best (signed root of the chi-square statistic, counted in Spark). A text is as like a landmark
as its most alike word; Nyström's map turns these likenesses into coordinates, in which a linear support vector
machine (squared hinge loss, damped Newton steps) is trained; a logistic curve fitted to its margins gives the score.

At most ``max_labelled`` documents are used for training, in the order of the hash of their id; this bounds what the
driver holds (``max_labelled`` x ``landmarks`` numbers). Scoring is one pass over all whole texts, without a shuffle.

NULL and empty texts have no words: the score of likeness zero. Labels that are NULL, or whose document is not
there, train nothing. Without any toxic or clean label every score is the share of toxic ones (0 if none).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from groupstats.llm.batches import map_batches, resident, whole_text

ORDER = 3
DECAY = 0.7
POWER = 4
LONGEST = 24
#: Letters of a word's beginnings that are compared too: insults often carry endings.
BEGINNINGS = (5, 7)
#: Kernel values that are not worked out exactly but count as zero.
FAINT = 0.02
#: Words looked at for landmarks, and the kernel value from which two are not both taken.
CANDIDATES, TOO_ALIKE = 400, 0.6
#: Words a worker remembers the likenesses of before it starts afresh.
REMEMBERED = 200_000
#: Pairs of a part and a landmark whose kernel values are worked out together.
STEP_PAIRS = 1 << 14

#: Signs read as letters (fixed values).
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}

_apart = re.compile(r"(?<!\S)(?:[^\W\d_][\s.\-_*]+){2,}[^\W\d_](?![^\s.,;:!?])").findall


def fold(word: str) -> str:
    """Lower-case letters of a word; look-alike signs inside it count, other signs go."""
    if word.isalpha() and word.isascii():
        return word
    if word[:-1].isalpha() and word.isascii():
        return word[:-1]
    letters = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    inner = letters.strip("!|.,;:?\"'()[]{}<>*#%&$-_/\\")
    if any(c.isalpha() for c in inner):
        inner = "".join(LOOK_ALIKES.get(c, c) for c in inner)
    return "".join(c for c in inner if c.isalpha())


def words_of(text: str) -> set[str]:
    """The distinct words of a text, in lower case, letters written apart joined to one."""
    low = text.lower()
    words = set(low.split())
    if any(len(w) == 1 and w.isalpha() for w in words):
        for joined in _apart(low):
            words.add("".join(c for c in joined if c.isalpha()))
    return words


def parts_of(word: str) -> list[str]:
    """The strings of letters a word is compared by: itself (long words in overlapping windows), and its beginnings."""
    if len(word) <= LONGEST:
        parts = [word]
    else:
        step = LONGEST // 2
        parts = [word[i : i + LONGEST] for i in range(0, len(word) - step, step)]
    return parts + [word[:n] for n in BEGINNINGS if n < len(word)]


# -------------------------------------------------------------------- kernel


def subsequence_kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Gap-weighted kernel of every row of letters ``s`` with the same row of ``t`` (or its only row)."""
    n, m = s.shape[1], t.shape[1]
    decay = np.float32(DECAY)
    rows = max(len(s), len(t))
    # below[k][j]: subsequences of the order so far in s[:i] and t[:j], weighted to the ends of both
    below = [np.ones((m + 1, rows), np.float32)] + [np.zeros((m + 1, rows), np.float32) for _ in range(ORDER - 1)]
    total = np.zeros(rows, np.float32)
    square = decay * decay
    part = np.empty(rows, np.float32)
    for i in range(n):
        meets = [(s[:, i] == t[:, j]) * square for j in range(m)]
        for j in range(m):
            total += np.multiply(meets[j], below[ORDER - 1][j], out=part)
        for k in range(ORDER - 1, 0, -1):
            run = np.zeros(rows, np.float32)
            for j in range(m):
                run *= decay
                run += np.multiply(meets[j], below[k - 1][j], out=part)
                below[k][j + 1] *= decay
                below[k][j + 1] += run
    return total


def letters(words: list[str]) -> np.ndarray:
    """Letters of words of the same length as numbers."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _pairs(rows: np.ndarray, reach: int) -> np.ndarray:
    """Which hashed pairs of letters, up to ``reach`` apart, each row has: 64 bits."""
    out = np.zeros(len(rows), np.uint64)
    for gap in range(1, reach + 1):
        for i in range(rows.shape[1] - gap):
            cell = (rows[:, i] * np.uint32(31) + rows[:, i + gap]) * np.uint32(2654435761) >> np.uint32(26)
            out |= np.uint64(1) << cell.astype(np.uint64)
    return out


class Likeness:
    """Kernel values of words with the landmarks, remembered by word."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.rows = [letters([w]) for w in landmarks]
        self.own = np.array([subsequence_kernel(r, r)[0] for r in self.rows], np.float32)
        self.pairs = np.array([_pairs(r, 1)[0] for r in self.rows], np.uint64)
        lengths = np.array([len(w) for w in landmarks], np.int64)
        self.by_size = [
            (marks := np.flatnonzero(lengths == size), np.concatenate([self.rows[j] for j in marks]))
            for size in np.unique(lengths)
        ]
        self.need = -(-2 * np.bitwise_count(self.pairs).astype(np.int64) // 3)
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        self.part_code: dict[str, int] = {}
        self.values = np.zeros((1024, len(self.landmarks)), np.float32)
        self.part_values = np.zeros((1024, len(self.landmarks)), np.float32)

    def _learn(self, raw: list[str]) -> None:
        """Kernel values of new words: the greatest over their parts."""
        first = len(self.code)
        owners: list[int] = []
        parts: list[int] = []
        new: list[str] = []
        known = self.part_code
        for k, w in enumerate(raw):
            self.code[w] = first + k
            for part in parts_of(fold(w)):
                if len(part) >= ORDER:
                    code = known.get(part)
                    if code is None:
                        code = known[part] = len(known)
                        new.append(part)
                    owners.append(first + k)
                    parts.append(code)
        while len(self.values) < len(self.code):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while len(self.part_values) < len(known):
            self.part_values = np.concatenate([self.part_values, np.zeros_like(self.part_values)])
        self._compare(new, len(known) - len(new))
        if owners:
            owner = np.array(owners)
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            self.values[owner[starts]] = np.maximum.reduceat(self.part_values[parts], starts, axis=0)

    def _compare(self, new: list[str], first: int) -> None:
        """Kernel values of new parts. One without two thirds of a landmark's neighbouring letters (next to each
        other, or with one letter between), or that cannot reach ``FAINT``, counts as unlike it."""
        sizes = np.array([len(p) for p in new])
        for size in np.unique(sizes):
            where = np.flatnonzero(sizes == size)
            rows = letters([new[k] for k in where])
            pairs = _pairs(rows, 2)
            own = np.zeros(len(rows), np.float32)
            for marks, stacked in self.by_size:
                found = [np.flatnonzero(np.bitwise_count(pairs & self.pairs[j]) >= self.need[j]) for j in marks]
                near_all = np.concatenate(found)
                mark_all = np.repeat(np.arange(len(marks)), [len(f) for f in found])
                for lo in range(0, len(near_all), STEP_PAIRS):
                    near, mark = near_all[lo : lo + STEP_PAIRS], mark_all[lo : lo + STEP_PAIRS]
                    value = subsequence_kernel(rows[near], stacked[mark])
                    # a part's own value is at least that of its runs of ORDER letters
                    most = value / np.sqrt((size - ORDER + 1) * DECAY ** (2 * ORDER) * self.own[marks[mark]])
                    strong = most**POWER >= FAINT
                    near, mark, value = near[strong], marks[mark[strong]], value[strong]
                    fresh = np.unique(near[own[near] == 0])
                    if len(fresh):
                        own[fresh] = subsequence_kernel(rows[fresh], rows[fresh])
                    self.part_values[first + where[near], mark] = (value / np.sqrt(own[near] * self.own[mark])) ** POWER

    def of(self, texts: list[str]) -> np.ndarray:
        """For each text and landmark the value of the most alike word."""
        if len(self.code) > REMEMBERED or len(self.part_code) > REMEMBERED:
            self._clear()
        found = [words_of(t) for t in texts]
        new = set().union(*found).difference(self.code) if found else set()
        if new:
            self._learn(sorted(new))
        out = np.zeros((len(texts), len(self.landmarks)), np.float32)
        code = self.code
        for k, words in enumerate(found):
            if words:
                out[k] = self.values[[code[w] for w in words]].max(axis=0)
        return out


def likeness(landmarks: tuple[str, ...]) -> Likeness:
    return resident(("likeness", landmarks), lambda: Likeness(list(landmarks)))


# ------------------------------------------------------------------ training


@dataclass(frozen=True)
class ToxicityModel:
    """Landmarks, weights on the likenesses to them (Nyström's map included), bias and logistic curve."""

    landmarks: tuple[str, ...]
    weights: np.ndarray
    bias: float
    slope: float
    level: float

    def score(self, values: np.ndarray) -> np.ndarray:
        margin = values @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.level, -30, 30)))


def spread_landmarks(words: list[str], most: int) -> tuple[str, ...]:
    """The first words of a list that are not too like one already taken."""
    taken: list[str] = []
    rows: list[np.ndarray] = []
    own: list[float] = []
    for word in words:
        row = letters([word])
        norm = float(subsequence_kernel(row, row)[0])
        alike = [float(subsequence_kernel(row, r)[0]) / np.sqrt(norm * o) for r, o in zip(rows, own)]
        if max(alike, default=0.0) < TOO_ALIKE:
            taken.append(word)
            rows.append(row)
            own.append(norm)
        if len(taken) == most:
            break
    return tuple(taken)


def nystrom_map(landmarks: list[str]) -> np.ndarray:
    """The inverse root of the kernel matrix of the landmarks."""
    n = len(landmarks)
    rows = [letters([w]) for w in landmarks]
    kernel = np.eye(n)
    own = [float(subsequence_kernel(r, r)[0]) for r in rows]
    for i in range(n):
        for j in range(i):
            value = float(subsequence_kernel(rows[i], rows[j])[0]) / np.sqrt(own[i] * own[j])
            kernel[i, j] = kernel[j, i] = value**POWER
    values, vectors = np.linalg.eigh(kernel)
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T


def train_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, classes weighted to equal shares; y is 1 or -1."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    ridge = np.full(x1.shape[1], 1.0)
    ridge[-1] = 1e-6
    w = np.zeros(x1.shape[1])

    def loss(w: np.ndarray) -> float:
        gap = np.maximum(0, 1 - y * (x1 @ w))
        return 0.5 * (ridge * w * w).sum() + penalty * (weight * gap * gap).sum()

    value = loss(w)
    for _ in range(steps):
        inside = y * (x1 @ w) < 1
        xi, yi, ci = x1[inside], y[inside], weight[inside]
        gradient = ridge * w + 2 * penalty * xi.T @ (ci * (xi @ w - yi))
        hessian = np.diag(ridge) + 2 * penalty * (xi.T * ci) @ xi
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-6 and loss(w - size * step) > value:
            size /= 2
        w = w - size * step
        new = loss(w)
        if value - new < 1e-9 * max(value, 1):
            break
        value = new
    return w[:-1], float(w[-1])


def fit_logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and level of the logistic curve that explains labels by margins (Newton steps, light ridge)."""
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    target = (y > 0).astype(float)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + 1e-3 * w
        hessian = (x.T * np.maximum(p * (1 - p), 1e-9)) @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train: Callable[[str], Column],
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    landmarks: int = 32,
    max_labelled: int = 10_000,
    least_count: int = 5,
) -> ToxicityModel:
    """Fit the model on labelled documents for whose id ``train`` holds; runs jobs."""
    known = (
        labels.filter(F.col(label).isin(0, 1) & train(id_column))
        .groupBy(id_column).agg(F.max(label).alias("_y"))
        .orderBy(F.xxhash64(id_column), id_column).limit(max_labelled)
    )
    spark = docs.sparkSession
    known = spark.createDataFrame(known.toArrow(), known.schema)  # at most max_labelled ids
    rows = docs.select(id_column, whole_text(text).alias("_text")).join(F.broadcast(known), id_column).select("_text", "_y")

    def spell(part: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [sorted({f for w in words_of(t) for f in parts_of(fold(w)) if len(f) > ORDER}) for t in part.column("_text").to_pylist()]
        return {"words": pa.array(found, pa.list_(pa.string()))}

    spelled = map_batches(rows, "_text", spell, StructType([StructField("words", ArrayType(StringType()))]), drop=("_text",))
    totals = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        share = 1.0 if bad else 0.0
        return ToxicityModel((), np.zeros(0), 0.0, 0.0, 30.0 if share else -30.0)
    counts = spelled.select("_y", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("_y").alias("a"), F.count(F.lit(1)).alias("n")
    ).filter(F.col("n") >= least_count)
    share = bad / (bad + good)
    lift = (F.col("a") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    best = counts.orderBy(F.desc(lift), "word").limit(CANDIDATES).collect()
    marks = spread_landmarks([r["word"] for r in best], landmarks)
    if not marks:
        return ToxicityModel((), np.zeros(0), 0.0, 0.0, float(np.log(share / (1 - share))))
    table = with_likeness(rows, "_text", marks).select("_y", "likeness").toArrow()
    y = np.where(table["_y"].to_numpy() > 0, 1.0, -1.0)
    values = np.array(table["likeness"].to_pylist(), np.float64)
    to_map = nystrom_map(list(marks))
    w, bias = train_svm(values @ to_map, y)
    weights = to_map @ w
    slope, level = fit_logistic(values @ weights + bias, y)
    return ToxicityModel(marks, weights, bias, slope, level)


def with_likeness(df: DataFrame, text: str, landmarks: tuple[str, ...]) -> DataFrame:
    """Replace the text by ``likeness``, its values with the landmarks."""

    def work(part: pa.RecordBatch) -> dict[str, pa.Array]:
        values = likeness(landmarks).of(part.column(text).to_pylist())
        return {"likeness": pa.array(list(values), pa.list_(pa.float32()))}

    return map_batches(df, text, work, StructType([StructField("likeness", ArrayType(FloatType()))]), drop=(text,), tables=True)


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``score`` (0 to 1) of the whole text; ``keep`` lists the columns to carry along (all by default)."""
    keep = df.columns if keep is None else keep
    rows = df.select(*[c for c in keep if c not in ("score", "_text")], whole_text(text).alias("_text"))

    def work(part: pa.RecordBatch) -> dict[str, pa.Array]:
        values = likeness(model.landmarks).of(part.column("_text").to_pylist())
        return {"score": pa.array(model.score(values.astype(np.float64)))}

    added = StructType.fromDDL("score double")
    return map_batches(rows, "_text", work, added, drop=("_text",), tables=True)
