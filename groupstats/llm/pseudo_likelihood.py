"""Masked pseudo-likelihood of documents under a bidirectional window network.

**Words** are white-space runs, A-Z in lower case, told apart by 64-bit identifiers. A table of all of them with their
counts is made in Spark and grows with the corpus. A word with at least ``own_floor`` occurrences (they grow more slowly than
the corpus, so such words become more) has a leaf, an input vector and a path of its own. Rarer words have
one leaf for each class of word endings, and of its probability the share of their exact count.

**Network.** For every place the vectors of the ``REACH`` words on either side, scaled by factors of their distance, add
up to a hidden layer (tanh). From it every inner node of a binary tree over the leaves (Huffman's, by counts) tells the probability
of going right; a leaf's probability is the product along its path, so those of all words add up to 1. The word
itself is never an input: it is masked and predicted from both sides. Untrained, the network is the unigram model.

**Training** covers every token of every document once. In each of ``ROUNDS`` rounds every task starts from the same
parameters and takes its own gradient steps (numpy, adaptive step sizes, of touched rows only) over the tokens of the round's
share of documents. The rows of parameters that tasks touched are shuffled by blocks of rows and averaged, weighted by how
often a task met the row. One set of parameters reaches the driver: 136 bytes for a word with a leaf of its own.

**Score.** The summed log-probabilities of a document's tokens, and their mean. NULL, empty and blank texts have no
tokens: sum and mean 0. Every row is scored by itself; rows that repeat are trained on as often as they are there.
The counts of rare words meet the documents by a join, which no word can make uneven as each has few occurrences.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from groupstats.llm.batches import gather, lists, map_batches, release, slices, text_bytes, unused, whole_text, word_slices
from groupstats.llm.hashing import xxh64
from groupstats.session import stored

#: Classes of the endings of rare words: the low bits of a word's identifier.
ENDINGS = 256
HIDDEN = 16
REACH = 2
ROUNDS = 2
STEP_TOKENS = 8192
RATE = 0.1
#: Tokens that a task counts at once, and fewest tokens of a training task, in all and for each leaf.
COUNTED_TOKENS = 1 << 21
TASK_TOKENS = 1 << 21
LEAF_TOKENS = 64
#: Rows of parameters that are averaged together.
BLOCK_ROWS = 4096

_OFFSETS = [o for o in range(-REACH, REACH + 1) if o]


def own_floor(total: int) -> int:
    """Occurrences from which a word has a leaf of its own, in a corpus of ``total`` tokens."""
    return max(5, math.isqrt(total) // 100)


@dataclass(frozen=True)
class Vocabulary:
    """Identifiers of the words with leaves of their own, in order; their leaves come first, then those of ``ENDINGS``.

    The path of leaf ``k`` is ``nodes[starts[k] : starts[k] + depths[k]]``, going right where ``right``. ``tilt`` is the log-odds of
    going right at a node by counts. Leaves in order of ``ranks`` go from deep to shallow, and their nodes on a level from
    left to right. ``log_rare`` is the log of the smoothed counts of the rare words of an ending.
    """

    total: int
    floor: int
    words: np.ndarray
    log_rare: np.ndarray
    nodes: np.ndarray
    right: np.ndarray
    starts: np.ndarray
    depths: np.ndarray
    tilt: np.ndarray
    ranks: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.words) + ENDINGS

    @cached_property
    def _by_high_bits(self) -> tuple[int, np.ndarray, int]:
        """How far a word is shifted to its high bits, the first leaf of each value of them, and the most leaves of one."""
        bits = len(self.words).bit_length() + 2
        n = np.bincount((self.words >> np.int64(64 - bits)) + (1 << bits - 1), minlength=1 << bits)
        return 64 - bits, (np.cumsum(n) - n).astype(np.int32), int(n.max())

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' leaves, and which words are rare."""
        shift, firsts, most = self._by_high_bits
        known = np.append(self.words, np.iinfo(np.int64).max)
        if most > 32:
            leaf = np.searchsorted(self.words, words).astype(np.int32)
        else:  # as hashes are even, few words share their high bits
            leaf = firsts.take((words >> np.int64(shift)) + len(firsts) // 2)
            for _ in range(most):
                leaf += known.take(leaf) < words
        rare = known.take(leaf) != words
        rare |= leaf == len(self.words)
        leaf[rare] = len(self.words) + (words[rare] & (ENDINGS - 1))
        return leaf, rare


def identifiers(plain: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """56 bits of the words' hashes, then the class of their last three bytes."""
    last = [plain[np.maximum(end - k, begin)] for k in (1, 2, 3)]
    ending = last[0] + last[1] * np.uint8(7) + last[2] * np.uint8(31)
    return ((xxh64(plain, begin, end - begin) & ~np.uint64(ENDINGS - 1)) | ending).view(np.int64)


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Every word of the texts (``word``, its identifier) with its occurrences ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "_text"):
                plain, begin, end, _ = word_slices(*text_bytes(part.column("_text")))
                held.append(identifiers(plain, begin, end))
                size += len(begin)
                if size >= COUNTED_TOKENS:
                    yield _counted(held)
                    held, size = [], 0
        if size:
            yield _counted(held)

    made = df.select(whole_text(text).alias("_text")).mapInArrow(run, "word long, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    words, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], ["word", "n"])


def count_vocabulary(counts: DataFrame) -> Vocabulary:
    """Leaves and tree from the table of all words; words with leaves of their own come back, the others by their endings."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    floor = own_floor(total)
    own = counts.filter(F.col("n") >= floor).toArrow()
    order = np.argsort(own["word"].to_numpy())
    words = own["word"].to_numpy()[order]
    rare = counts.filter(F.col("n") < floor).groupBy(F.col("word").bitwiseAND(F.lit(ENDINGS - 1)).alias("ending"))
    sums = np.full(ENDINGS, 0.5)
    for row in rare.agg(F.sum(F.col("n") + 0.5).alias("weight")).collect():
        sums[row["ending"]] = row["weight"]
    weights = np.concatenate([own["n"].to_numpy()[order].astype(np.float64), sums])
    return Vocabulary(total, floor, words, np.log(sums), *_tree(weights))


def _tree(weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Paths from the root to every leaf, the log-odds of going right by weight, and ranks of leaves.

    Leaves are as deep as in Huffman's tree and stand in order of depth, so leaves side by side share their upper nodes.
    """
    n = len(weights)
    heap = list(zip(weights.tolist(), range(n)))
    heapq.heapify(heap)
    above = np.zeros(2 * n - 1, np.int64)
    for node in range(n, 2 * n - 1):
        left, right = heapq.heappop(heap), heapq.heappop(heap)
        above[[left[1], right[1]]] = node
        heapq.heappush(heap, (left[0] + right[0], node))
    depths = np.zeros(2 * n - 1, np.int32)
    for node in range(2 * n - 3, -1, -1):
        depths[node] = depths[above[node]] + 1
    depths = depths[:n]
    ranks = np.empty(n, np.int32)
    ranks[np.argsort(-depths, kind="stable")] = np.arange(n)
    total = np.concatenate([weights, np.zeros(n - 1)])
    side, tilt, first = np.zeros(2 * n - 1, bool), np.zeros(n - 1), n - 1
    below = np.zeros(0, np.int64)
    for depth in range(int(depths.max()), 0, -1):  # nodes from below come first, being the deeper ones
        pairs = np.concatenate([below, np.flatnonzero(depths == depth)]).reshape(-1, 2)
        first -= len(pairs)
        below = n + first + np.arange(len(pairs))
        above[pairs], side[pairs[:, 1]] = below[:, None], True
        total[below] = total[pairs].sum(axis=1)
        tilt[below - n] = np.log(total[pairs[:, 1]] / total[pairs[:, 0]])
    starts = np.cumsum(depths, dtype=np.int64) - depths
    nodes, right = np.zeros(int(depths.sum()), np.int32), np.zeros(int(depths.sum()), bool)
    leaf, at = np.arange(n), np.arange(n)
    for step in range(1, int(depths.max()) + 1):
        place = starts[leaf] + depths[leaf] - step
        nodes[place], right[place] = above[at] - n, side[at]
        more = depths[leaf] > step
        leaf, at = leaf[more], above[at][more]
    return nodes, right, starts, depths, tilt.astype(np.float32), ranks


class WindowNetwork:
    """Parameters as rows of one array, with forward and backward passes over a stream of leaves.

    Rows: input vectors of the leaves and of the blank, nodes of the tree (their last number is the bias), factors
    of the distances, and the bias of the hidden layer.
    """

    def __init__(self, vocabulary: Vocabulary, table: np.ndarray | None = None):
        self.vocabulary = vocabulary
        inputs, nodes = vocabulary.leaves + 1, vocabulary.leaves - 1
        if table is None:
            table = np.zeros((inputs + nodes + len(_OFFSETS) + 1, HIDDEN + 1), np.float32)
            draw = np.random.default_rng(7)
            table[:inputs, :HIDDEN] = draw.normal(0, 0.5, (inputs, HIDDEN))
            table[inputs : inputs + nodes, HIDDEN] = vocabulary.tilt
            table[inputs + nodes : -1, :HIDDEN] = draw.choice([-1.0, 1.0], (len(_OFFSETS), HIDDEN))
        self.table = table.copy()
        self.slopes = np.ones(table.shape, np.float32)
        self.visits = np.zeros(len(table), np.int64)
        self.first_node, self.first_factor = inputs, inputs + nodes

    def _hidden(self, stream: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of the places' windows, the hidden layer from the first place on, and the places in it.

        The layer has a line for each of its numbers, so that work on all places runs along the lines.
        """
        base = int(places[0]) - REACH
        vectors = np.ascontiguousarray(self.table.take(stream[base : int(places[-1]) + REACH + 1], axis=0)[:, :HIDDEN])
        lines = np.ascontiguousarray(vectors.T)
        inner = len(vectors) - 2 * REACH
        total = np.repeat(self.table[-1, :HIDDEN, None], inner, axis=1)
        for k, offset in enumerate(_OFFSETS):
            total += lines[:, REACH + offset :][:, :inner] * self.table[self.first_factor + k, :HIDDEN, None]
        return vectors, np.tanh(total, out=total), places - (base + REACH)

    def _descend(self, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Step by step down the paths, deepest leaves first: rows of the nodes, where the places of each begin and
        how many they are, and the sides that the places go to.
        """
        # equal leaves stand side by side, and so do equal nodes; none of these stands on two levels
        begin = np.concatenate([[0], np.flatnonzero(leaf[1:] != leaf[:-1]) + 1, [len(leaf)]])
        number = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        leaf = leaf.take(begin[:-1])
        depths = self.vocabulary.depths.take(leaf).astype(np.int64)
        count = np.searchsorted(-depths, -np.arange(int(depths[0])), side="left")
        leaves = gather(np.zeros_like(count), count)  # of the first level, then of the second, and so on
        at = self.vocabulary.starts.take(leaf).take(leaves) + np.repeat(np.arange(len(count)), count)
        nodes, sides = self.vocabulary.nodes.take(at), self.vocabulary.right.take(at)
        first = np.concatenate([[0], np.flatnonzero(nodes[1:] != nodes[:-1]) + 1])
        rows = nodes.take(first) + self.first_node
        sizes = np.add.reduceat(np.diff(begin).take(leaves), first)
        level = np.concatenate([[0], np.cumsum(count)])
        cuts = np.searchsorted(first, level).tolist()
        first = begin.take(leaves.take(first))
        for step, n in enumerate(count.tolist()):
            some = slice(cuts[step], cuts[step + 1])
            right = sides[level[step] : level[step + 1]].take(number[: begin[n]])
            yield rows[some], first[some], sizes[some], right

    def log_probabilities(self, stream: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Log-probabilities of the leaves at ``places``."""
        out = np.empty(len(places))
        for at in range(0, len(places), STEP_TOKENS):
            some = places[at : at + STEP_TOKENS]
            leaf = stream[some]
            order = np.argsort(self.vocabulary.ranks.take(leaf))
            _, layer, inside = self._hidden(stream, some)
            sums = np.zeros(len(some))
            hidden = np.ascontiguousarray(layer.T).take(inside.take(order), axis=0)
            for rows, _, sizes, right in self._descend(leaf.take(order)):
                numbers = self.table.take(np.repeat(rows, sizes), axis=0)
                scores = np.einsum("ij,ij->i", numbers[:, :HIDDEN], hidden[: len(numbers)]) + numbers[:, HIDDEN]
                wrong = np.where(right, -scores, scores)
                sums[: len(wrong)] -= np.maximum(wrong, 0) + np.log1p(np.exp(-np.abs(wrong)))
            out[at + order] = sums
        return out

    def gradient(self, stream: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows met, how often, and the slopes in them of the summed negative log-probabilities at ``places``."""
        vectors, layer, inside = self._hidden(stream, places)
        leaf = stream[places]
        order = np.argsort(self.vocabulary.ranks.take(leaf))
        hidden = layer.take(inside.take(order), axis=1, mode="clip")
        deep = np.zeros((HIDDEN, len(places) + 1), hidden.dtype)  # the last column is that of blanks
        product = np.empty((HIDDEN + 1, len(places)), hidden.dtype)
        for met, first, sizes, right in self._descend(leaf.take(order)):
            n = len(right)
            numbers = np.repeat(np.ascontiguousarray(self.table.take(met, axis=0).T), sizes, axis=1)
            terms = np.multiply(numbers[:HIDDEN], hidden[:, :n], out=product[:HIDDEN, :n])
            while len(terms) > 4:  # four sums, each from its last line on
                terms[-8:-4] += terms[-4:]
                terms = terms[:-4]
            scores = (terms[0] + terms[1]) + (terms[2] + terms[3])
            scores += numbers[HIDDEN]
            error = np.subtract(1 / (1 + np.exp(-scores)), right, out=product[HIDDEN, :n])
            numbers[:HIDDEN] *= error
            deep[:, :n] += numbers[:HIDDEN]
            np.multiply(hidden[:, :n], error, out=product[:HIDDEN, :n])
            yield from _sums(product[:, :n], met, first, sizes)
        source = np.full(layer.shape[1], len(places))
        source[inside.take(order)] = np.arange(len(places))
        full = deep.take(source, axis=1, mode="clip")
        full *= 1 - layer * layer
        inner = full.shape[1]
        spread = np.zeros((HIDDEN + 1, len(vectors)), full.dtype)
        factors = np.zeros((len(_OFFSETS) + 1, HIDDEN + 1), full.dtype)
        by_place = np.ascontiguousarray(full.T)
        for k, offset in enumerate(_OFFSETS):
            spread[:HIDDEN, REACH + offset :][:, :inner] += full * self.table[self.first_factor + k, :HIDDEN, None]
            factors[k, :HIDDEN] = np.einsum("ij,ij->j", by_place, vectors[REACH + offset :][:inner])
        factors[-1, :HIDDEN] = by_place.sum(axis=0)
        base = int(places[0]) - REACH
        found, n, together, first = _grouped(stream[base : base + len(vectors)], self.first_node)
        yield from _sums(spread.take(together, axis=1, mode="clip"), found, first, n)
        yield np.arange(self.first_factor, len(self.table)), np.full(len(factors), len(places)), factors

    def train(self, stream: np.ndarray, places: np.ndarray) -> None:
        """One pass of gradient steps over the tokens at ``places``."""
        # a row as one item is written much faster than as a row of numbers
        item = np.dtype((np.void, self.table.dtype.itemsize * (HIDDEN + 1)))
        for at in range(0, len(places), STEP_TOKENS):
            # no row comes twice
            rows, n, slopes = map(np.concatenate, zip(*self.gradient(stream, places[at : at + STEP_TOKENS])))
            slopes = np.ascontiguousarray(slopes)
            self.visits[rows] += n
            squares = slopes * slopes
            squares += self.slopes.take(rows, axis=0)
            self.slopes.view(item)[rows] = squares.view(item)
            slopes /= np.sqrt(squares, out=squares)
            slopes *= -RATE
            slopes += self.table.take(rows, axis=0)
            self.table.view(item)[rows] = slopes.view(item)


def _sums(lines: np.ndarray, rows: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> Iterator[tuple]:
    """Rows, the sizes of their runs in the lines, and the runs' sums; the many runs of one are only copied."""
    one, more = np.flatnonzero(sizes == 1), np.flatnonzero(sizes > 1)
    if len(one) < len(more):
        yield rows, sizes, np.add.reduceat(lines, first, axis=1).T
        return
    yield rows.take(one), sizes.take(one), lines.take(first.take(one), axis=1, mode="clip").T
    if len(more):
        n = sizes.take(more)
        some = lines.take(gather(first.take(more), n), axis=1, mode="clip")
        yield rows.take(more), n, np.add.reduceat(some, np.cumsum(n) - n, axis=1).T


def _grouped(rows: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, how often each comes, an order with equal rows side by side, and where each begins in it."""
    n = np.bincount(rows, minlength=limit)
    found = np.flatnonzero(n)
    number = np.zeros(limit, np.uint16 if len(found) < 1 << 16 else np.int64)  # 16 bits are sorted in one pass
    number[found] = np.arange(len(found))
    n = n[found]
    return found, n, np.argsort(number.take(rows), kind="stable"), np.cumsum(n) - n


def encode(df: DataFrame, text: str, keep: list[str], vocabulary: Vocabulary, tokens: str, rare: str) -> DataFrame:
    """Replace the text by the leaves of its words, and the identifiers of the rare ones."""
    rows = df.select(*keep, whole_text(text).alias("_text"))

    def work(part: pa.RecordBatch) -> dict[str, pa.Array]:
        plain, begin, end, sizes = word_slices(*text_bytes(part.column("_text")))
        words = identifiers(plain, begin, end)
        leaf, unusual = vocabulary.find(words)
        before = np.concatenate([[0], np.cumsum(unusual)])
        ends = np.cumsum(sizes)
        return {tokens: lists(leaf, sizes), rare: lists(words[unusual], before[ends] - before[ends - sizes])}

    added = StructType([StructField(tokens, ArrayType(IntegerType())), StructField(rare, ArrayType(LongType()))])
    return map_batches(rows, "_text", work, added, drop=("_text",))


def _rows(batch: pa.RecordBatch, column: str = "_tokens") -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(column)
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def padded(leaf: np.ndarray, sizes: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of documents in a row with ``REACH`` blanks around each, and the places of the tokens."""
    places = np.arange(len(leaf)) + np.repeat(REACH * (np.arange(len(sizes)) + 1), sizes)
    stream = np.full(len(leaf) + REACH * (len(sizes) + 1), blank, np.int64)
    stream[places] = leaf
    return stream, places


def train_network(tokens: DataFrame, vocabulary: Vocabulary, share: str = "_share") -> np.ndarray:
    """Parameters after ``ROUNDS`` rounds; ``share`` numbers the rounds' documents. Runs jobs."""
    table = WindowNetwork(vocabulary).table
    tasks = max(1, vocabulary.total // max(TASK_TOKENS, LEAF_TOKENS * vocabulary.leaves))
    for number in range(ROUNDS):
        start = table

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            network = WindowNetwork(vocabulary, start)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    found, sizes = _rows(batch.slice(at, 256))
                    if len(found):
                        network.train(*padded(found, sizes, vocabulary.leaves))
            met = np.flatnonzero(network.visits)
            for block, rows in zip(*_blocks(met)):
                yield _packed(block, rows, network.visits[rows], network.table[rows])

        made = tokens.filter(F.col(share) == number).select("_tokens").coalesce(tasks).mapInArrow(run, _PARAMETERS)
        table = start.copy()
        blocks = -(-len(table) // BLOCK_ROWS)
        for row in made.repartition(blocks, "block").mapInArrow(_average, _PARAMETERS).toLocalIterator():
            values = np.frombuffer(row["numbers"], np.float32).reshape(-1, HIDDEN + 1)
            table[np.frombuffer(row["places"], np.int64)] = values
    return table


_PARAMETERS = "block int, places binary, visits binary, numbers binary"


def _blocks(rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    blocks, first = np.unique(rows // BLOCK_ROWS, return_index=True)
    return blocks, np.split(rows, first[1:]) if len(rows) else []


def _packed(block: int, rows: np.ndarray, visits: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    raw = [rows.astype(np.int64), visits.astype(np.int64), numbers.astype(np.float32)]
    arrays = [pa.array([block], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in raw)]
    return pa.RecordBatch.from_arrays(arrays, ["block", "places", "visits", "numbers"])


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: the means of its parameters, weighted by visits."""
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, *raw in zip(*(c.to_pylist() for c in batch.columns)):
            if block not in sums:
                sums[block] = np.zeros(BLOCK_ROWS, np.int64), np.zeros((BLOCK_ROWS, HIDDEN + 1))
            met, total = sums[block]
            places, visits = (np.frombuffer(x, np.int64) for x in raw[:2])
            met[places - block * BLOCK_ROWS] += visits
            numbers = np.frombuffer(raw[2], np.float32).reshape(-1, HIDDEN + 1)
            total[places - block * BLOCK_ROWS] += numbers * visits[:, None].astype(np.float64)
    for block, (met, total) in sums.items():
        some = np.flatnonzero(met)
        yield _packed(block, some + block * BLOCK_ROWS, met[some], total[some] / met[some, None])


def score_documents(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``n_tokens``, ``log_likelihood`` and ``mean_log_likelihood`` under a network trained on all rows.

    ``keep`` lists the columns to carry along (all but the text by default).
    """
    made = ["n_tokens", "log_likelihood", "mean_log_likelihood"]
    keep = [c for c in df.columns if c != text] if keep is None else keep
    keep = [c for c in keep if c not in (*made, "_text", "_tokens", "_share")]
    row, rare, likely = (unused(df, name) for name in ("_row", "_rare", "_likely"))
    counts = stored(word_counts(df, text), "words")
    vocabulary = count_vocabulary(counts)
    # the share of a document follows its text, so it stays the same when a task runs again
    shared = df.withColumn("_share", F.pmod(F.xxhash64(whole_text(text)), F.lit(ROUNDS)).cast("int"))
    numbered = shared.withColumn(row, F.monotonically_increasing_id())
    tokens = stored(encode(numbered, text, [*keep, "_share", row], vocabulary, "_tokens", rare), "tokens")
    table = train_network(tokens, vocabulary)
    rows = tokens.drop("_share", rare)
    fields = [f for f in rows.schema.fields if f.name != "_tokens"]
    schema = StructType([*fields, *StructType.fromDDL(f"n_tokens long, {likely} double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        network, own = WindowNetwork(vocabulary, table), len(vocabulary.words)
        log_share = np.concatenate([np.zeros(own), -vocabulary.log_rare])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found, sizes = _rows(part)
                each = network.log_probabilities(*padded(found, sizes, vocabulary.leaves)) + log_share[found]
                sums = np.concatenate([[0.0], np.cumsum(each)])
                ends = np.cumsum(sizes)
                values = [pa.array(sizes.astype(np.int64)), pa.array(sums[ends] - sums[ends - sizes])]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in fields], *values], schema.names)

    # a rare word's share of its leaf: the log of its count comes by the join, that of the leaf's counts is in the sum above
    places = tokens.select(row, F.explode(rare).alias("word"))
    unusual = places.join(counts.filter(F.col("n") < vocabulary.floor), "word", "left").groupBy(row)
    shares = unusual.agg(F.sum(F.log(F.coalesce("n", F.lit(0)) + 0.5)).alias("_share"))
    total = F.col(likely) + F.coalesce("_share", F.lit(0.0))
    return rows.mapInArrow(run, schema).join(shares, row, "left").select(
        *keep, "n_tokens", total.alias("log_likelihood"),
        (total / F.greatest("n_tokens", F.lit(1))).alias("mean_log_likelihood"),
    )
