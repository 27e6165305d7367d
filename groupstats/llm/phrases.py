"""Phrase collocations from depth-truncated suffix trees of words, partitioned by prefix.

Every word of a text starts a suffix, cut after ``most`` words or at the end of its piece of text. The suffixes of all texts
are partitioned vertically: word prefixes are counted, a prefix with more suffixes than a subtree may hold (``budget``)
is extended by the next word, and prefixes are taken in order until their suffixes fill a group. As groups are
ranges in the order of prefixes, only their first prefixes are kept, some ``total / budget`` of them; every task
cuts its sorted suffixes there. Equal suffixes of a task's step are counted before the shuffle, so a frequent phrase
costs a group one row per step at most.

A group's suffixes are then the leaves of a subtree of its own. Sorting them word by word numbers the nodes of each depth, and
totals of leaves, added up from depth to depth, are the frequencies of all phrases that begin there. A phrase whose
suffixes were cut into several groups lies at the edges of these groups; its parts are added afterwards.

Inside a path words are joined by the byte 0, which sorts before all bytes of words: so that suffixes of a
prefix stay together, a byte 0 in a word is kept as a line feed, which no word holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groupstats.llm.batches import slices, text_bytes, whole_text
from groupstats.session import shared_folder

#: Suffixes of a subtree.
BUDGET = 1 << 20
#: Text bytes whose suffixes are counted together before the shuffle.
STEP_BYTES = 4 << 20
JOINT = b"\0"
#: Bytes that end a piece of text, besides line breaks (fixed values).
STOPS = b".,;:!?\n\x0b\x0c\r"

Path = tuple[str, bytes]


def split_pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of the texts ``data[bounds[k] : bounds[k + 1]]``, A-Z in lower case; the text of each; is the next word
    in the same piece."""
    stop = np.isin(data, np.frombuffer(STOPS, np.uint8))
    inside = ~(stop | (data == 32) | (data == 9))
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cuts = bounds[:-1][np.diff(bounds) > 0]
    starts[cuts] = inside[cuts]
    at = np.flatnonzero(starts)
    place = np.cumsum(inside)
    offsets = np.append(place[at] - 1, place[-1] if len(place) else 0).astype(np.int32)
    letters = data[inside]
    letters = np.where((letters >= 65) & (letters <= 90), letters + 32, np.where(letters == 0, 10, letters)).astype(np.uint8)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(at, bounds)))
    piece = np.cumsum(stop)[at]
    linked = np.zeros(len(at), bool)
    linked[:-1] = (piece[1:] == piece[:-1]) & (rows[1:] == rows[:-1])
    return words, rows, linked


def coded(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct values in byte order, and each value's number in it."""
    made = values.dictionary_encode()
    order = pc.sort_indices(made.dictionary).to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return made.dictionary.take(pa.array(order)), number[made.indices.to_numpy()]


class Tree:
    """Suffixes as ``columns`` of word numbers (0: none) after a first column; nodes of every depth in order."""

    def __init__(self, columns: Sequence[np.ndarray]):
        self.base = int(max((c.max() for c in columns[1:] if len(c)), default=0)) + 1
        self.keys: list[np.ndarray] = []
        node = columns[0].astype(np.int64)
        self.nodes = []
        for column in columns[1:]:
            keys, node = np.unique(node * self.base + column, return_inverse=True)
            self.keys.append(keys)
            self.nodes.append(node)
        self.leaf = node

    def totals(self, leaf_totals: np.ndarray) -> list[np.ndarray]:
        """Totals of the nodes of every depth from those of the leaves."""
        totals = [leaf_totals]
        for keys, above in zip(self.keys[:0:-1], self.keys[-2::-1]):
            parent = keys // self.base
            summed = np.zeros(len(above), np.int64)
            np.add.at(summed, parent, totals[0])
            totals.insert(0, summed)
        return totals

    def words(self, depth: int, nodes: np.ndarray) -> list[np.ndarray]:
        """First column and word numbers of the given nodes of a depth (from 1)."""
        columns = []
        for keys in self.keys[depth - 1 :: -1]:
            columns.insert(0, keys[nodes] % self.base)
            nodes = keys[nodes] // self.base
        return [nodes, *columns]


class Suffixes:
    """The suffixes of a batch of texts, with the paths in ``extra`` sorted among them (as suffixes that do not count)."""

    def __init__(self, batch: pa.RecordBatch, depth: int, extra: Sequence[Path]):
        data, bounds = text_bytes(batch.column("text"))
        words, rows, linked = split_pieces(data, bounds)
        self.count = len(words)
        paths = [path.split(JOINT) for _, path in extra]
        more = pa.array([w for p in paths for w in p], pa.binary())
        self.words, ids = coded(pa.concat_arrays([words, more]))
        self.langs, langs = coded(pa.concat_arrays([batch.column("lang"), pa.array([g for g, _ in extra], pa.string())]))
        first = np.append(ids[: self.count] + 1, np.zeros(len(extra), np.int64))
        columns = [np.append(langs[: batch.num_rows][rows], langs[batch.num_rows :]), first]
        for _ in range(1, depth):
            follow = np.zeros(len(first), np.int64)
            follow[: max(self.count - 1, 0)] = np.where(linked[:-1], columns[-1][1 : self.count], 0)
            columns.append(follow)
        at = self.count
        for number, path in enumerate(paths):
            for place, _ in enumerate(path[:depth]):
                columns[place + 1][self.count + number] = ids[at + place] + 1
            at += len(path)
        self.columns = columns
        self.tree = Tree(columns)


def joined(words: pa.Array, columns: Sequence[np.ndarray]) -> pa.Array:
    """Paths of the words with these numbers (from 1) as strings."""
    parts = [words.take(pa.array(c - 1)) for c in columns]
    path = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, JOINT)
    return path.cast(pa.string())


def prefix_counts(docs: DataFrame, depth: int, parents: Sequence[Path]) -> DataFrame:
    """``(lang, path, f)``: how often each prefix of ``depth`` words occurs; beyond one word, only below ``parents``."""
    parents = list(parents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                made = Suffixes(part, depth, parents)
                tree, n = made.tree, made.count
                counts = np.bincount(tree.leaf[:n], minlength=len(tree.keys[-1]))
                good = counts > 0
                if depth > 1:
                    wanted = np.zeros(len(tree.keys[-2]), bool)
                    wanted[tree.nodes[-2][n:]] = True
                    good &= wanted[tree.keys[-1] // tree.base] & (tree.keys[-1] % tree.base > 0)
                nodes = np.flatnonzero(good)
                lang, *words = tree.words(depth, nodes)
                yield pa.RecordBatch.from_arrays(
                    [made.langs.take(pa.array(lang)), joined(made.words, words), pa.array(counts[nodes].astype(np.int64))],
                    ["lang", "path", "f"],
                )

    counted = docs.mapInArrow(run, "lang string, path string, f long")
    return counted.groupBy("lang", "path").agg(F.sum("f").alias("f"))


def group_starts(units: DataFrame, budget: int) -> list[Path]:
    """First prefixes of groups of neighbouring prefixes, each of about ``budget`` suffixes, in order.

    There are at most twice ``total / budget`` and one for every partition of the sort.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begun = 0, False
        for batch in batches:
            starts = []
            for row, f in enumerate(batch.column("f").to_pylist()):
                if not begun or held + f > budget:
                    starts.append(row)
                    held, begun = 0, True
                held += f
            yield batch.select(["lang", "path"]).take(pa.array(starts, pa.int64()))

    ordered = units.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    starts = ordered.mapInArrow(run, "lang string, path string").collect()
    return sorted((r["lang"], r["path"].encode()) for r in starts)


def deal(docs: DataFrame, depth: int, starts: Sequence[Path]) -> DataFrame:
    """``(lang, part, words, leaves, counts)``: every step's distinct suffixes and their counts, cut into groups."""
    starts = list(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                made = Suffixes(part, depth, starts)
                tree, n = made.tree, made.count
                counts = np.bincount(tree.leaf[:n], minlength=len(tree.keys[-1]))
                starting = np.zeros(len(counts), np.int64)
                np.add.at(starting, tree.leaf[n:], 1)
                group = np.cumsum(starting)
                real = np.flatnonzero(counts)
                lang, *words = tree.words(depth, real)
                group, counts = group[real], counts[real].astype(np.int64)
                edge = np.flatnonzero(np.diff(group) | np.diff(lang)) + 1
                out = []
                for low, high in zip([0, *edge], [*edge, len(real)]):
                    if low == high:
                        continue
                    local = np.stack([w[low:high] for w in words])
                    used = np.unique(local)
                    used = used[used > 0]
                    numbers = np.searchsorted(used, local) + 1
                    numbers[local == 0] = 0
                    text = pc.binary_join(pa.ListArray.from_arrays([0, len(used)], made.words.take(pa.array(used - 1))), JOINT)
                    out.append(
                        (made.langs[lang[low]].as_py(), int(group[low]), text[0].as_py(), numbers.astype(np.int32).tobytes(), counts[low:high].tobytes())
                    )
                columns = list(zip(*out)) or [[]] * 5
                kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                names = ["lang", "part", "words", "leaves", "counts"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.mapInArrow(run, "lang string, part int, words binary, leaves binary, counts binary")


def subtrees(dealt: DataFrame, depth: int, least: int) -> DataFrame:
    """``(lang, path, k, f)``: nodes of ``k`` words of every group's subtree with at least ``least`` suffixes, and those at
    its edges, which may go on in another group."""

    def grow(table: pa.Table) -> pa.Table:
        words = pc.split_pattern(table.column("words").combine_chunks(), JOINT)
        vocabulary, ids = coded(words.flatten())
        firsts = words.offsets.to_numpy()
        firsts = firsts - firsts[0]
        columns, counts = [], []
        for row, (leaves, count) in enumerate(zip(table.column("leaves"), table.column("counts"))):
            number = np.append(0, ids[firsts[row] : firsts[row + 1]] + 1)
            columns.append(number[np.frombuffer(leaves.as_py(), np.int32).reshape(depth, -1)])
            counts.append(np.frombuffer(count.as_py(), np.int64))
        words_of = np.concatenate(columns, axis=1)
        tree = Tree([np.zeros(words_of.shape[1], np.int64), *words_of])
        leaf_totals = np.zeros(len(tree.keys[-1]), np.int64)
        np.add.at(leaf_totals, tree.leaf, np.concatenate(counts))
        paths, sizes, totals = [], [], []
        edges = tree.words(depth, np.array([0, len(leaf_totals) - 1]))
        for k, total in enumerate(tree.totals(leaf_totals), 1):
            frequent = total >= least
            for edge in range(2):
                key = 0
                for d in range(k):
                    key = int(np.searchsorted(tree.keys[d], key * tree.base + edges[d + 1][edge]))
                frequent[key] = True
            nodes = np.flatnonzero(frequent & (tree.keys[k - 1] % tree.base > 0))
            paths.append(joined(vocabulary, tree.words(k, nodes)[1:]))
            sizes.append(np.full(len(nodes), k, np.int32))
            totals.append(total[nodes])
        path = pa.concat_arrays(paths)
        lang = pa.array([table.column("lang")[0].as_py()] * len(path), pa.string())
        return pa.table({"lang": lang, "path": path, "k": np.concatenate(sizes), "f": np.concatenate(totals)})

    return dealt.groupBy("lang", "part").applyInArrow(grow, "lang string, path string, k int, f long")


def phrase_counts(
    df: DataFrame, lang: str = "lang", text: str = "text", most: int = 3, least: int = 10, budget: int = BUDGET
) -> tuple[DataFrame, DataFrame]:
    """Frequencies of phrases and the number of words, by language.

    The first table is ``(lang, phrase, k, f)`` for every phrase of up to ``most`` words, space-joined, that occurs at least
    ``least`` times inside pieces of text; the second ``(lang, n)``. Both are read from the shared folder.

    Texts are split into pieces at ``.,;:!?`` and line breaks, pieces into words at spaces and tabs; A-Z count as a-z. A NULL
    text is empty, a NULL language is ``und``. Every row counts, repeated ones as well; other columns are not looked at.
    """
    spark = df.sparkSession

    def keep(made: DataFrame, name: str) -> DataFrame:
        path = shared_folder(spark, name)
        made.write.parquet(path)
        return spark.read.parquet(path)

    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), whole_text(text).alias("text"))
    counts = keep(prefix_counts(docs, 1, []), "word-counts")
    sizes = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    units = counts
    for depth in range(2, most + 1):
        # at most total / budget prefixes
        heavy = [(r["lang"], r["path"].encode()) for r in counts.filter(F.col("f") > budget).collect()]
        if not heavy:
            break
        counts = keep(prefix_counts(docs, depth, heavy), "prefix-counts")
        units = units.filter(F.col("f") <= budget).unionByName(counts)
    dealt = deal(docs, most, group_starts(units, budget))
    nodes = subtrees(dealt, most, least).groupBy("lang", "path", "k").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    phrase = F.replace(F.replace("path", F.lit("\0"), F.lit(" ")), F.lit("\n"), F.lit("\0"))
    return keep(nodes.select("lang", phrase.alias("phrase"), "k", "f"), "phrase-counts"), sizes


def words_from(phrase: Column, first: Column, size: Column) -> Column:
    """``size`` words of a phrase from the one numbered ``first`` (from 1)."""
    return F.array_join(F.slice(F.split(phrase, " "), first, size), " ")


def collocations(
    df: DataFrame,
    lang: str = "lang",
    text: str = "text",
    most: int = 3,
    least: int = 10,
    covered_percent: int = 50,
    top: int = 2000,
    budget: int = BUDGET,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of 2 to ``most`` words of each language.

    A candidate occurs ``a >= least`` times. Cut after ``k`` words, its parts occur ``l`` and ``r`` times; the cut with the least
    ``floor(1000000 * a * a / (l * r))`` counts, the shortest first part among equals. A candidate is dropped if a longer
    one that holds it occurs at least ``covered_percent`` percent as often. Ranks follow score and ``a`` downwards, then
    the phrase. Words, NULLs and repeated rows are those of :func:`phrase_counts`; no text gives no row.
    """
    nodes, sizes = phrase_counts(df, lang, text, most, least, budget)
    candidates = nodes.filter("k >= 2").withColumnRenamed("f", "a")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "*",
        words_from(F.col("phrase"), F.lit(1), F.col("cut")).alias("_left"),
        words_from(F.col("phrase"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("_right"),
    )
    parts = lambda side, f: nodes.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    cuts = cuts.join(parts("_left", "l"), ["lang", "_left"]).join(parts("_right", "r"), ["lang", "_right"])
    wide = lambda c: f"cast({c} as decimal(18, 0))"
    score = F.expr(f"(1000000bd * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})")
    best = cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("_best"))
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("k") - 1),
            lambda size: F.transform(
                F.sequence(F.lit(1), F.col("k") - size + 1), lambda first: words_from(F.col("phrase"), first, size)
            ),
        )
    )
    inner = candidates.filter("k > 2").select("lang", F.explode(spans).alias("phrase"), "a")
    covers = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = best.join(covers, ["lang", "phrase"], "left").filter(
        F.coalesce(100 * F.col("_longer") < covered_percent * F.col("a"), F.lit(True))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "_best.l", "_best.r", "_best.score").withColumn(
        "rank", F.row_number().over(order).cast("long")
    )
    return ranked.filter(F.col("rank") <= top).join(F.broadcast(sizes), "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
