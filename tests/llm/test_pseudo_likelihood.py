"""Words as their own leaves: exact counts, probabilities that add up to 1, gradients, prediction of words beyond the most frequent."""

from collections import Counter

import numpy as np
import pytest

from groupstats.llm import pseudo_likelihood
from groupstats.llm.pseudo_likelihood import WindowNetwork, count_vocabulary, padded, score_documents, word_counts


@pytest.fixture(scope="module")
def triples(spark):
    """400 documents of 100 triples of words, each of 300 words some 400 times; then 20 of the same words shuffled."""
    draw = np.random.default_rng(5)
    rows = []
    for k in range(400):
        words = [f"{c}{i}" for i in draw.integers(0, 100, 100) for c in "xyz"]
        rows.append((k, " ".join(words)))
        if k < 20:
            draw.shuffle(words)
            rows.append((1000 + k, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_counts_are_exact_and_vocabulary_follows_the_corpus(spark):
    texts = [" ".join(f"w{i % (20 * (k + 1))}" for i in range(400)) + f" Only{k}é" for k in range(12)] + [None, "", " \t"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    brute = Counter(w for t in texts if t for w in t.lower().split())
    counts = word_counts(df)
    assert sorted(r["n"] for r in counts.collect()) == sorted(brute.values())
    vocabulary = count_vocabulary(counts)
    assert len(vocabulary.words) == sum(n >= vocabulary.floor for n in brute.values()) > 100
    assert len(np.unique(vocabulary.find(vocabulary.words)[0])) == len(vocabulary.words)
    once = np.array([r["word"] for r in counts.filter("n = 1").collect()])
    leaf, rare = vocabulary.find(once)
    assert len(once) >= 12 and rare.all() and (leaf >= len(vocabulary.words)).all()


def _small(spark):
    counts = spark.createDataFrame([(k << 8 | k % 5, 3 + k % 11) for k in range(-30, 30)], "word long, n long")
    vocabulary = count_vocabulary(counts)
    network = WindowNetwork(vocabulary)
    draw = np.random.default_rng(3)
    network.table += draw.normal(0, 0.3, network.table.shape).astype(np.float32)
    sizes = np.array([7, 1, 12])
    return vocabulary, network, *padded(draw.integers(0, vocabulary.leaves, 20), sizes, vocabulary.leaves)


def test_probabilities_of_leaves_add_up_to_one(spark):
    vocabulary, network, stream, places = _small(spark)
    total = 0
    for leaf in range(vocabulary.leaves):
        other = stream.copy()
        other[places[4]] = leaf
        total += np.exp(network.log_probabilities(other, places[4:5])[0])
    assert 0 < len(vocabulary.words) < 60 and total == pytest.approx(1, abs=1e-4)


def test_gradient_is_that_of_the_log_probabilities(spark):
    _, network, stream, places = _small(spark)
    network.table = network.table.astype(np.float64)
    slopes = np.zeros(network.table.shape)
    for rows, n, some in network.gradient(stream, places):
        assert (n > 0).all()
        slopes[rows] += some
    used = np.argwhere(np.abs(slopes) > 1e-3)
    for row, column in used[np.random.default_rng(1).permutation(len(used))[:60]].tolist() + [[len(slopes) - 1, 2], [len(slopes) - 3, 5]]:
        at, ends = network.table[row, column], []
        for move in (1e-4, -1e-4):
            network.table[row, column] = at + move
            ends.append(-network.log_probabilities(stream, places).sum())
        network.table[row, column] = at
        assert (ends[0] - ends[1]) / 2e-4 == pytest.approx(slopes[row, column], rel=0.01, abs=2e-3)


def test_words_beyond_the_most_frequent_are_predicted_from_both_sides(triples):
    made = {r["doc_id"]: r["mean_log_likelihood"] for r in score_documents(triples).collect()}
    assert all(made[k] > made[1000 + k] + 4.5 for k in range(20))


def test_rare_words_share_their_leaf_by_exact_counts(spark):
    texts = ["the cat sat on the mat"] * 30 + ["1xab", "22xab", "22xab", "22xab"]
    df = spark.createDataFrame([(k, None, t) for k, t in enumerate(texts)], "doc_id long, _row long, text string").repartition(2)
    made = {r["doc_id"]: r for r in score_documents(df).collect()}
    assert len(made) == len(texts) and made[30]["_row"] is None
    assert made[31]["log_likelihood"] == pytest.approx(made[32]["log_likelihood"])
    assert made[31]["log_likelihood"] - made[30]["log_likelihood"] == pytest.approx(np.log(3.5 / 1.5))


def test_averages_are_weighted_by_visits():
    packed = pseudo_likelihood._packed
    numbers = [np.full((2, 17), 1.0), np.full((1, 17), 4.0)]
    batches = [packed(1, np.array([4096, 4100]), np.array([2, 5]), numbers[0]), packed(1, np.array([4100]), np.array([10]), numbers[1])]
    (made,) = pseudo_likelihood._average(iter(batches))
    assert np.frombuffer(made.column("places")[0].as_py(), np.int64).tolist() == [4096, 4100]
    assert np.frombuffer(made.column("numbers")[0].as_py(), np.float32).reshape(-1, 17)[:, 0].tolist() == [1, 3]


class _Counted(np.ndarray):
    """Parameters that count the rows read from them."""

    read = 0

    def take(self, indices, *args, **kwargs):
        if self.shape[1:] == (pseudo_likelihood.HIDDEN + 1,):
            _Counted.read += np.size(indices)
        return self.view(np.ndarray).take(indices, *args, **kwargs)


def test_a_step_of_training_reads_a_node_once(spark):
    counts = spark.createDataFrame([(k << 48, 5 + k * k) for k in range(-60, 60)], "word long, n long")
    vocabulary = count_vocabulary(counts)
    network = WindowNetwork(vocabulary)
    draw = np.random.default_rng(4)
    sizes = np.array([400, 1, 500])
    stream, places = padded(draw.integers(0, vocabulary.leaves, sizes.sum()), sizes, vocabulary.leaves)
    network.table, _Counted.read = network.table.view(_Counted), 0
    met = np.concatenate([rows for rows, _, _ in network.gradient(stream, places)])
    nodes = np.count_nonzero((met >= network.first_node) & (met < network.first_factor))
    assert len(np.unique(met)) == len(met) and nodes > 100
    assert _Counted.read <= nodes + len(stream)


def test_words_are_found_whatever_their_high_bits(spark):
    draw = np.random.default_rng(6)
    ends = np.iinfo(np.int64)
    for words in (draw.integers(ends.min, ends.max, 3000), np.arange(-1500, 1500), np.array([ends.min, -1, 0, ends.max]), np.zeros(0, np.int64)):
        words = np.unique(words)
        counts = spark.createDataFrame([(w, 1000) for w in words.tolist()], "word long, n long")
        vocabulary = count_vocabulary(counts)
        asked = np.concatenate([words, words + 1, draw.integers(ends.min, ends.max, 500), [ends.min, -1, 0, ends.max]])
        leaf, rare = vocabulary.find(asked)
        place = {w: k for k, w in enumerate(words.tolist())}
        assert vocabulary.words.tolist() == words.tolist()
        assert leaf.tolist() == [place.get(w, len(words) + (w & 255)) for w in asked.tolist()]
        assert rare.tolist() == [w not in place for w in asked.tolist()]


def test_sums_of_runs_of_one_and_more():
    draw = np.random.default_rng(8)
    for sizes in (np.array([1]), np.array([4]), np.array([1, 1, 3, 1]), np.array([2, 1, 5, 7]), np.ones(6, int)):
        lines, first = draw.normal(size=(17, sizes.sum())), np.cumsum(sizes) - sizes
        made = {int(r): (int(n), x) for rows, ns, xs in pseudo_likelihood._sums(lines, 10 + np.arange(len(sizes)), first, sizes) for r, n, x in zip(rows, ns, xs)}
        assert sorted(made) == list(range(10, 10 + len(sizes)))
        for k, (a, n) in enumerate(zip(first, sizes)):
            assert made[10 + k][0] == n and made[10 + k][1] == pytest.approx(lines[:, a : a + n].sum(axis=1))
