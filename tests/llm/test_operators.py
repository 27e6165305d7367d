"""The text operators against brute force and the tokenizer libraries, on small and odd inputs."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from groupstats.llm import packing, simhash, topk, toxicity
from groupstats.llm.components import components
from groupstats.llm.dom import describe, parse, plain
from groupstats.llm.hashing import xxh64
from groupstats.llm.order_minhash import compare_with_edits
from groupstats.llm.piece_model import Normalizer, _fields, read_char_map
from groupstats.llm.pseudo_likelihood import score_documents
from groupstats.llm.repeats import remove_repeats
from groupstats.llm.sentence_pieces import encode_pieces
from groupstats.llm.token_counts import count_tokens
from groupstats.llm.topk import top_k
from groupstats.llm.wrappers import extract, match_trees

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")

TEXTS = [
    None, "", " ", "  a", "a  b ", "▁", "a▁▁ b", "\n\n x\ty", "日本語テキスト🙂é́", "x" * 3000, "the" * 500, "\x00a", "ａｂｃ",
    "<s> </s> <unk>", " " * 50, "don't 's 'sx ''s !!'s it're 'LLama 1234", "<|startoftext|> a<|endoftext|>b", "ΣΑΣ İ ½²ª",
    "the cat sat on the mat. " * 300, "Same text twice.", "Same text twice.",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if k == 3 else k, t, "en", 1.5) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids double").repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def library_ids():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_are_those_of_the_library(docs, no_docs):
    library = library_ids()
    rows = encode_pieces(docs.withColumn("t", F.col("text")), PIECES, keep=["doc_id", "t", "ids"]).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        text = row["t"] or ""
        proto = library.encode(text, return_type="proto")
        assert row["ids"] == library.encode(text)
        assert row["decoded"] == library.decode(row["ids"])
        assert list(zip(row["begins"], row["ends"])) == [(p.begin, p.end) for p in proto.pieces]
    assert encode_pieces(no_docs, PIECES).count() == 0


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc_cf"])
def test_normaliser_is_that_of_the_library(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    spec = next(dict(_fields(v)) for f, v in _fields(library.serialized_model_proto()) if f == 3)
    own = Normalizer(read_char_map(bytes(spec[2])), True, True, True)
    assert len(own.char_map) > 1000
    for text in ["ｱﾞ ①  ﬁn", " Ａｂｃ\t\x07x ", "é", "㍿ ｶﾞ", "", "   "]:
        made, align = own(text)
        assert made == library.normalize(text)
        assert len(align) == len(made) + 1 and align == sorted(align) and align[-1] <= len(text.encode())


def test_counts_are_those_of_the_library(docs, no_docs):
    library = library_ids()
    rows = count_tokens(docs.withColumn("t", F.col("text")), PIECES, keep=["t", "n_tokens"]).collect()
    assert all(r["n_tokens"] == len(library.encode(r["t"] or "")) for r in rows) and len(rows) == len(TEXTS)
    assert count_tokens(no_docs, PIECES).count() == 0


def test_packing_keeps_every_id_once(docs, no_docs):
    named = docs.filter("doc_id IS NOT NULL")
    rows = packing.pack(named, WORDS, length=256).collect()
    library = Tokenizer.from_file(WORDS)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = library.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids) and len(part) == r["length"]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        pieces[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(range(len(TEXTS))) - {3}
    for found in pieces.values():
        assert sum(n for _, n, _ in found) == found[0][2]
    for found in sequences.values():
        end = 0
        for offset, n in sorted(found):
            assert offset == end
            end += n
        assert end <= 256
    assert packing.pack(no_docs, WORDS, length=256).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_patterns_cover_the_demand(seed):
    draw = np.random.default_rng(seed)
    demand = np.bincount(np.minimum(draw.geometric(0.03, 5000), 128) - 1, minlength=128)
    demand[40 * seed] += 4000
    plan = packing.solve_patterns(demand, 128)
    sizes = np.arange(1, 129)
    assert (sum(p * n for p, n in plan) == demand).all()
    assert all((p * sizes).sum() <= 128 for p, _ in plan)
    used = sum(n for _, n in plan)
    assert used <= 1.02 * max((demand * sizes).sum() / 128, demand[64:].sum()) + len(plan)


# ------------------------------------------------------------------ SimHash


def brute_fingerprint(text, size=3):
    low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_xxh64_is_that_of_the_library():
    draw = np.random.default_rng(1)
    data = draw.integers(0, 256, 5000).astype(np.uint8)
    starts, sizes = draw.integers(0, 4000, 300), np.arange(300)
    assert xxh64(data, starts, sizes).tolist() == [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for a, n in zip(starts, sizes)]


def test_fingerprints_are_majorities(docs):
    rows = simhash.fingerprints(docs.withColumn("t", F.col("text")), keep=["t"]).collect()
    assert all(r["_fp"] & (1 << 64) - 1 == brute_fingerprint(r["t"] or "") for r in rows)


@pytest.mark.parametrize("bucket", [2, 64])
def test_links_are_all_pairs_within_two_bits(spark, bucket):
    draw = random.Random(5)
    seeds = [draw.getrandbits(64) for _ in range(6)]
    found = {s for s in seeds}
    for s in seeds:
        found |= {s ^ (1 << a) ^ (1 << b) for a, b in (draw.choices(range(64), k=2) for _ in range(25))}
    found |= {draw.getrandbits(64) for _ in range(60)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in found)
    nodes = spark.createDataFrame([(x,) for x in signed], "_fp long")
    made = {(r["a"], r["b"]) for r in simhash.links(nodes, 2, bucket).collect()}
    mask = (1 << 64) - 1
    assert made == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & mask).bit_count() <= 2}


def test_classes_have_the_smallest_id(docs, no_docs):
    rows = simhash.near_duplicates(docs).collect()
    own = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert len(rows) == len(TEXTS) and own[20] == own[19] == 19 and own[0] == own[1] == own[2] == 0
    assert simhash.near_duplicates(no_docs).count() == 0


def test_thresholds_add_up():
    costs = [{-1: 0.0, 0: 5.0, 1: 50.0}, {-1: 0.0, 0: 1.0, 1: 2.0}, {-1: 0.0, 0: 9.0, 1: 90.0}]
    assert simhash.choose_thresholds(costs, 0) == (7.0, [0, 1, -1])


def test_components(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(30, 31), (40, 41), (41, 42), (42, 40)]
    made = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert made == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 40: 40, 41: 40, 42: 40}


# ------------------------------------------------------------------ repeats


def brute_repeats(texts, width=100):
    seen, out = set(), {}
    for k, t in sorted(texts):
        raw = t.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            s = raw[i : i + width]
            if s in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(s)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out[k] = sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()
    return out


def test_repeats_are_those_of_brute_force(spark, no_docs):
    draw = random.Random(3)
    base = ["".join(draw.choice("abc de") for _ in range(draw.choice([90, 100, 150, 300]))) for _ in range(8)]
    texts = []
    for k in range(120):
        kinds = [draw.choice(base), draw.choice(base)[: draw.randint(0, 250)], "xyz " * draw.randint(0, 80), "é" * draw.randint(0, 120), "qwert"]
        texts.append((k, "".join(draw.choice(kinds) for _ in range(draw.randint(0, 6)))))
    df = spark.createDataFrame([*texts, (500, None), (501, "")], "doc_id long, text string").repartition(5)
    rows = remove_repeats(df, keep_text=True).collect()
    made = {r["doc_id"]: (r["n_removed"], len(r["spans"]) // 2, hashlib.sha256(r["kept"]).hexdigest()) for r in rows}
    assert made == brute_repeats([*texts, (500, ""), (501, "")])
    assert all(r["kept_text"].encode() in (bytes(r["kept"]), r["kept_text"].encode()) for r in rows)
    assert remove_repeats(no_docs).count() == 0


def test_rows_given_twice_and_without_id(spark):
    draw = random.Random(1)
    # all strings of the first text are different; those of the second are all equal, so it keeps one byte
    for text, repeated in (("".join(draw.choice("abcdefgh ") for _ in range(400)), 0), ("a" * 400, 399)):
        df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
        rows = sorted((r["doc_id"] is None, r["n_removed"]) for r in remove_repeats(df).collect())
        assert rows == [(False, repeated), (False, repeated), (True, 400)]


# ------------------------------------------------- fingerprints, top k, pages


def test_order_minhash(spark, no_docs):
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdefg") for _ in range(draw.randint(1, 9))) for _ in range(300)]
    texts = [(k * 7, " ".join(draw.choice(words) for _ in range(draw.randint(0, 200)))) for k in range(30)] + [(1000, None), (None, "x y z")]
    rows = {r["doc_id"]: r for r in compare_with_edits(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    order = sorted(((k, t or "") for k, t in texts if k is not None), reverse=True)
    for i, (k, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        assert rows[k]["n_chars"] == len(t)
        assert rows[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[k]["near_next"] <= 1
        if t == edited:
            assert rows[k]["near_edited"] == 1 and rows[k]["fingerprint"] == rows[k]["edited_fingerprint"]
    long = [rows[k] for k, t in order if len(t) > 300]
    assert min(r["near_edited"] for r in long) > max(r["near_next"] for r in long)
    assert compare_with_edits(no_docs).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(*values):
    """xxhash64 of texts, ("int", n), and longs in turn; None leaves the hash as it is."""
    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<i", v[1]) if isinstance(v, tuple) else struct.pack("<q", v)
            h = xxhash.xxh64(data, h).intdigest()
    return signed(h)


def brute_fingerprint(text, k=2, least=2):
    low = (1 << 26) - 1
    hashes = [spark_hash(t) for t in re.findall(r"[^ \t\n\x0b\f\r]{1,12}", text or "")]
    kmers = [(spark_hash(*[hashes[i + j] if i + j < len(hashes) else None for j in range(k)]) >> 26, i) for i in range(max(1, len(hashes) - k + 1) if hashes else 0)]
    seen, numbered = defaultdict(int), []
    for own, place in sorted(kmers):
        numbered.append((spark_hash(own, ("int", seen[own])) & ~low) | place)
        seen[own] += 1
    bins = defaultdict(list)
    for x in sorted(numbered):
        bins[x >> 59 & 31].append(x)
    out = []
    for b in range(32):
        chosen = sorted(bins[b][:least], key=lambda x: x & low)
        out.append(spark_hash(*[x >> 26 for x in chosen]) if chosen else None)
    return out


def brute_likeness(a, b):
    filled = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


@pytest.mark.parametrize("ranges", [2, 5, 512])
def test_order_minhash_is_that_of_brute_force(spark, ranges):
    """Repeated ids, equal texts, NULLs and very long texts, over several ranges of ids."""
    draw = random.Random(22)
    words = ["".join(draw.choice("abcdefgé") for _ in range(draw.randint(1, 30))) for _ in range(40)]
    rows = [(draw.randint(-20, 60), " ".join(draw.choice(words) for _ in range(draw.choice([0, 1, 2, 30, 400])))) for _ in range(70)]
    rows += [(7, "same text"), (7, "same text"), (7, None), (None, "no id here"), (None, None), (1 << 40, "日本語" * 40), (5, "ab " * 30_000)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, a string, _range double").repartition(6)
    stands = {}
    for i, t in rows:
        if i is not None:
            stands[i] = min(stands.get(i, (2**63, "")), (spark_hash(t or ""), t or ""))
    order = sorted(stands)
    want = []
    for i, t in rows:
        t = t or ""
        # the largest follows on the smallest
        following = stands[order[order.index(i) - 1]][1] if i is not None else ""
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        a, b, c = brute_fingerprint(t), brute_fingerprint(edited), brute_fingerprint(following) if i is not None else [None] * 32
        text = lambda f: ".".join("" if x is None else f"{x & (1 << 64) - 1:x}" for x in f)
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), brute_likeness(a, b), brute_likeness(a, c)))
    got = [(str(r["doc_id"]), *list(r)[1:]) for r in compare_with_edits(df, ranges=ranges).collect()]
    assert sorted(got) == sorted(want)


def test_top_k_is_exact(spark):
    draw = np.random.default_rng(4)
    vectors = np.round(draw.normal(0, 0.3, (300, 16)), 2)
    vectors[200:260] = vectors[0]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    rows += [(300, None), (350, [math.nan] * 16), (400, [1.0] * 15 + [math.inf]), (None, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    made = defaultdict(list)
    for r in top_k(df, F.col("vec_id") % 50 == 0, "vec_id", "embedding").collect():
        made[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = np.floor(256 * vectors).astype(int)
    for q in range(0, 300, 50):
        scores = whole @ whole[q]
        best = sorted((-int(s), k) for k, s in enumerate(scores) if k != q)[:5]
        assert sorted(made[q]) == [(i + 1, k, -s) for i, (s, k) in enumerate(best)]
    assert set(made) == set(range(0, 300, 50))
    assert top_k(df.limit(0), F.lit(True), "vec_id", "embedding").count() == 0


def test_top_k_of_repeated_ids_ties_and_two_lengths(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "BLOCK", 16)
    draw = np.random.default_rng(7)
    rows = [(k % 120, [float(x) for x in draw.integers(-2, 3, 4 if k % 3 else 6)]) for k in range(200)]
    rows += [(500 + k, [1.0, 0.0, 0.0, 0.0]) for k in range(60)] + [(1, []), (50, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(4)
    made = defaultdict(list)
    for r in top_k(df, F.col("vec_id") % 10 == 0, "vec_id", "embedding", k=5).collect():
        made[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    for query in {i for i, _ in whole if i % 10 == 0}:
        asked = min(v for i, v in whole if i == query)
        scores = [(-sum(a * b for a, b in zip(asked, v)), i) for i, v in whole if i != query and len(v) == len(asked)]
        assert sorted(made[query]) == [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:5])], query


def page(k, body):
    return (
        f"<html><head><title>t{k}</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li>Home<li>News</ul></nav>"
        f"<div class=box><p>Always the same words here</p><p>{body}</p></div>"
        f"<div class='comments'>nice {k}</div><script>var a='<p>'</script><footer>&copy; x</footer></body></html>"
    )


def test_template_text_goes_and_varying_text_stays(spark):
    rows = [(k, "http://a.example/x", page(k, f"story &amp; number {k}\n of  many<br>lines with words {k * 77}")) for k in range(12)]
    rows += [(100, None, None), (101, "http://b.example", ""), (102, "http://c.example", "<p>a &lt; b<p>c"), (103, "http://c.example", "<article><h1>T</h1>x<b>y</b><aside>no</aside>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    made = {r["page_id"]: r["text"] for r in extract(df).collect()}
    for k in range(12):
        assert made[k] == f"story & number {k} of many lines with words {k * 77}"
    assert (made[100], made[101], made[102], made[103]) == ("", "", "a < b\nc", "T\nxy")
    assert extract(df.limit(0)).count() == 0


def test_trees_match_in_order():
    a, b = parse("<div><p>1<p>2<ul><li>x</ul></div>"), parse("<div><h2>0</h2><p>1<ul><li>y<li>z</ul></div>")
    describe(a), describe(b)
    pairs = {(x.tag, plain(x.text), plain(y.text)) for x, y in match_trees(a, b) if x.tag == "#text"}
    assert pairs == {("#text", "1", "1"), ("#text", "x", "y")}


# --------------------------------------------------------- toxicity, scoring


def brute_kernel(s, t, order=toxicity.ORDER, decay=toxicity.DECAY):
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(s)), order):
        for j in combinations(range(len(t)), order):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


@pytest.mark.parametrize("s,t", [("idiot", "idxiot"), ("abc", "abc"), ("banana", "bandana"), ("ab", "abc")])
def test_kernel_counts_gapped_subsequences(s, t):
    made = toxicity.subsequence_kernel(toxicity.letters([s]), toxicity.letters([t]))[0]
    assert made == pytest.approx(brute_kernel(s, t), rel=1e-5)


def test_likenesses_are_those_of_the_kernel(monkeypatch):
    monkeypatch.setattr(toxicity, "STEP_PAIRS", 3)
    marks = ["grumf", "zorbl", "snarkle", "blimfo"]
    words = ["grumf", "gr-umf", "grxumf", "snarkle", "snaarkle", "blimf", "zorbll", "other"]
    found = toxicity.Likeness(marks).of(words)
    for row, word in zip(found, words):
        for value, mark in zip(row, marks):
            best = 0.0
            for part in toxicity.parts_of(toxicity.fold(word)):
                own = brute_kernel(part, part) * brute_kernel(mark, mark)
                best = max(best, (brute_kernel(part, mark) / own**0.5) ** toxicity.POWER)
            # values that are not worked out are zero; others are the kernel's
            assert value == pytest.approx(best, rel=1e-3) or value == 0 and best < 0.3
            assert value > 0 or mark[:5] not in toxicity.fold(word)


def test_insults_are_found_with_inserted_letters(spark):
    draw = random.Random(9)
    clean = ["".join(draw.choice(["ta", "ne", "so", "ri", "mu"]) for _ in range(draw.randint(1, 4))) for _ in range(200)]
    rows = []
    for k in range(300):
        text = [draw.choice(clean) for _ in range(30)]
        if k % 3 == 0:
            text[draw.randrange(30)] = draw.choice(["blockhead", "dimwit"])
        rows.append((k, " ".join(text), int(k % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"), lambda c: F.col(c) % 4 != 2)
    tests = spark.createDataFrame(
        [(0, "tane soriso d i m w i t muta"), (1, "tane bl0ckhead, sori"), (2, "tane dim-wit"), (3, "tane soriso muta"), (4, None), (5, "")],
        "doc_id long, text string",
    )
    score = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(tests, model).collect()}
    assert min(score[k] for k in (0, 1, 2)) >= 0.3 > max(score[k] for k in (3, 4, 5)) and score[4] == score[5]
    blank = toxicity.train_toxicity(df.limit(0).select("doc_id", "text"), df.select("doc_id", "toxic"), lambda c: F.lit(True))
    assert {r["score"] < 1e-6 for r in toxicity.score_toxicity(tests, blank).collect()} == {True}


def test_scores_prefer_usual_order(spark, no_docs):
    draw = random.Random(4)
    rows = [(k, " ".join(f"a{(i * 3 + k) % 9}" for i in range(200))) for k in range(150)]
    shuffled = [f"a{i % 9}" for i in range(200)]
    draw.shuffle(shuffled)
    rows += [(900, " ".join(shuffled)), (901, None), (902, " ")]
    made = {r["doc_id"]: r for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    usual = np.mean([made[k]["mean_log_likelihood"] for k in range(150)])
    assert usual > made[900]["mean_log_likelihood"] + 0.1
    assert made[901]["n_tokens"] == made[902]["n_tokens"] == 0 == made[901]["log_likelihood"]
    assert score_documents(no_docs).count() == 0
