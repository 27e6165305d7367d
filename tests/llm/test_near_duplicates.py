"""The near-duplicate stage of the pipeline against brute force."""

import random
import re
from itertools import combinations

import corpus_pipeline
import pytest
import xxhash

from groupstats.llm.simhash import first_of_classes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(rows):
    """Rows by class: fingerprints that differ in two bits or less, linked on."""
    prints = [fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    made = {}
    for row, r in zip(rows, root):
        made.setdefault(r, []).append(row)
    return list(made.values())


@pytest.mark.parametrize("seed", [0, 1])
def test_stage_keeps_one_of_near_copies(spark, seed):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    rows = [(900, ""), (901, None), (902, "one two"), (903, "One  two")]
    for k in range(12):
        text = [draw.choice(words) for _ in range(draw.randint(60, 400))]
        for i in range(6):
            rows.append((100 * k + i, " ".join(text)))
            if i % 2:  # chains: each is an edit of the one before
                text[draw.randrange(len(text))] = draw.choice(words)
    alone = " ".join(draw.choice(words) for _ in range(60))
    rows += [(None, alone), (None, alone), (None, rows[4][1]), (7000, "a b c d e f"), (7000, "u v w x y z"), (7000, "a b c d e f")]
    df = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    kept = [(r["doc_id"], r["text"]) for r in kept.collect()]
    made = classes(rows)
    assert len(made) < len(rows) - 10 and len(kept) == len(made)
    for members in made:
        mine = [r for r in kept if r in members]
        least = min((r[0] for r in members if r[0] is not None), default=None)
        assert [r[0] for r in mine] == [least], members


def test_rows_of_one_id_and_clashing_columns(spark):
    rows = [(1, "a b c", "x", 5), (1, "a b c", "y", 6), (1, "a b c", "x", 5), (2, "q r s t u", None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string, _id int")
    found = {tuple(sorted(map(str, r))) for r in first_of_classes(df.repartition(3)).collect()}
    again = {tuple(sorted(map(str, r))) for r in first_of_classes(df.repartition(1)).collect()}
    assert found == again and len(found) == 2
    assert first_of_classes(df.limit(0)).count() == 0
