"""Repeats between many texts that have no id, or share one."""

import random

import pytest

from groupstats.llm.repeats import remove_repeats


@pytest.mark.parametrize("doc_id", [None, 7])
def test_texts_of_one_id_keep_their_own_places(spark, doc_id):
    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz "
    passage = "".join(draw.choice(letters) for _ in range(150))
    texts = []
    for k in range(1500):  # so many that 16 bits of their hashes collide
        text = "".join(draw.choice(letters) for _ in range(120 + k % 90))
        texts.append(text[:60] + passage + text[60:] if k % 3 == 0 else text)
    df = spark.createDataFrame([(doc_id, t) for t in texts], "doc_id long, text string")
    rows = remove_repeats(df, keep_text=True).collect()
    whole = {t: t.replace(passage, "") for t in texts}
    left = [r for r in rows if r["kept_text"] == r["text"]]
    assert len(rows) == 1500
    # the passage stays in one text, and nothing else is removed but letters next to it that an earlier text also has
    assert sum(passage in r["kept_text"] for r in rows) == 1
    assert len(left) == 1001
    assert all(abs(len(r["kept_text"]) - len(whole[r["text"]])) <= 12 for r in rows if passage not in r["kept_text"])


def test_copies_without_id_cost_what_one_does(spark):
    """Rows of one text without id are one document: nothing of it but what id 1 has goes, in time linear in the rows."""
    draw = random.Random(4)
    text = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(600))
    rows = [(1, text[:300], "a", 5, "b")] + [(None, text, "a", 5, "b")] * 4000
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string, _doc long, _tie string").repartition(5)
    made = remove_repeats(df)
    assert set(made.columns) == {*df.columns, "n_removed", "spans", "kept"}
    counts = made.groupBy("doc_id", "n_removed", "spans", "_text", "_doc", "_tie").count().collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"], r["spans"], r["count"]) for r in counts) == [
        (0, 300, [0, 300], 4000),
        (1, 0, [], 1),
    ]
    assert {(r["_text"], r["_doc"], r["_tie"]) for r in counts} == {("a", 5, "b")}
