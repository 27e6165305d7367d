"""Pairs of codes, counted and looked up in arrays."""

import itertools
import math
import random
from collections import defaultdict

import pyarrow as pa
import pytest

from groupstats.operators import encode, pair_tables
from groupstats.session import SMALL_ROWS

GROUPS, ENTRIES, TARGETS = ["ri_g", "ri_h"], ["e", "f", "many"], ["won", "time"]


def made(n):
    draw = random.Random(4)
    pick = lambda *values: draw.choice(values)
    return [
        (i, pick("a", "a_b", None), pick("x", "b_x", "nan"), pick("a", "a_b", "c"), pick(1, 2, None), f"m{draw.randrange(n // 3)}",
         pick(0, 1), pick(1.5, 2.5, None))
        for i in range(n)
    ]


ROWS = made(300)
NAMES = ["id", "ri_g", "ri_h", "e", "f", "many", "won", "time"]


def brute(rows):
    """Encoded values by id: keys are joined texts, so different values can share one."""
    shown = [{n: "nan" if v is None and n not in TARGETS else v for n, v in zip(NAMES, r)} for r in rows]
    out = defaultdict(dict)
    for g, e, t in itertools.product(GROUPS, ENTRIES, TARGETS):
        by_key = defaultdict(list)
        for r in shown:
            by_key[f"{r[e]}_{r[g]}"].append(r[t])
        known = [r[t] for r in shown if r[t] is not None]
        prior = sum(known) / len(known)
        for r in shown:
            of_key = by_key[f"{r[e]}_{r[g]}"]
            found = [v for v in of_key if v is not None]
            weight = 1 / (1 + math.exp(-(len(of_key) - 20) / 10))
            value = weight * sum(found) / len(found) + (1 - weight) * prior if found else None
            out[r["id"]][f"{g.removeprefix('ri_')}_{e}_te_{t}"] = value
    return out


@pytest.mark.parametrize("small", [100_000, 3, 0])
def test_pairs_equal_brute_force_and_multiply_no_rows(spark, small):
    df = spark.createDataFrame(ROWS, "id long, ri_g string, ri_h string, e string, f int, many string, won int, time double")
    spark.conf.set(SMALL_ROWS, str(small))
    try:
        out = encode.encode_pairs(df, GROUPS, [*ENTRIES, "absent"], TARGETS, k=20, f=10, keep=["id"])
        if small > 3:  # before, a join for each pair
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert "Join" not in plan and "Generate" not in plan
        found = {r["id"]: r.asDict() for r in out.collect()}
        whole = encode.encode_pairs(df, GROUPS, ENTRIES, TARGETS, k=20, f=10)
        assert whole.columns[: len(NAMES)] == NAMES and whole.drop(*NAMES[1:]).columns == out.columns
    finally:
        spark.conf.unset(SMALL_ROWS)
    stem = lambda name: next(n for n in out.columns if n.endswith(name))
    expected = brute(ROWS)
    assert len(found) == len(ROWS) and len(out.columns) == 1 + len(GROUPS) * len(ENTRIES) * len(TARGETS)
    for i, values in expected.items():
        for name, value in values.items():
            got = found[i][stem(name)]
            assert got == (None if value is None else pytest.approx(value)), name


@pytest.mark.parametrize("cells, values", [(1 << 22, 1 << 18), (40, 1 << 18), (1 << 22, 20), (0, 10)])
def test_counts_are_whole_with_little_memory(monkeypatch, cells, values):
    monkeypatch.setattr(pair_tables, "CELLS", cells)
    monkeypatch.setattr(pair_tables, "VALUES", values)
    text = lambda v: "nan" if v is None else str(v)
    columns = {pair_tables.text(n): [text(r[NAMES.index(n)]) for r in ROWS] for n in (*GROUPS, *ENTRIES)}
    table = pa.table({**columns, "won": [float(r[6]) for r in ROWS], "time": [r[7] for r in ROWS]})
    pairs = [(e, g) for g in GROUPS for e in ENTRIES]
    counted = defaultdict(lambda: [0] * 5)
    for batch in pair_tables.count_pairs(table.to_batches(max_chunksize=37), pairs, TARGETS):
        for r in batch.to_pylist():
            cell = counted[r["_pair"], r["_entry"], r["_group"]]
            for i, stat in enumerate(["_n", "_sum_won", "_count_won", "_sum_time", "_count_time"]):
                cell[i] += r[stat]
    expected = defaultdict(lambda: [0] * 5)
    for r in ROWS:
        for i, (e, g) in enumerate(pairs):
            cell = expected[i, text(r[NAMES.index(e)]), text(r[NAMES.index(g)])]
            for j, v in enumerate([1, r[6], 1, r[7] or 0, int(r[7] is not None)]):
                cell[j] += v
    assert dict(counted) == dict(expected)
