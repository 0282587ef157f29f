from __future__ import annotations

import math
import random

import pytest

from mineralis.operators.ranking import ordinal_rank


@pytest.mark.parametrize("rows_per_task", [10, 1_000_000])
def test_rank_of_hot_group_and_hot_value(spark, rows_per_task):
    rng = random.Random(1)
    rows = [("hot", 5.0 if rng.random() < 0.4 else round(rng.random() * 10, 1), i) for i in range(900)]
    rows += [(f"k{i % 30}", float(i % 3), 1000 + i) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, v double, ord long").repartition(5)
    got = {(r.k, r.ord): r["rank"] for r in ordinal_rank(df, ["k"], "v", "ord", rows_per_task=rows_per_task, slices=16).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])), 1):
            want[key, r[2]] = n
    assert got == want


@pytest.mark.parametrize("rows_per_task", [10, 1_000_000])
def test_rank_keeps_null_keys_and_values(spark, rows_per_task):
    """Whatever the size of a group, no row is lost: NULL keys, NULL and NaN values, all-NULL groups."""
    rng = random.Random(2)
    values = [None, float("nan"), 1.0, 2.0, 2.0, -3.5]
    rows = [(rng.choice([None, "a", "b"]), rng.choice(values), i) for i in range(300)] + [("none", None, 1000 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, v double, ord long").repartition(5)
    got = {(r.k, r.ord): r["rank"] for r in ordinal_rank(df, ["k"], "v", "ord", rows_per_task=rows_per_task, slices=8).collect()}
    order = lambda r: (r[1] is not None, math.isnan(r[1]) if r[1] is not None else False, 0 if r[1] is None or math.isnan(r[1]) else r[1], r[2])
    want = {}
    for key in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=order), 1):
            want[key, r[2]] = n
    assert got == want
