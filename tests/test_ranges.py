"""Exact quantiles and queue positions by ranges, on skewed values."""

import math
import random

import pytest

from tessera.functions import aggregates
from tessera.operators import preferences

Q = {"low": 0.1, "middle": 0.5, "high": 0.9, "first": 0.0, "last": 1.0, "beyond": 7.0}


def plain(values, q):
    got = sorted(v for v in values if v is not None and not math.isnan(v))
    return got[round(min(1.0, max(0.0, q)) * (len(got) - 1))] if got else None


@pytest.mark.parametrize(
    "values",
    [
        [math.inf, -math.inf, 1e300, *[i / 1000 for i in range(3000)]],
        [5.0] * 2000 + [1.0, 9.0, None, math.nan],
        [random.Random(1).gauss(0, 1) ** 9 for _ in range(4000)] + [0.0, -0.0] * 50,
        [1e15 + i for i in range(2500)] + [-1.0],
        [3.0], [None], [],
    ],
)
def test_nearest_rank(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    got = aggregates.nearest_rank(rows, "x", Q).collect()
    assert [r.asDict() for r in got] == [{name: plain(values, q) for name, q in Q.items()}]


def test_few_ranges_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "RANGES", 9)
    values = [float(i * i % 7919) for i in range(5000)]
    got = aggregates.nearest_rank(spark.createDataFrame([(v,) for v in values], "x double"), "x", Q).first().asDict()
    assert got == {name: plain(values, q) for name, q in Q.items()}


@pytest.mark.parametrize("orders", [list(range(500)), [10**15] + list(range(-200, 200)), [None, 3, 1, None, 2], [4], []])
def test_queue_positions(spark, orders):
    rows = [(f"q{i}", o, -1) for i, o in enumerate(orders)]
    random.Random(0).shuffle(rows)
    out = preferences.queue_positions(spark.createDataFrame(rows, "id string, ord long, n int")).collect()
    assert sorted(r["index"] for r in out) == list(range(1, len(rows) + 1)) and {r["total"] for r in out} <= {len(rows)}
    by = sorted(out, key=lambda r: r["index"])
    assert [r["ord"] for r in by] == sorted(orders, key=lambda o: (o is not None, o or 0))
