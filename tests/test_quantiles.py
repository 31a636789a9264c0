"""Bucketed quantiles beside sorted values."""

import random

import numpy as np
import pytest

from tidemark.operators.quantiles import exact_quantiles

AT = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)


@pytest.mark.parametrize("spread", [3, 500, 100_000])
def test_quantiles_equal_sorted_values(spark, spread):
    rng = random.Random(spread)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randint(-spread, spread) / 8])) for _ in range(700)] + [("one", 5.0), ("none", None)]
    got = exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(7), "v", AT, ["k"]).collect()
    groups = {k: [v for g, v in rows if g == k and v is not None] for k, _ in rows}
    assert {r["k"] for r in got} == {k for k, v in groups.items() if v} and len(got) == 4
    for r in got:
        values = groups[r["k"]]
        assert (r["n"], r["least"], r["most"]) == (len(values), min(values), max(values))
        assert np.allclose([r[f"p{round(q * 100)}"] for q in AT], np.quantile(values, AT))


def test_one_group_and_no_rows(spark):
    rows = spark.createDataFrame([(i,) for i in range(1001)], "v long")
    r = exact_quantiles(rows, "v", [0.5, 0.999]).collect()
    assert [tuple(x) for x in r] == [(1001, 0, 1000, 500.0, 999.0)]
    assert [tuple(x) for x in exact_quantiles(rows.where("v < 0"), "v", [0.5]).collect()] == [(0, None, None, None)]
