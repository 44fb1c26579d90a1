"""Quantiles against ``percentile``: ties, gaps, clusters, nulls and groups."""

import random

import pytest
from pyspark.sql import functions as F

from lumenrank.operators import quantiles


@pytest.mark.parametrize("rows, ranges", [(10_000, 1024), (5, 4)])
@pytest.mark.parametrize("p", [0.5, 0.7])
def test_quantiles_equal_percentile(spark, monkeypatch, rows, ranges, p):
    monkeypatch.setattr(quantiles, "ROWS", rows)
    monkeypatch.setattr(quantiles, "RANGES", ranges)
    rng = random.Random(9)
    groups = {
        "ties": [rng.choice([0.0, 300.0, 7e6]) for _ in range(99)],
        "gap": [rng.random() for _ in range(50)] + [1e9 + rng.random() for _ in range(50)],
        "cluster": [1.0 + i * 1e-12 for i in range(80)] + [-1e6],
        "one": [4.5],
        "few": [1.0, 2.0],
        "none": [None, None],
        None: [rng.gauss(0, 1) for _ in range(60)] + [None],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", p).alias("q")).collect()}
    got = {r.g: r["quantile"] for r in quantiles.quantile(df, F.col("v"), p, ["g"]).collect()}
    assert got.keys() == want.keys() and all((got[g] is None) == (want[g] is None) and (got[g] is None or got[g] == pytest.approx(want[g], rel=1e-12)) for g in want)
    assert quantiles.quantile(df, F.col("v"), p).first()[0] == pytest.approx(df.agg(F.percentile("v", p)).first()[0])
    assert quantiles.quantile(df.limit(0), F.col("v"), p).first()[0] is None
