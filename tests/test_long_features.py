"""Features of leads in blocks equal those of the lead in one row."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import features, long_features

FS, LENGTH = 250.0, 1024


def _leads():
    rng = np.random.default_rng(4)
    beat = np.exp(-0.5 * ((np.arange(200) - 60) / 4) ** 2)
    walk = np.cumsum(rng.normal(size=9000))
    return {
        "noise": rng.normal(size=5000), "beats": np.tile(beat, 40) + 0.01 * rng.normal(size=8000), "whole blocks": rng.normal(size=4 * LENGTH), "walk": walk,
        "one more": rng.normal(size=2 * LENGTH + 1), "short": rng.normal(size=40), "one": np.array([2.5]), "two": np.array([1.0, 3.0]), "flat": np.full(3000, 7.0),
        "tops": np.repeat(rng.integers(0, 4, 60), rng.integers(1, 400, 60)).astype(float), "long top": np.concatenate([[0.0], np.full(4000, 1.0), [0.0, 2.0, 0.0]]),
        "ramp": np.arange(6000) + (np.arange(6000) % 7 == 3) * 5.0, "ties": (np.arange(7000) % 9 == 4).astype(float), "none": np.zeros(0),
        "negative": -np.abs(rng.normal(size=3333)), "zeros": np.where(rng.random(2500) < 0.9, 0.0, rng.normal(size=2500)), "window": rng.normal(size=1024),
    }


@pytest.fixture(scope="module")
def rows(spark):
    out = [(k, b, x[s : s + LENGTH].tolist(), "clash") for k, x in _leads().items() for b, s in enumerate(range(0, max(1, len(x)), LENGTH))]
    return spark.createDataFrame(out, "rec string, block long, x array<double>, left string").repartition(7)


def test_equals_the_lead_in_one_row(spark, rows):
    whole = spark.createDataFrame([(k, [x.tolist()]) for k, x in _leads().items() if len(x)], "rec string, ecg array<array<double>>")
    want = {r["rec"]: r["features"] for r in features.lead_features(whole, FS).select("rec", "features").collect()}
    got = {r["rec"]: r["features"] for r in long_features.long_features(rows, FS, LENGTH).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert len(got[k]) == len(want[k]), k
        for i, (a, b) in enumerate(zip(got[k], want[k])):
            assert (a is None and b is None) or a == pytest.approx(b, rel=1e-7, abs=1e-9), (k, i, a, b)


def test_nothing(rows):
    assert long_features.long_features(rows.filter("block < 0"), FS, LENGTH).collect() == []


def test_block_length_is_checked(rows):
    with pytest.raises(ValueError):
        long_features.long_features(rows, FS, 1000)
    with pytest.raises(ValueError):
        long_features.long_features(rows, 6000.0, LENGTH)


def test_order_statistics_of_ties(spark):
    """Nine of ten values are equal, in ten blocks; no value is sorted."""
    rng = np.random.default_rng(1)
    x = np.where(rng.random(20_000) < 0.9, 3.0, rng.normal(size=20_000) * 10.0 ** rng.integers(-300, 300, 20_000))
    x[:4] = [-0.0, 0.0, np.inf, -np.inf]
    df = spark.createDataFrame([(1, b, x[b * 2000 : (b + 1) * 2000].tolist()) for b in range(10)], "rec int, block long, x array<double>")
    ranks = [0, 1, 5, 999, 10_000, 19_998, 19_999]
    got = long_features.order_statistics(df, spark.createDataFrame([(1, r) for r in ranks], "rec int, rank int")).collect()
    assert {r["rank"]: r["value"] for r in got} == {r: np.sort(x)[r] for r in ranks}


def test_blocks_from_samples(spark):
    samples = spark.range(2500).select(F.lit(1).alias("id"), F.col("id").alias("i"), (F.col("id") * 2).alias("v"))
    blocks = long_features.blocks_of(samples, "id", "i", "v", LENGTH).collect()
    assert {r["block"]: len(r["x"]) for r in blocks} == {0: 1024, 1: 1024, 2: 452}
    assert [v for r in sorted(blocks) for v in r["x"]] == [2.0 * i for i in range(2500)]
