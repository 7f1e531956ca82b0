"""Two-level operators against windows over whole series, and against definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.operators import frames, intervals, series


@pytest.fixture(scope="module")
def rows(spark):
    """Series of 40 to 200 frames, one with a null key, one that is short, with ties."""
    r = np.random.default_rng(1)
    return spark.createDataFrame([(None if k == 3 else k, i, float(np.round(r.normal(), 1))) for k in range(6) for i in range(3 if k == 5 else 40 * (k + 1))], "k int, i int, v double").repartition(5)


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_blocks_equal_whole_windows(rows):
    for f in (
        lambda b: frames.smooth(rows, ["k"], ["i"], "v", "x", b).withColumn("x", F.round("x", 9)),
        lambda b: frames.rolling_median(rows, ["k"], ["i"], "v", 5, "zero", "x", b),
        lambda b: frames.rolling_median(rows, ["k"], ["i"], "v", 3, "nearest", "x", b),
        lambda b: frames.local_maxima(rows, ["k"], ["i"], "v", b),
        lambda b: frames.largest_jump(rows, ["k"], ["i"], "v", b),
        lambda b: frames.normalise_db(rows.withColumn("v", F.exp("v")), ["k"], "v", "x", b),
        lambda b: frames.islands(rows.filter("v > 0"), ["k"], "i", F.lit(2), None, b),
        lambda b: frames.merge_gaps(rows.filter("v > 1"), ["k"], "i", 3, None, b),
    ):
        same(f(None), f(7))


def test_numbers_and_quantiles(rows):
    n = series.numbered(rows.drop("i"), ["k"], ["v"]).toPandas()
    for _, g in n.groupby("k", dropna=False):
        assert sorted(g["number"]) == list(range(len(g))) and g.sort_values("number")["v"].is_monotonic_increasing
    x = rows.withColumn("v", F.when(F.col("i") == 7, None).otherwise(F.col("v") * F.col("v") * 1000))
    same(x.groupBy("k").agg(F.round(F.median("v"), 9).alias("m"), F.round(F.percentile("v", F.lit(0.2)), 9).alias("p")), series.quantiles(x, ["k"], "v", {"m": 0.5, "p": 0.2}, most=5, bins=3).select("k", F.round("m", 9).alias("m"), F.round("p", 9).alias("p")))
    assert series.quantiles(x.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


def test_nearest_interval_against_all_pairs(spark):
    r = np.random.default_rng(2)
    for reach in (2, 30):
        i = [(k, float(a), float(a + r.integers(0, reach))) for k in range(3) for a in r.integers(0, 300, 40)]
        p = [(k, float(x)) for k in range(4) for x in r.integers(-10, 340, 80)]
        got = intervals.nearest_interval(spark.createDataFrame(p, "k int, x double").repartition(4), spark.createDataFrame(i, "k int, a double, z double").repartition(3), ["k"], "x", "a", "z").collect()
        want = {(k, x): min((max(0.0, a - x, x - z), a, z) for j, a, z in i if j == k) for k, x in p if k < 3}
        assert {(g.k, g.x): (g.distance, g.a, g.z) for g in got} == want and len(got) == len(want)
