"""Reflected box means: one sorted order for both axes, gaps, sizes up to two tiles wide."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscan.operators import stencil as ST
from test_rasters import frame, grid_of


def plain(a, k):
    h = k // 2
    p = np.pad(a, h, mode="symmetric")
    return np.array([[np.nanmean(p[i:i + k, j:j + k]) for j in range(a.shape[1])] for i in range(a.shape[0])])


@pytest.mark.parametrize("k, ts", [(1, 4), (3, 8), (7, 8), (7, 4), (9, 4), (15, 8), (17, 16)])
def test_box_means(spark, k, ts):
    rng = np.random.default_rng(k)
    a = rng.random((ts, ts)) + 0.5
    a[rng.random((ts, ts)) < 0.1] = np.nan
    d = frame(spark, a, ts=ts).withColumn("v", F.nanvl("v", F.lit(None)))
    cols = {f"m{i}": F.col("v") * (i + 1) for i in range(9)} | {"all": F.lit(2.0)}
    got = ST.box_mean(d, cols, k, ts).cache()
    for i in (0, 5, 8):
        np.testing.assert_allclose(grid_of(got, f"m{i}", (ts, ts)).astype(float), plain(a, k) * (i + 1))
    assert (grid_of(got, "all", (ts, ts)).astype(float) == 2).all()


def test_narrow_boxes_share_one_sort_and_copy_no_pixel(spark):
    d = ST.by_tile(frame(spark, np.ones((8, 8)), ts=8))
    plan = ST.box_mean(ST.box_mean(d, {"m": "v"}, 5, 8), {"n": "m"}, 3, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Sort [") == 1 and "Generate" not in plan


def test_a_tile_with_a_hole_stops_the_job(spark):
    d = frame(spark, np.ones((8, 8)), ts=8).where("r <> 3 OR c <> 4")
    with pytest.raises(Exception, match="not dense"):
        ST.box_mean(d, {"m": "v"}, 3, 8).collect()
