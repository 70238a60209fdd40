"""Hand-made rasters: grounded masks, stencils, components, joins, geometry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscan import schema as SC
from gridscan.functions import scalar as S
from gridscan.operators import aggregates as A
from gridscan.operators import features as X
from gridscan.operators import filters as FL
from gridscan.operators import grid as G
from gridscan.operators import joins as J
from gridscan.operators import stencil as ST


def frame(spark, a, gid="g", ts=None):
    """2-D array -> pixel rows (granule_id, r, c, v); NaN -> NULL."""
    rows = [(gid, int(r), int(c), None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    d = spark.createDataFrame(rows, "granule_id string, r int, c int, v double")
    return d if ts is None else ST.by_tile(G.with_tile(d, ts))


def grid_of(df, col, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[col] is not None:
            out[r.r, r.c] = r[col]
    return out


def mask(spark, a):
    return frame(spark, a.astype(float)).withColumn("cls", F.col("v").cast("int"))


def tiles(spark, *pos):
    return spark.createDataFrame([("g", r, c) for r, c in pos], "granule_id string, row int, col int")


def test_grounded_fraction_values(spark):
    a = np.zeros((40, 40))
    a[:, 20:] = 1
    one = FL.grounded_fraction(tiles(spark, (0, 0)), mask(spark, np.ones((40, 40))), 40).first().grounded_frac
    half = FL.grounded_fraction(tiles(spark, (0, 0)), mask(spark, a), 40).first().grounded_frac
    sides = {r.col: r.grounded_frac for r in FL.grounded_fraction(tiles(spark, (0, 0), (0, 20)), mask(spark, a), 20, h=F.lit(40)).collect()}
    assert one == 1.0 and half == 0.5 and sides == {0: 0.0, 20: 0.5}


def test_grounded_filter_keeps_cut_value_and_nothing(spark):
    a = np.zeros((10, 30))
    a[:, :10] = 1
    a[:7, 20:] = 1
    t = tiles(spark, (0, 0), (0, 10), (0, 20))
    assert {r.col for r in FL.grounded_tiles(t, mask(spark, a), 10, 0.70).collect()} == {0, 20}
    assert FL.grounded_tiles(t, mask(spark, np.zeros((10, 30))), 10, 0.01).count() == 0


def test_valid_fraction_boundary(spark):
    a = np.full((10, 20), np.nan)
    a[:5, :10] = 1
    a[:5, 10:] = 1
    a[0, 19] = 0
    assert [r.col for r in FL.valid_tiles(frame(spark, a), 10, 0.5).collect()] == [0]


def test_ingest_null_rule(spark):
    d = spark.createDataFrame([(0.0,), (-1.0,), (float("nan"),), (2.0,), (None,)], "v double")
    assert [r.v for r in SC.ingest(d).collect()] == [None, None, None, 2.0, None]


def test_linear_guard_and_unknown_band(spark):
    d = spark.createDataFrame([(-3.0,)], "v double")
    with pytest.raises(Exception, match="not dB"):
        d.select(S.linear_or_fail("v")).collect()
    from gridscan.operators.pixels import select_bands
    with pytest.raises(ValueError, match="unknown bands"):
        select_bands(d, ["XX"], SC.POLS)


def test_checkerboard_diagonals(spark):
    a = np.indices((8, 8)).sum(0) % 2 + 1.0
    r = ST.diagonal_gradient(frame(spark, a, ts=8), "v").first()
    assert r.grad45 == 0 and r.grad135 == 0
    img = frame(spark, a - 1, ts=8).withColumnRenamed("v", "s")
    g = X.cooccurrence(img, steps={1: [(0, 1), (1, 1), (1, 0), (1, -1)]}).first()
    assert g.glcm_contrast == pytest.approx(31 ** 2 / 2) and g.glcm_contrast_aniso > 0


def test_ramp_gradient_box_and_orientation(spark):
    a = np.repeat(np.arange(8.0)[:, None], 8, 1) + 1
    d = frame(spark, a, ts=8)
    g = ST.gradient(d, "v", 8)
    assert (grid_of(g, "gr", (8, 8)) == 1).all() and (grid_of(g, "gc", (8, 8)) == 0).all()
    m = grid_of(ST.box_mean(d, {"m": "v"}, 3, 8), "m", (8, 8))
    p = np.pad(a, 1, mode="symmetric")
    want = sum(p[i:i + 8, j:j + 8] for i in range(3) for j in range(3)) / 9
    np.testing.assert_allclose(m, want)
    z = X.dominant_orientation(d, "v", 8).first()
    assert z.zx == pytest.approx(-1) and z.zy == pytest.approx(0, abs=1e-12)


def test_gaussian_and_sobel_twins(spark):
    rng = np.random.default_rng(3)
    a = rng.random((16, 16)) + 0.5
    w = np.array(ST.gaussian_weights(2.0))
    got = grid_of(ST.separable(frame(spark, a, ts=16), {"o": "v"}, list(w), list(w), 16), "o", (16, 16))
    p = np.pad(a, 8, mode="symmetric")
    rows = sum(w[k] * p[:, k:k + 16] for k in range(17))
    want = sum(w[k] * rows[k:k + 16] for k in range(17))
    np.testing.assert_allclose(got, want)
    q = np.pad(a, 1, mode="symmetric")
    sm = q[:, :-2] + 2 * q[:, 1:-1] + q[:, 2:]
    s = ST.sobel(frame(spark, a, ts=16), "v", 16)
    np.testing.assert_allclose(grid_of(s, "gr", (16, 16)), sm[2:] - sm[:-2], atol=1e-12)


def test_median_filter_twin(spark):
    a = np.random.default_rng(1).random((8, 8))
    p = np.pad(a, 1, mode="symmetric")
    want = np.median(np.stack([p[i:i + 8, j:j + 8] for i in range(3) for j in range(3)]), axis=0)
    np.testing.assert_allclose(grid_of(ST.median_filter(frame(spark, a, ts=8), "v", 3, 8), "med", (8, 8)), want)


def packed(spark, a, n=2):
    return spark.createDataFrame([("g", i, 0, a.shape[0], a.shape[1], [float(x) for x in (a * (i + 1)).ravel()]) for i in range(n)],
                                 "granule_id string, row int, col int, h int, w int, data array<double>")


def test_spectrum_twin(spark):
    a = np.random.default_rng(2).random((16, 16))
    got = np.array(X.spectrum(packed(spark, a), 16, 12, 4).where("row = 1").first().fft)
    t = np.outer(np.hanning(12), np.hanning(12))
    specs = [np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(2 * a[r:r + 12, c:c + 12] * t)))).reshape(4, 3, 4, 3).mean(axis=(1, 3))
             for r in (0, 4) for c in (0, 4)]
    np.testing.assert_allclose(got, np.max(specs, axis=0).ravel())


def test_convolve_twin(spark):
    rng = np.random.default_rng(4)
    a = rng.random((8, 8))
    for k in (np.arange(9.0).reshape(3, 3), rng.random((5, 5)), np.outer([1, 2, 1], [1, 0, -1.0]), np.zeros((3, 3))):
        h = len(k) // 2
        p = np.pad(a, h, mode="symmetric")
        want = sum(k[i, j] * p[i:i + 8, j:j + 8] for i in range(len(k)) for j in range(len(k)))
        d = X.convolve(frame(spark, a, ts=8), "v", k.tolist(), 8, "out")
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and plan.count(" Sort ") <= 2
        np.testing.assert_allclose(grid_of(d, "out", (8, 8)), want, atol=1e-9)
    assert [len(X.low_rank(k)) for k in (np.ones((3, 3)), np.outer([1, 2, 1], [1, 0, -1]) + np.eye(3), np.zeros((3, 3)))] == [1, 3, 0]


def components(spark, a, ts, batch=1):
    m = G.with_tile(frame(spark, np.where(a, 1.0, np.nan)).where("v = 1").select("granule_id", "r", "c"), ts)
    return A.label_components(m, ts, batch)


def test_components_line_and_block(spark):
    a = np.zeros((16, 16), bool)
    a[2, 2:14] = True
    a[8:12, 5:9] = True
    lab = components(spark, a, 16).persist()
    s = {r.area: r for r in A.component_shapes(lab).collect()}
    assert set(s) == {12, 16}
    assert s[12].eccentricity == pytest.approx(1) and s[16].eccentricity == pytest.approx(0, abs=1e-6)
    f = A.component_funnel(A.component_shapes(lab), min_size=5).first()
    assert (f.total_components, f.after_size_filter, f.after_elongation_filter) == (2, 2, 1)
    assert {r.r for r in A.kept_components(lab, A.component_shapes(lab), min_size=5).collect()} == {2}


@pytest.mark.parametrize("batch", [1, 2])
def test_components_are_8_connected_and_stay_in_their_tile(spark, batch):
    a = np.zeros((8, 16), bool)
    for i in range(8):
        a[i, i] = a[i, 15 - i] = True
    n = A.component_shapes(components(spark, a, 8, batch)).groupBy("col").count().collect()
    assert {r["col"]: r["count"] for r in n} == {0: 1, 8: 1}


def test_components_random_masks(spark):
    rng = np.random.default_rng(5)
    a = rng.random((24, 24)) < 0.45
    seen, want = np.zeros(a.shape, bool), []
    for r, c in zip(*np.nonzero(a)):
        if seen[r, c]:
            continue
        stack, n = [(r, c)], 0
        seen[r, c] = True
        while stack:
            i, j = stack.pop()
            n += 1
            for u in range(max(0, i - 1), min(24, i + 2)):
                for v in range(max(0, j - 1), min(24, j + 2)):
                    if a[u, v] and not seen[u, v]:
                        seen[u, v] = True
                        stack.append((u, v))
        want.append(n)
    got = [r.area for r in A.component_shapes(components(spark, a, 24)).collect()]
    assert sorted(got) == sorted(want)


def test_straddling_tile_weights(spark):
    t = spark.createDataFrame([("g", 152, 4)], "granule_id string, row int, col int")
    ones = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(2) for j in range(2)], "gi int, gj int, v double")
    got = J.overlap_mean(t, ones, 512, ["v"]).first().v
    wi = np.array([512 - 152, 152]) / 512
    wj = np.array([508, 4]) / 512
    assert got == pytest.approx(sum(wi[i] * wj[j] * (10 * i + j) for i in range(2) for j in range(2)))


def test_offset_registration(spark):
    h = "struct<epsg:int,px_m:double,origin_x:double,origin_y:double>"
    d = spark.createDataFrame([((3031, 5.0, 115.0, -20.0), (3031, 5.0, 100.0, -30.0))], f"a {h}, b {h}")
    r = G.registration(d).first()
    assert (r.dr, r.dc) == (-2, 3)
    bad = spark.createDataFrame([((3031, 5.0, 116.0, -20.0), (3031, 5.0, 100.0, -30.0))], f"a {h}, b {h}")
    assert G.registration(bad, strict=False).first().ok is False
    with pytest.raises(Exception, match="one pixel grid"):
        G.registration(bad).collect()


def test_shifted_join_reads_fill_outside(spark):
    a = frame(spark, np.arange(144.0).reshape(12, 12) + 1)
    d = J.shifted_join(a.drop("v"), a, 3, -2, "v", ["granule_id"], fill=0.0)
    g = grid_of(d, "v", (12, 12))
    assert g[0, 2] == 1 + 12 * 3 and g[11, 5] == 0 and g[5, 0] == 0


def test_best_shift_finds_known_offset(spark):
    rng = np.random.default_rng(6)
    a = rng.random((20, 20))
    b = np.roll(a, (1, -2), axis=(0, 1))
    rows = [("k", r, c, float(a[r, c]), float(b[r, c])) for r in range(20) for c in range(20)]
    s = X.best_shift(spark.createDataFrame(rows, "k string, br int, bc int, va double, vb double"), 3, ["k"]).first()
    assert (s.dy, s.dx) == (1, -2) and s.peak > 0.99


def test_best_shift_equals_plain_correlations_on_ragged_boxes(spark):
    rng = np.random.default_rng(8)
    for trial in range(2):
        a, b = rng.normal(5, 1, (9, 11)), rng.normal(5, 1, (9, 11))
        there = rng.random((9, 11)) < 0.7
        rows = [("k", r, c + 3, float(a[r, c]) if rng.random() < 0.9 else None, float(b[r, c])) for r in range(9) for c in range(11) if there[r, c]]
        va, vb = ({(r, c): x[i] for x in rows for r, c in [(x[1], x[2])]} for i in (3, 4))
        peaks = {}
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                both = [(va[p], vb[p[0] + dy, p[1] + dx]) for p in va if va[p] is not None and (p[0] + dy, p[1] + dx) in vb]
                peaks[dy, dx] = np.corrcoef(*zip(*both))[0, 1]
        best = max(peaks, key=peaks.get)
        d = X.best_shift(spark.createDataFrame(rows, "k string, br int, bc int, va double, vb double"), 2, ["k"])
        s = d.first()
        assert (s.dy, s.dx) == best and abs(s.peak - peaks[best]) < 1e-9


def test_empty_raster_has_null_bounds_and_no_tiles(spark):
    h = spark.createDataFrame([("g", 20, 20)], "granule_id string, height int, width int")
    px = spark.createDataFrame([], "granule_id string, r int, c int, v double")
    b = G.data_bounds(px, h, 4)
    r = b.first()
    assert r.row_min is None and r.row_max is None and r.coverage_percent == 0
    assert G.swath_tiles(b, 8).count() == 0


def test_far_side_of_overlapped_reads(spark):
    b = spark.createDataFrame([("g", 1100, 512, 0, 1100, 0, 512)], "granule_id string, height int, width int, row_min int, row_max int, col_min int, col_max int")

    def rows(parity):
        k = G.center_crop(G.overlap_tiles(b, 512, 64), 512, 64, parity).where("col = 0").collect()
        return {x for r in k for x in range(r.row + r.top, r.row + r.bottom)}
    assert rows(False) == set(range(1100))
    assert rows(True) == set(range(1036))


def test_distance_transform(spark):
    cells = [("g", i, j, (i, j) in {(0, 0), (5, 3)}) for i in range(7) for j in range(9)] + [("none", 0, 0, False)]
    d = spark.createDataFrame(cells, "granule_id string, ti int, tj int, pos boolean")
    for r in J.distance_to_positive(d, "pos").collect():
        if r.granule_id == "none":
            assert r.dist is None
        else:
            assert r.dist == pytest.approx(min(np.hypot(r.ti, r.tj), np.hypot(r.ti - 5, r.tj - 3)))


def test_tile_scale_refuses_non_square(spark):
    ok = spark.createDataFrame([(2.5, 2.5), (5.0, 5.0), (20.0, 20.0)], "px_m double, px_y_m double")
    assert [r.scale for r in G.tile_scale(ok).collect()] == [2, 1, 1]
    with pytest.raises(Exception, match="non-square"):
        G.tile_scale(spark.createDataFrame([(2.5, 5.0)], "px_m double, px_y_m double")).collect()
