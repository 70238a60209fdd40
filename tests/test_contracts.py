"""Contracts: N in = N out, split separation, guards, files, streams, models."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscan.operators import checks as C
from gridscan.operators import filters as FL
from gridscan.operators import joins as J
from gridscan.operators import labels as L
from gridscan.operators import models as MD
from gridscan.operators import splits as SP
from gridscan.plans import cascade as CA
from gridscan.plans.lineage import scratch_path
from gridscan.sources import catalog as CT
from gridscan.sources import tables as TB
from gridscan.streaming import arrivals as AR


def stack(spark, n=12):
    rows = [("g", i, 0, None if i % 4 == 0 else i / n) for i in range(n)]
    return spark.createDataFrame(rows, "granule_id string, row int, col int, p double")


@pytest.mark.parametrize("theta", [0.01, 0.5, 0.99])
@pytest.mark.parametrize("as_column", [True, False])
def test_cascade_scatters_back(spark, theta, as_column):
    seg = F.col("p") * 2 if as_column else (lambda d: d.withColumn("seg", F.col("p") * 2))
    out = CA.cascade(stack(spark), F.col("p"), seg, theta, mask_threshold=1.0).orderBy("row").collect()
    assert [r.row for r in out] == list(range(12))
    for r in out:
        assert r.gate_flag == (r.p is not None and r.p >= theta)
        assert (r.seg is not None) == r.gate_flag
        assert r.seg_mask == (r.seg is not None and r.seg >= 1.0)


def test_flags_fall_with_the_threshold(spark):
    n = [CA.cascade(stack(spark), F.col("p"), F.col("p"), t).where("gate_flag").count() for t in (0.01, 0.5, 0.99)]
    assert n[0] > n[1] > n[2] == 0


def test_all_unscoreable(spark):
    d = stack(spark).withColumn("p", F.lit(None).cast("double"))
    out = CA.cascade(d, F.col("p"), F.col("p"), 0.5).collect()
    assert len(out) == 12 and not any(r.gate_flag for r in out) and all(r.seg is None for r in out)


def lattice(spark, n=30):
    rng = np.random.default_rng(0)
    rows = [("g", i, j, float(j * 2560), float(-i * 2560), int(rng.random() < 0.5), float(rng.random())) for i in range(n) for j in range(n)]
    return spark.createDataFrame(rows, "granule_id string, ti int, tj int, x_m double, y_m double, y int, s double")


def test_block_split_keeps_distance_and_quota(spark):
    d = SP.block_split(lattice(spark), 0.8, "s", 3, 1).toPandas()
    va, tr = d[d.part == "val"], d[d.part == "train"]
    assert len(va) >= 180 and len(va) < 180 + 9
    gap = np.maximum(np.abs(va.ti.values[:, None] - tr.ti.values), np.abs(va.tj.values[:, None] - tr.tj.values)).min()
    assert gap > 1


def test_buffered_split_and_folds(spark):
    t = lattice(spark)
    d = SP.buffered_split(t, 0.2, 25600.0, 5120.0).toPandas()
    va, tr = d[d.part == "val"], d[d.part == "train"]
    assert not set(zip(va.x_m, va.y_m)) & set(zip(tr.x_m, tr.y_m)) and len(va) >= 180
    for f in SP.buffered_folds(t, 25600.0, 5120.0).collect():
        train, test = SP.fold_train(t, f), SP.fold_test(t, f, 25600.0)
        assert (train.where("y = 1").count(), train.where("y = 0").count()) == (f.train_pos, f.train_neg)
        assert test.count() == f.n_test and test.join(train, ["ti", "tj"]).count() == 0


def test_band_split_gap_and_empty_side(spark):
    d = SP.band_split(lattice(spark), 0.8, 2)
    assert SP.check_split(d).first().gap >= 3
    with pytest.raises(ValueError, match="no val"):
        SP.require_both_sides(SP.band_split(lattice(spark, 4), 1.0, 1))


def test_outside_boxes_matches_brute_force(spark):
    t = lattice(spark)
    b = [(0.0, 9000.0, -20000.0, 0.0), (50000.0, 51200.0, -70000.0, -12800.0)]
    boxes = spark.createDataFrame(b, "x0 double, x1 double, y0 double, y1 double")
    want = {(r.x_m, r.y_m) for r in t.collect() if not any(x0 <= r.x_m <= x1 and y0 <= r.y_m <= y1 for x0, x1, y0, y1 in b)}
    for cell in (2560.0, 30000.0):
        assert {(r.x_m, r.y_m) for r in J.outside_boxes(t, boxes, cell).collect()} == want


def test_unseen_spacing(spark):
    h = spark.createDataFrame([("a", 5.0), ("b", 5.0049), ("c", 2.5)], "granule_id string, px_m double")
    seen = h.where("granule_id = 'a'")
    assert [r.granule_id for r in FL.unseen_spacing(h, seen).collect()] == ["c"]
    with pytest.raises(ValueError, match="spacing"):
        FL.guard_spacing(h, seen)
    assert FL.guard_spacing(h, seen, allow_unseen=True) is h
    with pytest.raises(ValueError, match="retrain"):
        FL.guard_policy({"looks": 1}, {"looks": 4})


def test_sidecar_must_match(spark):
    a = spark.createDataFrame([(1, 2)], "k int, a int")
    assert J.attach_sidecar(a, spark.createDataFrame([(1, 3)], "k int, b int"), ["k"]).first().b == 3
    with pytest.raises(Exception, match="different tile set"):
        J.attach_sidecar(a, spark.createDataFrame([(2, 3)], "k int, b int"), ["k"]).collect()


def test_label_union_rules(spark):
    s = "k int, label string, note string"
    a = spark.createDataFrame([(1, "p", "first"), (2, "p", "first")], s)
    b = spark.createDataFrame([(1, "p", "second"), (2, "n", "second"), (3, "n", "second")], s)
    got = {r.k: (r.label, r.note) for r in L.union_labels([a, b], ["k"], "label").collect()}
    assert got == {1: ("p", "first"), 3: ("n", "second")}


def test_catalog_of_files(spark, tmp_path):
    for n in ("A_GSLC_025_019_x.tif", "B_GSLC_025_091_x.tif", "notes.txt"):
        (tmp_path / n).write_bytes(b"x" * 10)
    assert {r.granule_id for r in CT.scan_granules(spark, str(tmp_path)).collect()} == {"025_019", "025_091"}
    (tmp_path / "C_GSLC_025_019_y.tif").write_bytes(b"y")
    with pytest.raises(Exception, match="ambiguous granule id"):
        CT.scan_granules(spark, str(tmp_path)).collect()
    amb = CT.scan_granules(spark, str(tmp_path), strict=False).where("ambiguous").collect()
    assert [(r.granule_id, r.n_files) for r in amb] == [("025_019", 2)]


def test_malformed_scene_name(spark):
    d = spark.createDataFrame([("BIO_S1_SCS__1S_20250304T1_X_M07_Y",)], "name string")
    r = CT.parse_scene(d).first()
    assert (r.stack, str(r.acq_date), r.foot) == ("S1", "2025-03-04", "M07")
    with pytest.raises(Exception, match="cannot read stack"):
        CT.parse_scene(spark.createDataFrame([("other",)], "name string")).collect()


def test_score_csv_text(spark, tmp_path):
    d = spark.createDataFrame([("a.tif", 0, 512, 1.0, -2.0, 0.25, None), ("a.tif", 0, 0, 1.0, -2.0, None, None)],
                              "granule_id string, row int, col int, x_m double, y_m double, p_rf double, p_cnn double")
    TB.write_score_csv(d.coalesce(1), str(tmp_path / "o"), ["rf", "cnn"], {"rf": 0.2})
    f = [x for x in os.listdir(tmp_path / "o") if x.endswith(".csv")][0]
    lines = (tmp_path / "o" / f).read_text().splitlines()
    assert lines == ["granule,row,col,x_m,y_m,p_rf,p_cnn,flag_rf", "a,0,512,1.0,-2.0,0.2500,,1"]


def test_target_checks_fail_on_binary_target(spark):
    d = spark.createDataFrame([(0.0,), (1.0,), (None,)], "t double")
    r = {x.name: x.status for x in C.target_checks(d, "t").collect()}
    assert r == {"no NaN in targets": "fail", "targets in [0,1]": "ok", "target is continuous": "fail"}


def separable(spark, n=400):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, n)
    rows = [(i, int(y[i]), float(y[i] + rng.normal() * 0.4), float(rng.normal()), float(rng.random() * 1e5), float(-rng.random() * 1e5)) for i in range(n)]
    return spark.createDataFrame(rows, "k int, y int, f double, g double, x_m double, y_m double").persist()


def test_gate_model_beats_coordinates_and_keeps_rows(spark, tmp_path):
    d = separable(spark).withColumn("fold", F.col("k") % 3)
    small = {"numTrees": 15, "maxDepth": 4}
    o = MD.out_of_fold(d, "fold", ["f", "g"], **small)
    c = MD.out_of_fold(d, "fold", ["x_m", "y_m"], **small)
    from gridscan.operators.metrics import auc
    assert auc(o, "oof", "y").first().auc > 0.9 > 0.65 > auc(c, "oof", "y").first().auc
    m = MD.fit_gate(d, ["f", "g"], **small)
    holes = d.withColumn("f", F.when(F.col("k") % 5 != 0, F.col("f")))
    s = MD.score_tiles(holes, m, ["f", "g"]).toPandas()
    assert len(s) == 400 and (s.p.isna() == (s.k % 5 == 0)).all()
    MD.save_bundle(spark, m, {"threshold": 0.3, "features": ["f", "g"]}, str(tmp_path / "b"))
    m2, b = MD.load_bundle(spark, str(tmp_path / "b"))
    assert b["threshold"] == 0.3
    again = MD.score_tiles(d, m2, b["features"]).orderBy("k").toPandas().p
    np.testing.assert_array_equal(again, MD.score_tiles(d, m, ["f", "g"]).orderBy("k").toPandas().p)


def test_side_by_side_needs_every_threshold(spark):
    d = separable(spark)
    with pytest.raises(ValueError, match="own threshold"):
        MD.score_side_by_side(d, {"a": lambda x: x, "b": lambda x: x}, {"a": 0.5})


def test_stream_of_small_batches_equals_batch(spark, tmp_path):
    rows = [(i, i % 7, i % 5, float(i % 11)) for i in range(200)]
    d = spark.createDataFrame(rows, "event_id int, gi int, gj int, v double").withColumn(
        "arrival", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") * 60))
    src = str(tmp_path / "in")
    d.repartition(4).write.parquet(src)
    s = AR.read_arrivals(spark, src, d.schema, files_per_batch=1)
    out = scratch_path(spark, "t")
    AR.run(AR.updates_to(AR.running_mosaic(s, F.col("gi"), F.col("gj"), "v"), f"{out}/u", f"{out}/c"))
    got = {(r.gi, r.gj): (round(r["mean"], 9), r.passes) for r in AR.latest(spark, f"{out}/u", ["gi", "gj"]).collect()}
    want = {(r.gi, r.gj): (round(r.m, 9), r.n) for r in d.groupBy("gi", "gj").agg(F.avg("v").alias("m"), F.count("v").alias("n")).collect()}
    assert got == want
    dup = AR.drop_redelivered(AR.read_arrivals(spark, src, d.schema, files_per_batch=1), ["gi", "gj"], delay="10 days")
    AR.run(AR.append_to(dup, f"{out}/d", f"{out}/dc"))
    assert spark.read.parquet(f"{out}/d").count() == len(want)


def test_presets(spark):
    from gridscan.plans import presets as P
    with pytest.raises(ValueError, match="unknown raster kind"):
        P.preset("other")
    with pytest.raises(ValueError, match="missing"):
        P.checked_pixels(spark.createDataFrame([(1.0, 2.0)], "hh double, vv double"), "quad_pol")
    px = spark.createDataFrame([(0.0,), (float("nan"),), (3.0,)], "v double")
    assert [r.v for r in P.checked_pixels(px, "single_pol").collect()] == [None, None, 3.0]
    with pytest.raises(Exception, match="not dB"):
        P.checked_pixels(spark.createDataFrame([(-12.0,)], "v double"), "single_pol").collect()
    with pytest.raises(ValueError, match="no default threshold"):
        P.build("quad_pol", F.col("p"), F.col("p"), {"threshold": 0.3})
    run = P.build("single_pol", F.col("p"), F.col("p"), {"threshold": 0.5})
    assert run(stack(spark)).count() == 12


def test_group_folds_are_stratified(spark):
    """Whole groups in one fold, each class shared out evenly, also when all groups are of one size."""
    import numpy as np
    from gridscan.operators.splits import group_folds
    rng = np.random.default_rng(3)
    rows = [(int(g), int(i), int(rng.random() < (0.9 if g % 7 == 0 else 0.05))) for g in range(140) for i in range(20)]
    d = group_folds(spark.createDataFrame(rows, "g int, i int, y int"), 5, ["g"]).toPandas()
    assert len(d) == len(rows) and (d.groupby("g").fold.nunique() == 1).all()
    share = d.groupby("fold").y.sum() / d.y.sum()
    assert (abs(share - 0.2) < 0.02).all() and (abs(d.groupby("fold").size() / len(d) - 0.2) < 0.02).all()


def test_out_of_fold_keeps_rows_without_a_fold(spark):
    from gridscan.operators.models import out_of_fold
    d = spark.range(90).selectExpr("id", "id % 2 y", "cast(id % 2 + rand(1) as double) f", "if(id < 10, null, id % 3) fold")
    got = out_of_fold(d, "fold", ["f"], numTrees=3, maxDepth=2)
    assert got.count() == 90 and got.where("oof IS NULL").count() == 10
    assert out_of_fold(d.where("false"), "fold", ["f"]).count() == 0
