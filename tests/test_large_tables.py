"""Work that must not grow faster than its tables: jobs, files and partitions, on small tables."""

import random
import re

import pytest
from pyspark.sql import functions as F


def test_fold_fits_share_their_rows(spark, tmp_path):
    """Scores are those of one fit per fold over its own training rows, at a few jobs a fit."""
    from gridscan.operators import models as MD
    from gridscan.operators.splits import buffered_folds, fold_test, fold_train
    rng = random.Random(3)
    rows = [(i, 100.0 * (i % 20), 100.0 * (i // 20), rng.random() if i % 7 else None, rng.randrange(2)) for i in range(400)]
    d = spark.createDataFrame(rows, "id long, x_m double, y_m double, e double, y int").coalesce(1)
    params = {"numTrees": 3, "maxDepth": 2}
    ran = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = ran()
    got = {r.id: (r.a, r.b) for r in MD.buffered_out_of_fold(d, 1000.0, 100.0, {"a": ["e", "x_m"], "b": ["x_m", "y_m"]}, **params).collect()}
    jobs = ran() - before
    folds = buffered_folds(d, 1000.0, 100.0).collect()
    assert len(folds) == 4 and len(got) == 400
    f = folds[0]
    for n, (name, feats) in enumerate((("a", ["e", "x_m"]), ("b", ["x_m", "y_m"]))):
        want = MD.score_tiles(fold_test(d, f, 1000.0), MD.fit_gate(fold_train(d, f), feats, **params), feats, name).collect()
        assert any(r[name] is not None for r in want)
        assert all(got[r.id][n] == (None if r[name] is None else pytest.approx(r[name])) for r in want)
    assert jobs <= 9 * 2 * len(folds)


def test_folds_share_their_code_and_read_few_partitions(spark):
    """A second table with other boxes compiles next to nothing, 16 small partitions are not 16 tasks a job; every fold has its own rows."""
    from gridscan.operators import models as MD
    from gridscan.operators.splits import buffered_folds, fold_test, fold_train
    compiled = lambda: spark._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME().getCount()
    st, params, feats = spark.sparkContext.statusTracker(), {"numTrees": 2, "maxDepth": 1}, ["e", "x_m"]
    for shift in (0.0, 37.0):
        rng = random.Random(4)
        rows = [(i, 100.0 * (i % 20) + shift if i != 5 else None, 100.0 * (i // 20) + shift, rng.random() if i % 7 else None, rng.randrange(2) if i % 11 else None) for i in range(400)]
        d = spark.createDataFrame(rows, "id long, x_m double, y_m double, e double, y int").repartition(16, "id").persist()
        folds = buffered_folds(d, 500.0, 100.0).orderBy("bx", "by").collect()
        code, jobs = compiled(), set(st.getJobIdsForGroup(None))
        got = MD.buffered_out_of_fold(d, 500.0, 100.0, {"a": feats}, **params)
        code, jobs = compiled() - code, set(st.getJobIdsForGroup(None)) - jobs
        got = {r.id: (r.fold, r.a) for r in got.collect()}
    assert len(folds) == 16 and code <= 3 * len(folds)
    assert sum(st.getStageInfo(s).numCompletedTasks for s in {s for j in jobs for s in st.getJobInfo(j).stageIds}) <= 40 * len(folds)
    one = d.coalesce(1)
    for i in (1, len(folds) - 1):
        want = MD.score_tiles(fold_test(one, folds[i], 500.0), MD.fit_gate(fold_train(one, folds[i]), feats, **params), feats, "a").collect()
        assert any(r.a is not None for r in want) and any(r.a is None for r in want)
        assert all(got[r.id] == (i, None if r.a is None else pytest.approx(r.a)) for r in want)


def test_tiles_beyond_the_context_grid_stay(spark, sf, tmp_path):
    """j02_context_centre against its SQL where the map outgrows the six rows of the context grid."""
    from oracle import compare, connect
    from gridscan.queries import ORACLE, QUERIES
    for name in ("part", "embeddings"):
        d = spark.read.parquet(f"{sf}/{name}.parquet")
        if name == "embeddings":
            d = d.unionByName(d.withColumn("vec_id", F.col("vec_id") + 14900))
        d.coalesce(1).write.parquet(str(tmp_path / "t" / name))
        next((tmp_path / "t" / name).glob("part-*.parquet")).rename(tmp_path / f"{name}.parquet")
    assert spark.read.parquet(str(tmp_path / "embeddings.parquet")).where("vec_id >= 15000").count() > 0
    con = connect(str(tmp_path))
    assert compare(spark, con, str(tmp_path), QUERIES["j02_context_centre"], ORACLE["j02_context_centre"]) is None


def many_granules(spark, n, side=32):
    return spark.range(n * side * side).select(F.concat(F.lit("g"), F.floor(F.col("id") / side ** 2).cast("string")).alias("granule_id"),
                                               (F.floor(F.col("id") / side) % side).cast("int").alias("r"), (F.col("id") % side).cast("int").alias("c"), F.rand(1).alias("v"))


def test_files_follow_blocks_not_granules(spark, tmp_path):
    """Three times the granules in the same number of files; a window still reads few of them."""
    from gridscan.sources import raster as R
    files = {}
    for n in (100, 300):
        R.write_pixels(many_granules(spark, n), str(tmp_path / str(n)), block=16)
        files[n] = len(list((tmp_path / str(n)).rglob("*.parquet")))
    assert max(files.values()) <= 2 * 2 * R.PARTS
    d = spark.read.parquet(str(tmp_path / "300"))
    got = R.read_window(d, "g7", 20, 3, 8, 30, block=16)
    assert got.count() == 8 * 29 and d.count() == 300 * 1024
    assert got.select(F.input_file_name()).distinct().count() <= 2


def test_a_task_has_a_bounded_part_of_a_dense_raster(spark, monkeypatch):
    """Partitions grow with the raster and are not put together again."""
    from gridscan.operators import stencil as ST
    from gridscan.operators.grid import tile_grid
    if hasattr(ST, "TASK_PIXELS"):
        monkeypatch.setattr(ST, "TASK_PIXELS", 4096)
    for n in (40, 120):
        d = many_granules(spark, n)
        heads = d.select("granule_id").distinct().select("granule_id", F.lit(32).alias("height"), F.lit(32).alias("width"))
        dense = ST.densify(tile_grid(heads, 16).select("granule_id", "row", "col"), d, 16, ["v"], (0, 0))
        per_task = [r["count"] for r in dense.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(per_task) == n * 1024 and max(per_task) <= 4 * 4096
        parts = dense.rdd.getNumPartitions()
        assert parts >= n * 1024 / 4096


def test_granule_suite_reads_its_bands_twice(spark, tmp_path):
    """Few scans whatever the checks; bands without a common pixel fail the reciprocity check instead of leaving no row."""
    from gridscan.operators.checks import granule_suite
    d = many_granules(spark, 2).select("granule_id", "r", "c", *[F.when((F.col("granule_id") == "g0") | (F.col("c") % 2 == k % 2), F.col("v") + 1).alias(b) for k, b in enumerate(("hh", "vv", "hv", "vh"))])
    d.write.parquet(str(tmp_path / "w"))
    w = spark.read.parquet(str(tmp_path / "w"))
    heads = spark.createDataFrame([(g, 5.0, 0.0, 0.0, 3031) for g in ("g0", "g1")], "granule_id string, px_m double, origin_x double, origin_y double, epsg int")
    rep = granule_suite(w, heads, w.withColumn("cls", F.lit(1)), (0.0, 0.0), 16)
    got = {(r.granule_id, r.name): r.status for r in rep.collect()}
    assert len(got) == 14
    assert all(got["g1", f"reciprocity {n}"] == "fail" and got["g0", f"reciprocity {n}"] == "ok" for n in ("hh/vv", "hv/vh"))
    # Bands once here (the tile table is stored by now), and the mask, which stands on the same file.
    assert len(re.findall(r"Relation \[[^]]*hh#", rep._jdf.queryExecution().optimizedPlan().toString())) == 2


def test_a_shard_reads_its_pixels_once(spark, tmp_path):
    from gridscan.operators.grid import with_tile
    from gridscan.sources import tables as T
    many_granules(spark, 2).withColumn("cls", (F.col("c") % 3 == 0).cast("int")).write.parquet(str(tmp_path / "p"))
    px = spark.read.parquet(str(tmp_path / "p"))
    labels = spark.createDataFrame(with_tile(px, 16).select("granule_id", "row", "col").distinct().withColumn("pf", F.lit(1.0)).collect())
    d = T.pack_shard(labels, px, 16, "v", "cls", ["pf"])
    assert all(r.coverage == pytest.approx(sum(r.cls) / 256) and r.n == 256 for r in d.collect()) and d.count() == 8
    assert len(re.findall(r"Relation \[[^]]*cls#", d._jdf.queryExecution().optimizedPlan().toString())) == 1
