"""Blocked layouts: windows and surviving tiles prune files; overlapping reads own each pixel once."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridscan.plans import cascade as CA
from gridscan.plans.lineage import stored
from gridscan.schema import TILE
from gridscan.sources import raster as R

TS = 16


def files_read(df):
    """Files that the scans of partitioned tables open when `df` runs, and how many of these scans prune while running."""
    df.collect()
    found = []

    def walk(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        if "QueryStage" in name:
            return walk(p.plan())
        if name.startswith("Scan parquet") and "PartitionFilters: []" not in (text := p.verboseStringWithOperatorId()) and "PartitionFilters" in text:
            found.append((p.metrics().apply("numFiles").value(), "dynamicpruning" in text.lower()))
        for k in range(p.children().size()):
            walk(p.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.fixture(scope="module")
def raster(spark, tmp_path_factory):
    """Three granules of 96 x 80 pixels in blocks of 16, the third without data."""
    rng = random.Random(9)
    rows = [(g, r, c, None if g == "c" or rng.random() < 0.1 else float(rng.randrange(1, 1000) * (20 if (r // 16 + c // 16) % 3 == 0 else 1)), rng.randrange(2))
            for g in "abc" for r in range(96) for c in range(80)]
    px = spark.createDataFrame(rows, "granule_id string, r int, c int, v double, cls int")
    path = str(tmp_path_factory.mktemp("px") / "t")
    R.write_pixels(px, path, block=16)
    heads = spark.createDataFrame([(g, 96, 80, 5.0, 0.0, 0.0) for g in "abc"], "granule_id string, height int, width int, px_m double, origin_x double, origin_y double")
    return rows, spark.read.parquet(path), heads


def test_windows_prune_files(spark, raster):
    rows, px, _ = raster
    w = spark.createDataFrame([("a", 10, 20, 9, 12), ("b", 90, -5, 12, 9), ("b", 40, 40, 0, 5), ("x", 0, 0, 4, 4)], "granule_id string, row int, col int, h int, w int")
    got = R.read_windows(px, stored(w, "windows"), block=16)
    want = {(g, r, c): v for g, r, c, v, _ in rows}
    cells = [(g, r, c) for g, r0, c0, h, k in [tuple(x) for x in w.collect()] for r in range(r0, r0 + h) for c in range(c0, c0 + k)]
    assert Counter((r.granule_id, r.r, r.c, r.v) for r in got.collect()) == Counter((*k, want.get(k) or 0.0) for k in cells)
    scans = files_read(got)
    assert len(scans) == 1 and scans[0][1]
    # Each partition column prunes on its own: granules a and b, block rows 0, 1 and 5, so six of the 18 partitions.
    everything = len(px.select(F.input_file_name().alias("f")).distinct().collect())
    assert 0 < scans[0][0] <= everything / 3


def test_no_windows_read_nothing(spark, raster):
    w = spark.createDataFrame([], "granule_id string, row int, col int, h int, w int")
    assert R.read_blocks(raster[1], w, 16).collect() == []


def gate():
    return F.try_divide(F.count_if(F.col("v") > 3000), F.count("v"))


def share_of_peak(pix):
    top = pix.groupBy(*TILE).agg(F.max("v").alias("top"))
    return pix.join(top, TILE).withColumn("seg", F.col("v") / F.col("top"))


def test_surviving_tiles_prune_files(spark, raster):
    _, px, heads = raster
    tiles, seg, _ = CA.scan_granule(px, heads, TS, 4, gate(), share_of_peak, 0.5, 0.5, block=16)
    flagged = tiles.where("gate_flag").count()
    assert 0 < flagged < tiles.count()
    plain_tiles, plain_seg, _ = CA.scan_granule(px, heads, TS, 4, gate(), share_of_peak, 0.5, 0.5)
    assert sorted(map(tuple, tiles.select(plain_tiles.columns).collect())) == sorted(map(tuple, plain_tiles.collect()))
    assert seg.select("granule_id", "r", "c", "seg").exceptAll(plain_seg.select("granule_id", "r", "c", "seg")).isEmpty()
    assert any(pruned for _, pruned in files_read(seg))


@pytest.mark.parametrize("margin", [1, 3, 5, 6, 7])
def test_every_pixel_of_the_area_has_one_owner(spark, raster, margin):
    """The owner's own part of a read, as `center_crop` has it; where such parts overlap, the later read."""
    _, px, heads = raster
    pos = spark.createDataFrame([("a", 3, 5), ("a", 67, 37), ("b", 80, 64)], "granule_id string, row int, col int")
    reads = CA.overlapped_reads(pos, heads, TS, margin).collect()
    last = {}
    for q in sorted(reads, key=lambda q: (q.granule_id, q.row, q.col)):
        for r in range(q.row + q.top, min(q.row + q.bottom, 96)):
            for c in range(q.col + q.left, min(q.col + q.right, 80)):
                last[q.granule_id, r, c] = (q.row, q.col)
    area = spark.createDataFrame(list({(q.granule_id, q.row_min, q.row_max, q.col_min, q.col_max) for q in reads}), "granule_id string, row_min int, row_max int, col_min int, col_max int")
    own = CA.full_grid(heads.where("granule_id < 'c'"), 32).join(area, "granule_id").select(
        "granule_id", "r", "c", CA.owner("r", "row_min", "row_max", TS, margin).alias("row"), CA.owner("c", "col_min", "col_max", TS, margin).alias("col"))
    got = {(x.granule_id, x.r, x.c): (x.row, x.col) for x in own.where("row IS NOT NULL AND col IS NOT NULL").collect()}
    assert got == last


@pytest.mark.parametrize("block", [None, 16])
def test_export_with_a_margin(spark, raster, block):
    rows, px, heads = raster
    margin, stride = 4, TS - 8
    out = CA.export_granule(px, heads, TS, 4, gate(), share_of_peak, 0.5, margin=margin, grid_block=32, min_valid=0.5, mask="cls", min_grounded=0.4, block=block).collect()
    assert len(out) == 3 * 96 * 80
    value = {(g, r, c): v for g, r, c, v, _ in rows}
    reads = {(x.granule_id, x.row, x.col) for x in out if x.gate_prob is not None}
    rejected = 0
    for g, row, col in reads:
        inside = [value[g, r, c] for r in range(row, min(row + TS, 96)) for c in range(col, min(col + TS, 80)) if value[g, r, c]]
        p = sum(v > 3000 for v in inside) / len(inside)
        assert len(inside) >= TS * TS / 2 and row % stride == col % stride == 0
        rejected += p < 0.5
        for x in (x for x in out if (x.granule_id, x.row, x.col) == (g, row, col)):
            v = value[g, x.r, x.c]
            assert x.gate_prob == pytest.approx(p) and x.seg == (pytest.approx(v / max(inside)) if v and p >= 0.5 else None)
            # Values come from the inside of a read wherever another read follows or goes before.
            assert x.r - row >= margin or row == 0
            assert row + TS - x.r > margin or row + stride >= 96
    assert 0 < rejected < len(reads)
    assert all(x.gate_prob is None and x.seg is None and x.row is None for x in out if x.granule_id == "c")


def test_margin_must_fit(raster):
    with pytest.raises(ValueError):
        CA.owner("r", "row_min", "row_max", TS, 8)
