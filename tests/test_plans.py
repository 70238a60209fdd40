"""Physical plans: shuffles, join kinds, pruning."""

from pyspark.sql import functions as F

from gridscan.operators import filters as FL
from gridscan.operators import stencil as ST
from gridscan.operators.features import tile_features
from gridscan.operators.grid import with_tile
from gridscan.sources import raster as R

def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def pixels(spark, n=64):
    d = spark.range(n * n).select(F.when(F.col("id") >= 0, "g").alias("granule_id"), (F.col("id") / n).cast("int").alias("r"), (F.col("id") % n).cast("int").alias("c"))
    return d.withColumn("v", F.rand(1) + 1)


def test_stencil_chain_is_one_shuffle(spark):
    d = ST.by_tile(with_tile(pixels(spark), 16))
    d = ST.wiener(ST.lee(d, "v", 5, 16).select("granule_id", "row", "col", "r", "c", "v", "lee"), "lee", 5, 16)
    assert plan(d).count("Exchange") == 1


def test_all_38_features_are_one_shuffle(spark):
    d = with_tile(pixels(spark), 16)
    for b in ("hh", "hv", "vh", "vv"):
        d = d.withColumn(b, F.col("v"))
    assert plan(tile_features(d, 16)).count("Exchange") == 1


def test_window_read_prunes_partitions_and_pushes_filters(spark, tmp_path):
    R.write_pixels(pixels(spark), str(tmp_path / "p"), block=16)
    p = plan(R.read_window(spark.read.parquet(str(tmp_path / "p")), "g", 20, 3, 8, 8, block=16).select("v"))
    assert "PartitionFilters: [" in p and "block_r" in p.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(c,3)" in p and "GreaterThanOrEqual(block_c,0)" in p


def test_valid_fraction_reads_only_its_columns(spark, tmp_path):
    pixels(spark).withColumn("other", F.lit("x")).write.parquet(str(tmp_path / "q"))
    p = plan(FL.valid_tiles(spark.read.parquet(str(tmp_path / "q")), 16, 0.5))
    assert "other" not in p.split("ReadSchema")[1].split("\n")[0] and p.count("Exchange") == 1


def test_top_k_per_class_is_limited_before_the_shuffle(spark):
    from gridscan.operators.sampling import per_class
    d = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("cls"), F.rand(2).alias("p"))
    assert "WindowGroupLimit" in plan(per_class(d, 5, "cls", "p", ["id"]))


def test_dense_raster_is_made_behind_the_one_shuffle_of_pixels(spark):
    """Pixels and tile keys are shuffled once each; two sorts at most for eight co-occurrence directions."""
    from gridscan.operators.features import cooccurrence
    from gridscan.operators.grid import tile_grid
    heads = spark.createDataFrame([("g", 64, 64)], "granule_id string, height int, width int")
    d = ST.densify(tile_grid(heads, 16), pixels(spark), 16, ["v"], (0, 0))
    p = plan(cooccurrence(d, "v", ts=16))
    assert p.count("Exchange hashpartitioning") == 2 and p.count(" Sort ") <= 2


def test_neighbours_by_offset_are_the_neighbours(spark):
    import pytest
    d = ST.by_tile(with_tile(pixels(spark, 24), 8)).withColumn("v", F.when(F.col("r") * 7 % 5 != 2, F.col("v")))
    for dr, dc in ((0, 1), (0, -2), (1, 1), (3, -3), (-1, 2), (7, -7), (-8, 0), (2, 9)):
        both = d.select(ST.neighbour("v", dr, dc).alias("a"), ST.neighbour_dense("v", dr, dc, 8).alias("b"))
        assert both.where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()
    with pytest.raises(Exception, match="not dense"):
        d.where("r <> 3 OR c <> 5").select(ST.neighbour_dense("v", 0, 1, 8)).collect()


def test_tiles_may_begin_anywhere_and_overlap(spark):
    tiles = spark.createDataFrame([("g", 3, 5), ("g", 11, 5), ("g", 7, 9), ("g", 60, 60), ("h", 0, 0), ("g", 3, 5)], "granule_id string, row int, col int")
    px = pixels(spark).where("(r + c) % 3 <> 0")
    got = {(x.granule_id, x.row, x.col, x.r, x.c): x.v for x in ST.densify(tiles, px, 8, ["v"]).collect()}
    known = {("g", x.r, x.c): x.v for x in px.collect()}
    want = {(g, a, b, r, c): known.get((g, r, c)) for g, a, b in {tuple(t) for t in tiles.collect()} for r in range(a, a + 8) for c in range(b, b + 8)}
    assert got == want


def test_reach_lists_no_squares(spark):
    """Chebyshev reach makes 2k + 1 rows a tile, with range frames in place of the other axis."""
    from gridscan.operators.joins import outside_tiles
    t = spark.range(400).select(F.lit("g").alias("granule_id"), (F.col("id") / 20).cast("int").alias("ti"), (F.col("id") % 20).cast("int").alias("tj"), (F.col("id") % 57 == 5).alias("val"))
    d = outside_tiles(t.where("NOT val"), t.where("val"), 3)
    marked = {(r.ti, r.tj) for r in t.where("val").collect()}
    want = {(r.ti, r.tj) for r in t.where("NOT val").collect() if all(max(abs(r.ti - a), abs(r.tj - b)) > 3 for a, b in marked)}
    assert d.columns == t.columns and {(r.ti, r.tj) for r in d.collect()} == want and want
    p = plan(outside_tiles(t.where("NOT val"), t.where("val"), 3))
    assert p.count("Generate explode") == 1 and "Join" not in p and "rangeframe" in p.lower()
