"""Leakage-safe splits and fold tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridscan.functions.stats import n_true
from gridscan.operators.filters import assert_not_empty
from gridscan.operators.joins import outside_boxes, outside_tiles
from gridscan.plans.ordering import hash_position, order_key, position_in_bins, running_totals, value_bin, value_position
from gridscan.schema import SEED


def tile_blocks(df: DataFrame, b: int, row: str = "ti", col: str = "tj") -> DataFrame:
    """Block of b x b tiles inside a granule."""
    return df.withColumn("br", F.floor(F.col(row) / b)).withColumn("bc", F.floor(F.col(col) / b))


def map_blocks(df: DataFrame, block_m: float, x: str = "x_m", y: str = "y_m") -> DataFrame:
    """Block of the shared map, across granules."""
    return df.withColumn("bx", F.floor(F.col(x) / block_m)).withColumn("by", F.floor(F.col(y) / block_m))


def random_split(df: DataFrame, train: float, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """Exactly int(n * train) rows in train, in seeded order."""
    d = hash_position(df, [], seed, key, "_rn", total="_all")
    part = F.when(F.col("_rn") <= F.floor(F.col("_all") * train), "train").otherwise("val")
    return d.withColumn("part", part).drop("_rn", "_all")


def band_split(df: DataFrame, train: float, buffer: int = 1, by: Sequence[str] = (), row: str = "ti", col: str = "tj") -> DataFrame:
    """Contiguous band along the longer axis, with `buffer` tiles between the sides; tiles in between are dropped."""
    rng = df.groupBy(*by).agg((F.max(row) - F.min(row)).alias("_h"), (F.max(col) - F.min(col)).alias("_w"))
    if by:
        d = df.join(rng, list(by))
    else:
        d = df.withColumn("_x", rng.select(F.struct("_h", "_w")).scalar()).select("*", "_x._h", "_x._w").drop("_x")
    d = d.withColumn("coord", F.when(F.col("_h") >= F.col("_w"), F.col(row)).otherwise(F.col(col)).cast("long"))
    d = position_in_bins(d.drop("_h", "_w"), by, F.coalesce("coord", F.lit(0)), ["coord", row, col], "_rn", total="_all")
    d = d.withColumn("part", F.when(F.col("_rn") <= F.floor(F.col("_all") * train), "train").otherwise("val")).drop("_rn", "_all")
    edge = d.where("part = 'val'").groupBy(*by).agg(F.min("coord").alias("_edge"))
    d = d.join(edge, list(by), "left") if by else d.withColumn("_edge", edge.select("_edge").scalar())
    ok = (F.col("part") == "val") | F.col("_edge").isNull() | (F.lit(buffer) <= 0) | (F.col("coord") < F.col("_edge") - buffer)
    return d.where(ok).drop("_edge")


def _fill_blocks(blocks: DataFrame, order: str, n: str, quota: Column) -> DataFrame:
    """Blocks in order until the quota is reached: a block counts when the ones before it fall short."""
    r = running_totals(blocks, [], order, [n])
    return r.where(F.col(f"cum_{n}") - F.col(n) < quota)


def block_split(df: DataFrame, train: float, strat: str, block_tiles: int = 3, buffer: int = 1, seed: int = SEED,
                key: Sequence[str] = ("granule_id",)) -> DataFrame:
    """Hold out every k-th block down a difficulty ordering until the quota is met, then cut a tile buffer."""
    k = max(round(1.0 / max(1.0 - train, 1e-9)), 2)
    d = tile_blocks(df, block_tiles)
    blk = d.groupBy(*key, "br", "bc").agg(F.count(F.lit(1)).alias("n"), F.avg(strat).alias("_s"))
    blk = value_position(blk, [], "_s", [*key, "br", "bc"], "_i", total="_nb")
    i = F.col("_i") - 1
    blk = blk.withColumn("_o", F.when(i % k == seed % k, i).otherwise(i + F.col("_nb")))
    val = _fill_blocks(blk, "_o", "n", (1.0 - train) * F.col("all_n")).select(*key, "br", "bc", F.lit(True).alias("_val"))
    d = d.join(val, [*key, "br", "bc"], "left")
    v, t = d.where(F.col("_val")), d.where(F.col("_val").isNull())
    if buffer > 0:
        t = outside_tiles(t, v, buffer, key)
    return t.withColumn("part", F.lit("train")).unionByName(v.withColumn("part", F.lit("val"))).drop("_val", "br", "bc")


def buffered_split(df: DataFrame, val: float, block_m: float, buffer_m: float, seed: int = SEED) -> DataFrame:
    """Seeded blocks until the quota is met; train loses every tile inside a val block's nominal box + buffer."""
    d = map_blocks(df, block_m)
    blk = d.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n")).withColumn("_h", order_key(seed, "bx", "by"))
    blk = position_in_bins(blk, [], F.coalesce(F.substring("_h", 1, 2), F.lit("")), ["_h", "bx", "by"], "_o")
    got = _fill_blocks(blk, "_o", "n", F.bround(val * F.col("all_n"))).select("bx", "by")
    boxes = got.select((F.col("bx") * block_m - buffer_m).alias("x0"), ((F.col("bx") + 1) * block_m + buffer_m).alias("x1"),
                       (F.col("by") * block_m - buffer_m).alias("y0"), ((F.col("by") + 1) * block_m + buffer_m).alias("y1"))
    v = d.join(got, ["bx", "by"], "left_semi")
    t = outside_boxes(d.join(got, ["bx", "by"], "left_anti"), boxes, block_m + 2 * buffer_m)
    return t.withColumn("part", F.lit("train")).unionByName(v.withColumn("part", F.lit("val"))).drop("bx", "by")


def buffered_folds(df: DataFrame, block_m: float, buffer_m: float, y: str = "y", min_test: int = 20, min_class: int = 30) -> DataFrame:
    """One fold per usable block: its occupied extent grown by the buffer, and the class counts on both sides.

    The train side of a fold is "everything outside the box", so it is described by the box rather than
    materialised folds x tiles times; its class counts are totals minus what lies inside, and "inside" is
    an equi-join on box-sized cells.
    """
    d = map_blocks(df, block_m)
    pos, neg = n_true(F.col(y) == 1), n_true(F.col(y) == 0)
    blk = d.groupBy("bx", "by").agg(
        F.count(F.lit(1)).alias("n_test"), pos.alias("test_pos"), neg.alias("test_neg"),
        (F.min("x_m") - buffer_m).alias("x0"), (F.max("x_m") + buffer_m).alias("x1"),
        (F.min("y_m") - buffer_m).alias("y0"), (F.max("y_m") + buffer_m).alias("y1"))
    blk = blk.where((F.col("n_test") >= min_test) & (F.col("test_pos") > 0) & (F.col("test_neg") > 0))
    cell = block_m + 2 * buffer_m

    def k(v):
        return F.floor(v / cell)
    b = blk.withColumn("_cx", F.explode(F.sequence(k(F.col("x0")), k(F.col("x1"))))).withColumn(
        "_cy", F.explode(F.sequence(k(F.col("y0")), k(F.col("y1")))))
    p = df.select(F.col("x_m").alias("_x"), F.col("y_m").alias("_y"), F.col(y).alias("_lab")).groupBy("_x", "_y").agg(
        n_true(F.col("_lab") == 1).alias("_p"), n_true(F.col("_lab") == 0).alias("_n"))
    p = p.withColumn("_cx", k(F.col("_x"))).withColumn("_cy", k(F.col("_y")))
    near = b.join(p, ["_cx", "_cy"]).where(F.col("_x").between(F.col("x0"), F.col("x1")) & F.col("_y").between(F.col("y0"), F.col("y1")))
    near = near.groupBy("bx", "by").agg(F.sum("_p").alias("_np"), F.sum("_n").alias("_nn"))
    tot = df.agg(F.struct(pos.alias("p"), neg.alias("n"))).scalar()
    out = blk.join(near, ["bx", "by"]).withColumn("_t", tot)
    out = out.withColumn("train_pos", F.col("_t.p") - F.col("_np")).withColumn("train_neg", F.col("_t.n") - F.col("_nn"))
    return out.where((F.col("train_pos") >= min_class) & (F.col("train_neg") >= min_class)).drop("_t", "_np", "_nn")


def fold_test(df: DataFrame, fold, block_m: float) -> DataFrame:
    """Test rows of one fold row."""
    d = map_blocks(df, block_m)
    return d.where((F.col("bx") == fold["bx"]) & (F.col("by") == fold["by"])).drop("bx", "by")


def outside_fold(fold) -> Column:
    return ~(F.col("x_m").between(fold["x0"], fold["x1"]) & F.col("y_m").between(fold["y0"], fold["y1"]))


def fold_train(df: DataFrame, fold) -> DataFrame:
    """Train rows of one fold row: a filter against its box, pushed down to the scan."""
    return df.where(outside_fold(fold))


def leave_one_out(df: DataFrame, group: str, y: str = "y", min_train: int = 1) -> DataFrame:
    """One fold per group with its class counts; single-class folds are marked unusable."""
    pos, neg = n_true(F.col(y) == 1), n_true(F.col(y) == 0)
    tot = df.agg(F.struct(pos.alias("p"), neg.alias("n"))).scalar()
    g = df.groupBy(group).agg(pos.alias("test_pos"), neg.alias("test_neg")).withColumn("_t", tot)
    g = g.withColumn("train_pos", F.col("_t.p") - F.col("test_pos")).withColumn("train_neg", F.col("_t.n") - F.col("test_neg")).drop("_t")
    return g.withColumn("usable", (F.col("test_pos") > 0) & (F.col("test_neg") > 0)
                        & (F.col("train_pos") >= min_train) & (F.col("train_neg") >= min_train))


def stratified_folds(df: DataFrame, k: int, key: Sequence[str], y: str = "y", seed: int = SEED) -> DataFrame:
    """Fold = seeded position inside the class, modulo k."""
    d = hash_position(df, [y], seed, key, "_rn")
    return d.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_rn")


def group_folds(df: DataFrame, k: int, group: Sequence[str], y: str = "y", seed: int = SEED) -> DataFrame:
    """Stratified group folds: whole groups, dealt back and forth (0..k-1, k-1..0, ...) by falling class counts.

    Groups go by positives, then by other rows, then in seeded order, so each fold gets its share of the groups
    rich and poor in positives.  Only the group table is ranked, and groups of equal counts share no single bin.
    """
    pos = n_true(F.col(y) == 1)
    g = df.groupBy(*group).agg(pos.alias("_p"), (F.count(F.lit(1)) - pos).alias("_n")).withColumn("_h", order_key(seed, *group))
    bins = F.struct((-value_bin(F.col("_p"))).alias("p"), (-value_bin(F.col("_n"))).alias("n"), F.substring("_h", 1, 1).alias("h"))
    g = position_in_bins(g, [], bins, ["_h", *group], "_rn")
    i = (F.col("_rn") - 1) % (2 * k)
    g = g.withColumn("fold", F.when(i < k, i).otherwise(2 * k - 1 - i).cast("int")).select(*group, "fold")
    return df.join(g, list(group))


def check_split(df: DataFrame, by: Sequence[str] = (), coord: str = "coord") -> DataFrame:
    """Sizes of both sides and the gap between them along the split axis."""
    tr, va = F.col("part") == "train", F.col("part") == "val"
    return df.groupBy(*by).agg(n_true(tr).alias("n_train"), n_true(va).alias("n_val"),
                               (F.min(F.when(va, F.col(coord))) - F.max(F.when(tr, F.col(coord)))).alias("gap"))


def require_both_sides(df: DataFrame) -> DataFrame:
    for side in ("train", "val"):
        assert_not_empty(df.where(F.col("part") == side), f"the split has no {side} tiles")
    return df
