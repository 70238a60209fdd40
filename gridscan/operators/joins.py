"""Joins of tiles, pixels and context grids.

Every join here is an equi-join on a derived key.  Context tables carry no broadcast hint: Spark broadcasts
them when their measured size is under `spark.sql.autoBroadcastJoinThreshold`, and shuffles otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridscan.functions.stats import pearson
from gridscan.operators.grid import block_average, world_cell
from gridscan.schema import TILE, TILE_M


def _index(x: Column, step: int) -> Column:
    return F.floor(x / step).cast("int")


def join_context(tiles: DataFrame, ctx: DataFrame, ts: int, nrow: int, ncol: int, how: str = "left") -> DataFrame:
    """Context cell of each tile by floor index, clamped to the last row and column."""
    t = tiles.withColumn("gi", F.least(_index(F.col("row"), ts), F.lit(nrow - 1))).withColumn(
        "gj", F.least(_index(F.col("col"), ts), F.lit(ncol - 1)))
    return t.join(ctx, ["gi", "gj"], how)


def lookup_context(tiles: DataFrame, ctx: DataFrame, x: str, y: str, x0: float, y0: float, cell: float, nrow: int,
                   ncol: int, strict: bool = True) -> DataFrame:
    """Context cell under the tile centre on one fixed grid; a centre outside it stops the job.

    `strict=False`: such a tile stays, without a context.
    """
    gi, gj = world_cell(x, y, x0, y0, cell, nrow, ncol)
    if strict:
        gi = F.when(gi >= 0, gi).otherwise(F.raise_error(F.lit("a tile centre is outside the context grid")).cast("int"))
    t = tiles.withColumn("gi", gi).withColumn("gj", gj)
    return t.join(ctx, ["gi", "gj"], "left")


def shifted_join(a: DataFrame, b: DataFrame, dr: int, dc: int, value: str, key: Sequence[str] = (), fill=0,
                 out: str | None = None) -> DataFrame:
    """Raster a with raster b's value at (r+dr, c+dc); where b has nothing it reads `fill`."""
    s = b.select(*key, (F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.col(value).alias(out or value))
    return a.join(s, [*key, "r", "c"], "left").withColumn(out or value, F.coalesce(out or value, F.lit(fill)))


def regrid_nearest(target: DataFrame, source: DataFrame, value: str, t_px: float, s_px: float, key: Sequence[str],
                   dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """Source cell under each target cell centre.  (dx, dy): target origin minus source origin, in metres."""
    sr = F.floor((dy + (F.col("r") + 0.5) * t_px) / s_px).cast("int")
    sc = F.floor((dx + (F.col("c") + 0.5) * t_px) / s_px).cast("int")
    s = source.select(*key, F.col("r").alias("_sr"), F.col("c").alias("_sc"), value)
    return target.withColumn("_sr", sr).withColumn("_sc", sc).join(s, [*key, "_sr", "_sc"], "left").drop("_sr", "_sc")


def regrid_bilinear(target: DataFrame, source: DataFrame, value: str, t_px: float, s_px: float, key: Sequence[str],
                    dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """Weighted mean of the up to four source cells around each target centre; nodata cells drop out."""
    u = (dy + (F.col("r") + 0.5) * t_px) / s_px - 0.5
    w = (dx + (F.col("c") + 0.5) * t_px) / s_px - 0.5
    t = target.withColumn("_u", u).withColumn("_w", w)
    t = t.withColumn("_fu", F.col("_u") - F.floor("_u")).withColumn("_fw", F.col("_w") - F.floor("_w"))
    corners = F.array(*[
        F.struct((F.floor("_u") + i).cast("int").alias("sr"), (F.floor("_w") + j).cast("int").alias("sc"),
                 ((F.col("_fu") if i else 1 - F.col("_fu")) * (F.col("_fw") if j else 1 - F.col("_fw"))).alias("wt"))
        for i in (0, 1) for j in (0, 1)])
    e = t.select(*key, "r", "c", F.explode(corners).alias("k")).select(
        *key, "r", "c", F.col("k.sr").alias("_sr"), F.col("k.sc").alias("_sc"), F.col("k.wt").alias("_wt"))
    s = source.select(*key, F.col("r").alias("_sr"), F.col("c").alias("_sc"), F.col(value).alias("_v"))
    j = e.join(s, [*key, "_sr", "_sc"], "left")
    return j.groupBy(*key, "r", "c").agg(
        F.try_divide(F.sum(F.col("_wt") * F.col("_v")), F.sum(F.when(F.col("_v").isNotNull(), F.col("_wt")))).alias(value))


def overlap_mean(tiles: DataFrame, grid: DataFrame, ts: int, values: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """Area-weighted mean of the grid cells each tile straddles; cells outside the grid are skipped.

    The interval overlap becomes an equi-join: a tile touches at most 2 x 2 cells of its own size.
    """
    r, c = F.col("row"), F.col("col")
    e = tiles.select(*TILE).withColumn("gi", F.explode(F.sequence(_index(r, ts), _index(r + ts - 1, ts))))
    e = e.withColumn("gj", F.explode(F.sequence(_index(c, ts), _index(c + ts - 1, ts))))
    oy = F.least(r + ts, (F.col("gi") + 1) * ts) - F.greatest(r, F.col("gi") * ts)
    ox = F.least(c + ts, (F.col("gj") + 1) * ts) - F.greatest(c, F.col("gj") * ts)
    j = e.withColumn("_w", (oy * ox).cast("double")).join(grid.select(*key, "gi", "gj", *values), [*key, "gi", "gj"], "left")
    m = j.groupBy(*TILE).agg(*[
        F.try_divide(F.sum(F.col("_w") * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), F.col("_w")))).alias(v)
        for v in values])
    return tiles.join(m, TILE, "left")


def world_key(x, y, cell: float = TILE_M) -> tuple[Column, Column]:
    return F.bround(x / cell).cast("long"), F.bround(y / cell).cast("long")


def match_ground(a: DataFrame, b: DataFrame, x: str, y: str, label: str, strict: bool = False) -> DataFrame:
    """Tiles of two granules on the same ground.  `strict`: a differing label stops the job."""
    def keyed(d, s):
        kx, ky = world_key(F.col(x), F.col(y))
        return d.select(kx.alias("kx"), ky.alias("ky"), *[F.col(n).alias(f"{n}_{s}") for n in d.columns])
    m = keyed(a, "a").join(keyed(b, "b"), ["kx", "ky"])
    same = F.col(f"{label}_a") == F.col(f"{label}_b")
    if strict:
        same = F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("labels disagree on shared ground")).cast("boolean"))
    return m.withColumn("agree", same)


def holdout(labels: DataFrame, snapshot: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(train, test): keys known to the snapshot, and fresh ones."""
    s = snapshot.select(*key).distinct()
    return labels.join(s, list(key), "left_semi"), labels.join(s, list(key), "left_anti")


def outside_boxes(points: DataFrame, boxes: DataFrame, cell: float, x: str = "x_m", y: str = "y_m",
                  on: Sequence[str] = ()) -> DataFrame:
    """Points outside every box (x0, x1, y0, y1), closed on all sides.

    Each box lists the cells it touches, so the range anti-join is an equi anti-join with a residual test.
    Pick `cell` near the box size: then a box touches a handful of cells, whatever the number of boxes.
    """
    def k(v):
        return F.floor(v / cell)
    bx = boxes.select(*[F.col(o).alias(f"_o_{o}") for o in on], "x0", "x1", "y0", "y1")
    bx = bx.withColumn("_bx", F.explode(F.sequence(k(F.col("x0")), k(F.col("x1")))))
    bx = bx.withColumn("_by", F.explode(F.sequence(k(F.col("y0")), k(F.col("y1")))))
    p = points.withColumn("_px", k(F.col(x))).withColumn("_py", k(F.col(y)))
    cond = ((p["_px"] == bx["_bx"]) & (p["_py"] == bx["_by"]) & (p[x] >= bx["x0"]) & (p[x] <= bx["x1"])
            & (p[y] >= bx["y0"]) & (p[y] <= bx["y1"]))
    for o in on:
        cond = cond & (p[o] == bx[f"_o_{o}"])
    return p.join(bx, cond, "left_anti").drop("_px", "_py")


def outside_tiles(train: DataFrame, val: DataFrame, k: int, key: Sequence[str] = ("granule_id",)) -> DataFrame:
    """Train tiles more than k tiles (Chebyshev) from every val tile.

    Separable: each val tile marks its own column, 2k + 1 rows; a range frame of k to either side along each grid
    row spreads the marks, so no cell of the square around a tile is listed.
    """
    marks = val.select(*key, "ti", "tj").distinct().withColumn("ti", F.explode(F.sequence(F.col("ti") - k, F.col("ti") + k)))
    marks = marks.distinct().withColumn("_mark", F.lit(True))
    both = train.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    along = W.partitionBy(*key, "ti").orderBy("tj").rangeBetween(-k, k)
    near = both.withColumn("_near", F.max("_mark").over(along))
    return near.where(~F.col("_mark") & ~F.col("_near")).select(*train.columns)


def distance_to_positive(grid: DataFrame, positive: str, key: Sequence[str] = ("granule_id",)) -> DataFrame:
    """Euclidean distance in tiles from every cell of a dense grid to the nearest positive cell; NULL if none.

    Separable: nearest positive along each column with two window passes, then the minimum of
    (dj^2 + g^2) over the cells of each grid row, held as one short array.  A group is one row or one column
    of a granule's tile grid, never a granule.
    """
    w = W.partitionBy(*key, "tj").orderBy("ti")
    here = F.when(F.col(positive), F.col("ti"))
    up = F.last(here, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    down = F.first(here, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    g = grid.withColumn("_g", F.least(F.col("ti") - up, down - F.col("ti")).cast("double"))
    rest = [c for c in grid.columns if c not in (*key, "ti")]
    rows = g.groupBy(*key, "ti").agg(F.collect_list(F.struct(*rest, "_g")).alias("_cells"))
    rows = rows.withColumn("_src", F.filter("_cells", lambda x: x["_g"].isNotNull()))

    def with_distance(cell: Column) -> Column:
        d2 = F.array_min(F.transform("_src", lambda s: (s["tj"] - cell["tj"]) * (s["tj"] - cell["tj"]) + s["_g"] * s["_g"]))
        return F.struct(*[cell[c].alias(c) for c in rest], F.sqrt(d2).alias("dist"))
    return rows.select(*key, "ti", F.inline(F.transform("_cells", with_distance)))


def scatter_back(tiles: DataFrame, results: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """All tiles with the survivors' results; others NULL.  `results` must be unique on `key`."""
    return tiles.join(results.select(*key, *cols), list(key), "left")


def attach_sidecar(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Join a sidecar built for exactly the same tiles; a tile on one side only stops the job."""
    j = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), list(key), "full_outer")
    ok = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    bad = F.raise_error(F.lit("the sidecar was built for a different tile set"))
    return j.where(F.when(ok, F.lit(True)).otherwise(bad.cast("boolean"))).drop("_a", "_b")


def compare_tables(a: DataFrame, b: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Counts on each side, keys on one side only, and the largest absolute difference."""
    j = a.select(*key, F.col(value).alias("_a"), F.lit(1).alias("_ia")).join(
        b.select(*key, F.col(value).alias("_b"), F.lit(1).alias("_ib")), list(key), "full_outer")
    return j.agg(F.count("_ia").alias("n_a"), F.count("_ib").alias("n_b"),
                 F.count_if(F.col("_ib").isNull()).alias("only_a"), F.count_if(F.col("_ia").isNull()).alias("only_b"),
                 F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_diff"))


def compare_fields(df: DataFrame, a: str, b: str, theta_a: float, theta_b: float, by: Sequence[str] = ()) -> DataFrame:
    """Correlation, means and flag agreement of two scores on the tiles both of them scored."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), pearson(a, b).alias("corr"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
        F.avg(((F.col(a) >= theta_a) == (F.col(b) >= theta_b)).cast("double")).alias("agreement"))


def score_minus_label(tiles: DataFrame, label_px: DataFrame, p: str, label: str, ts: int, k: int) -> DataFrame:
    """Per k-cell difference between the tile score painted on the cell and the mean label of the cell."""
    lab = block_average(label_px, k, label)
    sub = ts // k
    t = tiles.select("granule_id", (F.floor(F.col("row") / k)).cast("int").alias("row"),
                     (F.floor(F.col("col") / k)).cast("int").alias("col"), p).where(F.col(p).isNotNull())
    key = lab.withColumn("row", (F.floor(F.col("r") / sub) * sub).cast("int")).withColumn(
        "col", (F.floor(F.col("c") / sub) * sub).cast("int"))
    return key.join(t, TILE).withColumn("diff", F.col(p) - F.col(label))


def common_box(px: DataFrame, headers: DataFrame, pairs: DataFrame, side: int, every: int = 1, v: str = "v") -> DataFrame:
    """Pixels of two granules inside one map box, keyed by position in the box, every `every`-th row and column.

    `pairs`: (ga, gb, bx0, by1).  Only positions present in both remain: the common shape.  Each box lists the
    blocks of `side` pixels that it touches (3 x 3 at most), and pixels meet only the boxes of their own block.
    """
    h = headers.select("granule_id", "px_m", "origin_x", "origin_y")
    block = lambda x: F.floor(x / side).cast("int")

    def one(gcol, out):
        p = pairs.select(gcol, F.col("ga").alias("_ga"), F.col("gb").alias("_gb"), "bx0", "by1").withColumnRenamed(gcol, "granule_id").join(h, "granule_id")
        r0, c0 = (F.col("origin_y") - F.col("by1")) / F.col("px_m"), (F.col("bx0") - F.col("origin_x")) / F.col("px_m")
        # Positions are rounded, hence one pixel to spare on either side.
        for name, first in (("_kr", r0), ("_kc", c0)):
            p = p.withColumn(name, F.explode(F.sequence(block(first - 1), block(first + side))))
        d = px.select("granule_id", "r", "c", v, block(F.col("r")).alias("_kr"), block(F.col("c")).alias("_kc")).join(p, ["granule_id", "_kr", "_kc"])
        br = F.bround((F.col("by1") - (F.col("origin_y") - F.col("r") * F.col("px_m"))) / F.col("px_m")).cast("int")
        bc = F.bround((F.col("origin_x") + F.col("c") * F.col("px_m") - F.col("bx0")) / F.col("px_m")).cast("int")
        d = d.select(F.col("_ga").alias("ga"), F.col("_gb").alias("gb"), br.alias("br"), bc.alias("bc"), F.col(v).alias(out))
        return d.where(F.col("br").between(0, side - 1) & F.col("bc").between(0, side - 1)
                       & (F.col("br") % every == 0) & (F.col("bc") % every == 0))
    return one("ga", "va").join(one("gb", "vb"), ["ga", "gb", "br", "bc"])
