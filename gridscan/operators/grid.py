"""Tile grids, affine arithmetic, footprints and resampling on aligned grids.

Headers are rows (granule_id, height, width, px_m, origin_x, origin_y [, px_y_m]); the origin is the
top-left corner, rows run south.  Every expansion is an `explode(sequence)` of a header or tile row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridscan.schema import GROUND_M, TILE, TILE_M


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def floor_to(x, step, origin=0) -> Column:
    return (F.floor((_c(x) - _c(origin)) / _c(step)) * _c(step) + _c(origin)).cast("int")


def with_tile(px: DataFrame, ts: int, row0=0, col0=0) -> DataFrame:
    """Key each pixel with the top-left corner of its tile."""
    return px.withColumn("row", floor_to("r", ts, row0)).withColumn("col", floor_to("c", ts, col0))


def _seq(start, last, step) -> Column:
    """start, start+step, ... <= last; an empty range gives no row."""
    return F.when(_c(last) >= _c(start), F.sequence(_c(start), _c(last), _c(step)))


def tile_grid(headers: DataFrame, ts: int, partial: bool = True) -> DataFrame:
    """Every tile corner from origin 0; `partial=False` leaves out ragged right and bottom tiles."""
    off = 1 if partial else ts
    g = headers.withColumn("row", F.explode(_seq(F.lit(0), F.col("height") - off, F.lit(ts))))
    return g.withColumn("col", F.explode(_seq(F.lit(0), F.col("width") - off, F.lit(ts))))


def decimate(px: DataFrame, k: int, nearest: bool = True, height=None, width=None) -> DataFrame:
    """Keep one sample per k x k block: the nearest to its centre, or the first one (`a[::k]`).

    Adds decimated indices `dr`, `dc`.  With a size, blocks beyond floor(size / k) are left out.
    """
    at = k // 2 if nearest else 0
    out = px.where((F.col("r") % k == at) & (F.col("c") % k == at))
    out = out.withColumn("dr", F.floor(F.col("r") / k).cast("int")).withColumn("dc", F.floor(F.col("c") / k).cast("int"))
    if height is not None:
        out = out.where((F.col("dr") < F.floor(_c(height) / k)) & (F.col("dc") < F.floor(_c(width) / k)))
    return out


def data_bounds(px: DataFrame, headers: DataFrame, k: int, v: str = "v") -> DataFrame:
    """Bounding box of data on a k-decimated mask, and its coverage; an empty raster gives NULL bounds.

    `px` has one row per pixel.  1/k^2 of the pixels are aggregated map-side to one row per granule.
    """
    hit = decimate(px.where(F.col(v) > 0), k).select("granule_id", "dr", "dc")
    box = (hit.join(headers.select("granule_id", "height", "width"), "granule_id")
           .where((F.col("dr") < F.floor(F.col("height") / k)) & (F.col("dc") < F.floor(F.col("width") / k)))
           .groupBy("granule_id")
           .agg(F.min("dr").alias("r0"), F.max("dr").alias("r1"), F.min("dc").alias("c0"), F.max("dc").alias("c1"),
                F.count(F.lit(1)).alias("n")))
    h, w = F.col("height"), F.col("width")
    return headers.join(box, "granule_id", "left").select(
        *headers.columns,
        (F.col("r0") * k).alias("row_min"), F.when(F.col("r1").isNotNull(), F.least((F.col("r1") + 1) * k, h)).alias("row_max"),
        (F.col("c0") * k).alias("col_min"), F.when(F.col("c1").isNotNull(), F.least((F.col("c1") + 1) * k, w)).alias("col_max"),
        (F.coalesce("n", F.lit(0)) * 100.0 / (F.floor(h / k) * F.floor(w / k))).alias("coverage_percent"))


def swath_tiles(bounds: DataFrame, ts: int) -> DataFrame:
    """Tile grid anchored at the swath corner instead of the raster origin."""
    g = bounds.withColumn("row", F.explode(_seq("row_min", F.col("row_max") - 1, ts)))
    return g.withColumn("col", F.explode(_seq("col_min", F.col("col_max") - 1, ts)))


def tile_scale(headers: DataFrame, ground_m: float = GROUND_M, strict: bool = True) -> DataFrame:
    """Native pixels per `ground_m` pixel.  Non-square pixels stop the job."""
    scale = F.greatest(F.lit(1), F.bround(F.lit(ground_m) / F.col("px_m")).cast("int"))
    if strict and "px_y_m" in headers.columns:
        bad = F.abs(F.col("px_m") - F.col("px_y_m")) > 1e-6
        scale = F.when(bad, F.raise_error(F.lit("non-square pixels: resample before use")).cast("int")).otherwise(scale)
    return headers.withColumn("scale", scale)


def world_x(col, header_px="px_m", origin="origin_x") -> Column:
    return _c(origin) + _c(col) * _c(header_px)


def world_y(row, header_px="px_m", origin="origin_y") -> Column:
    return _c(origin) - _c(row) * _c(header_px)


def with_world(tiles: DataFrame, ts: int) -> DataFrame:
    """Top-left (x_m, y_m) and centre (xc_m, yc_m) of each tile in map metres."""
    half = ts / 2
    return (tiles.withColumn("x_m", world_x("col")).withColumn("y_m", world_y("row"))
            .withColumn("xc_m", world_x(F.col("col") + half)).withColumn("yc_m", world_y(F.col("row") + half)))


def world_cell(x, y, x0: float, y0: float, cell: float, nrow: int, ncol: int) -> tuple[Column, Column]:
    """Row and column of the cell holding (x, y) on a fixed grid; both -1 outside it."""
    gi, gj = F.floor((F.lit(y0) - _c(y)) / cell), F.floor((_c(x) - F.lit(x0)) / cell)
    ok = (gi >= 0) & (gi < nrow) & (gj >= 0) & (gj < ncol)
    return F.when(ok, gi).otherwise(-1).cast("int"), F.when(ok, gj).otherwise(-1).cast("int")


def clip_footprint(tiles: DataFrame, step: int) -> DataFrame:
    """Real height and width of each tile, cut at the raster edge."""
    return (tiles.withColumn("h", F.least(F.lit(step), F.col("height") - F.col("row")))
            .withColumn("w", F.least(F.lit(step), F.col("width") - F.col("col"))))


def crop_window(positions: DataFrame, headers: DataFrame, step: int) -> DataFrame:
    """Tight window over all positions of a granule, clipped to the raster, with its shifted origin."""
    b = positions.groupBy("granule_id").agg(F.min("row").alias("row0"), F.min("col").alias("col0"),
                                            F.max("row").alias("rmax"), F.max("col").alias("cmax"))
    j = b.join(headers, "granule_id")
    return j.select(
        "granule_id", "row0", "col0",
        (F.least(F.col("rmax") + step, F.col("height")) - F.col("row0")).alias("h"),
        (F.least(F.col("cmax") + step, F.col("width")) - F.col("col0")).alias("w"),
        world_x("col0").alias("origin_x"), world_y("row0").alias("origin_y"))


def overlap_tiles(bounds: DataFrame, ts: int, margin: int) -> DataFrame:
    """Anchors on the finer grid (stride ts - 2*margin) used when tiles overlap."""
    stride = ts - 2 * margin
    if stride <= 0:
        raise ValueError("margin must be smaller than half a tile")
    return swath_tiles(bounds, stride)


def center_crop(tiles: DataFrame, ts: int, margin: int, parity: bool = False) -> DataFrame:
    """Which part of each overlapping tile to keep: top, left, bottom, right, and where it lands.

    The first row and column keep their near side.  A far side is kept whenever no following tile covers it;
    `parity=True` keeps it only for reads shorter than 2*margin + 1, which can leave a strip unwritten.
    """
    stride = ts - 2 * margin
    t = tiles.withColumn("h", F.least(F.lit(ts), F.col("height") - F.col("row"))).withColumn(
        "w", F.least(F.lit(ts), F.col("width") - F.col("col")))

    def far(pos, size, lim):
        last = F.col(size) < 2 * margin + 1
        if not parity:
            last = last | (F.col(pos) + stride >= F.col(lim))
        return F.when(last, F.col(size)).otherwise(F.col(size) - margin)

    top = F.when(F.col("row") == F.col("row_min"), 0).otherwise(margin)
    left = F.when(F.col("col") == F.col("col_min"), 0).otherwise(margin)
    t = t.withColumn("top", top).withColumn("left", left)
    t = t.withColumn("bottom", F.greatest(far("row", "h", "row_max"), F.col("top") + 1))
    t = t.withColumn("right", F.greatest(far("col", "w", "col_max"), F.col("left") + 1))
    return t.withColumn("out_row", F.col("row") + F.col("top")).withColumn("out_col", F.col("col") + F.col("left"))


def block_average(px: DataFrame, f: int, v: str = "v", key: Sequence[str] = ("granule_id",), strict: bool = False) -> DataFrame:
    """f x f block mean; nodata-aware, or (strict) NULL unless all f*f samples are valid."""
    m = F.avg(v)
    if strict:
        m = F.when(F.count(v) >= f * f, m)
    return px.groupBy(*key, F.floor(F.col("r") / f).cast("int").alias("r"),
                      F.floor(F.col("c") / f).cast("int").alias("c")).agg(m.alias(v))


def paint(px: DataFrame, tiles: DataFrame, ts: int, cols: Sequence[str], how: str = "left") -> DataFrame:
    """Give every pixel the scalars of its tile: an equi-join on the tile key."""
    return with_tile(px, ts).join(tiles.select(*TILE, *cols), TILE, how)


def expand(tiles: DataFrame, ts: int) -> DataFrame:
    """Every pixel (r, c) under each tile; bounded by the tile area."""
    e = tiles.withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + ts - 1)))
    return e.withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + ts - 1)))


def registration(pairs: DataFrame, strict: bool = True) -> DataFrame:
    """Integer offset (dr, dc) of raster a inside raster b.

    `pairs` carries both headers as structs `a` and `b`.  Different CRS or pixel size, or a fractional shift,
    stop the job; with strict=False they give ok=false.
    """
    dr = (F.col("b.origin_y") - F.col("a.origin_y")) / F.col("b.px_m")
    dc = (F.col("a.origin_x") - F.col("b.origin_x")) / F.col("b.px_m")
    ok = ((F.col("a.epsg") == F.col("b.epsg")) & (F.abs(F.col("a.px_m") - F.col("b.px_m")) <= 1e-6)
          & (F.abs(dr - F.bround(dr)) <= 1e-4) & (F.abs(dc - F.bround(dc)) <= 1e-4))

    def whole(d):
        v = F.bround(d).cast("int")
        if strict:
            return F.when(ok, v).otherwise(F.raise_error(F.lit("rasters do not share one pixel grid")).cast("int"))
        return F.when(ok, v)

    return pairs.select("*", whole(dr).alias("dr"), whole(dc).alias("dc"), ok.alias("ok"))


def bounds_of(prefix: str = "") -> dict[str, Column]:
    p = f"{prefix}." if prefix else ""
    x0, y1 = F.col(f"{p}origin_x"), F.col(f"{p}origin_y")
    return {"x0": x0, "x1": x0 + F.col(f"{p}width") * F.col(f"{p}px_m"),
            "y0": y1 - F.col(f"{p}height") * F.col(f"{p}px_m"), "y1": y1}


def overlap_bounds(pairs: DataFrame) -> DataFrame:
    """Common map rectangle of headers `a` and `b`; no row where they do not overlap."""
    a, b = bounds_of("a"), bounds_of("b")
    o = pairs.select("*", F.greatest(a["x0"], b["x0"]).alias("x0"), F.greatest(a["y0"], b["y0"]).alias("y0"),
                     F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"))
    return o.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def inset_boxes(overlap: DataFrame, n: int, side_m: float) -> DataFrame:
    """n x n boxes spread over each overlap, away from its edges."""
    i = overlap.withColumn("bi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    i = i.withColumn("bj", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    cx = F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("bi") + 1) / (n + 1)
    cy = F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("bj") + 1) / (n + 1)
    return (i.withColumn("bx0", cx - side_m / 2).withColumn("bx1", cx + side_m / 2)
            .withColumn("by0", cy - side_m / 2).withColumn("by1", cy + side_m / 2))


def mosaic_extent(headers: DataFrame, by: Sequence[str] = (), cell: float = TILE_M, strict: bool = True) -> DataFrame:
    """Union bounds of many granules; all four sides must lie on multiples of `cell`."""
    b = bounds_of()
    e = headers.groupBy(*by).agg(F.min(b["x0"]).alias("x0"), F.max(b["x1"]).alias("x1"),
                                 F.min(b["y0"]).alias("y0"), F.max(b["y1"]).alias("y1"))
    on_grid = F.lit(True)
    for s in ("x0", "x1", "y0", "y1"):
        on_grid = on_grid & (F.abs(F.col(s) / cell - F.bround(F.col(s) / cell)) < 1e-6)
    if strict:
        on_grid = F.when(on_grid, F.lit(True)).otherwise(
            F.raise_error(F.lit("mosaic bounds are off the tile grid")).cast("boolean"))
    return e.withColumn("aligned", on_grid)


def centre_subtile(tiles: DataFrame, big: int, small: int) -> DataFrame:
    """Corner of the centred `small` tile inside each `big` tile."""
    off = (big - small) // 2
    return tiles.withColumn("sub_row", F.col("row") + off).withColumn("sub_col", F.col("col") + off)


def dense_grid(headers: DataFrame, scores: DataFrame, ts: int, value: str, stride: str | None = None) -> DataFrame:
    """All cells (ti, tj) of each granule with the score covering them, NULL where nothing was scored.

    A score read at a coarser native stride fills stride/ts x stride/ts cells.
    """
    n = F.greatest(F.lit(1), F.floor(F.col(stride) / ts).cast("int")) if stride else F.lit(1)
    s = scores.select("granule_id", F.floor(F.col("row") / ts).cast("int").alias("i"),
                      F.floor(F.col("col") / ts).cast("int").alias("j"), n.alias("n"), F.col(value))
    s = s.withColumn("ti", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("n") - 1)))
    s = s.withColumn("tj", F.explode(F.sequence(F.col("j"), F.col("j") + F.col("n") - 1)))
    s = s.groupBy("granule_id", "ti", "tj").agg(F.max(value).alias(value))
    g = headers.withColumn("ti", F.explode(_seq(F.lit(0), F.floor(F.col("height") / ts).cast("int") - 1, F.lit(1))))
    g = g.withColumn("tj", F.explode(_seq(F.lit(0), F.floor(F.col("width") / ts).cast("int") - 1, F.lit(1))))
    return g.select("granule_id", "ti", "tj").join(s, ["granule_id", "ti", "tj"], "left")


def trim_to_data(grid: DataFrame, valid: Column, pad: int = 2) -> DataFrame:
    """Keep the cells inside the padded bounding box of the valid ones."""
    b = grid.where(valid).groupBy("granule_id").agg(
        F.min("ti").alias("_a"), F.max("ti").alias("_b"), F.min("tj").alias("_c"), F.max("tj").alias("_d"))
    inside = (F.col("ti").between(F.col("_a") - pad, F.col("_b") + pad)
              & F.col("tj").between(F.col("_c") - pad, F.col("_d") + pad))
    return grid.join(b, "granule_id").where(inside).drop("_a", "_b", "_c", "_d")
