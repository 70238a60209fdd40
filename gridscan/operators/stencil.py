"""Neighbourhood operators inside tiles.

A tile is computed without a halo, so every window is partitioned by the tile key plus a row, a column or a
diagonal.  `by_tile` shuffles once by tile; all windows after it find their clustering already satisfied, so
a chain of stencils costs one shuffle and local sorts.  Box and kernel filters expect dense tiles (`densify`).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridscan.functions.stats import pearson
from gridscan.operators.grid import expand
from gridscan.schema import TILE


# Pixels a task gets of a dense raster: sorts and windows of a chain hold a few hundred bytes for each.
TASK_PIXELS = 1 << 18


def by_tile(px: DataFrame, tile: Sequence[str] = TILE, parts: int | None = None) -> DataFrame:
    return px.repartition(*tile) if parts is None else px.repartition(parts, *tile)


def dense_parts(tiles: DataFrame, ts: int) -> int:
    """Partitions for all pixels of the tiles: they grow with the raster, a task's share does not.  Counts the tiles."""
    return max(tiles.sparkSession.sparkContext.defaultParallelism, math.ceil(tiles.count() * ts * ts / TASK_PIXELS))


def densify(tiles: DataFrame, px: DataFrame, ts: int, cols: Sequence[str], origin: tuple[int, int] | None = None) -> DataFrame:
    """Every pixel of every tile; NULL where the pixel table has no row.  Comes out clustered by tile.

    Pixels get their tile key from the places where tiles begin (modulo `ts`, per granule) and are shuffled once,
    as many as there are; the dense raster is made behind that shuffle, from tile keys, and never moves itself.
    `origin`: all tiles stand on the one grid that begins there, so the places need not be gathered.
    """
    t = tiles.select(*TILE).distinct() if origin is None else tiles.select(*TILE)
    parts = dense_parts(t, ts)
    if origin is None:
        at = t.select("granule_id", F.pmod("row", F.lit(ts)).alias("_r0"), F.pmod("col", F.lit(ts)).alias("_c0")).distinct()
        px, r0, c0 = px.join(at, "granule_id"), F.col("_r0"), F.col("_c0")
    else:
        r0, c0 = F.lit(origin[0]), F.lit(origin[1])
    corner = lambda x, o: (F.col(x) - F.pmod(F.col(x) - o, F.lit(ts))).cast("int")
    known = px.select("granule_id", corner("r", r0).alias("row"), corner("c", c0).alias("col"), "r", "c", *cols, F.lit(None).cast("boolean").alias("_in"))
    ints = [F.col(x).cast("int").alias(x) for x in ("row", "col")]
    empty = expand(by_tile(t.select("granule_id", *ints), parts=parts), ts).select(*known.columns[:5], *[F.lit(None).cast(px.schema[c].dataType).alias(c) for c in cols], F.lit(True).alias("_in"))
    both = by_tile(known, parts=parts).unionByName(empty).groupBy(*known.columns[:5])
    return both.agg(*[F.max(c).alias(c) for c in cols], F.max("_in").alias("_in")).where("_in").drop("_in")


def neighbour(v: Column | str, dr: int, dc: int, tile: Sequence[str] = TILE) -> Column:
    """Value at (r+dr, c+dc) in the same tile, NULL if that pixel is missing.

    A one-position range frame along the row, or along the line through (dr, dc): no self-join.
    """
    if dr == 0:
        w = W.partitionBy(*tile, "r").orderBy("c").rangeBetween(dc, dc)
    else:
        w = W.partitionBy(*tile, F.col("c") * dr - F.col("r") * dc).orderBy("r").rangeBetween(dr, dr)
    return F.max(v).over(w)


def neighbour_dense(v: str, dr: int, dc: int, ts: int, tile: Sequence[str] = TILE) -> Column:
    """`neighbour` on dense tiles: in row-major order it stands dr * ts + dc rows on, so one sort serves all directions.

    A tile that lacks pixels stops the job: `densify` it first.
    """
    w, off = W.partitionBy(*tile).orderBy("r", "c"), dr * ts + dc
    at = (lambda x: F.lead(x, off).over(w)) if off >= 0 else (lambda x: F.lag(x, -off).over(w))
    r, c = F.col("r") + dr, F.col("c") + dc
    inside = r.between(F.col("row"), F.col("row") + ts - 1) & c.between(F.col("col"), F.col("col") + ts - 1)
    found = (at("r") == r) & (at("c") == c)
    gap = F.raise_error(F.lit("a tile is not dense")).cast("double")
    return F.when(inside, F.when(F.coalesce(found, F.lit(False)), at(v)).otherwise(gap))


def _origin(axis: str) -> str:
    return {"r": "row", "c": "col"}[axis]


def _other(axis: str) -> str:
    return {"r": "c", "c": "r"}[axis]


def _reflect(df: DataFrame, axis: str, h: int, ts: int) -> DataFrame:
    """Mirror `h` positions over both tile edges (d c b a | a b c d | d c b a); adds `_pos`."""
    if h > ts:
        raise ValueError("window is wider than two tiles")
    a, o = F.col(axis), F.col(_origin(axis))
    pos = F.array_compact(F.array(
        a, F.when(a - o < h, 2 * o - 1 - a), F.when(o + ts - 1 - a < h, 2 * (o + ts) - 1 - a)))
    return df.withColumn("_pos", F.explode(pos))


def kernel_pass(df: DataFrame, cols: Mapping[str, Column | str], weights: Sequence[float] | Mapping[str, Sequence[float]], axis: str, ts: int,
                tile: Sequence[str] = TILE) -> DataFrame:
    """Weighted sum along one axis with a reflected border; `weights` has odd length, centre in the middle.

    One list serves all columns, or each column of the result has its own, all of one length.
    """
    own = weights if isinstance(weights, Mapping) else {o: weights for o in cols}
    h = max((len(w) for w in own.values()), default=0) // 2
    p = _reflect(df.select("*", *[(F.col(c) if isinstance(c, str) else c).alias(f"_in_{o}") for o, c in cols.items()]), axis, h, ts)
    w = W.partitionBy(*tile, _other(axis)).orderBy("_pos")
    outs = {}
    for o in cols:
        x = F.col(f"_in_{o}")
        terms = []
        for i, wt in enumerate(own[o]):
            k = i - h
            if wt == 0:
                continue
            at = x if k == 0 else (F.lead(x, k).over(w) if k > 0 else F.lag(x, -k).over(w))
            terms.append(at * float(wt))
        outs[o] = sum(terms[1:], terms[0]) if terms else x * 0.0
    keep = [c for c in df.columns if c not in cols]
    return p.select(*keep, "_pos", *[e.alias(o) for o, e in outs.items()]).where(F.col("_pos") == F.col(axis)).drop("_pos")


def separable(df: DataFrame, cols: Mapping[str, Column | str], along_r: Sequence[float], along_c: Sequence[float], ts: int,
              tile: Sequence[str] = TILE) -> DataFrame:
    return kernel_pass(kernel_pass(df, cols, along_c, "c", ts, tile), {o: o for o in cols}, along_r, "r", ts, tile)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def _box_pass(df: DataFrame, names: Sequence[str], k: int, axis: str, ts: int, tile: Sequence[str], border: str) -> DataFrame:
    h = k // 2
    if border == "reflect":
        p, lo, hi = _reflect(df, axis, h, ts), -h, h
    elif border == "clip":
        p, lo, hi = df.withColumn("_pos", F.col(axis)), -h, h
    elif border == "forward":  # edge pixel repeated k-1 times beyond the far side
        last = F.col(axis) == F.col(_origin(axis)) + ts - 1
        seq = F.when(last, F.sequence(F.col(axis), F.col(axis) + k - 1)).otherwise(F.array(F.col(axis)))
        p, lo, hi = df.withColumn("_pos", F.explode(seq)), 0, k - 1
    else:
        raise ValueError(f"unknown border {border!r}")
    w = W.partitionBy(*tile, _other(axis)).orderBy("_pos").rowsBetween(lo, hi)
    keep = [c for c in df.columns if c not in names]
    return p.select(*keep, "_pos", *[F.sum(n).over(w).alias(n) for n in names]).where(F.col("_pos") == F.col(axis)).drop("_pos")


#: Widest window whose samples are fetched one by one from the tile's one sorted order; wider ones slide along lines.
NARROW = 15


def _whole(df: DataFrame, ts: int, tile: Sequence[str]) -> Column:
    """Does a pixel stand at its row-major place in a tile that has all its pixels?"""
    place = (F.col("r") - F.col("row")) * ts + F.col("c") - F.col("col") + 1
    return (F.row_number().over(W.partitionBy(*tile).orderBy("r", "c")) == place) & (F.count(F.lit(1)).over(W.partitionBy(*tile)) == ts * ts)


def _mirrored_sums(df: DataFrame, names: Sequence[str], k: int, axis: str, ts: int, tile: Sequence[str]) -> DataFrame:
    """Sums of k pixels with a reflected border, on dense tiles in row-major order: no copies, no sort of its own.

    A mirrored pixel stands within reach itself, so near the edge a sample counts twice instead.
    """
    h, step = k // 2, ts if axis == "r" else 1
    w = W.partitionBy(*tile).orderBy("r", "c")
    p = F.col(axis) - F.col(_origin(axis))
    at = lambda n, d: F.col(n) if d == 0 else F.lead(n, d * step).over(w) if d > 0 else F.lag(n, -d * step).over(w)
    offsets = range(-h, h + 1)
    times = {d: F.when((p + d).between(0, ts - 1), 1 + (2 * p + d + 1 <= h).cast("int") + (2 * p + d >= 2 * ts - 1 - h).cast("int")).otherwise(0) for d in offsets}
    keep = [c for c in df.columns if c not in names]
    near = df.select(*keep, *[at(n, d).alias(f"{n}_{d + h}") for n in names for d in offsets], *[times[d].alias(f"_t_{d + h}") for d in offsets])
    term = lambda n, i: F.when(F.col(f"_t_{i}") > 0, F.col(f"{n}_{i}") * F.col(f"_t_{i}")).otherwise(0)
    return near.select(*keep, *[sum((term(n, i) for i in range(1, k)), term(n, 0)).alias(n) for n in names])


def box_mean(df: DataFrame, cols: Mapping[str, Column | str], k: int, ts: int, border: str = "reflect",
             tile: Sequence[str] = TILE) -> DataFrame:
    """k x k mean of several columns at once, over the valid samples of the window.

    border: reflect (centred), clip (centred, shrinking at the edge) or forward (k x k ahead, edge repeated).
    """
    if border != "forward" and k % 2 == 0:
        raise ValueError("a centred window needs an odd size")
    narrow = border == "reflect" and k <= NARROW
    if k // 2 > ts and border == "reflect":
        raise ValueError("window is wider than two tiles")
    d = df.withColumn("_whole", _whole(df, ts, tile)) if narrow else df
    gap = F.raise_error(F.lit("a tile is not dense")).cast("long")
    # Counts of several columns are the digits of one long: windows carry it instead of a column each.
    bits = (k * k).bit_length()
    per = 62 // bits
    xs = {o: F.col(c) if isinstance(c, str) else c for o, c in cols.items()}
    d = d.withColumns({f"_s_{o}": F.coalesce(x.cast("double"), F.lit(0.0)) for o, x in xs.items()} | {f"_v_{o}": x.isNotNull() for o, x in xs.items()})
    counts = {}
    for at in range(0, len(cols), per):
        n = sum((F.when(F.col(f"_v_{o}"), F.lit(1 << bits * i)).otherwise(0).cast("long") for i, o in enumerate(list(cols)[at:at + per])), F.lit(0).cast("long"))
        counts[f"_n_{at // per}"] = F.when(F.col("_whole"), n).otherwise(gap) if narrow else n
    names = [f"_s_{o}" for o in cols] + list(counts)
    d = d.withColumns(counts).drop("_whole", *[f"_v_{o}" for o in cols])
    for axis in ("c", "r"):
        d = _mirrored_sums(d, names, k, axis, ts, tile) if narrow else _box_pass(d, names, k, axis, ts, tile, border)
    for i, o in enumerate(cols):
        n = F.shiftright(f"_n_{i // per}", bits * (i % per)).bitwiseAND((1 << bits) - 1)
        d = d.withColumn(o, F.try_divide(F.col(f"_s_{o}"), n))
    return d.drop(*names)


def local_moments(df: DataFrame, v: str, k: int, ts: int, border: str = "reflect", tile: Sequence[str] = TILE) -> DataFrame:
    """Local mean, variance and coefficient of variation."""
    x = F.col(v).cast("double")
    d = box_mean(df, {"loc_mean": x, "_sq": x * x}, k, ts, border, tile)
    d = d.withColumn("loc_var", F.greatest(F.col("_sq") - F.col("loc_mean") * F.col("loc_mean"), F.lit(0.0))).drop("_sq")
    return d.withColumn("loc_cv", F.coalesce(F.try_divide(F.sqrt("loc_var"), F.col("loc_mean")), F.lit(0.0)))


def textured(df: DataFrame, theta: float = 0.3) -> DataFrame:
    return df.withColumn("textured", F.col("loc_cv") > theta)


def _blend(v: str, weight: Column) -> Column:
    w = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(weight, F.lit(0.0))))
    return F.col("loc_mean") + w * (F.col(v) - F.col("loc_mean"))


def lee(df: DataFrame, v: str, k: int, ts: int, out: str = "lee", tile: Sequence[str] = TILE) -> DataFrame:
    """Local mean pulled to the sample where local variance beats the tile's variance."""
    d = local_moments(df, v, k, ts, tile=tile).withColumn("_ov", F.var_pop(v).over(W.partitionBy(*tile)))
    return d.withColumn(out, _blend(v, F.try_divide(F.col("loc_var"), F.col("loc_var") + F.col("_ov")))).drop("_ov")


def enhanced_lee(df: DataFrame, v: str, k: int, ts: int, looks: int = 1, out: str = "elee", tile: Sequence[str] = TILE) -> DataFrame:
    d = df.withColumn(v, F.col(v) + 1e-10)
    d = local_moments(d, v, k, ts, tile=tile)
    cv2 = F.col("loc_cv") * F.col("loc_cv")
    return d.withColumn(out, _blend(v, (cv2 - 1.0 / looks) / (cv2 + 1e-10)))


def wiener(df: DataFrame, v: str, k: int, ts: int, out: str = "wiener", tile: Sequence[str] = TILE) -> DataFrame:
    """Noise level = 5th percentile of the tile's positive local variances."""
    d = local_moments(df, v, k, ts, tile=tile)
    pos = F.when(F.col("loc_var") > 0, F.col("loc_var"))
    d = d.withColumn("_nv", F.coalesce(F.percentile(pos, F.lit(0.05)).over(W.partitionBy(*tile)), F.lit(0.0)))
    return d.withColumn(out, _blend(v, (F.col("loc_var") - F.col("_nv")) / (F.col("loc_var") + 1e-10))).drop("_nv")


def median_filter(df: DataFrame, v: str, k: int, ts: int, out: str = "med", tile: Sequence[str] = TILE) -> DataFrame:
    """k x k median with a reflected border: the window's samples travel as one short array (k*k values)."""
    h = k // 2
    d = df.withColumn("_l", F.array(v))
    for axis in ("c", "r"):
        w = W.partitionBy(*tile, _other(axis)).orderBy("_pos").rowsBetween(-h, h)
        p = _reflect(d, axis, h, ts)
        d = p.withColumn("_l", F.flatten(F.collect_list("_l").over(w))).where(F.col("_pos") == F.col(axis)).drop("_pos")
    s = F.array_sort(F.array_compact("_l"))
    n = F.size(s)
    lo, hi = F.try_element_at(s, F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int")), F.try_element_at(s, (F.floor(n / 2) + 1).cast("int"))
    return d.withColumn(out, (lo + hi) / 2).drop("_l")


def gradient(df: DataFrame, v: str, ts: int, gr: str = "gr", gc: str = "gc", tile: Sequence[str] = TILE, dense: bool = False) -> DataFrame:
    """Central differences, one-sided at the tile edge.  `dense`: no pixel is missing, so both axes share one sort."""
    def near(dr, dc):
        return neighbour_dense(v, dr, dc, ts, tile) if dense else neighbour(v, dr, dc, tile)

    def one(axis, dr, dc):
        nxt, prv = near(dr, dc), near(-dr, -dc)
        x = F.col(v)
        first, last = F.col(axis) == F.col(_origin(axis)), F.col(axis) == F.col(_origin(axis)) + ts - 1
        return F.when(first, nxt - x).when(last, x - prv).otherwise((nxt - prv) / 2)
    return df.withColumn(gr, one("r", 1, 0)).withColumn(gc, one("c", 0, 1))


def sobel(df: DataFrame, v: str, ts: int, gr: str = "gr", gc: str = "gc", tile: Sequence[str] = TILE) -> DataFrame:
    d = separable(df.withColumn(gr, F.col(v)), {gr: v}, [-1, 0, 1], [1, 2, 1], ts, tile)
    return separable(d.withColumn(gc, F.col(v)), {gc: v}, [1, 2, 1], [-1, 0, 1], ts, tile)


def diagonal_gradient(df: DataFrame, v: str, tile: Sequence[str] = TILE) -> DataFrame:
    """Mean absolute first difference along the two diagonals, per tile."""
    d = df.withColumn("_d45", F.abs(neighbour(v, 1, 1, tile) - F.col(v))).withColumn(
        "_d135", F.abs(neighbour(v, 1, -1, tile) - F.col(v)))
    return d.groupBy(*tile).agg(F.avg("_d45").alias("grad45"), F.avg("_d135").alias("grad135"))


def diagonal_acf(df: DataFrame, v: str, ts: int, min_pairs: int = 101, tile: Sequence[str] = TILE) -> DataFrame:
    """Correlation of interior pixels with their diagonal neighbours; NULL below `min_pairs` pairs."""
    inner = (F.col("r").between(F.col("row") + 1, F.col("row") + ts - 2)
             & F.col("c").between(F.col("col") + 1, F.col("col") + ts - 2))
    d = df.withColumn("_n45", neighbour(v, 1, 1, tile)).withColumn("_n135", neighbour(v, 1, -1, tile))
    x = F.when(inner, F.col(v))
    return d.groupBy(*tile).agg(pearson(x, F.col("_n45"), min_pairs).alias("acf45"),
                                pearson(x, F.col("_n135"), min_pairs).alias("acf135"))


def residual_rho1(df: DataFrame, v: str, ts: int, k: int = 9, tile: Sequence[str] = TILE) -> DataFrame:
    """Lag-1 autocorrelation per axis of what is left after a k x k mean; 0 for a flat tile.  Tiles are dense."""
    d = box_mean(df, {"_bg": v}, k, ts, tile=tile).withColumn("_r", F.col(v) - F.col("_bg"))
    d = d.withColumn("_r", F.col("_r") - F.avg("_r").over(W.partitionBy(*tile)))
    d = d.withColumns({"_down": neighbour_dense("_r", 1, 0, ts, tile), "_right": neighbour_dense("_r", 0, 1, ts, tile)})
    den = F.avg(F.col("_r") * F.col("_r"))

    def rho(n):
        return F.when(den < 1e-20, 0.0).otherwise(F.avg(F.col("_r") * F.col(n)) / F.greatest(den, F.lit(1e-300)))
    return d.groupBy(*tile).agg(rho("_down").alias("rho_row"), rho("_right").alias("rho_col"))


def structure_tensor(df: DataFrame, v: str, ts: int, smooth: Sequence[float] | int = 5, derivative: str = "sobel",
                     tile: Sequence[str] = TILE) -> DataFrame:
    """Smoothed gradient products arr, arc, acc and the coherence of their eigenvalues.

    `smooth`: kernel weights (e.g. `gaussian_weights(2.0)`), or an odd box size.
    """
    d = sobel(df, v, ts, tile=tile) if derivative == "sobel" else gradient(df, v, ts, tile=tile, dense=True)
    prods = {"arr": F.col("gr") * F.col("gr"), "arc": F.col("gr") * F.col("gc"), "acc": F.col("gc") * F.col("gc")}
    if isinstance(smooth, int):
        d = box_mean(d, prods, smooth, ts, tile=tile)
    else:
        d = separable(d, prods, smooth, smooth, ts, tile)
    gap = F.sqrt(F.pow(F.col("arr") - F.col("acc"), F.lit(2)) + 4 * F.col("arc") * F.col("arc"))
    return d.drop("gr", "gc").withColumn("coherence", gap / (F.col("arr") + F.col("acc") + 1e-9)).withColumn(
        "angle2", F.atan2(2 * F.col("arc"), F.col("acc") - F.col("arr")))


def orientation_agreement(df: DataFrame, v: str, ts: int, win: int = 41, smooth: Sequence[float] | int = 5,
                          derivative: str = "sobel", out: str = "agreement", tile: Sequence[str] = TILE) -> DataFrame:
    """Axial resultant of local orientations in a window, normalised by the weight inside that window."""
    d = structure_tensor(df, v, ts, smooth, derivative, tile).withColumn("_w", F.col(v) * F.col("coherence"))
    d = box_mean(d, {"_x": F.col("_w") * F.cos("angle2"), "_y": F.col("_w") * F.sin("angle2"), "_z": F.col("_w")}, win, ts, tile=tile)
    return d.withColumn(out, F.hypot("_x", "_y") / (F.col("_z") + 1e-9)).drop("_x", "_y", "_z", "_w")
