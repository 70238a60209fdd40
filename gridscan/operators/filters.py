"""Tile and granule filters.  Fractions are shares of the tile's area: a missing pixel row is nodata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridscan.functions.scalar import flag
from gridscan.functions.stats import n_true
from gridscan.operators.grid import decimate, with_tile
from gridscan.plans.ordering import exact_quantiles
from gridscan.schema import GROUNDED, NOISE_FLOOR_DB, TILE


def _area(area: Column | int | None, ts: int) -> Column:
    if area is None:
        return F.lit(ts * ts)
    return area if isinstance(area, Column) else F.lit(area)


def valid_fraction(px: DataFrame, ts: int, v: str = "v", area: int | None = None) -> DataFrame:
    return with_tile(px, ts).groupBy(*TILE).agg((n_true(F.col(v) > 0) / _area(area, ts)).alias("valid_frac"))


def valid_tiles(px: DataFrame, ts: int, theta: float, v: str = "v") -> DataFrame:
    """Tiles with at least `theta` of their area valid."""
    return valid_fraction(px, ts, v).where(F.col("valid_frac") >= theta)


def valid_fraction_bands(wide: DataFrame, ts: int, bands: Sequence[str]) -> DataFrame:
    """Smallest per-band valid fraction of each tile; all bands in one aggregation."""
    fr = [n_true(F.col(b) > 0) / (ts * ts) for b in bands]
    return with_tile(wide, ts).groupBy(*TILE).agg(F.least(*fr).alias("valid_frac"))


def coarse_prefilter(tiles: DataFrame, px: DataFrame, headers: DataFrame, k: int, ts: int, theta: float = 0.3,
                     v: str = "v") -> DataFrame:
    """Keep tiles whose footprint in a k-decimated mask has at least `theta` data.

    The mask costs 1/k^2 of the pixels; the survivors' keys then prune the full-resolution read.
    """
    step = max(1, ts // k)
    hits = decimate(px.where(F.col(v) > 0), k).select("granule_id", "dr", "dc")
    t = tiles.select(*TILE).join(headers.select("granule_id", F.floor(F.col("height") / k).cast("int").alias("mh"),
                                                F.floor(F.col("width") / k).cast("int").alias("mw")), "granule_id")
    r0, c0 = F.floor(F.col("row") / k).cast("int"), F.floor(F.col("col") / k).cast("int")
    t = t.withColumn("dr", F.explode(F.sequence(r0, r0 + step - 1))).withColumn(
        "dc", F.explode(F.sequence(c0, c0 + step - 1)))
    t = t.where((F.col("dr") < F.col("mh")) & (F.col("dc") < F.col("mw")))
    m = t.join(hits.withColumn("hit", F.lit(1.0)), ["granule_id", "dr", "dc"], "left")
    ok = m.groupBy(*TILE).agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("coarse_frac")).where(F.col("coarse_frac") >= theta)
    return tiles.join(ok, TILE)


def coarse_valid_all_bands(wide: DataFrame, k: int, ts: int, bands: Sequence[str]) -> DataFrame:
    """Share of a tile's k-cells whose mean is positive in every band."""
    cell = wide.groupBy("granule_id", F.floor(F.col("r") / k).cast("int").alias("r"),
                        F.floor(F.col("c") / k).cast("int").alias("c")).agg(*[F.avg(b).alias(b) for b in bands])
    ok = F.lit(True)
    for b in bands:
        ok = ok & F.coalesce(F.col(b) > 0, F.lit(False))
    sub = ts // k
    t = with_tile(cell, sub).groupBy(*TILE).agg((n_true(ok) / (sub * sub)).alias("valid_frac"))
    return t.withColumn("row", F.col("row") * k).withColumn("col", F.col("col") * k)


def grounded_fraction(tiles: DataFrame, mask: DataFrame, ts: int, cls: str = "cls", code: int = GROUNDED,
                      h: Column | int | None = None, w: Column | int | None = None) -> DataFrame:
    """Share of class `code` in each tile's own window of the class raster; unmapped pixels count as other.

    `h`, `w`: the tile's real footprint (column expressions), default a full tile.
    """
    n = with_tile(mask.where(F.col(cls) == code), ts).groupBy(*TILE).agg(F.count(F.lit(1)).alias("_n"))
    hh, ww = (F.lit(ts) if x is None else x if isinstance(x, Column) else F.lit(x) for x in (h, w))
    return tiles.join(n, TILE, "left").withColumn(
        "grounded_frac", F.coalesce("_n", F.lit(0)) / (hh * ww)).drop("_n")


def grounded_tiles(tiles: DataFrame, mask: DataFrame, ts: int, theta: float, **kw) -> DataFrame:
    return grounded_fraction(tiles, mask, ts, **kw).where(F.col("grounded_frac") >= theta)


def masked_decision(df: DataFrame, p: str, theta: float, grounded: str = "grounded", out: str = "flag") -> DataFrame:
    """The mask acts on the decision only: every scored row stays."""
    return df.withColumn(out, flag(p, theta) & F.coalesce(F.col(grounded), F.lit(False)))


def finite_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(features))


def admissible(df: DataFrame, pos_frac: str, inbox: str, pos: float = 0.5, neg: float = 0.05) -> DataFrame:
    """Labelled tiles inside the export box; the ambiguous band between the two cuts is dropped."""
    return df.where(F.col(inbox) & ((F.col(pos_frac) >= pos) | (F.col(pos_frac) <= neg)))


def inside_box(x0, x1, y0, y1, box) -> Column:
    """Whole tile inside the box (bx0, bx1, by0, by1)."""
    bx0, bx1, by0, by1 = box
    return (x0 >= bx0) & (x1 <= bx1) & (y0 >= by0) & (y1 <= by1)


def near_positives(grid: DataFrame, positive: Column, margin: int, by: Sequence[str] = ("granule_id",)) -> DataFrame:
    """Tiles inside the bounding box of the positive tiles, grown by `margin` tiles."""
    b = grid.where(positive).groupBy(*by).agg(F.min("ti").alias("_a"), F.max("ti").alias("_b"),
                                              F.min("tj").alias("_c"), F.max("tj").alias("_d"))
    inside = (F.col("ti").between(F.col("_a") - margin, F.col("_b") + margin)
              & F.col("tj").between(F.col("_c") - margin, F.col("_d") + margin))
    return grid.join(b, list(by)).where(inside).drop("_a", "_b", "_c", "_d")


def above_noise_floor(tiles: DataFrame, cross_db: str, floor_db: float = NOISE_FLOOR_DB,
                      by: Sequence[str] = ("granule_id",)) -> DataFrame:
    """Drop whole granules whose median cross-pol level is at or below the noise floor."""
    med = exact_quantiles(tiles, cross_db, [0.5], by)
    return tiles.join(med.where(F.col("q")[0] > floor_db), list(by), "left_semi")


def density_filter(df: DataFrame, min_coverage: float, stored: Sequence[str], computed: Column,
                   min_components: int | None = None, n_components: str = "n_components") -> DataFrame:
    """First stored coverage, else the one computed from the mask; a tile without any is kept."""
    cov = F.coalesce(*[F.col(s) for s in stored], computed)
    out = df.withColumn("coverage", cov).where(F.col("coverage").isNull() | (F.col("coverage") >= min_coverage))
    if min_components is not None:
        out = out.where(F.col(n_components) >= min_components)
    return out


def assert_not_empty(df: DataFrame, message: str) -> DataFrame:
    """Fail early on an empty pool or split.  Reads at most one row."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def rethreshold(scores: DataFrame, p: str, theta: float) -> DataFrame:
    """Apply another threshold to stored scores; nothing is scored again."""
    return scores.where(F.col(p) >= theta)


def only(granules: DataFrame, part: str, col: str = "granule_id") -> DataFrame:
    return granules.where(F.col(col).contains(part))


def unseen_spacing(headers: DataFrame, seen: DataFrame, px: str = "px_m", tol: float = 0.01) -> DataFrame:
    """Granules whose pixel spacing never came with a positive label.

    Spacings are compared on a grid of `tol`: each seen value covers its own and both neighbouring keys,
    so the check is an equi anti-join with the exact distance as residual.
    """
    s = seen.select(F.col(px).alias("_s")).distinct()
    s = s.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_s") / tol) - 1, F.floor(F.col("_s") / tol) + 1)))
    h = headers.withColumn("_k", F.floor(F.col(px) / tol))
    return h.join(s, (h["_k"] == s["_k"]) & (F.abs(h[px] - s["_s"]) < tol), "left_anti").drop("_k")


def guard_spacing(headers: DataFrame, seen: DataFrame, allow_unseen: bool = False) -> DataFrame:
    if not allow_unseen and not unseen_spacing(headers, seen).isEmpty():
        raise ValueError("a granule has a pixel spacing without positive labels; pass allow_unseen=True to score it")
    return headers


def guard_policy(bundle: dict, expected: dict) -> None:
    """A model trained under another resampling policy must not be used."""
    for k, v in expected.items():
        if bundle.get(k) != v:
            raise ValueError(f"model bundle has {k}={bundle.get(k)!r}, this run uses {v!r}: retrain")
