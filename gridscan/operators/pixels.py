"""Pixel-table operators that need an aggregate: stretches, normalisation, band handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from gridscan.functions.scalar import clip, soft, standardise
from gridscan.plans.ordering import exact_quantiles
from gridscan.schema import TILE, null_if_nodata


def contrast_stretch(px: DataFrame, v: str = "v", tile: Sequence[str] = TILE, fill: str = "median",
                     out: str = "s") -> DataFrame:
    """log10, then p2..p98 of the tile mapped to [0, 1].

    fill="median": nodata takes the tile's median before the percentiles; a flat tile gives NULL.
    fill="zero": percentiles over valid pixels only, nodata and flat tiles give 0.
    One shuffle by tile; a tile is a bounded group.
    """
    w = W.partitionBy(*tile)
    lg = px.withColumn("_lg", F.log10(null_if_nodata(v)))
    if fill == "median":
        lg = lg.withColumn("_lg", F.coalesce("_lg", F.percentile("_lg", F.lit(0.5)).over(w)))
    q = F.percentile("_lg", F.array(F.lit(0.02), F.lit(0.98))).over(w)
    lg = lg.withColumn("_q", q)
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    s = clip((F.col("_lg") - lo) / F.when(hi > lo, hi - lo), 0.0, 1.0)
    if fill == "zero":
        s = F.coalesce(s, F.lit(0.0))
    return lg.withColumn(out, s).drop("_lg", "_q")


def fit_normalisation(px: DataFrame, v: str = "v", train=None) -> DataFrame:
    """One shared mean and sd, over the training rows only, in double precision: (mu, sd)."""
    t = px if train is None else px.where(train)
    x = F.col(v).cast("double")
    return t.agg(F.avg(x).alias("mu"), F.stddev_pop(x).alias("sd"))


def normalise(px: DataFrame, stats: DataFrame, v: str = "v", out: str = "z") -> DataFrame:
    """Apply a one-row (mu, sd) table; the constants travel as a scalar subquery."""
    s = stats.select(F.struct("mu", "sd")).scalar()
    return px.withColumn("_s", s).withColumn(out, standardise(v, F.col("_s.mu"), F.col("_s.sd"))).drop("_s")


def select_bands(px: DataFrame, wanted: Sequence[str], known: Sequence[str], band: str = "band") -> DataFrame:
    missing = [b for b in wanted if b not in known]
    if missing:
        raise ValueError(f"unknown bands {missing}; have {list(known)}")
    return px.where(F.col(band).isin(list(wanted)))


def multiscale_soft(px: DataFrame, resp: str, key: Sequence[str], out: str = "target") -> DataFrame:
    """Mean over scale rows of the soft response, per pixel."""
    return px.groupBy(*key).agg(F.avg(soft(resp)).alias(out))


def p99_scale(px: DataFrame, v: str = "v", out: str = "scaled", by: Sequence[str] = ()) -> DataFrame:
    """clip(v / p99 of the non-zero values, 0, 1); the percentile is exact and skew-safe."""
    q = exact_quantiles(px.where(F.col(v) != 0), v, [0.99], by)
    if by:
        px = px.join(q.select(*by, F.col("q")[0].alias("_p")), list(by), "left")
    else:
        px = px.withColumn("_p", q.select(F.col("q")[0]).scalar())
    return px.withColumn(out, clip(F.col(v) / F.col("_p"), 0.0, 1.0)).drop("_p")
