"""Aggregations over pixel, tile and score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridscan.functions.scalar import clip
from gridscan.functions.stats import n_true, pearson, share
from gridscan.operators.grid import decimate, with_tile
from gridscan.plans.ordering import exact_quantiles
from gridscan.schema import TILE


def robust_stats(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Median and 1.4826 * MAD + 1e-6 per feature (and group): two skew-safe quantile passes over melted rows."""
    by = list(by)
    long = df.select(*by, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        by, list(features), "feature", "x")
    keys = [*by, "feature"]
    med = exact_quantiles(long, "x", [0.5], keys).select(*keys, F.col("q")[0].alias("center"))
    dev = long.join(med, keys).withColumn("d", F.abs(F.col("x") - F.col("center")))
    mad = exact_quantiles(dev, "d", [0.5], keys).select(*keys, (1.4826 * F.col("q")[0] + 1e-6).alias("scale"))
    return med.join(mad, keys)


def tile_fractions(labels: DataFrame, px: DataFrame, ts: int, k: int, cls: str = "cls", v: str = "v") -> DataFrame:
    """Positive share of each tile's area, and share of valid samples on a k-decimated grid."""
    pos = with_tile(labels.where(F.col(cls) == 1), ts).groupBy(*TILE).agg(F.count(F.lit(1)).alias("_n"))
    d = with_tile(decimate(px, k), ts).groupBy(*TILE).agg(n_true(F.col(v) > 0).alias("_d"))
    sub = (ts // k) ** 2
    return pos.join(d, TILE, "full_outer").select(
        *TILE, (F.coalesce("_n", F.lit(0)) / (ts * ts)).alias("aoi_pos_frac"),
        (F.coalesce("_d", F.lit(0)) / sub).alias("data_frac"))


def class_fractions(px: DataFrame, cell: Sequence[str], cls: str, classes: Sequence[int], area: int | None = None) -> DataFrame:
    """Share of every class per cell and the majority class (the lowest code wins a tie), in one aggregation."""
    n = F.lit(area) if area else F.count(F.lit(1))
    fr = {k: f"frac_{k}" for k in classes}
    g = px.groupBy(*cell).agg(*[(F.count_if(F.col(cls) == k) / n).alias(a) for k, a in fr.items()])
    top = F.greatest(*[F.col(a) for a in fr.values()])
    major = F.coalesce(*[F.when(F.col(a) == top, F.lit(k)) for k, a in fr.items()])
    return g.withColumn("majority", major)


def speed_cells(px: DataFrame, cell: Sequence[str], v: str) -> DataFrame:
    """Mean and max speed per cell over positive values only."""
    pos = F.when(F.col(v) > 0, F.col(v))
    return px.groupBy(*cell).agg(F.avg(pos).alias("vel_mean"), F.max(pos).alias("vel_max"))


def coverage(px: DataFrame, tile: Sequence[str], v: str, theta: float = 0.2) -> DataFrame:
    return px.groupBy(*tile).agg(share(F.col(v) > theta).alias("coverage"), n_true(F.col(v) > theta).alias("pixels"))


def coverage_summary(cov: DataFrame, by: Sequence[str] = (), hit: float = 0.01) -> DataFrame:
    c = F.col("coverage")
    return cov.groupBy(*by).agg(F.count(F.lit(1)).alias("n_tiles"), n_true(c > hit).alias("n_hit"),
                                share(c > hit).alias("share_hit"), F.avg(c).alias("mean_coverage"), F.max(c).alias("max_coverage"))


def mosaic(df: DataFrame, gi: Column, gj: Column, v: str) -> DataFrame:
    """Repeat passes onto one ground grid: linear mean first, dB last, with the number of valid passes."""
    m = df.groupBy(gi.alias("gi"), gj.alias("gj")).agg(F.avg(v).alias("mean"), F.count(v).alias("passes"))
    return m.withColumn("db", 10 * F.log10("mean"))


def pass_stats(df: DataFrame, key: Sequence[str], approximate: bool = False) -> DataFrame:
    """Tile slots, distinct ground tiles, mean and max passes per tile."""
    if approximate:
        return df.agg(F.count(F.lit(1)).alias("slots"), F.approx_count_distinct(F.struct(*key)).alias("ground_tiles"))
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("slots"), F.count(F.lit(1)).alias("ground_tiles"),
                   F.avg("n").alias("mean_passes"), F.max("n").alias("max_passes"))


def class_counts(df: DataFrame, by: str, y: str) -> DataFrame:
    """Rows, positives, negatives and base rate per group with the grand total (NULL group)."""
    return df.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("n_pos"),
                             F.sum(1 - F.col(y)).alias("n_neg"), F.avg(F.col(y).cast("double")).alias("base_rate"))


def by_threshold(df: DataFrame, thetas: Sequence[float], parts: dict, by: Sequence[str] = ()) -> DataFrame:
    """Aggregates that depend on a threshold, one row per (group, theta).

    `parts`: name -> function(theta) -> aggregate column.  All thresholds are conditional aggregates of a single
    pass; the input is never multiplied by the number of thresholds.
    """
    aggs = [f(t).alias(f"{n}__{i}") for i, t in enumerate(thetas) for n, f in parts.items()]
    wide = df.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("theta"), *[F.col(f"{n}__{i}").alias(n) for n in parts])
                     for i, t in enumerate(thetas)])
    return wide.select(*by, F.inline(rows))


def keep_rate(df: DataFrame, p: str, thetas: Sequence[float], by: Sequence[str]) -> DataFrame:
    c = F.col(p)
    return by_threshold(df, thetas, {"n": lambda t: F.count(c), "kept": lambda t: n_true(c >= t),
                                     "keep_rate": lambda t: F.try_divide(n_true(c >= t), F.count(c))}, by)


def keep_rate_by_band(df: DataFrame, p: str, theta: float, vel: str, grounded: str,
                      bands: Sequence[tuple[float, float]] = ((0, 50), (50, 250), (250, 1000), (1000, float("inf")))) -> DataFrame:
    """Tiles and kept tiles per fixed speed band on grounded ice; tiles without a speed are `unmapped`."""
    v = F.col(vel)
    label = F.when(v.isNull(), "unmapped")
    for lo, hi in bands:
        name = f"{lo:g}-{hi:g}" if hi != float("inf") else f">{lo:g}"
        label = label.when((v >= lo) & (v < hi), name) if hi != float("inf") else label.when(v >= lo, name)
    d = df.where(F.col(p).isNotNull() & F.col(grounded)).withColumn("band", label)
    return d.where(F.col("band").isNotNull()).groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), n_true(F.col(p) >= theta).alias("kept"))


def kept_on_grounded(df: DataFrame, p: str, grounded: str, thetas: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Share of kept tiles that are grounded, beside the share of all scored tiles that are."""
    c, g = F.col(p), F.col(grounded)
    return by_threshold(df.where(c.isNotNull()), thetas, {
        "kept": lambda t: n_true(c >= t),
        "kept_grounded": lambda t: F.avg(F.when(c >= t, g.cast("double"))),
        "base_grounded": lambda t: F.avg(g.cast("double"))}, by)


def percentile_summary(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    q = exact_quantiles(df, value, probs, by)
    return q.select(*by, "n", *[F.col("q")[i].alias(f"p{round(p * 100):02d}") for i, p in enumerate(probs)])


def basemap(px: DataFrame, ts: int, v: str = "v") -> DataFrame:
    """Log mean amplitude per tile, stretched by the granule's own p2..p98."""
    t = with_tile(px, ts).groupBy(*TILE).agg(F.log10(F.avg(v)).alias("lg"))
    q = exact_quantiles(t, "lg", [0.02, 0.98], ["granule_id"]).select(
        "granule_id", F.col("q")[0].alias("_lo"), F.col("q")[1].alias("_hi"))
    s = clip((F.col("lg") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9), 0.0, 1.0)
    return t.join(q, "granule_id", "left").withColumn("shade", s).drop("_lo", "_hi")


def reciprocity(wide: DataFrame, a: str, b: str, by: Sequence[str] = ("granule_id",), min_pixels: int = 100) -> DataFrame:
    """Log correlation of two bands over common valid pixels, and the difference of their medians in dB."""
    both = wide.where((F.col(a) > 0) & (F.col(b) > 0)).select(*by, F.log10(a).alias("a"), F.log10(b).alias("b"))
    r = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson("a", "b", min_pixels).alias("r"))
    med = exact_quantiles(both.unpivot(list(by), ["a", "b"], "band", "x"), "x", [0.5], [*by, "band"])
    m = med.groupBy(*by).agg(
        (10 * (F.max(F.when(F.col("band") == "a", F.col("q")[0])) - F.max(F.when(F.col("band") == "b", F.col("q")[0])))).alias("diff_db"))
    return r.join(m, list(by))


def binned_means(df: DataFrame, x: str, y: str, n_bins: int = 10, min_n: int = 5) -> DataFrame:
    """Means of x and y in equal bins of x on [0, 1]; the last bin is closed; thin bins are left out."""
    b = F.least(F.floor(F.col(x) * n_bins), F.lit(n_bins - 1)).alias("bin")
    return df.where(F.col(x).between(0, 1) & F.col(y).isNotNull()).groupBy(b).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y")).where(F.col("n") >= min_n)


def histogram(df: DataFrame, x: str, n_bins: int = 25, by: Sequence[str] = ()) -> DataFrame:
    b = F.least(F.floor(F.col(x) * n_bins), F.lit(n_bins - 1)).alias("bin")
    return df.where(F.col(x).between(0, 1)).groupBy(*by, b).agg(F.count(F.lit(1)).alias("n"))


def correlation(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"), pearson(x, y).alias("r"))


def source_tally(labels: DataFrame, source: str, label: str) -> DataFrame:
    return labels.groupBy(source, label).agg(F.count(F.lit(1)).alias("n"))


def conflicts(labels: DataFrame, key: Sequence[str], label: str) -> DataFrame:
    """Keys whose sources disagree."""
    return labels.groupBy(*key).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo <> hi").select(*key)


def ensemble_mean(scores: DataFrame, tile: Sequence[str], p: str) -> DataFrame:
    return scores.groupBy(*tile).agg(F.avg(p).alias(p), F.count(p).alias("n_members"))


def importance_by_prefix(importances: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Sum of feature importances per name prefix; everything else is `other`."""
    g = F.lit("other")
    for p in reversed(list(prefixes)):
        g = F.when(F.col("feature").startswith(p), p).otherwise(g)
    return importances.groupBy(g.alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.sum("importance").alias("importance"))


def spacings(headers: DataFrame, y: str, px: str = "px_m", by: Sequence[str] = ()) -> DataFrame:
    """Distinct pixel spacings (4 decimals) and whether each was ever seen with a positive label."""
    return headers.groupBy(*by, F.round(px, 4).alias(px)).agg(
        F.count(F.lit(1)).alias("n"), (F.max(y) == 1).alias("seen_positive"))


def label_components(mask: DataFrame, ts: int, batch: int = 1) -> DataFrame:
    """8-connected components inside each tile.  `mask`: (granule_id, row, col, r, c) of the set pixels; adds `comp`.

    No component crosses a tile border, so an Arrow group is a square of batch x batch whole tiles: 1 for full-size
    tiles, more for small ones.  Labels come from hooking to the smallest neighbour label and pointer jumping.
    """
    import pandas as pd

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        r, c = pdf["r"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64)
        w = int(c.max() - c.min()) + 3
        pos = (r - r.min()) * w + c - c.min() + 1
        order = np.argsort(pos)
        pos = pos[order]
        tile = (pdf["row"].to_numpy(np.int64) * (int(pdf["col"].max()) + 1) + pdf["col"].to_numpy(np.int64))[order]
        pairs = []
        for step in (1, w - 1, w, w + 1):
            at = np.clip(np.searchsorted(pos, pos + step), 0, len(pos) - 1)
            hit = np.flatnonzero((pos[at] == pos + step) & (tile[at] == tile))
            pairs.append(np.stack([hit, at[hit]]))
        a, b = np.concatenate(pairs, axis=1)
        root = np.arange(len(pos))
        while True:
            lo = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], lo)
            np.minimum.at(new, root[b], lo)
            while not np.array_equal(new, new[new]):
                new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        return pdf.iloc[order].assign(comp=root)[["granule_id", "row", "col", "r", "c", "comp"]]

    m = mask.select(*TILE, "r", "c")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in m.schema.fields)
    span = ts * batch
    return m.groupBy("granule_id", F.floor(F.col("row") / span), F.floor(F.col("col") / span)).applyInPandas(label, kinds + ", comp bigint")


def component_shapes(labelled: DataFrame, tile: Sequence[str] = TILE) -> DataFrame:
    """Area, eccentricity and major axis length from second moments."""
    g = labelled.groupBy(*tile, "comp").agg(
        F.count(F.lit(1)).alias("area"), F.var_pop("r").alias("a"), F.var_pop("c").alias("b"), F.covar_pop("r", "c").alias("k"))
    half = F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, F.lit(2)) + F.pow("k", F.lit(2)))
    l1 = (F.col("a") + F.col("b")) / 2 + half
    l2 = F.greatest((F.col("a") + F.col("b")) / 2 - half, F.lit(0.0))
    ecc = F.when(l1 > 0, F.sqrt(F.greatest(1 - l2 / l1, F.lit(0.0)))).otherwise(0.0)
    return g.select(*tile, "comp", "area", ecc.alias("eccentricity"), (4 * F.sqrt(l1)).alias("major_axis"))


def component_funnel(shapes: DataFrame, tile: Sequence[str] = TILE, min_size: int = 100, min_ecc: float = 0.85) -> DataFrame:
    """How many components survive the size and the elongation cut, and their total length."""
    big = F.col("area") >= min_size
    long = big & (F.col("eccentricity") >= min_ecc)
    return shapes.groupBy(*tile).agg(
        F.count(F.lit(1)).alias("total_components"), n_true(big).alias("after_size_filter"),
        n_true(long).alias("after_elongation_filter"),
        F.sum(F.when(long, F.col("major_axis")).otherwise(0.0)).alias("total_length"))


def kept_components(labelled: DataFrame, shapes: DataFrame, tile: Sequence[str] = TILE, min_size: int = 100,
                    min_ecc: float = 0.85) -> DataFrame:
    """Pixels of the components that pass both cuts."""
    ok = shapes.where((F.col("area") >= min_size) & (F.col("eccentricity") >= min_ecc)).select(*tile, "comp")
    return labelled.join(ok, [*tile, "comp"], "left_semi")
