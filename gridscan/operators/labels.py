"""Label sets: union of sources, derivation from a label raster, matching and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridscan.operators.joins import distance_to_positive
from gridscan.plans.ordering import exact_quantiles, hash_position
from gridscan.schema import SEED


def union_labels(sources: Sequence[DataFrame], key: Sequence[str], label: str) -> DataFrame:
    """One label per key: earlier sources win, keys with differing labels are dropped.  One aggregation."""
    u = None
    for rank, s in enumerate(sources):
        s = s.withColumn("_rank", F.lit(rank))
        u = s if u is None else u.unionByName(s, allowMissingColumns=True)
    rest = [c for c in u.columns if c not in key and c != "_rank"]
    g = u.groupBy(*key).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"),
                            F.min_by(F.struct(*rest), "_rank").alias("_s"), F.min("_rank").alias("source_rank"))
    return g.where(F.col("_lo") == F.col("_hi")).select(*key, "_s.*", "source_rank")


def first_wins(df: DataFrame, key: Sequence[str], rank: Column | str) -> DataFrame:
    """Keep the row with the lowest rank per key; `min_by` combines map-side, so a hot key costs nothing."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), rank).alias("_s")).select(*key, "_s.*")


def shared_keys(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    return a.select(*key).intersect(b.select(*key))


def fresh_rows(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    return a.join(b.select(*key), list(key), "left_anti")


def with_augmented(df: DataFrame, copies: Sequence[DataFrame], fold: str) -> DataFrame:
    """Native rows plus augmented copies, flagged; a copy keeps its original's key and fold."""
    out = df.withColumn("native", F.lit(True)).withColumn("copy", F.lit(0))
    for i, c in enumerate(copies, 1):
        out = out.unionAll(c.withColumn("native", F.lit(False)).withColumn("copy", F.lit(i)).select(*out.columns))
    return out


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def derive_labels(grid: DataFrame, positive_label: str, negative_label: str = "none", pos: float = 0.5, min_data: float = 0.5,
                  neg_buffer: float = 2, neg_max: float | None = None, hard_min: float = 0.0, tile_km: float = 2.56,
                  key: Sequence[str] = ("granule_id",), allowed: Column | None = None) -> DataFrame:
    """Tile labels from a dense grid (ti, tj, aoi_pos_frac, data_frac).

    Positive: fraction above `pos` (tier core), or ambiguous but at least `hard_min` (tier hard).
    Negative: fraction 0, at least `neg_buffer` (and at most `neg_max`) tiles from any positive pixel.
    Everything else, and tiles with too little data, is dropped.
    """
    d = distance_to_positive(grid.withColumn("_any", F.col("aoi_pos_frac") > 0), "_any", key)
    f, dist = F.col("aoi_pos_frac"), F.col("dist")
    enough = F.col("data_frac") >= min_data
    if allowed is not None:
        enough = enough & allowed
    core = f > pos
    hard = (f > 0) & ~core & (f >= hard_min) if hard_min > 0 else F.lit(False)
    far = dist.isNull() | (dist >= neg_buffer)
    if neg_max is not None:
        far = far & (dist <= neg_max)
    label = F.when(core | hard, positive_label).when((f == 0) & far, negative_label)
    tier = F.when(hard, "hard").otherwise("core")
    out = d.where(enough).withColumn("label", label).where(F.col("label").isNotNull())
    return out.withColumn("tier", tier).withColumn("dist_km", dist * tile_km).drop("_any", "dist")


def match_by_speed(df: DataFrame, y: str, vel: str, n_bins: int, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """1:1 match of the classes inside pooled speed-quantile bins; unmatched positives come back as `spare`.

    Ranks inside (bin, class) come from hash-prefix bins, so one dominant speed bin is spread over tasks.
    """
    d = df.where(F.col(vel).isNotNull())
    q = exact_quantiles(d, vel, [i / n_bins for i in range(n_bins + 1)])
    edges = F.array_distinct("q")
    inner = q.select(F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0))).alias("e")).scalar()
    above = [F.coalesce(F.get("_e", F.lit(i)) <= F.col(vel), F.lit(False)).cast("int") for i in range(n_bins - 1)]
    d = d.withColumn("_e", inner).withColumn("bin", sum(above, F.lit(0))).drop("_e")
    r = hash_position(d, ["bin", y], seed, key, "_rn", total="_all")
    size = d.groupBy("bin").agg(F.least(F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)).alias("_k"))
    out = r.join(size, "bin")
    part = F.when(F.col("_rn") <= F.col("_k"), "matched").when(F.col(y) == 1, "spare")
    return out.withColumn("part", part).where("part IS NOT NULL").drop("_rn", "_all", "_k")


def two_threshold(df: DataFrame, frac: str, inbox: str, pos: float = 0.5, neg: float = 0.05, usable: Column | None = None) -> DataFrame:
    ok = F.col(inbox) & ((F.col(frac) >= pos) | (F.col(frac) <= neg))
    if usable is not None:
        ok = ok & usable
    return df.withColumn("y", (F.col(frac) >= pos).cast("int")).withColumn("labelled", F.coalesce(ok, F.lit(False)))


def balanced_weights(df: DataFrame, y: str, out: str = "weight") -> DataFrame:
    """n / (2 * n_class) per row."""
    s = df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("n1")).alias("s")).scalar()
    d = df.withColumn("_s", s)
    n, n1 = F.col("_s.n"), F.col("_s.n1")
    return d.withColumn(out, F.try_divide(n, 2 * F.when(F.col(y) == 1, n1).otherwise(n - n1))).drop("_s")
