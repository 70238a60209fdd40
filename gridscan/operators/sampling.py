"""Seeded and systematic samples, top-k picks.

Random draws are the md5 order of `seed|key`: reproducible in any engine and prefix-stable (a larger n keeps
the smaller draw).  Top-k runs as Spark's limit or group-limit, which prune before the shuffle; full ranks
come from `gridscan.plans.ordering`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridscan.plans.lineage import cut_lineage
from gridscan.plans.ordering import hash_position, order_key, position_in_bins, value_position
from gridscan.schema import SEED, TILE


def _first_per_group(df: DataFrame, n: int, by: Sequence[str], order: Sequence, ranked) -> DataFrame:
    """First n rows per group.  While the session lets Spark prune groups of n before the shuffle, a plain
    window does; beyond that `ranked(df, name)` ranks bin by bin, so that no group is sorted in one task."""
    if n <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        d = df.withColumn("_first", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long"))
    else:
        d = ranked(df, "_first")
    return d.where(F.col("_first") <= n)


def first_n(df: DataFrame, n: int, order: Sequence[str] = ("row", "col")) -> DataFrame:
    """The first n rows in scan order."""
    return df.orderBy(*order).limit(n)


def draw(df: DataFrame, n: int, key: Sequence[str], seed: int = SEED, by: Sequence[str] = (),
         scan_order: Sequence[str] | None = None) -> DataFrame:
    """n rows without replacement (per group with `by`); `scan_order` restores the reading order."""
    h = df.withColumn("_h", order_key(seed, *key))
    if by:
        out = _first_per_group(h, n, by, ["_h", *key], lambda d, c: hash_position(d.drop("_h"), by, seed, key, c)).drop("_first", "_h")
    else:
        out = h.orderBy("_h", *key).limit(n).drop("_h")
    return out.orderBy(*scan_order) if scan_order else out


def every_kth(tiles: DataFrame, k: int, by: Sequence[str] = ("granule_id",)) -> DataFrame:
    """Every k-th tile in scan order (the first included); ranks are finished grid row by grid row."""
    p = position_in_bins(tiles, by, F.coalesce(F.col("row").cast("long"), F.lit(0)), ["row", "col"], "_pos")
    return p.where((F.col("_pos") - 1) % k == 0).drop("_pos")


def sample_valid(tiles: DataFrame, n: int, valid: Column, seed: int = SEED, every: int = 5, by: Sequence[str] = ("granule_id",), scan: int = 3) -> DataFrame:
    """n random tiles among the first scan x n valid ones of a systematic scan; random tiles where none is valid."""
    cand = every_kth(tiles, every, by).where(valid)
    cand = _first_per_group(cand, scan * n, by, ["row", "col"], lambda d, c: position_in_bins(
        d, by, F.coalesce(F.col("row").cast("long"), F.lit(0)), ["row", "col"], c)).drop("_first")
    good = draw(cand, n, TILE, seed, by)
    rest = tiles.join(cand.select(*by).distinct(), list(by), "left_anti")
    return good.withColumn("fallback", F.lit(False)).unionByName(
        draw(rest, n, TILE, seed, by).withColumn("fallback", F.lit(True)))


def spaced_pick(cands: DataFrame, min_sep: int, seed: int = SEED, n: int | None = None, key: Sequence[str] = ("granule_id",)) -> DataFrame:
    """Greedy pick in seeded order with Chebyshev separation >= min_sep, as parallel rounds.

    A round accepts every undecided tile that comes before all undecided tiles within reach, then drops the
    tiles the new picks block; that is exactly the sequential greedy result.  Reach is separable: each tile
    stands in the 2m + 1 grid rows it reaches, and a range frame of m to either side along each row does the
    rest, so no pair of tiles is ever emitted and no cell of the square is listed.  Rounds grow with the longest
    chain of conflicts (logarithmic for random orders); each is checkpointed.
    """
    cols = cands.columns
    und = cut_lineage(cands.withColumn("_h", order_key(seed, *key, "ti", "tj")))
    m = min_sep - 1
    if m <= 0:
        picked = und
    else:
        along = W.partitionBy(*key, "ti").orderBy("tj").rangeBetween(-m, m)

        def in_rows(d: DataFrame) -> DataFrame:
            """Each tile once in every grid row it reaches; `_own` where it stands itself."""
            e = d.withColumn("_i", F.explode(F.sequence(F.lit(-m), F.lit(m))))
            return e.withColumn("ti", F.col("ti") + F.col("_i")).withColumn("_own", F.col("_i") == 0).drop("_i")

        picked = None
        while True:
            best = in_rows(und).withColumn("_best", F.min("_h").over(along))
            decided = cut_lineage(best.where("_own").select(*und.columns, (F.col("_h") == F.col("_best")).alias("_won")))
            won = decided.where("_won").drop("_won")
            picked = won if picked is None else picked.unionByName(won)
            marks = in_rows(won.select(*key, "ti", "tj")).select(*key, "ti", "tj", F.lit(True).alias("_mark"))
            rest = decided.where(~F.col("_won")).drop("_won").withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
            rest = rest.withColumn("_near", F.max("_mark").over(along)).where(~F.col("_mark") & ~F.col("_near"))
            und = cut_lineage(rest.select(*und.columns))
            if und.isEmpty():
                break
    if n is not None:
        picked = picked.orderBy("_h").limit(n)
    return picked.select(*cols)


def top_k(df: DataFrame, k: int, value: str, ties: Sequence[str] = ("row", "col")) -> DataFrame:
    return df.where(F.col(value).isNotNull()).orderBy(F.col(value).desc(), *ties).limit(k)


def per_class(df: DataFrame, k: int, cls: str, p: str, ties: Sequence[str], descending=("tp", "fp")) -> DataFrame:
    """k rows per confusion class: most confident first for tp/fp, lowest score first for fn/tn."""
    d = df.withColumn("_o", F.when(F.col(cls).isin(list(descending)), -F.col(p)).otherwise(F.col(p)))
    out = _first_per_group(d, k, [cls], ["_o", *ties], lambda x, c: value_position(x, [cls], "_o", ties, c))
    return out.withColumnRenamed("_first", "rn").drop("_o")


def spread_thirds(df: DataFrame, value: str, tile: str, n: int) -> DataFrame:
    """n//3 worst, middle and best tiles by value, without repeats, capped at n in tile order."""
    d = value_position(df, [], value, [tile], "_pos", total="_all")
    pos, tot = F.col("_pos") - 1, F.col("_all")
    nn = F.least(F.lit(n), tot)
    k = F.greatest(F.lit(1), F.floor(nn / 3))
    start = F.greatest(F.lit(0), F.floor(tot / 2) - F.floor(k / 2))
    end = F.floor(tot / 2) - F.floor(k / 2) + k
    part = F.when(pos < k, "worst").when((pos >= start) & (pos < end), "median").when(pos >= tot - k, "best")
    return d.withColumn("part", part).where("part IS NOT NULL").drop("_pos", "_all").orderBy(tile).limit(n)


def select_flagged(df: DataFrame, n: int, flag: str, how: str, mean_prob: str, key: Sequence[str], seed: int = SEED) -> DataFrame:
    f = df.where(F.col(flag))
    if how == "best":
        return top_k(f, n, mean_prob, key)
    if how == "random":
        return draw(f, n, key, seed)
    raise ValueError(f"how must be 'best' or 'random', not {how!r}")


def positives_first(df: DataFrame, n: int, tier: str, key: Sequence[str], seed: int = SEED, first: str = "hard") -> DataFrame:
    """Up to n rows, all of tier `first` before any other, seeded order inside a tier."""
    d = df.withColumn("_t", F.when(F.col(tier) == first, 0).otherwise(1)).withColumn("_h", order_key(seed, *key))
    return d.orderBy("_t", "_h", *key).limit(n).drop("_t", "_h")
