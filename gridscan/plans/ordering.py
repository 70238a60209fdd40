"""Exact order statistics that do not need one group in one task.

`percentile`, an unpartitioned window or a window over one hot key all send a whole group to a single task.
These helpers split every group into bins by value first, so that the largest unit of work is one bin:

* a bin is a fixed logarithmic interval of the value (`value_bin`): order-preserving, the same on every
  evaluation and every executor, and needs no pass over the data;
* bin totals (one short row per non-empty bin) give each bin its start rank;
* ranks, running sums and quantiles are then finished inside (group, bin).

Results are exact; the bins only balance the work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BINS_PER_OCTAVE = 1024
_ZERO = 1100 * BINS_PER_OCTAVE  # beyond the exponent range of a double


def value_bin(v: Column) -> Column:
    """Order-preserving bin: 1024 per power of two on each side of zero, one each for -infinity, infinity and NaN (last)."""
    v = v.cast("double")

    def mag(x: Column) -> Column:
        return F.floor(F.log2(x) * BINS_PER_OCTAVE) + 1 + _ZERO

    # Never NULL: a nullable bin would add an inferred filter to one side of the rank joins, and the two
    # sides could then no longer share one exchange.
    edge, beyond = F.lit(2 * _ZERO).cast("long"), F.lit(2 * _ZERO + 1).cast("long")
    infinite = F.lit(float("inf"))
    return F.coalesce(F.when(F.isnan(v), beyond).when(v == infinite, edge).when(v == -infinite, -edge).when(v > 0, mag(v)).when(v < 0, -mag(-v)), F.lit(0).cast("long"))


def _bin_starts(binned: DataFrame, by: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Per (group, bin): totals of the bins before it, and of the whole group."""
    keys = [*by, "_bin"]
    totals = binned.groupBy(*keys).agg(*[e.alias(f"_in_{n}") for n, e in sums.items()])
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    upto = group.orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    for n in sums:
        totals = (totals
                  .withColumn(f"_start_{n}", F.sum(f"_in_{n}").over(upto) - F.col(f"_in_{n}"))
                  .withColumn(f"_all_{n}", F.sum(f"_in_{n}").over(group)))
    return totals


def running_totals(df: DataFrame, by: Sequence[str], order: str, sums: Sequence[str],
                   descending: bool = False) -> DataFrame:
    """Inclusive running sums of `sums` along `order` within `by`, plus group totals.

    `df` must hold one row per (by, order): aggregate ties first.  Adds `cum_<s>` and `all_<s>`.
    """
    binned = df.withColumn("_bin", value_bin(F.col(order)))
    starts = _bin_starts(binned, by, {s: F.sum(s) for s in sums})
    inner = (W.partitionBy(*by, "_bin").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    out = binned.join(starts.drop(*[f"_in_{s}" for s in sums]), [*by, "_bin"])
    cols = [F.col(x) for x in df.columns]
    for s in sums:
        up = F.col(f"_start_{s}") + F.sum(s).over(inner)
        cum = F.col(f"_all_{s}") - up + F.col(s) if descending else up
        cols += [cum.alias(f"cum_{s}"), F.col(f"_all_{s}").alias(f"all_{s}")]
    return out.select(*cols)


def position_in_bins(df: DataFrame, by: Sequence[str], bin_col: Column, order: Sequence[Column | str],
                     name: str = "rn", total: str | None = None) -> DataFrame:
    """Exact 1-based `row_number` over (bin_col, *order) within `by`.

    `bin_col` must come first in the wanted order (a grid row, a hash prefix, ...).  One task sorts one
    (group, bin) only.  `total` also returns the group size.
    """
    binned = df.withColumn("_bin", bin_col)
    starts = _bin_starts(binned, by, {"n": F.count(F.lit(1))})
    inner = W.partitionBy(*by, "_bin").orderBy(*order)
    out = (binned.withColumn("_rn_in_bin", F.row_number().over(inner).cast("long"))
           .join(starts, [*by, "_bin"])
           .withColumn(name, F.col("_start_n") + F.col("_rn_in_bin")))
    if total:
        out = out.withColumn(total, F.col("_all_n"))
    return out.drop("_bin", "_rn_in_bin", "_in_n", "_start_n", "_all_n")


def order_key(seed: int | str, *keys: str) -> Column:
    """Seeded pseudo-random order: md5 of `seed|k1|k2|...`; the same text in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def hash_position(df: DataFrame, by: Sequence[str], seed: int | str, keys: Sequence[str], name: str = "rn",
                  total: str | None = None) -> DataFrame:
    """Position of each row in the seeded order of its group; 256 hash prefixes share a hot group."""
    h = df.withColumn("_h", order_key(seed, *keys))
    return position_in_bins(h, by, F.coalesce(F.substring("_h", 1, 2), F.lit("")), ["_h", *keys], name, total).drop("_h")


def value_position(df: DataFrame, by: Sequence[str], order: str, ties: Sequence[str], name: str = "rn",
                   descending: bool = False, total: str | None = None) -> DataFrame:
    """Exact `row_number` by value (ties broken by `ties`) within `by`, bin by bin."""
    first = value_bin(F.col(order))
    key = F.col(order).desc() if descending else F.col(order).asc()
    return position_in_bins(df, by, -first if descending else first, [key, *ties], name, total)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                    name: str = "q") -> DataFrame:
    """Linear-interpolation quantiles of non-null `value` per group, as `<name> ARRAY<DOUBLE>` and `n`.

    Equals `percentile(value, probs)` without holding a group's values in one task: equal values are
    counted before the shuffle, and only the bins that hold a wanted rank are sorted.
    """
    by = list(by)
    hist = (df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v"))
            .agg(F.count(F.lit(1)).alias("_n")))
    binned = hist.withColumn("_bin", value_bin(F.col("_v")))
    starts = _bin_starts(binned, by, {"n": F.sum("_n")})

    def rank(p: float) -> Column:
        return (F.col("_all_n") - 1) * F.lit(float(p))

    wanted = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), r.cast("long").alias("rank"))
        for i, p in enumerate(probs)
        for side, r in ((0, F.floor(rank(p))), (1, F.ceil(rank(p))))
    ])
    lo, hi = F.col("_start_n"), F.col("_start_n") + F.col("_in_n")
    needed = (starts.withColumn("_t", F.filter(wanted, lambda t: (t["rank"] >= lo) & (t["rank"] < hi)))
              .where(F.size("_t") > 0).drop("_in_n"))
    inner = W.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    end = F.col("_start_n") + F.sum("_n").over(inner)
    hits = (binned.join(needed, [*by, "_bin"])
            .withColumn("_end", end)
            .select(*by, "_v", "_n", "_end", "_all_n", F.explode("_t").alias("t"))
            .where((F.col("t.rank") < F.col("_end")) & (F.col("t.rank") >= F.col("_end") - F.col("_n"))))
    at = {(i, s): F.max(F.when((F.col("t.i") == i) & (F.col("t.side") == s), F.col("_v")))
          for i in range(len(probs)) for s in (0, 1)}
    n = F.max("_all_n")
    qs = []
    for i, p in enumerate(probs):
        h = (n - 1) * F.lit(float(p))
        step = (at[i, 1] - at[i, 0]) * (h - F.floor(h))
        # Between equal ends (two infinities too) there is nothing to add.
        qs.append(F.when(at[i, 0] == at[i, 1], at[i, 0]).otherwise(at[i, 0] + step))
    return hits.groupBy(*by).agg(F.array(*qs).alias(name), n.alias("n"))
