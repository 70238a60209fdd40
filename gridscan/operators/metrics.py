"""Evaluation: ranking metrics, overlap metrics, strata, sweeps, controls.

Ranking metrics first count rows per distinct score (map-side), then take running totals over score bins, so
a global AUC or PR curve never sorts all rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from gridscan.functions import stats as ST
from gridscan.functions.stats import n_true
from gridscan.operators.aggregates import by_threshold
from gridscan.plans.lineage import settle
from gridscan.plans.ordering import exact_quantiles, running_totals, value_position


def score_counts(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score; unscored rows take no part."""
    return df.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).cast("double").alias("p")).agg(
        F.sum(F.col(y).cast("long")).alias("n1"), F.sum(1 - F.col(y).cast("long")).alias("n0"))


def average_rank(df: DataFrame, p: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """1-based rank by score, ties sharing their mean rank."""
    h = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("n"))
    h = running_totals(h, by, p, ["n"]).select(*by, p, (F.col("cum_n") - (F.col("n") - 1) / 2).alias(out))
    return df.join(h, [*by, p])


def pr_curve(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct threshold: rows and positives at or above it, precision and recall."""
    c = running_totals(score_counts(df, p, y, by), by, "p", ["n1", "n0"], descending=True)
    tp, fl = F.col("cum_n1"), F.col("cum_n1") + F.col("cum_n0")
    return c.select(*by, "p", tp.alias("tp"), fl.alias("flagged"), (tp / fl).alias("precision"),
                    F.try_divide(tp, F.col("all_n1")).alias("recall"), F.col("all_n1"), F.col("all_n0"))


def auc(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank-sum AUC with average ranks for ties; NULL for a single class."""
    c = running_totals(score_counts(df, p, y, by), by, "p", ["n1", "n0"])
    below = F.col("cum_n0") - F.col("n0") + F.col("n0") / 2
    return c.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("n1") * below), F.max("all_n1").cast("double") * F.max("all_n0")).alias("auc"),
        F.max("all_n1").alias("n_pos"), F.max("all_n0").alias("n_neg"))


def auc_summaries(df: DataFrame, p: str, y: str, fold: str) -> DataFrame:
    """Pooled, pair-weighted within-fold and unweighted fold-mean AUC: report all three or none."""
    per = auc(df, p, y, [fold])
    w = F.col("n_pos") * F.col("n_neg")
    s = per.agg(F.try_divide(F.sum(F.col("auc") * w), F.sum(F.when(F.col("auc").isNotNull(), w))).alias("within_fold"),
                F.avg("auc").alias("fold_mean"), F.count("auc").alias("folds"))
    return s.withColumn("pooled", auc(df, p, y).select("auc").scalar())


def threshold_for_recall(df: DataFrame, p: str, y: str, targets: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Highest threshold whose recall reaches each target (0 when none does), and the share of rows below it."""
    c = pr_curve(df, p, y, by)
    n = F.max(F.col("all_n1") + F.col("all_n0"))
    parts = {"threshold": lambda t: F.coalesce(F.max(F.when(F.col("recall") >= t, F.col("p"))), F.lit(0.0)),
             "skip_rate": lambda t: 1 - F.coalesce(F.min(F.when(F.col("recall") >= t, F.col("flagged"))), n) / n}
    return by_threshold(c, targets, parts, by).withColumnRenamed("theta", "target")


def operating_point(df: DataFrame, p: str, y: str, theta: float, by: Sequence[str] = ()) -> DataFrame:
    """Recall kept, share skipped, negatives discarded, accuracy at 0.5."""
    d = df.where(F.col(p).isNotNull())
    keep, pos = F.col(p) >= theta, F.col(y) == 1
    return d.groupBy(*by).agg(
        F.try_divide(n_true(keep & pos), n_true(pos)).alias("recall"), F.avg((~keep).cast("double")).alias("skipped"),
        F.try_divide(n_true(~keep & ~pos), n_true(~pos)).alias("negatives_discarded"),
        F.avg(((F.col(p) >= 0.5) == pos).cast("double")).alias("accuracy"))


def lift_table(df: DataFrame, p: str, y: str, thetas: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Precision over base rate per fold and threshold; both NULL where nothing is flagged."""
    d = df.where(F.col(p).isNotNull())
    pos = F.col(y).cast("double")
    base = F.avg(pos)

    def prec(t):
        return F.avg(F.when(F.col(p) >= t, pos))
    return by_threshold(d, thetas, {"n": lambda t: F.count(F.lit(1)), "base": lambda t: base, "flagged": lambda t: n_true(F.col(p) >= t),
                                    "precision": prec, "lift": lambda t: F.try_divide(prec(t), base)}, by)


def tile_confusion(px: DataFrame, tile: Sequence[str], prob: str, target: str, pred_theta: float = 0.5, target_theta: float = 0.2) -> DataFrame:
    """TP, FP, FN and pixel count per tile; both sides are thresholded strictly above."""
    a, b = F.col(prob) > pred_theta, F.col(target) > target_theta
    return px.groupBy(*tile).agg(n_true(a & b).alias("tp"), n_true(a & ~b).alias("fp"), n_true(~a & b).alias("fn"), F.count(F.lit(1)).alias("n_px"))


def with_scores(conf: DataFrame) -> DataFrame:
    """IoU, precision, recall and F1 of a confusion table."""
    d = conf.withColumn("iou", ST.iou("tp", "fp", "fn")).withColumn("precision", ST.precision("tp", "fp")).withColumn("recall", ST.recall("tp", "fn"))
    return d.withColumn("f1", ST.f1("precision", "recall"))


def pooled(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return with_scores(conf.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def iou_summary(conf: DataFrame, tile: str, batch: int) -> DataFrame:
    """Pooled IoU; mean, median, p10, p90 over tiles; mean over batches of `batch` tiles in tile order.

    The tile table (one row per tile) is settled first, so the pixels are read once.
    """
    conf = settle(conf)
    t = with_scores(conf)
    q = exact_quantiles(t, "iou", [0.1, 0.5, 0.9]).select("q").scalar()
    b = value_position(conf, [], tile, [], "_rn").withColumn("batch", F.floor((F.col("_rn") - 1) / batch))
    pb = pooled(b, ["batch"]).agg(F.avg("iou")).scalar()
    out = t.agg(F.count(F.lit(1)).alias("n_tiles"), ST.iou(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("pooled"), F.avg("iou").alias("tile_mean"))
    return out.withColumn("_q", q).select("n_tiles", "pooled", "tile_mean", F.col("_q")[1].alias("tile_median"),
                                          F.col("_q")[0].alias("tile_p10"), F.col("_q")[2].alias("tile_p90"), pb.alias("batch_mean"))


def stratify(conf: DataFrame, value: str, n_bins: int = 3) -> DataFrame:
    """Pooled metrics in quantile bins of a per-tile value: [lo, hi), the last bin closed; nothing when too few values.

    The tile table is settled first, so the pixels are read once.
    """
    conf = settle(conf)
    q = exact_quantiles(conf, value, [i / n_bins for i in range(n_bins + 1)])
    d = conf.where(F.col(value).isNotNull()).withColumn("_q", q.select(F.struct("q", "n")).scalar())
    d = d.where(F.col("_q.n") >= 2 * n_bins)
    b = sum([(F.get("_q.q", F.lit(i)) <= F.col(value)).cast("int") for i in range(1, n_bins)], F.lit(0))
    d = d.withColumn("bin", b).withColumn("lo", F.get("_q.q", F.col("bin"))).withColumn("hi", F.get("_q.q", F.col("bin") + 1))
    return pooled(d, ["bin", "lo", "hi"])


def stratify_fixed(conf: DataFrame, value: str, cuts: Sequence[tuple[float, float, str]]) -> DataFrame:
    """Pooled metrics per stratum; `cuts` are (from, below, name), rows outside all of them are left out."""
    name = F.lit(None).cast("string")
    for lo, hi, nm in reversed(list(cuts)):
        name = F.when((F.col(value) >= lo) & (F.col(value) < hi), nm).otherwise(name)
    return pooled(conf.withColumn("stratum", name).where("stratum IS NOT NULL"), ["stratum"])


SWEEP = [round(0.05 * i, 2) for i in range(1, 20)]


def threshold_sweep(px: DataFrame, prob: str, target: str, target_theta: float = 0.2, thetas: Sequence[float] = SWEEP) -> DataFrame:
    """Pooled metrics per prediction threshold, target fixed: one pass with 3 counters per threshold."""
    b = F.col(target) > target_theta
    parts = {"tp": lambda t: n_true((F.col(prob) > t) & b), "fp": lambda t: n_true((F.col(prob) > t) & ~b), "fn": lambda t: n_true(~(F.col(prob) > t) & b)}
    d = with_scores(by_threshold(px, thetas, parts))
    one = W.partitionBy(F.lit(0))  # one row per threshold
    return d.withColumn("best", F.col("iou") == F.max("iou").over(one))


def control(df: DataFrame, measured: str, recorded: str, tol: float = 5e-3) -> DataFrame:
    """A metric must reproduce its recorded value before anything else is read."""
    d = F.abs(F.col(measured) - F.col(recorded))
    return df.withColumn("delta", d).withColumn("verdict", F.when(d < tol, "MATCH").otherwise("MISMATCH"))


def coverage_ratio(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    t, p, n = F.sum(F.col("tp") + F.col("fn")), F.sum(F.col("tp") + F.col("fp")), F.sum("n_px")
    return conf.groupBy(*by).agg((t / n).alias("target_cov"), (p / n).alias("pred_cov"), ((p / n) / F.greatest(t / n, F.lit(1e-9))).alias("ratio"))


def feature_auc(df: DataFrame, features: Sequence[str], y: str, by: Sequence[str] = ()) -> DataFrame:
    """AUC of every single feature taken as a score."""
    long = df.select(*by, y, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([*by, y], list(features), "feature", "x")
    return auc(long, "x", y, [*by, "feature"])


def margin_over_baseline(df: DataFrame, features: Sequence[str], baseline: Sequence[str], y: str, by: Sequence[str] = ()) -> DataFrame:
    """AUC of every feature beside the best AUC among the `baseline` columns (map coordinates, say), and the margin."""
    a = feature_auc(df, [*features, *baseline], y, by)
    best = F.max(F.when(F.col("feature").isin(*baseline), F.col("auc"))).over(W.partitionBy(*by) if by else W.partitionBy(F.lit(0)))
    a = a.withColumn("baseline_auc", best).where(~F.col("feature").isin(*baseline))
    return a.withColumn("margin", F.col("auc") - F.col("baseline_auc"))


def speckle_table(tiles: DataFrame, metrics: Sequence[str], source: str, key: Sequence[str], a: str, b: str) -> DataFrame:
    """Median of each metric for two sources on the tiles both have, and their ratio."""
    two = tiles.where(F.col(source).isin(a, b))
    both = two.groupBy(*key).agg(F.count_distinct(source).alias("_n")).where("_n = 2").select(*key)
    long = two.join(both, list(key)).select(source, *metrics).unpivot([source], list(metrics), "metric", "x")
    q = exact_quantiles(long, "x", [0.5], ["metric", source])
    m = q.groupBy("metric").agg(F.max(F.when(F.col(source) == a, F.col("q")[0])).alias("median_a"),
                                F.max(F.when(F.col(source) == b, F.col("q")[0])).alias("median_b"), F.max("n").alias("n"))
    return m.withColumn("ratio", F.try_divide("median_a", "median_b"))


def class_medians(df: DataFrame, p: str, y: str, by: Sequence[str]) -> DataFrame:
    q = exact_quantiles(df, p, [0.5], [*by, y])
    return q.select(*by, y, "n", F.col("q")[0].alias("median_p"))


def model_agreement(df: DataFrame, a: str, b: str, theta_a: float, theta_b: float) -> DataFrame:
    """Cross table of two models' own flags; the scores are never combined."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy((F.col(a) >= theta_a).alias("flag_a"), (F.col(b) >= theta_b).alias("flag_b")).agg(F.count(F.lit(1)).alias("n"))
