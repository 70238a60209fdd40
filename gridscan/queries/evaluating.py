"""Evaluation."""

from pyspark.sql import functions as F

from gridscan.functions.stats import looks
from gridscan.operators import metrics as M
from gridscan.operators.stencil import residual_rho1
from gridscan.queries import views as V
from gridscan.queries.registry import query
from gridscan.queries.stencils import DEN, image, nb

_RANK = """, rk AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {p}) + (count(*) OVER (PARTITION BY {by}, {p}) - 1) / 2.0 AS rk FROM {src} WHERE {p} IS NOT NULL)"""
_AUC = "(sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0)"


def scored(spark, sf):
    """feat with p_t: a coarse score with many ties."""
    return V.feat(spark, sf).withColumn("p_t", F.floor(F.col("p_a") * 20) / 20)


_SC = ", sc AS (SELECT *, floor(p_a * 20) / 20 AS p_t, 1 AS one FROM feat)"


@query("w13_average_rank", _SC + _RANK.format(by="one", p="p_t", src="sc") + " SELECT vec_id, round(rk, 6) AS rank FROM rk", "feat")
def _(spark, sf):
    return M.average_rank(scored(spark, sf), "p_t").select("vec_id", F.round("rank", 6).alias("rank"))


@query("w14_pr_curve", """, d AS (SELECT p_b AS p, sum(y) AS n1, count(*) AS n FROM feat WHERE p_b IS NOT NULL GROUP BY 1),
    c AS (SELECT p, sum(n1) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS fl, sum(n1) OVER () AS n1 FROM d)
    SELECT round(p, 6) AS p, CAST(tp AS BIGINT) AS tp, CAST(fl AS BIGINT) AS flagged, round(tp / fl, 6) AS "precision", round(tp / n1, 6) AS recall FROM c""", "feat")
def _(spark, sf):
    d = M.pr_curve(V.feat(spark, sf), "p_b", "y")
    return d.select(F.round("p", 6).alias("p"), "tp", "flagged", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("e01_auc", _SC + _RANK.format(by="label // 4", p="p_t", src="sc") + f""" SELECT CAST(label // 4 AS INTEGER) AS grp, round({_AUC}, 6) AS auc,
    count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM rk GROUP BY 1""", "feat")
def _(spark, sf):
    d = M.auc(scored(spark, sf).withColumn("grp", F.floor(F.col("label") / 4).cast("int")), "p_t", "y", ["grp"])
    return d.withColumn("auc", F.round("auc", 6))


@query("e02_auc_summaries", _RANK.format(by="granule_id", p="p_b", src="feat") + f""", f AS (SELECT granule_id, {_AUC} AS a, count(*) FILTER (y = 1) * count(*) FILTER (y = 0) AS w FROM rk GROUP BY 1),
    pr AS (SELECT *, rank() OVER (ORDER BY p_b) + (count(*) OVER (PARTITION BY p_b) - 1) / 2.0 AS rk FROM feat WHERE p_b IS NOT NULL), po AS (SELECT {_AUC} AS a FROM pr)
    SELECT round(sum(a * w) / sum(w), 6) AS within_fold, round(avg(a), 6) AS fold_mean, count(a) AS folds, round((SELECT a FROM po), 6) AS pooled FROM f""", "feat")
def _(spark, sf):
    d = M.auc_summaries(V.feat(spark, sf), "p_b", "y", "granule_id")
    return d.select("folds", *[F.round(c, 6).alias(c) for c in ("within_fold", "fold_mean", "pooled")])


@query("e03_threshold_for_recall", """, g AS (SELECT a.granule_id, a.p_a AS p, count(*) FILTER (b.p_a >= a.p_a) AS fl,
      count(*) FILTER (b.p_a >= a.p_a AND b.y = 1) / CAST(count(*) FILTER (b.y = 1) AS DOUBLE) AS rec, count(*) AS n
      FROM (SELECT DISTINCT granule_id, p_a FROM feat) a JOIN feat b USING (granule_id) GROUP BY 1, 2),
    t AS (SELECT CAST(unnest([0.9, 0.95]) AS DOUBLE) AS target)
    SELECT granule_id, target, round(coalesce(max(p) FILTER (rec >= target), 0.0), 6) AS threshold,
      round(1 - coalesce(min(fl) FILTER (rec >= target), max(n)) / CAST(max(n) AS DOUBLE), 6) AS skip_rate FROM g, t GROUP BY 1, 2""", "feat")
def _(spark, sf):
    d = M.threshold_for_recall(V.feat(spark, sf), "p_a", "y", [0.9, 0.95], ["granule_id"])
    return d.select("granule_id", "target", F.round("threshold", 6).alias("threshold"), F.round("skip_rate", 6).alias("skip_rate"))


@query("e04_operating_point", """SELECT granule_id, round(avg(CAST(p_b >= 0.4 AS INTEGER)) FILTER (y = 1), 6) AS recall, round(avg(CAST(p_b < 0.4 AS INTEGER)), 6) AS skipped,
    round(avg(CAST(p_b < 0.4 AS INTEGER)) FILTER (y = 0), 6) AS negatives_discarded, round(avg(CAST((p_b >= 0.5) = (y = 1) AS INTEGER)), 6) AS accuracy
    FROM feat WHERE p_b IS NOT NULL GROUP BY 1""", "feat")
def _(spark, sf):
    d = M.operating_point(V.feat(spark, sf), "p_b", "y", 0.4, ["granule_id"])
    return d.select("granule_id", *[F.round(c, 6).alias(c) for c in ("recall", "skipped", "negatives_discarded", "accuracy")])


@query("e05_lift", """SELECT granule_id, theta, count(*) AS n, round(avg(y), 6) AS base, count(*) FILTER (p_b >= theta) AS flagged, round(avg(y) FILTER (p_b >= theta), 6) AS "precision",
    round((avg(y) FILTER (p_b >= theta)) / avg(y), 6) AS lift FROM feat, (SELECT CAST(unnest([0.5, 0.65, 0.8, 0.999]) AS DOUBLE) AS theta) WHERE p_b IS NOT NULL GROUP BY 1, 2""", "feat")
def _(spark, sf):
    d = M.lift_table(V.feat(spark, sf), "p_b", "y", [0.5, 0.65, 0.8, 0.999], ["granule_id"])
    return d.select("granule_id", "theta", "n", "flagged", *[F.round(c, 6).alias(c) for c in ("base", "precision", "lift")])


_CONF = """, cf AS (SELECT tile, count(*) FILTER (prob > 0.5 AND target > 0.4) AS tp, count(*) FILTER (prob > 0.5 AND NOT target > 0.4) AS fp,
    count(*) FILTER (NOT prob > 0.5 AND target > 0.4) AS fn, count(*) AS n_px FROM seg GROUP BY 1)"""
_IOU = "(tp + 1e-6) / (tp + fp + fn + 1e-6)"
_P = "(tp + 1e-6) / (tp + fp + 1e-6)"
_R = "(tp + 1e-6) / (tp + fn + 1e-6)"


def conf(spark, sf):
    return M.tile_confusion(V.seg(spark, sf), ["tile"], "prob", "target", 0.5, 0.4)


@query("e06_tile_confusion", _CONF + " SELECT * FROM cf", "seg")
def _(spark, sf):
    return conf(spark, sf)


@query("e07_overlap_scores", _CONF + f", s AS (SELECT tile, {_IOU} AS iou, {_P} AS p, {_R} AS r FROM cf) " + """SELECT tile, round(iou, 6) AS iou, round(p, 6) AS "precision",
    round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-6), 6) AS f1 FROM s""", "seg")
def _(spark, sf):
    return M.with_scores(conf(spark, sf)).select("tile", *[F.round(c, 6).alias(c) for c in ("iou", "precision", "recall", "f1")])


@query("e08_iou_summary", _CONF + f""", s AS (SELECT *, {_IOU} AS iou, (row_number() OVER (ORDER BY tile) - 1) // 8 AS b FROM cf),
    bt AS (SELECT b, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM s GROUP BY 1)
    SELECT count(*) AS n_tiles, round((sum(tp) + 1e-6) / (sum(tp + fp + fn) + 1e-6), 6) AS pooled, round(avg(iou), 6) AS tile_mean, round(quantile_cont(iou, 0.5), 6) AS tile_median,
      round(quantile_cont(iou, 0.1), 6) AS tile_p10, round(quantile_cont(iou, 0.9), 6) AS tile_p90, round((SELECT avg({_IOU}) FROM bt), 6) AS batch_mean FROM s""", "seg")
def _(spark, sf):
    d = M.iou_summary(conf(spark, sf), "tile", 8)
    return d.select("n_tiles", *[F.round(c, 6).alias(c) for c in d.columns if c != "n_tiles"])


def conf_with_value(spark, sf):
    c = conf(spark, sf)
    v = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("tile"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 10000).alias("val"))
    return c.join(v, "tile", "left")


_CV = _CONF + ", cv AS (SELECT cf.*, CASE WHEN s_acctbal > 0 THEN s_acctbal / 10000 END AS val FROM cf LEFT JOIN supplier ON s_suppkey = tile)"


@query("e09_stratify", _CV + f""", q AS (SELECT quantile_cont(val, [0, 1.0 / 3, 2.0 / 3, 1]) AS e FROM cv WHERE val IS NOT NULL),
    b AS (SELECT cv.*, CASE WHEN val >= e[3] THEN 2 WHEN val >= e[2] THEN 1 ELSE 0 END AS bin, e FROM cv, q WHERE val IS NOT NULL),
    g AS (SELECT bin, round(e[bin + 1], 6) AS lo, round(e[bin + 2], 6) AS hi, count(*) AS n, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM b GROUP BY 1, 2, 3)
    SELECT bin, lo, hi, n, round({_IOU}, 6) AS iou, round({_P}, 6) AS "precision", round({_R}, 6) AS recall FROM g""", "seg")
def _(spark, sf):
    d = M.stratify(conf_with_value(spark, sf), "val")
    return d.select("bin", "n", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "iou", "precision", "recall")])


# Strata of the grounded fraction (from, below, name).
CUTS = [(0.0, 0.05, "shelf / sea ice"), (0.05, 0.95, "mixed"), (0.95, 1.01, "grounded")]


@query("e10_stratify_fixed", _CV + f""", g AS (SELECT CASE WHEN val < 0.05 THEN 'shelf / sea ice' WHEN val < 0.95 THEN 'mixed' WHEN val < 1.01 THEN 'grounded' END AS stratum,
      count(*) AS n, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM cv WHERE val >= 0 GROUP BY 1)
    SELECT stratum, n, round({_IOU}, 6) AS iou, round({_P}, 6) AS "precision", round({_R}, 6) AS recall FROM g WHERE stratum IS NOT NULL""", "seg")
def _(spark, sf):
    d = M.stratify_fixed(conf_with_value(spark, sf), "val", CUTS)
    return d.select("stratum", "n", *[F.round(c, 6).alias(c) for c in ("iou", "precision", "recall")])


@query("e11_threshold_sweep", """, t AS (SELECT CAST(unnest([""" + ", ".join(map(str, M.SWEEP)) + f"""]) AS DOUBLE) AS theta),
    g AS (SELECT theta, count(*) FILTER (prob > theta AND target > 0.4) AS tp, count(*) FILTER (prob > theta AND NOT target > 0.4) AS fp,
      count(*) FILTER (NOT prob > theta AND target > 0.4) AS fn FROM seg, t GROUP BY 1)
    SELECT theta, tp, fp, fn, round({_IOU}, 6) AS iou, {_IOU} = (SELECT max({_IOU}) FROM g) AS best FROM g""", "seg")
def _(spark, sf):
    d = M.threshold_sweep(V.seg(spark, sf), "prob", "target", 0.4)
    return d.select("theta", "tp", "fp", "fn", F.round("iou", 6).alias("iou"), "best")


@query("e12_control", _CONF + f""", s AS (SELECT tile, {_IOU} AS iou, {_IOU} + (tile % 10) * 0.0011 AS rec FROM cf)
    SELECT tile, round(abs(iou - rec), 6) AS delta, CASE WHEN tile % 10 < 5 THEN 'MATCH' ELSE 'MISMATCH' END AS verdict FROM s""", "seg")
def _(spark, sf):
    d = M.with_scores(conf(spark, sf)).withColumn("rec", F.col("iou") + (F.col("tile") % 10) * 0.0011)
    return M.control(d, "iou", "rec").select("tile", F.round("delta", 6).alias("delta"), "verdict")


@query("e13_coverage_ratio", _CONF + """ SELECT tile % 7 AS grp, round(sum(tp + fn) / sum(n_px), 6) AS target_cov, round(sum(tp + fp) / sum(n_px), 6) AS pred_cov,
    round((sum(tp + fp) / sum(n_px)) / greatest(sum(tp + fn) / sum(n_px), 1e-9), 6) AS ratio FROM cf GROUP BY 1""", "seg")
def _(spark, sf):
    d = M.coverage_ratio(conf(spark, sf).withColumn("grp", F.col("tile") % 7), ["grp"])
    return d.select("grp", *[F.round(c, 6).alias(c) for c in ("target_cov", "pred_cov", "ratio")])


@query("e14_feature_auc", """, l AS (UNPIVOT (SELECT y, e0, e1, e2, x_m, y_m FROM feat) ON e0, e1, e2, x_m, y_m INTO NAME feature VALUE x),
    lo AS (SELECT *, 1 AS one FROM l)""" + _RANK.format(by="feature", p="x", src="lo") + f" SELECT feature, round({_AUC}, 6) AS auc FROM rk GROUP BY 1", "feat")
def _(spark, sf):
    return M.feature_auc(V.feat(spark, sf), ["e0", "e1", "e2", "x_m", "y_m"], "y").select("feature", F.round("auc", 6).alias("auc"))


@query("e14_margin_over_coordinates", """, l AS (UNPIVOT (SELECT y, e0, e1, e2, x_m, y_m FROM feat) ON e0, e1, e2, x_m, y_m INTO NAME feature VALUE x),
    lo AS (SELECT *, 1 AS one FROM l)""" + _RANK.format(by="feature", p="x", src="lo") + f""", au AS (SELECT feature, {_AUC} AS auc FROM rk GROUP BY 1),
    bs AS (SELECT max(auc) AS b FROM au WHERE feature IN ('x_m', 'y_m'))
    SELECT feature, round(auc, 6) AS auc, round(b, 6) AS baseline_auc, round(auc - b, 6) AS margin FROM au, bs WHERE feature NOT IN ('x_m', 'y_m')""", "feat")
def _(spark, sf):
    d = M.margin_over_baseline(V.feat(spark, sf), ["e0", "e1", "e2"], ["x_m", "y_m"], "y")
    return d.select("feature", *[F.round(c, 6).alias(c) for c in ("auc", "baseline_auc", "margin")])


def speckle_tiles(spark, sf):
    rho = residual_rho1(image(spark, sf), "a", V.TS)
    enl = image(spark, sf).groupBy("granule_id", "row", "col").agg(looks("a").alias("enl"))
    d = rho.join(enl, ["granule_id", "row", "col"])
    return d.withColumn("src", F.substring("granule_id", 1, 1)).withColumn("k", F.substring("granule_id", 2, 20))


SPECKLE_METRICS = nb("n1", "den", "a", 4) + """, b AS (SELECT granule_id, "row", col, r, c, a, a - avg(nv) AS x FROM n1
      GROUP BY granule_id, "row", col, r, c, a),
    z AS (SELECT granule_id, "row", col, r, c, a, x - avg(x) OVER (PARTITION BY granule_id, "row", col) AS x FROM b),
    m AS (SELECT substr(z.granule_id, 1, 1) AS src, substr(z.granule_id, 2) AS k, z."row", z.col, CASE WHEN avg(z.x * z.x) < 1e-20 THEN 0.0 ELSE avg(z.x * d.x) / avg(z.x * z.x) END AS rho_row,
      pow(avg(z.a) / nullif(stddev_pop(z.a), 0), 2) AS enl FROM z LEFT JOIN z d ON d.granule_id = z.granule_id AND d."row" = z."row" AND d.r = z.r + 1 AND d.c = z.c GROUP BY 1, 2, 3, 4)"""


@query("e17_speckle_table", DEN + SPECKLE_METRICS + """,
    mt AS (SELECT * FROM m WHERE src IN ('A', 'R') AND (k, "row", col) IN (SELECT (k, "row", col) FROM m WHERE src = 'A') AND (k, "row", col) IN (SELECT (k, "row", col) FROM m WHERE src = 'R')),
    l AS (SELECT src, 'enl' AS metric, enl AS x FROM mt UNION ALL SELECT src, 'rho_row', rho_row FROM mt)
    SELECT metric, round(quantile_cont(x, 0.5) FILTER (src = 'A'), 6) AS median_a, round(quantile_cont(x, 0.5) FILTER (src = 'R'), 6) AS median_b,
      count(x) FILTER (src = 'A') AS n, round((quantile_cont(x, 0.5) FILTER (src = 'A')) / nullif(quantile_cont(x, 0.5) FILTER (src = 'R'), 0), 4) AS ratio FROM l GROUP BY 1""", "px")
def _(spark, sf):
    d = M.speckle_table(speckle_tiles(spark, sf), ["enl", "rho_row"], "src", ["k", "row", "col"], "A", "R")
    return d.select("metric", "n", F.round("median_a", 6).alias("median_a"), F.round("median_b", 6).alias("median_b"), F.round("ratio", 4).alias("ratio"))


@query("e18_class_medians", "SELECT granule_id, y, count(p_b) AS n, round(quantile_cont(p_b, 0.5), 6) AS median_p FROM feat WHERE p_b IS NOT NULL GROUP BY 1, 2", "feat")
def _(spark, sf):
    return M.class_medians(V.feat(spark, sf), "p_b", "y", ["granule_id"]).withColumn("median_p", F.round("median_p", 6))


@query("e19_model_agreement", "SELECT p_a >= 0.5 AS flag_a, p_b >= 0.6 AS flag_b, count(*) AS n FROM feat WHERE p_b IS NOT NULL GROUP BY 1, 2", "feat")
def _(spark, sf):
    return M.model_agreement(V.feat(spark, sf), "p_a", "p_b", 0.5, 0.6)
