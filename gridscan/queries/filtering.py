"""Filters."""

from pyspark.sql import functions as F

from gridscan.functions.scalar import flag
from gridscan.operators import filters as FL
from gridscan.operators.grid import tile_grid, with_tile
from gridscan.queries import views as V
from gridscan.queries.grids import px_headers
from gridscan.queries.registry import query

BANDS = ["hh", "hv", "vh", "vv"]


def label_band(spark, sf):
    """feat with a label fraction, an in-box flag and feature columns that may be NULL."""
    return V.feat(spark, sf).withColumn("pos_frac", F.col("e3") + 0.3).withColumn("inbox", F.col("label") != 9)


_LB = ", lb AS (SELECT *, e3 + 0.3 AS pos_frac, label <> 9 AS inbox FROM feat)"


@query("f01_valid_fraction", """, t AS (SELECT granule_id, "row", col, count(v) / 256.0 AS valid_frac FROM pt GROUP BY 1, 2, 3)
    SELECT granule_id, "row", col, round(valid_frac, 6) AS valid_frac FROM t WHERE valid_frac >= 0.55""", "pt")
def _(spark, sf):
    return FL.valid_tiles(V.px(spark, sf), V.TS, 0.55).select("granule_id", "row", "col", F.round("valid_frac", 6).alias("valid_frac"))


@query("f01_valid_fraction_bands", """, t AS (SELECT granule_id, (r // 16) * 16 AS "row", (c // 16) * 16 AS col,
      least(count(hh), count(hv), count(vh), count(vv)) / 256.0 AS valid_frac FROM pols GROUP BY 1, 2, 3)
    SELECT granule_id, "row", col, round(valid_frac, 6) AS valid_frac FROM t WHERE valid_frac >= 0.5""", "pols")
def _(spark, sf):
    d = FL.valid_fraction_bands(V.pols(spark, sf), V.TS, BANDS).where("valid_frac >= 0.5")
    return d.select("granule_id", "row", "col", F.round("valid_frac", 6).alias("valid_frac"))


@query("f02_coarse_prefilter", """, hits AS (SELECT DISTINCT granule_id, r // 4 AS dr, c // 4 AS dc FROM px
      WHERE v > 60000 AND r % 4 = 2 AND c % 4 = 2),
    h AS (SELECT DISTINCT granule_id FROM px),
    a AS (SELECT granule_id, unnest(range(0, 24)) AS dr FROM h), g AS (SELECT *, unnest(range(0, 24)) AS dc FROM a)
    SELECT granule_id, (dr // 4) * 16 AS "row", (dc // 4) * 16 AS col,
      round(count(hits.dr) / 16.0, 6) AS coarse_frac
    FROM g LEFT JOIN hits USING (granule_id, dr, dc) GROUP BY 1, 2, 3 HAVING count(hits.dr) / 16.0 >= 0.3""", "px")
def _(spark, sf):
    h, d = px_headers(spark, sf), V.px(spark, sf).where("v > 60000")
    t = FL.coarse_prefilter(tile_grid(h, V.TS), d, h, 4, V.TS, 0.3)
    return t.select("granule_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"),
                    F.round("coarse_frac", 6).alias("coarse_frac"))


@query("f03_coarse_all_bands", """, cell AS (SELECT granule_id, r // 2 AS cr, c // 2 AS cc, count(hh) > 0 AND count(hv) > 0
      AND count(vh) > 0 AND count(vv) > 0 AS ok FROM pols GROUP BY 1, 2, 3)
    SELECT granule_id, (cr // 8) * 16 AS "row", (cc // 8) * 16 AS col, round(count(*) FILTER (ok) / 64.0, 6) AS valid_frac
    FROM cell GROUP BY 1, 2, 3""", "pols")
def _(spark, sf):
    d = FL.coarse_valid_all_bands(V.pols(spark, sf), 2, V.TS, BANDS)
    return d.select("granule_id", "row", "col", F.round("valid_frac", 6).alias("valid_frac"))


@query("f04_grounded", """, t AS (SELECT granule_id, "row", col, count(*) FILTER (cls = 1) / 256.0 AS grounded_frac
      FROM pt GROUP BY 1, 2, 3)
    SELECT granule_id, "row", col, round(grounded_frac, 6) AS grounded_frac FROM t WHERE grounded_frac >= 0.25""", "pt")
def _(spark, sf):
    d = V.px(spark, sf)
    tiles = tile_grid(px_headers(spark, sf), V.TS).select("granule_id", "row", "col")
    g = FL.grounded_tiles(tiles, d, V.TS, 0.25)
    return g.select("granule_id", "row", "col", F.round("grounded_frac", 6).alias("grounded_frac"))


@query("f05_masked_decision", "SELECT vec_id, p_b, coalesce(p_b >= 0.5, false) AND grounded AS flag FROM feat", "feat")
def _(spark, sf):
    return FL.masked_decision(V.feat(spark, sf), "p_b", 0.5).select("vec_id", "p_b", "flag")


@query("f06_finite_features", "SELECT vec_id FROM feat WHERE p_b IS NOT NULL AND vel IS NOT NULL", "feat")
def _(spark, sf):
    return FL.finite_features(V.feat(spark, sf), ["p_a", "p_b", "vel"]).select("vec_id")


@query("f07_admissible", _LB + " SELECT vec_id, y FROM lb WHERE inbox AND (pos_frac >= 0.4 OR pos_frac <= 0.2)", "feat")
def _(spark, sf):
    return FL.admissible(label_band(spark, sf), "pos_frac", "inbox", 0.4, 0.2).select("vec_id", "y")


@query("f08_box_flag", """SELECT vec_id, x_m >= 7680 AND x_m + 2560 <= 46080 AND y_m - 2560 >= -40960 AND y_m <= -5120 AS inbox
    FROM feat""", "feat")
def _(spark, sf):
    x, y = F.col("x_m"), F.col("y_m")
    return V.feat(spark, sf).select("vec_id", FL.inside_box(x, x + 2560, y - 2560, y, (7680, 46080, -40960, -5120)).alias("inbox"))


@query("f09_near_positives", """, b AS (SELECT granule_id, min(ti) AS a, max(ti) AS b, min(tj) AS c, max(tj) AS d FROM feat
      WHERE e0 > 0.15 GROUP BY 1)
    SELECT vec_id FROM feat JOIN b USING (granule_id) WHERE ti BETWEEN a - 1 AND b.b + 1 AND tj BETWEEN c - 1 AND d + 1""", "feat")
def _(spark, sf):
    return FL.near_positives(V.feat(spark, sf), F.col("e0") > 0.15, 1).select("vec_id")


@query("f10_noise_floor", """, t AS (SELECT granule_id, "row", col, 10 * log10(quantile_cont(v, 0.5)) AS db FROM pt GROUP BY 1, 2, 3),
    g AS (SELECT granule_id FROM t GROUP BY 1 HAVING quantile_cont(db, 0.5) > 47.3)
    SELECT granule_id, "row", col, round(db, 6) AS db FROM t JOIN g USING (granule_id)""", "pt")
def _(spark, sf):
    t = with_tile(V.px(spark, sf), V.TS).groupBy("granule_id", "row", "col").agg(
        (10 * F.log10(F.percentile("v", F.lit(0.5)))).alias("db"))
    return FL.above_noise_floor(t, "db", 47.3).select("granule_id", "row", "col", F.round("db", 6).alias("db"))


@query("f11_density", """, t AS (SELECT tile, count(*) AS n_components, avg(CAST(target > 0.6 AS INTEGER)) AS computed,
      CASE WHEN tile % 3 = 0 THEN avg(CAST(prob > 0.4 AS INTEGER)) END AS edge_coverage,
      CASE WHEN tile % 5 = 0 THEN avg(CAST(prob > 0.8 AS INTEGER)) END AS ridge_coverage FROM seg GROUP BY 1),
    c AS (SELECT *, coalesce(edge_coverage, ridge_coverage, computed) AS coverage FROM t)
    SELECT tile, round(coverage, 6) AS coverage FROM c WHERE coverage >= 0.3 AND n_components >= 400""", "seg")
def _(spark, sf):
    t = V.seg(spark, sf).groupBy("tile").agg(
        F.count(F.lit(1)).alias("n_components"), F.avg((F.col("target") > 0.6).cast("int")).alias("computed"),
        F.avg(F.when(F.col("tile") % 3 == 0, (F.col("prob") > 0.4).cast("int"))).alias("edge_coverage"),
        F.avg(F.when(F.col("tile") % 5 == 0, (F.col("prob") > 0.8).cast("int"))).alias("ridge_coverage"))
    d = FL.density_filter(t, 0.3, ["edge_coverage", "ridge_coverage"], F.col("computed"), 400)
    return d.select("tile", F.round("coverage", 6).alias("coverage"))


@query("f12_threshold_flag", "SELECT vec_id, coalesce(p_b >= 0.55, false) AS flag FROM feat", "feat")
def _(spark, sf):
    return V.feat(spark, sf).select("vec_id", flag("p_b", 0.55).alias("flag"))


@query("f13_rethreshold", "SELECT vec_id, round(p_b, 6) AS p FROM feat WHERE p_b >= 0.62", "feat")
def _(spark, sf):
    from gridscan.plans.lineage import scratch_path
    path = scratch_path(spark, "scores")
    V.feat(spark, sf).select("granule_id", "vec_id", "p_b").write.partitionBy("granule_id").parquet(path)
    return FL.rethreshold(spark.read.parquet(path), "p_b", 0.62).select("vec_id", F.round("p_b", 6).alias("p"))


@query("f14_only", "SELECT granule_id, height FROM gran WHERE contains(granule_id, '07')", "gran")
def _(spark, sf):
    return FL.only(V.gran(spark, sf), "07").select("granule_id", "height")


@query("f15_unseen_spacing", """, g AS (SELECT *, px_m + (height % 3) * 0.02 AS sp FROM gran),
    seen AS (SELECT DISTINCT sp FROM g WHERE y = 1 AND sp < 5.03)
    SELECT granule_id FROM g WHERE NOT EXISTS (SELECT 1 FROM seen WHERE abs(g.sp - seen.sp) < 0.01)""", "gran")
def _(spark, sf):
    g = V.gran(spark, sf).withColumn("px_m", F.col("px_m") + (F.col("height") % 3) * 0.02)
    return FL.unseen_spacing(g, g.where("y = 1 AND px_m < 5.03")).select("granule_id")
