"""Aggregations."""

from pyspark.sql import functions as F

from gridscan.operators import aggregates as A
from gridscan.operators.grid import with_tile
from gridscan.queries import views as V
from gridscan.queries.registry import query


def r6(df, *cols, keep=()):
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in cols])


@query("a01_tile_fractions", """SELECT granule_id, "row", col, count(*) FILTER (cls = 1) / 256.0 AS aoi_pos_frac,
    count(*) FILTER (r % 4 = 2 AND c % 4 = 2 AND v > 0) / 16.0 AS data_frac FROM pt GROUP BY 1, 2, 3""", "pt")
def _(spark, sf):
    d = V.px(spark, sf)
    return A.tile_fractions(d, d, V.TS, 4)


@query("a02_class_fractions", """, t AS (SELECT granule_id, r // 16 AS gi, c // 16 AS gj, CAST(v2 AS INTEGER) % 5 AS cls FROM px),
    n AS (SELECT granule_id, gi, gj, k, count(*) FILTER (cls = k) / CAST(count(*) AS DOUBLE) AS f FROM t,
      (SELECT unnest(range(0, 5)) AS k) GROUP BY 1, 2, 3, 4)
    SELECT granule_id, gi, gj, round(max(f) FILTER (k = 1), 6) AS frac_1, round(max(f) FILTER (k = 3), 6) AS frac_3,
      CAST(arg_max(k, f * 1000 - k * 1e-6) AS INTEGER) AS majority FROM n GROUP BY 1, 2, 3""", "px")
def _(spark, sf):
    d = V.px(spark, sf).select("granule_id", F.floor(F.col("r") / 16).cast("int").alias("gi"),
                               F.floor(F.col("c") / 16).cast("int").alias("gj"), (F.col("v2").cast("int") % 5).alias("cls"))
    g = A.class_fractions(d, ["granule_id", "gi", "gj"], "cls", range(5))
    return r6(g, "frac_1", "frac_3", keep=["granule_id", "gi", "gj", "majority"])


@query("a03_speed_cells", """SELECT granule_id, r // 16 AS gi, c // 16 AS gj, round(avg(CASE WHEN v2 > 20 THEN v2 - 20 END), 6) AS vel_mean,
    max(CASE WHEN v2 > 20 THEN v2 - 20 END) AS vel_max FROM px GROUP BY 1, 2, 3""", "px")
def _(spark, sf):
    d = V.px(spark, sf).select("granule_id", F.floor(F.col("r") / 16).alias("gi"), F.floor(F.col("c") / 16).alias("gj"),
                               (F.col("v2") - 20).alias("vel"))
    g = A.speed_cells(d, ["granule_id", "gi", "gj"], "vel")
    return g.select("granule_id", "gi", "gj", F.round("vel_mean", 6).alias("vel_mean"), "vel_max")


@query("a04_coverage", """SELECT tile, round(avg(CAST(prob > 0.2 AS INTEGER)), 6) AS coverage, count(*) FILTER (prob > 0.2) AS pixels
    FROM seg GROUP BY 1""", "seg")
def _(spark, sf):
    g = A.coverage(V.seg(spark, sf), ["tile"], "prob")
    return g.select("tile", F.round("coverage", 6).alias("coverage"), "pixels")


@query("a05_coverage_summary", """, t AS (SELECT tile, avg(CAST(prob > 0.75 AS INTEGER)) AS coverage FROM seg GROUP BY 1)
    SELECT count(*) AS n_tiles, count(*) FILTER (coverage > 0.25) AS n_hit, round(avg(CAST(coverage > 0.25 AS INTEGER)), 6) AS share_hit,
      round(avg(coverage), 6) AS mean_coverage, round(max(coverage), 6) AS max_coverage FROM t""", "seg")
def _(spark, sf):
    g = A.coverage_summary(A.coverage(V.seg(spark, sf), ["tile"], "prob", 0.75), hit=0.25)
    return r6(g, "share_hit", "mean_coverage", "max_coverage", keep=["n_tiles", "n_hit"])


@query("a06_repeat_mosaic", """, s AS (SELECT (r + CASE WHEN granule_id LIKE 'A%' THEN 8 ELSE 0 END) // 4 AS gi,
      (c + CASE WHEN granule_id LIKE 'N%' THEN 12 ELSE 0 END) // 4 AS gj, v FROM px)
    SELECT gi, gj, count(v) AS passes, round(10 * log10(avg(v)), 6) AS db FROM s GROUP BY 1, 2""", "px")
def _(spark, sf):
    d = V.px(spark, sf)
    gi = F.floor((F.col("r") + F.when(F.col("granule_id").startswith("A"), 8).otherwise(0)) / 4)
    gj = F.floor((F.col("c") + F.when(F.col("granule_id").startswith("N"), 12).otherwise(0)) / 4)
    return A.mosaic(d, gi, gj, "v").select("gi", "gj", "passes", F.round("db", 6).alias("db"))


@query("a07_pass_stats", """, n AS (SELECT r, c, count(*) AS n FROM px WHERE v IS NOT NULL GROUP BY 1, 2)
    SELECT CAST(sum(n) AS BIGINT) AS slots, count(*) AS ground_tiles, round(avg(n), 6) AS mean_passes, max(n) AS max_passes FROM n""", "px")
def _(spark, sf):
    d = A.pass_stats(V.px(spark, sf).where("v IS NOT NULL"), ["r", "c"])
    return d.withColumn("mean_passes", F.round("mean_passes", 6))


@query("a08_class_counts", """SELECT granule_id, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg,
    round(avg(y), 6) AS base_rate FROM feat GROUP BY ROLLUP (granule_id)""", "feat")
def _(spark, sf):
    return A.class_counts(V.feat(spark, sf), "granule_id", "y").withColumn("base_rate", F.round("base_rate", 6))


@query("a09_keep_rate", """SELECT granule_id, theta, count(p_b) AS n, count(*) FILTER (p_b >= theta) AS kept,
    round(count(*) FILTER (p_b >= theta) / CAST(count(p_b) AS DOUBLE), 6) AS keep_rate
    FROM feat, (SELECT CAST(unnest([0.333, 0.65, 0.8]) AS DOUBLE) AS theta) GROUP BY 1, 2""", "feat")
def _(spark, sf):
    d = A.keep_rate(V.feat(spark, sf), "p_b", [0.333, 0.65, 0.8], ["granule_id"])
    return d.withColumn("keep_rate", F.round("keep_rate", 6))


@query("a10_speed_bands", """SELECT CASE WHEN vel IS NULL THEN 'unmapped' WHEN vel < 50 THEN '0-50' WHEN vel < 250 THEN '50-250'
      WHEN vel < 1000 THEN '250-1000' ELSE '>1000' END AS band, count(*) AS n, count(*) FILTER (p_b >= 0.5) AS kept
    FROM feat WHERE p_b IS NOT NULL AND grounded GROUP BY 1""", "feat")
def _(spark, sf):
    return A.keep_rate_by_band(V.feat(spark, sf), "p_b", 0.5, "vel", "grounded")


@query("a11_kept_on_grounded", """SELECT theta, count(*) FILTER (p_b >= theta) AS kept,
      round(avg(CAST(grounded AS INTEGER)) FILTER (p_b >= theta), 6) AS kept_grounded, round(avg(CAST(grounded AS INTEGER)), 6) AS base_grounded
    FROM feat, (SELECT CAST(unnest([0.333, 0.5, 0.65]) AS DOUBLE) AS theta) WHERE p_b IS NOT NULL GROUP BY 1""", "feat")
def _(spark, sf):
    d = A.kept_on_grounded(V.feat(spark, sf), "p_b", "grounded", [0.333, 0.5, 0.65])
    return r6(d, "kept_grounded", "base_grounded", keep=["theta", "kept"])


@query("a12_robust_stats", """, l AS (UNPIVOT (SELECT granule_id, e0, e1, e2 FROM feat) ON e0, e1, e2 INTO NAME feature VALUE x),
    m AS (SELECT granule_id, feature, quantile_cont(x, 0.5) AS center FROM l GROUP BY 1, 2)
    SELECT granule_id, feature, round(center, 6) AS center, round(1.4826 * quantile_cont(abs(x - center), 0.5) + 1e-6, 6) AS scale
    FROM l JOIN m USING (granule_id, feature) GROUP BY 1, 2, 3""", "feat")
def _(spark, sf):
    return r6(A.robust_stats(V.feat(spark, sf), ["e0", "e1", "e2"], ["granule_id"]), "center", "scale", keep=["granule_id", "feature"])


@query("a13_percentiles", """SELECT granule_id, count(v) AS n, round(quantile_cont(v, 0.1), 4) AS p10, round(quantile_cont(v, 0.5), 4) AS p50,
    round(quantile_cont(v, 0.9), 4) AS p90, round(quantile_cont(v, 0.99), 4) AS p99 FROM px GROUP BY 1""", "px")
def _(spark, sf):
    d = A.percentile_summary(V.px(spark, sf), "v", [0.1, 0.5, 0.9, 0.99], ["granule_id"])
    return d.select("granule_id", "n", *[F.round(c, 4).alias(c) for c in ("p10", "p50", "p90", "p99")])


@query("a14_basemap", """, t AS (SELECT granule_id, "row", col, log10(avg(v)) AS lg FROM pt GROUP BY 1, 2, 3),
    q AS (SELECT granule_id, quantile_cont(lg, 0.02) AS lo, quantile_cont(lg, 0.98) AS hi FROM t GROUP BY 1)
    SELECT granule_id, "row", col, round(least(1.0, greatest(0.0, (lg - lo) / (hi - lo + 1e-9))), 6) AS shade
    FROM t JOIN q USING (granule_id)""", "pt")
def _(spark, sf):
    return r6(A.basemap(V.px(spark, sf), V.TS), "shade", keep=["granule_id", "row", "col"])


@query("a15_reciprocity", """SELECT granule_id, count(*) AS n, round(corr(log10(hh), log10(vv)), 6) AS r,
    round(10 * (quantile_cont(log10(hh), 0.5) - quantile_cont(log10(vv), 0.5)), 6) AS diff_db
    FROM pols WHERE hh > 0 AND vv > 0 GROUP BY 1""", "pols")
def _(spark, sf):
    return r6(A.reciprocity(V.pols(spark, sf), "hh", "vv"), "r", "diff_db", keep=["granule_id", "n"])


@query("a16_binned_means", """SELECT CAST(least(floor(p_a * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p_a), 6) AS mean_x, round(avg(p_b), 6) AS mean_y
    FROM feat WHERE p_b IS NOT NULL GROUP BY 1 HAVING count(*) >= 5""", "feat")
def _(spark, sf):
    return r6(A.binned_means(V.feat(spark, sf), "p_a", "p_b"), "mean_x", "mean_y", keep=["bin", "n"])


@query("a17_histogram", "SELECT y, CAST(least(floor(p_b * 25), 24) AS BIGINT) AS bin, count(*) AS n FROM feat WHERE p_b IS NOT NULL GROUP BY 1, 2", "feat")
def _(spark, sf):
    return A.histogram(V.feat(spark, sf), "p_b", 25, ["y"])


@query("a18_pearson", """, t AS (SELECT tile % 10 AS grp, avg(CAST(prob > 0.5 AS INTEGER)) AS cov, avg(target) AS tgt FROM seg GROUP BY tile)
    SELECT grp, count(*) AS n, round(corr(cov, tgt), 6) AS r FROM t GROUP BY 1""", "seg")
def _(spark, sf):
    t = V.seg(spark, sf).groupBy("tile").agg(F.avg((F.col("prob") > 0.5).cast("int")).alias("cov"), F.avg("target").alias("tgt"))
    return r6(A.correlation(t.withColumn("grp", F.col("tile") % 10), "cov", "tgt", ["grp"]), "r", keep=["grp", "n"])


@query("a19_source_tally", """, u AS (SELECT 'a' AS source, * FROM lab_a UNION ALL SELECT 'b', * FROM lab_b),
    x AS (SELECT doc_id FROM u GROUP BY 1 HAVING min(lab) <> max(lab))
    SELECT source, lab, count(*) AS n, (SELECT count(*) FROM x) AS n_conflicts FROM u GROUP BY 1, 2""", "lab_a lab_b")
def _(spark, sf):
    u = V.lab_a(spark, sf).withColumn("source", F.lit("a")).unionByName(V.lab_b(spark, sf).withColumn("source", F.lit("b")))
    n = A.conflicts(u, ["doc_id"], "lab").agg(F.count(F.lit(1))).scalar()
    return A.source_tally(u, "source", "lab").withColumn("n_conflicts", n)


_COMP = """, m AS (SELECT granule_id, "row", col, r, c, r * 96 + c AS id FROM pt WHERE cls = 1),
    e AS (SELECT a.granule_id, a.id AS s, b.id AS t FROM m a JOIN m b ON a.granule_id = b.granule_id AND a."row" = b."row"
      AND a.col = b.col AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1),
    reach AS (SELECT granule_id, id AS s, id AS t FROM m UNION SELECT reach.granule_id, reach.s, e.t FROM reach JOIN e
      ON e.granule_id = reach.granule_id AND e.s = reach.t),
    comp AS (SELECT granule_id, s AS id, min(t) AS comp FROM reach GROUP BY 1, 2),
    sh AS (SELECT granule_id, "row", col, comp, count(*) AS area, var_pop(r) AS a, var_pop(c) AS b, covar_pop(r, c) AS k
      FROM m JOIN comp USING (granule_id, id) GROUP BY 1, 2, 3, 4),
    l AS (SELECT *, (a + b) / 2 + sqrt(pow((a - b) / 2, 2) + k * k) AS l1, greatest((a + b) / 2 - sqrt(pow((a - b) / 2, 2) + k * k), 0.0) AS l2 FROM sh),
    f AS (SELECT *, CASE WHEN l1 > 0 THEN sqrt(greatest(1 - l2 / l1, 0.0)) ELSE 0.0 END AS ecc, 4 * sqrt(l1) AS len FROM l)"""


@query("a20_components", _COMP + """ SELECT granule_id, "row", col, area, round(ecc, 5) AS eccentricity, round(len, 5) AS major_axis,
    count(*) AS n FROM f GROUP BY ALL""", "pt", recursive=True)
def _(spark, sf):
    m = with_tile(V.px(spark, sf).where("cls = 1").select("granule_id", "r", "c"), V.TS)
    s = A.component_shapes(A.label_components(m, V.TS, batch=6))
    return s.groupBy("granule_id", "row", "col", "area", F.round("eccentricity", 5).alias("eccentricity"),
                     F.round("major_axis", 5).alias("major_axis")).agg(F.count(F.lit(1)).alias("n"))


@query("a20_component_funnel", _COMP + """ SELECT granule_id, "row", col, count(*) AS total_components,
    count(*) FILTER (area >= 4) AS after_size_filter, count(*) FILTER (area >= 4 AND ecc >= 0.85) AS after_elongation_filter,
    round(sum(CASE WHEN area >= 4 AND ecc >= 0.85 THEN len ELSE 0.0 END), 5) AS total_length FROM f GROUP BY 1, 2, 3""", "pt", recursive=True)
def _(spark, sf):
    m = with_tile(V.px(spark, sf).where("cls = 1").select("granule_id", "r", "c"), V.TS)
    d = A.component_funnel(A.component_shapes(A.label_components(m, V.TS, batch=6)), min_size=4)
    return d.withColumn("total_length", F.round("total_length", 5))


@query("a21_ensemble_mean", """SELECT l_suppkey AS tile, l_partkey AS pix, round(avg(l_discount), 6) AS p, count(l_discount) AS n_members
    FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    li = V.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("tile"), F.col("l_partkey").alias("pix"), F.col("l_discount").alias("p"))
    return A.ensemble_mean(li, ["tile", "pix"], "p").withColumn("p", F.round("p", 6))


@query("a23_spacings", """SELECT round(px_m + (height % 20) * 0.1, 4) AS px_m, count(*) AS n, max(y) = 1 AS seen_positive FROM gran GROUP BY 1""", "gran")
def _(spark, sf):
    g = V.gran(spark, sf).withColumn("px_m", F.col("px_m") + (F.col("height") % 20) * 0.1)
    return A.spacings(g, "y")
