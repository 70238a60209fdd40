"""Scalar expressions and normalisations."""

from pyspark.sql import functions as F

from gridscan.functions import scalar as S
from gridscan.operators import pixels as PX
from gridscan.operators.grid import with_tile
from gridscan.queries import views as V
from gridscan.queries.registry import query


@query("p01_nodata_mask", "SELECT granule_id, r, c, CASE WHEN v2 > 10 THEN v END AS v FROM px", "px")
def _(spark, sf):
    d = V.px(spark, sf).withColumn("raw", F.when(F.col("v2") > 10, F.col("v")).otherwise(F.lit(0.0)))
    return d.select("granule_id", "r", "c", S.nodata_to_null("raw").alias("v"))


@query("p02_decibels", """SELECT granule_id, r, c, round(10 * log10(v), 6) AS db,
    round(pow(10, (10 * log10(v)) / 10) / 1000, 6) AS back_k, round(pow(10, log10(v2) / 2), 6) AS amp FROM px""", "px")
def _(spark, sf):
    d = V.px(spark, sf).withColumn("db", S.to_db("v")).withColumn("d2", S.to_db("v2"))
    return d.select("granule_id", "r", "c", F.round("db", 6).alias("db"),
                    F.round(S.from_db("db") / 1000, 6).alias("back_k"),
                    F.round(S.from_db("d2", amplitude=True), 6).alias("amp"))


@query("p03_linear_guard", """SELECT granule_id, count(*) AS n, count(v) AS n_valid, min(v) AS lowest
    FROM px GROUP BY 1""", "px")
def _(spark, sf):
    d = V.px(spark, sf).withColumn("v", S.linear_or_fail("v"))
    return d.groupBy("granule_id").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_valid"),
                                       F.min("v").alias("lowest"))


_STRETCH = """, lg AS (SELECT *, log10(v) AS lg FROM pt),
    m AS (SELECT granule_id, "row", col, quantile_cont(lg, 0.5) AS med,
      quantile_cont(lg, 0.02) AS z2, quantile_cont(lg, 0.98) AS z98 FROM lg GROUP BY 1, 2, 3),
    f AS (SELECT lg.*, coalesce(lg, med) AS fl, z2, z98 FROM lg JOIN m USING (granule_id, "row", col)),
    q AS (SELECT granule_id, "row", col, quantile_cont(fl, 0.02) AS p2, quantile_cont(fl, 0.98) AS p98
      FROM f GROUP BY 1, 2, 3)
    SELECT granule_id, r, c,
      round(CASE WHEN p98 > p2 THEN least(1.0, greatest(0.0, (fl - p2) / (p98 - p2))) END, 6) AS gate_s,
      round(CASE WHEN lg IS NOT NULL AND z98 > z2 THEN least(1.0, greatest(0.0, (lg - z2) / (z98 - z2)))
            ELSE 0.0 END, 6) AS seg_s
    FROM f JOIN q USING (granule_id, "row", col)"""


@query("p04_contrast_stretch", _STRETCH, "pt")
def _(spark, sf):
    d = with_tile(V.px(spark, sf), V.TS)
    d = PX.contrast_stretch(d, "v", fill="median", out="gate_s")
    d = PX.contrast_stretch(d, "v", fill="zero", out="seg_s")
    return d.select("granule_id", "r", "c", F.round("gate_s", 6).alias("gate_s"), F.round("seg_s", 6).alias("seg_s"))


@query("p05_train_normalisation", """, s AS (SELECT avg(log10(v)) AS mu, stddev_pop(log10(v)) AS sd FROM px WHERE r < 64)
    SELECT granule_id, r, c, round(coalesce((log10(v) - mu) / sd, 0.0), 6) AS z FROM px, s""", "px")
def _(spark, sf):
    d = V.px(spark, sf).withColumn("lg", F.log10("v"))
    st = PX.fit_normalisation(d, "lg", F.col("r") < 64)
    return PX.normalise(d, st, "lg").select("granule_id", "r", "c", F.round("z", 6).alias("z"))


@query("p06_channel_merge", """SELECT granule_id, r, c, round((hh + vv) / 2, 6) AS co, round((hv + vh) / 2, 6) AS "cross",
    round(((hv + vh) / 2) / ((hh + vv) / 2), 8) AS ratio FROM pols""", "pols")
def _(spark, sf):
    return V.pols(spark, sf).select("granule_id", "r", "c", F.round(S.co_pol(), 6).alias("co"),
                                    F.round(S.cross_pol(), 6).alias("cross"), F.round(S.pol_ratio(), 8).alias("ratio"))


@query("p07_band_subset", """SELECT granule_id, 'HV' AS band, r, c, hv AS v FROM pols
    UNION ALL SELECT granule_id, 'VV', r, c, vv FROM pols""", "pols")
def _(spark, sf):
    from gridscan.sources.raster import unpivot_bands
    d = unpivot_bands(V.pols(spark, sf))
    return PX.select_bands(d, ["HV", "VV"], ["HH", "HV", "VH", "VV"])


@query("p08_soft_rect", """, s AS (SELECT tile, pix, least(1.0, greatest(0.0, (prob - 0.08) / (0.48 - 0.08))) AS soft,
      least(1.0, greatest(0.0, (target - 0.7) / (1.0 - 0.7))) AS rect FROM seg)
    SELECT tile, pix, round(soft, 6) AS soft, round(rect, 6) AS rect, round(soft * rect, 6) AS target FROM s""", "seg")
def _(spark, sf):
    return V.seg(spark, sf).select("tile", "pix", F.round(S.soft("prob"), 6).alias("soft"),
                                   F.round(S.rect("target"), 6).alias("rect"),
                                   F.round(S.soft_target("prob", "target"), 6).alias("target"))


@query("p09_multiscale_soft", """SELECT l_suppkey AS tile, l_partkey AS pix,
    round(avg(least(1.0, greatest(0.0, (l_discount * 5 - 0.08) / (0.48 - 0.08)))), 6) AS target
    FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    li = V.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("tile"), F.col("l_partkey").alias("pix"),
                                               (F.col("l_discount") * 5).alias("resp"))
    d = PX.multiscale_soft(li, "resp", ["tile", "pix"])
    return d.select("tile", "pix", F.round("target", 6).alias("target"))


@query("p10_p99_scaling", """, q AS (SELECT quantile_cont(v, 0.99) AS p FROM px WHERE v <> 0)
    SELECT granule_id, r, c, round(CASE WHEN v IS NOT NULL THEN least(1.0, greatest(0.0, v / p)) END, 6) AS scaled
    FROM px, q""", "px")
def _(spark, sf):
    d = PX.p99_scale(V.px(spark, sf), "v")
    return d.select("granule_id", "r", "c", F.round("scaled", 6).alias("scaled"))


@query("p11_log_speed", """SELECT vec_id, round(log10(greatest(vel, 0.001)), 6) AS lg,
    round(coalesce(log10(greatest(vel, 0.001)), -1.0), 6) AS lg_filled, vel IS NULL AS missing
    FROM (SELECT vec_id, vel FROM feat WHERE vel IS NOT NULL)
    UNION ALL SELECT vec_id, NULL, -1.0, true FROM feat WHERE vel IS NULL""", "feat")
def _(spark, sf):
    return V.feat(spark, sf).select("vec_id", F.round(S.log_speed("vel"), 6).alias("lg"),
                                    F.round(S.log_speed("vel", missing=-1.0), 6).alias("lg_filled"),
                                    F.col("vel").isNull().alias("missing"))


@query("p12_class_name", """SELECT gi, gj, cls AS code, CASE cls WHEN 0 THEN 'ocean' WHEN 1 THEN 'grounded'
    WHEN 2 THEN 'transient_shelf' WHEN 3 THEN 'floating_shelf' WHEN 4 THEN 'rock' ELSE 'unknown' END AS name
    FROM (SELECT p_partkey AS gi, p_size AS gj, p_size % 7 AS cls FROM part)""")
def _(spark, sf):
    p = V.table(spark, sf, "part").select(F.col("p_partkey").alias("gi"), F.col("p_size").alias("gj"),
                                          (F.col("p_size") % 7).alias("code"))
    return p.select("gi", "gj", "code", S.class_name("code").alias("name"))


@query("p13_odds_fusion", """SELECT vec_id, round(p_a * q / (p_a * q + (1 - p_a) * (1 - q) + 1e-12), 6) AS fused,
    round(0.6 * (1 - q) / (0.6 * (1 - q) + (1 - 0.6) * q + 1e-12), 6) AS equivalent
    FROM (SELECT *, CASE WHEN p_b IS NOT NULL THEN least(0.9, greatest(0.1, p_b)) END AS q FROM feat)""", "feat")
def _(spark, sf):
    d = V.feat(spark, sf).withColumn("q", F.when(F.col("p_b").isNotNull(), S.clip("p_b", 0.1, 0.9)))
    return d.select("vec_id", F.round(S.odds_fusion("p_a", "q"), 6).alias("fused"),
                    F.round(S.fused_equivalent_threshold(0.6, "q"), 6).alias("equivalent"))


@query("p14_agreement_code", """SELECT vec_id, CASE WHEN p_b IS NULL THEN 0 WHEN y = 0 AND p_b < 0.5 THEN 1
    WHEN y = 1 AND p_b < 0.5 THEN 2 WHEN y = 0 THEN 3 ELSE 4 END AS code FROM feat""", "feat")
def _(spark, sf):
    return V.feat(spark, sf).select("vec_id", S.agreement_code(F.col("y") == 1, "p_b", 0.5).alias("code"))


@query("p15_blank_reason", """SELECT vec_id, CASE WHEN a > 0.05 AND a < 0.5 THEN 2
    WHEN a IS NOT NULL AND p_b IS NOT NULL THEN 4 WHEN a IS NOT NULL THEN 3
    WHEN e4 + 0.5 >= 0.4 AND e5 + 0.5 < 0.5 THEN 1 ELSE 0 END AS why
    FROM (SELECT *, CASE WHEN label < 8 THEN e3 + 0.3 END AS a FROM feat)""", "feat")
def _(spark, sf):
    d = V.feat(spark, sf).withColumn("a", F.when(F.col("label") < 8, F.col("e3") + 0.3))
    d = d.withColumn("vf", F.col("e4") + 0.5).withColumn("gf", F.col("e5") + 0.5)
    return d.select("vec_id", S.blank_reason("vf", "gf", "a", "p_b", 0.4, 0.5).alias("why"))


@query("p16_confusion_class", """SELECT vec_id, CASE WHEN y = 1 AND p_a >= 0.5 THEN 'tp' WHEN y = 1 THEN 'fn'
    WHEN p_a >= 0.5 THEN 'fp' ELSE 'tn' END AS cls FROM feat""", "feat")
def _(spark, sf):
    return V.feat(spark, sf).select("vec_id", S.confusion_class(F.col("y") == 1, F.col("p_a") >= 0.5).alias("cls"))


@query("p17_robust_align", """, m AS (SELECT granule_id, quantile_cont(e0, 0.5) AS c FROM feat GROUP BY 1),
    d AS (SELECT granule_id, c, 1.4826 * quantile_cont(abs(e0 - c), 0.5) + 1e-6 AS s
      FROM feat JOIN m USING (granule_id) GROUP BY 1, 2)
    SELECT vec_id, round((e0 - c) / s * 0.2 + 0.05, 6) AS aligned FROM feat JOIN d USING (granule_id)""", "feat")
def _(spark, sf):
    from gridscan.operators.aggregates import robust_stats
    d = V.feat(spark, sf)
    st = robust_stats(d, ["e0"], ["granule_id"]).select("granule_id", "center", "scale")
    j = d.join(st, "granule_id")
    return j.select("vec_id", F.round(S.robust_align("e0", "center", "scale", F.lit(0.05), F.lit(0.2)), 6).alias("aligned"))


@query("p18_axis_distance", """, a AS (SELECT vec_id, (vec_id * 37) % 180 + 0.5 AS ang FROM feat)
    SELECT vec_id, CAST(least(least(abs(ang - 45), 180 - abs(ang - 45)), least(abs(ang - 135), 180 - abs(ang - 135)))
    AS DOUBLE) AS dist FROM a""", "feat")
def _(spark, sf):
    d = V.feat(spark, sf).withColumn("ang", (F.col("vec_id") * 37) % 180 + F.lit(0.5))
    return d.select("vec_id", S.axis_distance("ang").alias("dist"))


@query("p19_clean_granule_id", """SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_name
    ELSE replace(s_name, '#', '.tif.') END AS granule_id FROM supplier""")
def _(spark, sf):
    d = V.table(spark, sf, "supplier").withColumn(
        "f", F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit(".tif")))
        .otherwise(F.regexp_replace("s_name", "#", ".tif.")))
    return d.select(F.col("s_suppkey").alias("k"), S.clean_granule_id("f").alias("granule_id"))


@query("p20_zero_not_grounded", """SELECT vec_id, round(CASE WHEN p_b IS NOT NULL AND NOT grounded THEN 0.0 ELSE p_b END, 6)
    AS shown FROM feat""", "feat")
def _(spark, sf):
    return V.feat(spark, sf).select("vec_id", F.round(S.zero_if_not_grounded("p_b", "grounded"), 6).alias("shown"))
