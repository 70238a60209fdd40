"""Per-tile features."""

from pyspark.sql import functions as F

from gridscan.functions.stats import looks
from gridscan.operators import features as X
from gridscan.operators.grid import with_tile
from gridscan.operators.joins import common_box
from gridscan.queries import views as V
from gridscan.queries.joining import box_pairs
from gridscan.queries.registry import query
from gridscan.queries.stencils import DEN, TENSOR, image

TS, TILE = V.TS, ["granule_id", "row", "col"]


def rk(d, cols, n=6):
    """Rounded columns beside a tile key as BIGINT."""
    return d.select("granule_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"),
                    *[F.round(c, n).alias(c) for c in cols])


def pol_tiles(spark, sf):
    return with_tile(V.pols(spark, sf), TS)


_CH = """, ch AS (SELECT granule_id, CAST((r // 16) * 16 AS BIGINT) AS "row", CAST((c // 16) * 16 AS BIGINT) AS col, r, c, hh AS "HH", vv AS "VV",
      (hh + vv) / 2 AS co, (hv + vh) / 2 AS "cross", ((hv + vh) / 2) / ((hh + vv) / 2) AS ratio FROM pols)"""
_RAD = ", ".join(f"""10 * log10(quantile_cont("{n}", 0.5)) AS "{n}_dB", stddev_pop(log10("{n}")) AS "{n}_logstd",
    quantile_cont(log10("{n}"), 0.9) - quantile_cont(log10("{n}"), 0.1) AS "{n}_logspread", stddev_pop("{n}") / avg("{n}") AS "{n}_cv" """
                 for n in ("HH", "VV", "co", "cross"))
_X1 = _CH + f""", x1 AS (SELECT granule_id, "row", col, {_RAD}, 10 * log10(quantile_cont("cross", 0.5)) - 10 * log10(quantile_cont(co, 0.5)) AS "ratio_dB",
      10 * log10(quantile_cont("HH", 0.5)) - 10 * log10(quantile_cont("VV", 0.5)) AS "hh_vv_dB", stddev_pop(log10(ratio)) AS ratio_logstd,
      quantile_cont(log10(ratio), 0.9) - quantile_cont(log10(ratio), 0.1) AS ratio_logspread,
      least(count("HH"), count("VV"), count(co), count("cross")) >= 128 AND count(ratio) >= 100 AS ok FROM ch GROUP BY 1, 2, 3)"""
_X2 = """, lg AS (SELECT granule_id, "row", col, r, c, log10("HH") AS "HH", log10("cross") AS "cross", log10(ratio) AS ratio FROM ch),
    pr AS (SELECT a.granule_id, a."row", a.col, {sel} FROM lg a
      LEFT JOIN lg s ON s.granule_id = a.granule_id AND s."row" = a."row" AND s.col = a.col AND s.r = a.r + 1 AND s.c = a.c + 1
      LEFT JOIN lg w ON w.granule_id = a.granule_id AND w."row" = a."row" AND w.col = a.col AND w.r = a.r + 1 AND w.c = a.c - 1),
    x2 AS (SELECT granule_id, "row", col, {agg} FROM pr GROUP BY 1, 2, 3)""".format(
    sel=", ".join(f"""a."{n}" AS "{n}", s."{n}" AS "{n}_s", w."{n}" AS "{n}_w", CASE WHEN a.r % 16 BETWEEN 1 AND 14 AND a.c % 16 BETWEEN 1 AND 14
      THEN a."{n}" END AS "{n}_i" """ for n in ("HH", "cross", "ratio")),
    agg=", ".join(f"""CASE WHEN count(*) FILTER ("{n}_i" IS NOT NULL AND "{n}_s" IS NOT NULL) >= 40 THEN corr("{n}_i", "{n}_s") END AS "acf45_{n}",
      CASE WHEN count(*) FILTER ("{n}_i" IS NOT NULL AND "{n}_w" IS NOT NULL) >= 40 THEN corr("{n}_i", "{n}_w") END AS "acf135_{n}",
      avg(abs("{n}_s" - "{n}")) AS "grad45_{n}", avg(abs("{n}_w" - "{n}")) AS "grad135_{n}" """ for n in ("HH", "cross", "ratio")))


def _x2_sql(c):
    k, n = c.split("_", 1)
    return {"acfaniso": f'"acf45_{n}" - "acf135_{n}"', "gradaniso": f'"grad135_{n}" - "grad45_{n}"'}.get(k, f'"{c}"')


@query("x01_radiometric", _X1 + ' SELECT granule_id, "row", col, ' + ", ".join(
    f'round(CASE WHEN ok THEN "{c}" END, 6) AS "{c}"' for c in X.RADIOMETRIC) + " FROM x1", "pols")
def _(spark, sf):
    return rk(X.radiometric_features(pol_tiles(spark, sf), TS), X.RADIOMETRIC)


@query("x02_axis_texture", _CH + _X2 + ' SELECT granule_id, "row", col, ' + ", ".join(
    f'round({_x2_sql(c)}, 6) AS "{c}"' for c in X.AXIS) + " FROM x2", "pols")
def _(spark, sf):
    return rk(X.axis_features(pol_tiles(spark, sf), TS, 40), X.AXIS)


@query("x03_tile_features", _X1 + _X2 + """, lb AS (SELECT granule_id, (r // 16) * 16 AS "row", (c // 16) * 16 AS col, count(*) FILTER (cls = 1) / 256.0 AS aoi_pos
      FROM px GROUP BY 1, 2, 3)
    SELECT granule_id, "row", col, """ + ", ".join(f'round(CASE WHEN ok THEN {_x2_sql(c) if c in X.AXIS else chr(34) + c + chr(34)} END, 6) AS "{c}"'
                                               for c in X.RADIOMETRIC + X.AXIS) + """, aoi_pos, vel AS ctx_vel, CAST(col * 5.0 AS DOUBLE) AS x_m
    FROM x1 JOIN x2 USING (granule_id, "row", col) LEFT JOIN lb USING (granule_id, "row", col)
      LEFT JOIN ctx ON gi = "row" // 16 AND gj = col // 16""", "pols px ctx")
def _(spark, sf):
    from gridscan.operators.aggregates import tile_fractions
    from gridscan.operators.joins import join_context
    f = X.tile_features(pol_tiles(spark, sf), TS, min_pairs=40)
    px = V.px(spark, sf)
    lab = tile_fractions(px, px, TS, 4).select(*TILE, F.col("aoi_pos_frac").alias("aoi_pos"))
    j = join_context(f.join(lab, TILE, "left"), V.ctx(spark, sf), TS, 6, 6)
    feats = X.RADIOMETRIC + X.AXIS
    return j.select("granule_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"),
                    *[F.round(c, 6).alias(c) for c in feats], "aoi_pos", F.col("vel").alias("ctx_vel"), (F.col("col") * 5.0).alias("x_m"))


IMG = DEN + """, md AS (SELECT granule_id, "row", col, quantile_cont(lv, 0.5) AS med, count(lv) AS nv FROM den GROUP BY 1, 2, 3),
    fl AS (SELECT granule_id, "row", col, r, c, coalesce(lv, med) AS f, nv FROM den JOIN md USING (granule_id, "row", col)),
    pq AS (SELECT granule_id, "row", col, quantile_cont(f, 0.02) AS p2, quantile_cont(f, 0.98) AS p98 FROM fl GROUP BY 1, 2, 3),
    img AS (SELECT granule_id, "row", col, r, c, CASE WHEN nv >= 128 AND p98 > p2 THEN least(1.0, greatest(0.0, (f - p2) / (p98 - p2))) END AS s
      FROM fl JOIN pq USING (granule_id, "row", col))"""


def gate(spark, sf):
    return X.gate_image(image(spark, sf).withColumn("amp", F.pow(F.lit(10.0), "lv")), "amp", TS)


_GLCM = IMG + """, st AS (SELECT * FROM (VALUES (1, 0, 0, 1), (1, 1, 1, 1), (1, 2, 1, 0), (1, 3, 1, -1), (3, 0, 0, 3), (3, 1, 2, 2), (3, 2, 3, 0), (3, 3, 2, -2)) t(d, k, dr, dc)),
    qq AS (SELECT *, CAST(floor(s * 31) AS INTEGER) AS q FROM img WHERE s IS NOT NULL),
    pp AS (SELECT a.granule_id, a."row", a.col, d, k, a.q AS i, b.q AS j FROM qq a CROSS JOIN st JOIN qq b ON b.granule_id = a.granule_id
      AND b."row" = a."row" AND b.col = a.col AND b.r = a.r + dr AND b.c = a.c + dc),
    sy AS (SELECT * FROM pp UNION ALL SELECT granule_id, "row", col, d, k, j, i FROM pp),
    nn AS (SELECT granule_id, "row", col, d, k, i, j, CAST(count(*) AS DOUBLE) AS n FROM sy GROUP BY ALL),
    mm AS (SELECT granule_id, "row", col, d, k, sum(n) AS t, sum(n * i) / sum(n) AS mu, sum(n * i * i) / sum(n) AS m2 FROM nn GROUP BY ALL),
    ft AS (SELECT granule_id, "row", col, d, k, sum(n * (i - j) * (i - j)) / t AS contrast, sum(n * abs(i - j)) / t AS dissimilarity,
      sum(n / (1 + (i - j) * (i - j))) / t AS homogeneity, sqrt(sum(n * n)) / t AS energy,
      CASE WHEN m2 - mu * mu < 1e-15 THEN 1.0 ELSE (sum(n * i * j) / t - mu * mu) / (m2 - mu * mu) END AS correlation
      FROM nn JOIN mm USING (granule_id, "row", col, d, k) GROUP BY granule_id, "row", col, d, k, t, mu, m2),
    fd AS (SELECT granule_id, "row", col, d, """ + ", ".join(
    f"avg({p}) AS {p}, stddev_pop({p}) AS {p}_sd" for p in ("contrast", "correlation", "homogeneity", "energy", "dissimilarity")) + """ FROM ft GROUP BY ALL)
    SELECT granule_id, "row", col, """.replace("GROUP BY ALL", 'GROUP BY granule_id, "row", col, d') + ", ".join(
    f"round(avg({p}), 6) AS glcm_{p}, round(avg({p}_sd), 6) AS glcm_{p}_aniso" for p in ("contrast", "correlation", "homogeneity", "energy", "dissimilarity")) + """
    FROM fd GROUP BY 1, 2, 3"""
_GLCM = _GLCM.replace("AS n FROM sy GROUP BY ALL", 'AS n FROM sy GROUP BY granule_id, "row", col, d, k, i, j').replace(
    "AS m2 FROM nn GROUP BY ALL", 'AS m2 FROM nn GROUP BY granule_id, "row", col, d, k')


@query("x04_cooccurrence", _GLCM, "px")
def _(spark, sf):
    d = X.cooccurrence(gate(spark, sf), ts=TS)
    return rk(d, [c for c in d.columns if c.startswith("glcm")])


@query("x05_image_cv", IMG + ' SELECT granule_id, "row", col, round(stddev_pop(s) / (avg(s) + 1e-9), 6) AS cv FROM img GROUP BY 1, 2, 3', "px")
def _(spark, sf):
    return rk(X.image_variation(gate(spark, sf)), ["cv"])


@query("x06_coherence", TENSOR + """ SELECT granule_id, "row", col, round(avg(coh), 6) AS coherence_mean, round(quantile_cont(coh, 0.9), 6) AS coherence_p90,
    round(avg(CAST(coh > 0.5 AS INTEGER)), 6) AS coherence_frac_hi FROM co GROUP BY 1, 2, 3""", "px")
def _(spark, sf):
    return rk(X.coherence_features(image(spark, sf), "a", TS, 5, "central"), ["coherence_mean", "coherence_p90", "coherence_frac_hi"])


@query("x06_coherence_gaussian")
def _(spark, sf):
    from gridscan.operators.stencil import gaussian_weights
    d = X.coherence_features(image(spark, sf), "a", TS, gaussian_weights(2.0), "sobel")
    return rk(d, ["coherence_mean", "coherence_p90", "coherence_frac_hi"])


@query("x07_looks", 'SELECT granule_id, "row", col, CASE WHEN stddev_pop(v) > 0 THEN round(pow(avg(v) / stddev_pop(v), 2), 6) END AS enl FROM pt GROUP BY 1, 2, 3', "pt")
def _(spark, sf):
    return with_tile(V.px(spark, sf), TS).groupBy(*TILE).agg(F.round(looks("v"), 6).alias("enl"))


_ORI = TENSOR[:TENSOR.index(", t1 AS")] + """,
    zz AS (SELECT granule_id, "row", col, sum(sqrt(gr * gr + gc * gc) * cos(2 * atan2(gr, gc))) / (sum(sqrt(gr * gr + gc * gc)) + 1e-12) AS zx,
      sum(sqrt(gr * gr + gc * gc) * sin(2 * atan2(gr, gc))) / (sum(sqrt(gr * gr + gc * gc)) + 1e-12) AS zy FROM gd GROUP BY 1, 2, 3),
    un AS (SELECT *, zx / (sqrt(zx * zx + zy * zy) + 1e-12) AS ux, zy / (sqrt(zx * zx + zy * zy) + 1e-12) AS uy FROM zz)"""


@query("x08_orientation", _ORI + """ SELECT granule_id, count(*) AS n, round(sqrt(pow(avg(ux), 2) + pow(avg(uy), 2)), 6) AS "R" FROM un GROUP BY 1""", "px")
def _(spark, sf):
    z = X.dominant_orientation(image(spark, sf), "a", TS)
    return X.orientation_concentration(z, ["granule_id"]).withColumn("R", F.round("R", 6))


@query("x08_orientation_regions", _ORI + """, qe AS (SELECT granule_id, k, quantile_cont("row", [0, 1.0 / 3, 2.0 / 3, 1])[k + 1] AS rlo,
      quantile_cont("row", [0, 1.0 / 3, 2.0 / 3, 1])[k + 2] AS rhi, quantile_cont(col, [0, 1.0 / 3, 2.0 / 3, 1])[k + 1] AS clo,
      quantile_cont(col, [0, 1.0 / 3, 2.0 / 3, 1])[k + 2] AS chi FROM un CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1, 2)
    SELECT granule_id, a.k AS ri, b.k AS rj, count(*) AS n, round(sqrt(pow(avg(ux), 2) + pow(avg(uy), 2)), 6) AS "R" FROM un
    JOIN qe a USING (granule_id) JOIN qe b USING (granule_id)
    WHERE "row" BETWEEN a.rlo AND a.rhi AND col BETWEEN b.clo AND b.chi GROUP BY 1, 2, 3 HAVING count(*) >= 4""", "px")
def _(spark, sf):
    z = X.dominant_orientation(image(spark, sf), "a", TS)
    return X.regional_concentration(z, ["granule_id"], 3, 4).withColumn("R", F.round("R", 6))


@query("x09_orientation_gate", TENSOR + """, oc AS (SELECT granule_id, "row", col, CASE WHEN count(*) FILTER (a > 0) < 10 THEN 0.0 ELSE
      sqrt(pow(sum(a * coh * cos(ang2)), 2) + pow(sum(a * coh * sin(ang2)), 2)) / (sum(a * coh) + 1e-9) END AS oc FROM co GROUP BY 1, 2, 3)
    SELECT granule_id, r, c, round(oc, 6) AS orient_conc, round(CASE WHEN oc < 0.12 THEN 0.0 ELSE a END, 6) AS a
    FROM den JOIN oc USING (granule_id, "row", col)""", "px")
def _(spark, sf):
    img = image(spark, sf)
    d = X.orientation_gate(img, X.response_concentration(img, "a", TS, 5, "central"), "a")
    return d.select("granule_id", "r", "c", F.round("orient_conc", 6).alias("orient_conc"), F.round("a", 6).alias("a"))


def packed(spark, sf):
    d = X.pack(image(spark, sf), TILE, ["a"]).withColumnRenamed("a", "data")
    return d.select(*TILE, F.lit(TS).alias("h"), F.lit(TS).alias("w"), "data")


_K = [[0.1, 0.2, 0.0], [-0.3, 1.0, 0.4], [0.05, 0.0, -0.25]]


@query("x10_convolve", DEN + """, kk AS (SELECT * FROM (VALUES (-1, -1, 0.1), (-1, 0, 0.2), (0, -1, -0.3), (0, 0, 1.0), (0, 1, 0.4), (1, -1, 0.05), (1, 1, -0.25)) t(i, j, wt))
    SELECT d.granule_id, d.r, d.c, round(sum(CAST(wt AS DOUBLE) * n.a), 6) AS v FROM den d CROSS JOIN kk JOIN den n ON n.granule_id = d.granule_id
      AND n.r = least(greatest(d.r + i, d."row"), d."row" + 15) AND n.c = least(greatest(d.c + j, d.col), d.col + 15) GROUP BY 1, 2, 3""", "px")
def _(spark, sf):
    d = X.convolve(image(spark, sf), "a", _K, TS, "v")
    return d.select("granule_id", "r", "c", F.round("v", 6).alias("v"))


# Rank 2: a ridge along one diagonal that no single separable pass can give.
_RANK_2 = [[a * x + b * y for x, y in zip((1, 2, 3, 2, 1), (-1, 0.5, 0, 1, -2))] for a, b in ((0.1, 0), (0.2, 0.1), (0.3, -0.2), (0.1, 0.4), (0, 0.3))]


@query("x10_low_rank", DEN + ", kk AS (SELECT * FROM (VALUES " + ", ".join(f"({i - 2}, {j - 2}, {w!r})" for i, row in enumerate(_RANK_2) for j, w in enumerate(row)) + f""") t(i, j, wt)),
    nn AS (SELECT d.granule_id, d.r, d.c, d."row" AS y, d.col AS x, d.r + i AS p, d.c + j AS q, wt FROM den d CROSS JOIN kk),
    mm AS (SELECT granule_id, r, c, wt, CASE WHEN p < y THEN 2 * y - 1 - p WHEN p > y + 15 THEN 2 * (y + 16) - 1 - p ELSE p END AS p, CASE WHEN q < x THEN 2 * x - 1 - q WHEN q > x + 15 THEN 2 * (x + 16) - 1 - q ELSE q END AS q FROM nn)
    SELECT mm.granule_id, mm.r, mm.c, round(sum(CAST(wt AS DOUBLE) * n.a), 5) AS v FROM mm JOIN den n ON n.granule_id = mm.granule_id AND n.r = p AND n.c = q GROUP BY 1, 2, 3""", "px")
def _(spark, sf):
    d = X.convolve(image(spark, sf), "a", _RANK_2, TS, "v")
    return d.select("granule_id", "r", "c", F.round("v", 5).alias("v"))


@query("x11_spectrum")
def _(spark, sf):
    return X.spectrum(packed(spark, sf), TS, 12, 4)


@query("x12_context_features", """, tl AS (SELECT DISTINCT granule_id, "row", col FROM pt),
    cx AS (SELECT gi, gj, cls, CASE WHEN vel > 43 THEN vel END AS vel FROM ctx)
    SELECT granule_id, "row", col, round(cls * 0.2, 6) AS ctx_grounded_frac, CAST(CAST(cls = 1 AS INTEGER) AS DOUBLE) AS ctx_is_grounded,
      CAST(CAST(cls IN (2, 3) AS INTEGER) AS DOUBLE) AS ctx_is_floating, round(coalesce(log10(CAST(vel AS DOUBLE)), -1.0), 6) AS ctx_log_vel_mean,
      round(coalesce(log10(CAST(vel * 2 AS DOUBLE)), -1.0), 6) AS ctx_log_vel_max, CAST(CAST(vel IS NULL AS INTEGER) AS DOUBLE) AS ctx_vel_missing
    FROM tl JOIN cx ON gi = "row" // 16 AND gj = col // 16""", "pt ctx")
def _(spark, sf):
    t = with_tile(V.px(spark, sf), TS).select(*TILE).distinct()
    vel = F.when(F.col("vel") > 43, F.col("vel"))
    c = V.ctx(spark, sf).select("gi", "gj", (F.col("cls") * 0.2).alias("grounded_frac"), F.col("cls").alias("bedmap_class"),
                                vel.alias("vel_mean"), (vel * 2).alias("vel_max"))
    d = X.context_features(t, c, TS, 6, 6)
    return d.select(*TILE, *[F.round(x, 6).alias(x) for x in X.CONTEXT_FEATURES])


_CHIP = ", ".join(f"CASE WHEN count({b}) >= 4 THEN round(10 * log10(avg({b})), 6) END AS {b}" for b in ("hh", "hv", "vh", "vv"))


@query("x13_chips", f""", b AS (SELECT granule_id, (r // 16) * 16 AS "row", (c // 16) * 16 AS col, r // 2 AS br, c // 2 AS bc, {_CHIP} FROM pols GROUP BY 1, 2, 3, 4, 5)
    SELECT granule_id, "row", col, count(*) AS n, {", ".join(f"list({x} ORDER BY br, bc) AS {x}" for x in ("hh", "hv", "vh", "vv"))} FROM b GROUP BY 1, 2, 3""", "pols")
def _(spark, sf):
    bands = ["hh", "hv", "vh", "vv"]
    d = X.chips(pol_tiles(spark, sf), TS, 2, bands)
    return d.select(*TILE, "n", *[F.transform(b, lambda x: F.round(x, 6)).alias(b) for b in bands])


_PSF = (TENSOR[:TENSOR.index(", t1 AS")] + """,
    jj AS (SELECT granule_id, "row", col, degrees(0.5 * atan2(2 * avg(gc * gr), avg(gc * gc) - avg(gr * gr))) AS d FROM gd GROUP BY 1, 2, 3),
    an AS (SELECT granule_id, "row", col, CASE WHEN d < 0 THEN d + 180 ELSE d END AS ang FROM jj),
    cv AS (SELECT granule_id, "row", col, count(*) FILTER (v > 103000) / 256.0 AS pred, count(*) FILTER (v2 > 49 AND v > 95000) / 256.0 AS tgt FROM pt GROUP BY 1, 2, 3),
    gg AS (SELECT CASE WHEN pred > 0.003 THEN 'fp' WHEN pred < 1e-4 THEN 'quiet' END AS grp,
      least(least(abs(ang - 45), 180 - abs(ang - 45)), least(abs(ang - 135), 180 - abs(ang - 135))) AS dist FROM cv JOIN an USING (granule_id, "row", col) WHERE tgt = 0)
    SELECT grp, count(*) AS n, round(avg(dist), 6) AS mean_dist, round(avg(CAST(dist <= 15 AS INTEGER)), 6) AS share_near,
      round(quantile_cont(dist, 0.5), 6) AS median_dist FROM gg WHERE grp IS NOT NULL GROUP BY 1""")


@query("x14_psf_diagnosis", _PSF, "pt")
def _(spark, sf):
    ang = X.dominant_angle(image(spark, sf), "a", TS)
    cov = with_tile(V.px(spark, sf), TS).groupBy(*TILE).agg(
        (F.count_if(F.col("v") > 103000) / 256).alias("pred_cov"), (F.count_if((F.col("v2") > 49) & (F.col("v") > 95000)) / 256).alias("tgt_cov"))
    d = X.psf_diagnosis(cov.join(ang, TILE), 0.003)
    return d.select("grp", "n", *[F.round(c, 6).alias(c) for c in ("mean_dist", "share_near", "median_dist")])


X15_RANKED = """, ba AS (SELECT granule_id AS ga, substr(granule_id, 2) AS k, r - 8 AS br, c - 10 AS bc, log10(v) AS va FROM px WHERE granule_id LIKE 'A%'),
    bb AS (SELECT granule_id AS gb, substr(granule_id, 2) AS k, r - 4 AS br, c - 3 AS bc, log10(v) AS vb FROM px WHERE granule_id LIKE 'R%'),
    bx AS (SELECT ga, gb, br, bc, va, vb FROM ba JOIN bb USING (k, br, bc) WHERE br BETWEEN 0 AND 63 AND bc BETWEEN 0 AND 63),
    shy AS (SELECT unnest(range(-1, 2)) AS dy), shx AS (SELECT unnest(range(-1, 2)) AS dx),
    rr1 AS (SELECT l.ga, l.gb, dy, dx, corr(l.va, m.vb) AS peak FROM bx l CROSS JOIN shy CROSS JOIN shx JOIN bx m ON m.ga = l.ga AND m.gb = l.gb AND m.br = l.br + dy AND m.bc = l.bc + dx GROUP BY 1, 2, 3, 4),
    rk1 AS (SELECT *, row_number() OVER (PARTITION BY ga, gb ORDER BY round(peak, 9) DESC, abs(dy) + abs(dx), dy, dx) AS rn FROM rr1)"""


@query("x15_best_shift", """, a AS (SELECT granule_id AS ga, substr(granule_id, 2) AS k, r - 8 AS br, c - 10 AS bc, log10(v) AS va FROM px WHERE granule_id LIKE 'A%'),
    b AS (SELECT granule_id AS gb, substr(granule_id, 2) AS k, r - 4 AS br, c - 3 AS bc, log10(v) AS vb FROM px WHERE granule_id LIKE 'R%'),
    bx AS (SELECT ga, gb, br, bc, va, vb FROM a JOIN b USING (k, br, bc) WHERE br BETWEEN 0 AND 63 AND bc BETWEEN 0 AND 63),
    sh AS (SELECT unnest(range(-2, 3)) AS dy), sx AS (SELECT unnest(range(-2, 3)) AS dx),
    rr AS (SELECT l.ga, l.gb, dy, dx, corr(l.va, m.vb) AS peak FROM bx l CROSS JOIN sh CROSS JOIN sx JOIN bx m ON m.ga = l.ga AND m.gb = l.gb
      AND m.br = l.br + dy AND m.bc = l.bc + dx GROUP BY 1, 2, 3, 4),
    rk AS (SELECT *, row_number() OVER (PARTITION BY ga, gb ORDER BY round(peak, 9) DESC, abs(dy) + abs(dx), dy, dx) AS rn FROM rr)
    SELECT ga, gb, dy, dx, round(peak, 6) AS peak FROM rk WHERE rn = 1""", "px")
def _(spark, sf):
    h, p = box_pairs(spark, sf)
    b = common_box(V.px(spark, sf).withColumn("v", F.log10("v")), h, p, 64)
    d = X.best_shift(b, 2, ["ga", "gb"])
    return d.select("ga", "gb", "dy", "dx", F.round("peak", 6).alias("peak"))
