"""Joins."""

from pyspark.sql import functions as F

from gridscan.operators import joins as J
from gridscan.operators.grid import tile_grid, with_tile
from gridscan.queries import views as V
from gridscan.queries.grids import px_headers
from gridscan.queries.registry import query


def tile_p(spark, sf):
    """Per-tile pseudo score of the px raster: share of bright valid pixels."""
    return with_tile(V.px(spark, sf), V.TS).groupBy("granule_id", "row", "col").agg(
        (F.count_if(F.col("v") > 60000) / F.count("v")).alias("p"), F.count("v").alias("n"))


_TP = """, tp AS (SELECT granule_id, "row", col, count(*) FILTER (v > 60000) / CAST(count(v) AS DOUBLE) AS p, count(v) AS n
    FROM pt GROUP BY 1, 2, 3)"""


@query("j01_context_floor", _TP + """ SELECT granule_id, "row", col, n, vel, cls FROM tp
    LEFT JOIN ctx ON gi = least("row" // 16, 5) AND gj = least(col // 16, 4)""", "pt ctx")
def _(spark, sf):
    d = J.join_context(tile_p(spark, sf), V.ctx(spark, sf), V.TS, 6, 5)
    return d.select("granule_id", "row", "col", "n", "vel", "cls")


@query("j02_context_centre", """, t AS (SELECT *, x_m + 1280 AS xc, y_m - 1280 AS yc FROM feat)
    SELECT vec_id, vel AS tile_vel, c.speed, c.cls FROM t LEFT JOIN (SELECT gi, gj, vel AS speed, cls FROM ctx) c
    ON gi = CAST(floor((0 - yc) / (2560.0 * 100)) AS INTEGER) AND gj = CAST(floor(xc / 12800) AS INTEGER)""", "feat ctx")
def _(spark, sf):
    c = V.ctx(spark, sf).select("gi", "gj", F.col("vel").alias("speed"), "cls")
    t = V.feat(spark, sf).withColumn("xc", F.col("x_m") + 1280).withColumn("yc", (F.col("y_m") - 1280) / 20)
    return J.lookup_context(t, c, "xc", "yc", 0.0, 0.0, 12800.0, 6, 6, strict=False).select("vec_id", F.col("vel").alias("tile_vel"), "speed", "cls")


@query("j03_offset_join", """SELECT a.granule_id, a.r, a.c, a.v, coalesce(b.cls, 0) AS lab FROM px a
    LEFT JOIN px b ON b.granule_id = a.granule_id AND b.r = a.r + 3 AND b.c = a.c - 2""", "px")
def _(spark, sf):
    d = V.px(spark, sf)
    return J.shifted_join(d.select("granule_id", "r", "c", "v"), d, 3, -2, "cls", ["granule_id"], out="lab")


@query("j04_regrid_nearest", """, t AS (SELECT granule_id, unnest(range(0, 40)) AS r FROM (SELECT DISTINCT granule_id FROM px)),
    g AS (SELECT granule_id, r, unnest(range(0, 40)) AS c FROM t)
    SELECT g.granule_id, CAST(g.r AS INTEGER) AS r, CAST(g.c AS INTEGER) AS c, cls FROM g LEFT JOIN
      (SELECT granule_id, r AS sr, c AS sc, cls FROM px) s ON s.granule_id = g.granule_id
    AND sr = CAST(floor((10 + (g.r + 0.5) * 12) / 5) AS INTEGER) AND sc = CAST(floor((20 + (g.c + 0.5) * 12) / 5) AS INTEGER)
    """, "px")
def _(spark, sf):
    t = tile_grid(px_headers(spark, sf).withColumn("height", F.lit(40)).withColumn("width", F.lit(40)), 1)
    t = t.select("granule_id", F.col("row").alias("r"), F.col("col").alias("c"))
    return J.regrid_nearest(t, V.px(spark, sf), "cls", 12.0, 5.0, ["granule_id"], 20.0, 10.0)


@query("j05_regrid_bilinear", """, t AS (SELECT granule_id, unnest(range(0, 40)) AS r FROM (SELECT DISTINCT granule_id FROM px)),
    g AS (SELECT granule_id, r, unnest(range(0, 40)) AS c FROM t),
    u AS (SELECT *, (0 + (r + 0.5) * 12) / CAST(5 AS DOUBLE) - 0.5 AS u, (0 + (c + 0.5) * 12) / CAST(5 AS DOUBLE) - 0.5 AS w FROM g),
    k AS (SELECT u.*, i, j, CAST(floor(u) + i AS INTEGER) AS sr, CAST(floor(w) + j AS INTEGER) AS sc,
      (CASE WHEN i = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN j = 1 THEN w - floor(w) ELSE 1 - (w - floor(w)) END) AS wt
      FROM u, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
    SELECT k.granule_id, CAST(k.r AS INTEGER) AS r, CAST(k.c AS INTEGER) AS c,
      round(sum(wt * log10(v)) / sum(CASE WHEN v IS NOT NULL THEN wt END), 6) AS lg
    FROM k LEFT JOIN px ON px.granule_id = k.granule_id AND px.r = sr AND px.c = sc GROUP BY 1, 2, 3""", "px")
def _(spark, sf):
    t = tile_grid(px_headers(spark, sf).withColumn("height", F.lit(40)).withColumn("width", F.lit(40)), 1)
    t = t.select("granule_id", F.col("row").alias("r"), F.col("col").alias("c"))
    s = V.px(spark, sf).withColumn("lg", F.log10("v"))
    d = J.regrid_bilinear(t, s, "lg", 12.0, 5.0, ["granule_id"])
    return d.select("granule_id", "r", "c", F.round("lg", 6).alias("lg"))


@query("j06_overlap_mean", """, t AS (SELECT granule_id, "row" + 5 AS "row", col + 11 AS col FROM tp),
    e AS (SELECT granule_id, "row", col, vel, (least("row" + 16, (gi + 1) * 16) - greatest("row", gi * 16)) *
      (least(col + 16, (gj + 1) * 16) - greatest(col, gj * 16)) AS w FROM t JOIN ctx
      ON gi BETWEEN "row" // 16 AND ("row" + 15) // 16 AND gj BETWEEN col // 16 AND (col + 15) // 16)
    SELECT granule_id, "row", col, round(sum(CAST(w AS DOUBLE) * vel) / sum(w), 6) AS vel FROM e GROUP BY 1, 2, 3""".replace(", t AS", _TP + ", t AS", 1), "pt ctx")
def _(spark, sf):
    t = tile_p(spark, sf).select("granule_id", (F.col("row") + 5).alias("row"), (F.col("col") + 11).alias("col"))
    d = J.overlap_mean(t, V.ctx(spark, sf), V.TS, ["vel"])
    return d.select("granule_id", "row", "col", F.round("vel", 6).alias("vel"))


_AB = """, a AS (SELECT *, CAST(round_even(x_m / 2560, 0) AS BIGINT) AS kx, CAST(round_even(y_m / 2560, 0) AS BIGINT) AS ky
      FROM feat WHERE granule_id IN ('g0', 'g1')),
    b AS (SELECT *, CAST(round_even((x_m - 5120) / 2560, 0) AS BIGINT) AS kx, CAST(round_even(y_m / 2560, 0) AS BIGINT) AS ky
      FROM feat WHERE granule_id IN ('g2', 'g3'))"""


def two_granules(spark, sf):
    f = V.feat(spark, sf)
    return (f.where(F.col("granule_id").isin("g0", "g1")),
            f.where(F.col("granule_id").isin("g2", "g3")).withColumn("x_m", F.col("x_m") - 5120))


@query("j07_match_ground", _AB + """ SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b, kx, ky, a.y = b.y AS agree
    FROM a JOIN b USING (kx, ky)""", "feat")
def _(spark, sf):
    a, b = two_granules(spark, sf)
    return J.match_ground(a, b, "x_m", "y_m", "y").select("vec_id_a", "vec_id_b", "kx", "ky", "agree")


@query("j08_holdout", """, s AS (SELECT doc_id FROM lab_b WHERE doc_id % 3 <> 0)
    SELECT doc_id, lab, CASE WHEN doc_id IN (SELECT doc_id FROM s) THEN 'train' ELSE 'test' END AS part FROM lab_a""", "lab_a lab_b")
def _(spark, sf):
    tr, te = J.holdout(V.lab_a(spark, sf), V.lab_b(spark, sf).where("doc_id % 3 <> 0"), ["doc_id"])
    return tr.withColumn("part", F.lit("train")).unionByName(te.withColumn("part", F.lit("test")))


@query("j09_outside_boxes", """, bx AS (SELECT min(x_m) - 2560 AS x0, max(x_m) + 2560 AS x1, min(y_m) - 2560 AS y0, max(y_m) + 2560 AS y1
      FROM feat GROUP BY floor(x_m / 12800), floor(y_m / 12800) HAVING sum(y) % 4 = 1)
    SELECT vec_id FROM feat WHERE NOT EXISTS (SELECT 1 FROM bx WHERE x_m BETWEEN x0 AND x1 AND y_m BETWEEN y0 AND y1)""", "feat")
def _(spark, sf):
    f = V.feat(spark, sf)
    b = f.groupBy(F.floor(F.col("x_m") / 12800).alias("bx"), F.floor(F.col("y_m") / 12800).alias("by")).agg(
        (F.min("x_m") - 2560).alias("x0"), (F.max("x_m") + 2560).alias("x1"),
        (F.min("y_m") - 2560).alias("y0"), (F.max("y_m") + 2560).alias("y1"), F.sum("y").alias("s")).where("s % 4 = 1")
    return J.outside_boxes(f, b, 12800.0).select("vec_id")


@query("j10_outside_tiles", """, v AS (SELECT granule_id, ti, tj FROM feat WHERE label = 7)
    SELECT vec_id FROM feat f WHERE label <> 7 AND NOT EXISTS (SELECT 1 FROM v WHERE v.granule_id = f.granule_id
      AND abs(v.ti - f.ti) <= 2 AND abs(v.tj - f.tj) <= 2)""", "feat")
def _(spark, sf):
    f = V.feat(spark, sf)
    return J.outside_tiles(f.where("label <> 7"), f.where("label = 7"), 2).select("vec_id")


@query("j11_distance_to_positive", """, h AS (SELECT DISTINCT granule_id FROM px), a AS (SELECT granule_id, unnest(range(0, 24)) AS ti FROM h),
    g AS (SELECT *, unnest(range(0, 24)) AS tj FROM a),
    p AS (SELECT DISTINCT granule_id, r // 4 AS pi, c // 4 AS pj FROM px WHERE v > 103000)
    SELECT g.granule_id, CAST(ti AS INTEGER) AS ti, CAST(tj AS INTEGER) AS tj,
      round(sqrt(min((ti - pi) * (ti - pi) + (tj - pj) * (tj - pj))), 6) AS dist
    FROM g LEFT JOIN p USING (granule_id) GROUP BY 1, 2, 3""", "px")
def _(spark, sf):
    g = tile_grid(px_headers(spark, sf).withColumn("height", F.lit(24)).withColumn("width", F.lit(24)), 1)
    g = g.select("granule_id", F.col("row").alias("ti"), F.col("col").alias("tj"))
    p = V.px(spark, sf).where("v > 103000").select(
        "granule_id", F.floor(F.col("r") / 4).cast("int").alias("ti"), F.floor(F.col("c") / 4).cast("int").alias("tj")).distinct()
    g = g.join(p.withColumn("pos", F.lit(True)), ["granule_id", "ti", "tj"], "left")
    d = J.distance_to_positive(g.withColumn("pos", F.coalesce("pos", F.lit(False))), "pos")
    return d.select("granule_id", "ti", "tj", F.round("dist", 6).alias("dist"))


@query("j12_scatter_back", _TP + """ SELECT granule_id, "row", col, CASE WHEN p >= 0.55 THEN round(p * p, 6) END AS stage2,
    coalesce(p >= 0.55, false) AS flag FROM tp""", "pt")
def _(spark, sf):
    t = tile_p(spark, sf)
    s2 = t.where("p >= 0.55").withColumn("stage2", F.round(F.col("p") * F.col("p"), 6))
    d = J.scatter_back(t, s2, ["granule_id", "row", "col"], ["stage2"])
    return d.select("granule_id", "row", "col", "stage2", F.coalesce(F.col("p") >= 0.55, F.lit(False)).alias("flag"))


@query("j13_scatter_scores", "SELECT vec_id, CASE WHEN p_b IS NOT NULL AND vel IS NOT NULL THEN round(p_b * 0.5, 6) END AS p FROM feat", "feat")
def _(spark, sf):
    f = V.feat(spark, sf)
    kept = f.na.drop(subset=["p_b", "vel"]).select("vec_id", F.round(F.col("p_b") * 0.5, 6).alias("p"))
    return J.scatter_back(f.select("vec_id"), kept, ["vec_id"], ["p"])


@query("j14_sidecar", """SELECT vec_id, label, round(e1, 6) AS e1 FROM feat""", "feat")
def _(spark, sf):
    f = V.feat(spark, sf)
    return J.attach_sidecar(f.select("vec_id", "label"), f.select("vec_id", F.round("e1", 6).alias("e1")), ["vec_id"])


@query("j15_compare_tables", """, a AS (SELECT vec_id, p_a AS v FROM feat WHERE label <> 2), b AS (SELECT vec_id, p_b AS v FROM feat WHERE label <> 5)
    SELECT count(a.vec_id) AS n_a, count(b.vec_id) AS n_b, count(*) FILTER (b.vec_id IS NULL) AS only_a,
      count(*) FILTER (a.vec_id IS NULL) AS only_b, round(max(abs(a.v - b.v)), 6) AS max_diff
    FROM a FULL OUTER JOIN b ON a.vec_id = b.vec_id""", "feat")
def _(spark, sf):
    f = V.feat(spark, sf)
    d = J.compare_tables(f.where("label <> 2").select("vec_id", F.col("p_a").alias("v")),
                         f.where("label <> 5").select("vec_id", F.col("p_b").alias("v")), ["vec_id"], "v")
    return d.withColumn("max_diff", F.round("max_diff", 6))


@query("j16_compare_fields", """SELECT granule_id, count(*) AS n, round(corr(p_a, p_b), 6) AS corr, round(avg(p_a), 6) AS mean_a,
    round(avg(p_b), 6) AS mean_b, round(avg(CAST((p_a >= 0.5) = (p_b >= 0.55) AS INTEGER)), 6) AS agreement
    FROM feat WHERE p_b IS NOT NULL GROUP BY 1""", "feat")
def _(spark, sf):
    d = J.compare_fields(V.feat(spark, sf), "p_a", "p_b", 0.5, 0.55, ["granule_id"])
    return d.select("granule_id", "n", *[F.round(c, 6).alias(c) for c in ("corr", "mean_a", "mean_b", "agreement")])


@query("j17_score_minus_label", _TP + """, l AS (SELECT granule_id, r // 4 AS r, c // 4 AS c, avg(cls) AS lab FROM px GROUP BY 1, 2, 3)
    SELECT granule_id, r, c, round(p - lab, 6) AS diff FROM l JOIN tp ON tp.granule_id = l.granule_id
      AND tp."row" = (r // 4) * 16 AND tp.col = (c // 4) * 16 WHERE p IS NOT NULL""".replace("SELECT granule_id, r, c, round(p", "SELECT l.granule_id, r, c, round(p"), "pt")
def _(spark, sf):
    lab = V.px(spark, sf).select("granule_id", "r", "c", F.col("cls").cast("double").alias("lab"))
    d = J.score_minus_label(tile_p(spark, sf), lab, "p", "lab", V.TS, 4)
    return d.select("granule_id", "r", "c", F.round("diff", 6).alias("diff"))


def box_pairs(spark, sf):
    """Granules A.._k and R.._k seen with different origins, and one map box each."""
    h = px_headers(spark, sf)
    h = h.withColumn("origin_x", F.when(F.col("granule_id").startswith("R"), 35.0).otherwise(0.0)).withColumn(
        "origin_y", F.when(F.col("granule_id").startswith("R"), -20.0).otherwise(0.0))
    ids = h.select("granule_id").withColumn("k", F.substring("granule_id", 2, 20))
    a, b = ids.where("granule_id LIKE 'A%'"), ids.where("granule_id LIKE 'R%'")
    p = a.select(F.col("granule_id").alias("ga"), "k").join(b.select(F.col("granule_id").alias("gb"), "k"), "k")
    return h, p.select("ga", "gb", F.lit(50.0).alias("bx0"), F.lit(-40.0).alias("by1"))


@query("j18_common_box", """, a AS (SELECT granule_id AS ga, substr(granule_id, 2) AS k, r - 8 AS br, c - 10 AS bc, v AS va FROM px WHERE granule_id LIKE 'A%'),
    b AS (SELECT granule_id AS gb, substr(granule_id, 2) AS k, r - 4 AS br, c - 3 AS bc, v AS vb FROM px WHERE granule_id LIKE 'R%')
    SELECT ga, gb, br, bc, va, vb FROM a JOIN b USING (k, br, bc) WHERE br BETWEEN 0 AND 63 AND bc BETWEEN 0 AND 63
      AND br % 2 = 0 AND bc % 2 = 0""", "px")
def _(spark, sf):
    h, p = box_pairs(spark, sf)
    return J.common_box(V.px(spark, sf), h, p, 64, 2)
