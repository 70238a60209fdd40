"""Neighbourhood operators on dense 16-px tiles (image = log10 of the px raster, gaps filled with 4)."""

from pyspark.sql import functions as F

from gridscan.operators import stencil as ST
from gridscan.operators.grid import tile_grid, with_tile
from gridscan.queries import views as V
from gridscan.queries.grids import px_headers
from gridscan.queries.registry import query

TS = V.TS
PIX = ["granule_id", "r", "c"]


def image(spark, sf):
    """Dense tiles: a = filled log image, lv = the log image with gaps."""
    t = tile_grid(px_headers(spark, sf), TS).select("granule_id", "row", "col")
    d = V.px(spark, sf).select("granule_id", "r", "c", F.log10("v").alias("lv"))
    return ST.densify(t, d, TS, ["lv"], (0, 0)).withColumn("a", F.coalesce("lv", F.lit(4.0)))


DEN = """, gh AS (SELECT DISTINCT granule_id FROM px), gr_ AS (SELECT granule_id, unnest(range(0, 96)) AS r FROM gh),
    gc_ AS (SELECT *, unnest(range(0, 96)) AS c FROM gr_),
    den AS (SELECT granule_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, (r // 16) * 16 AS "row", (c // 16) * 16 AS col,
      log10(v) AS lv, coalesce(log10(v), 4.0) AS a FROM gc_ LEFT JOIN px USING (granule_id, r, c))"""


def _mir(x, o):
    return f'CASE WHEN {x} < {o} THEN 2 * {o} - 1 - ({x}) WHEN {x} > {o} + 15 THEN 2 * ({o} + 16) - 1 - ({x}) ELSE {x} END'


def nb(name, src, col, h, border="reflect"):
    """CTE of (pixel, neighbour value) pairs for a (2h+1)^2 window inside the tile."""
    off = f"(SELECT unnest(range(-{h}, {h + 1})) AS i), (SELECT unnest(range(-{h}, {h + 1})) AS j)"
    if border == "reflect":
        on = f"n.r = {_mir('d.r + i', 'd.row')} AND n.c = {_mir('d.c + j', 'd.col')}"
    elif border == "clip":
        on = "n.r = d.r + i AND n.c = d.c + j AND n.\"row\" = d.\"row\" AND n.col = d.col"
    else:
        off = f"(SELECT unnest(range(0, {h})) AS i), (SELECT unnest(range(0, {h})) AS j)"
        on = "n.r = least(d.r + i, d.\"row\" + 15) AND n.c = least(d.c + j, d.col + 15)"
    return (f', {name} AS (SELECT d.*, i, j, n.{col} AS nv FROM {src} d CROSS JOIN {off} '
            f'JOIN {src} n ON n.granule_id = d.granule_id AND {on})').replace("d.row", 'd."row"')


def out(d, **cols):
    return d.select(*PIX, *[F.round(e, 6).alias(n) for n, e in cols.items()])


@query("w01_shift_pairs", """SELECT a.granule_id, a.r, a.c, e.v AS east, s.v AS southeast, w.v AS southwest2 FROM pt a
    LEFT JOIN pt e ON e.granule_id = a.granule_id AND e."row" = a."row" AND e.col = a.col AND e.r = a.r AND e.c = a.c + 1
    LEFT JOIN pt s ON s.granule_id = a.granule_id AND s."row" = a."row" AND s.col = a.col AND s.r = a.r + 1 AND s.c = a.c + 1
    LEFT JOIN pt w ON w.granule_id = a.granule_id AND w."row" = a."row" AND w.col = a.col AND w.r = a.r + 2 AND w.c = a.c - 2""", "pt")
def _(spark, sf):
    d = ST.by_tile(with_tile(V.px(spark, sf), TS))
    return d.select(*PIX, ST.neighbour("v", 0, 1).alias("east"), ST.neighbour("v", 1, 1).alias("southeast"),
                    ST.neighbour("v", 2, -2).alias("southwest2"))


@query("w02_box_mean", DEN + nb("n1", "den", "lv", 2) + nb("n2", "den", "lv", 2, "clip") + nb("n3", "den", "lv", 3, "forward") + """,
    a AS (SELECT granule_id, r, c, avg(nv) AS m FROM n1 GROUP BY 1, 2, 3), b AS (SELECT granule_id, r, c, avg(nv) AS m FROM n2 GROUP BY 1, 2, 3),
    f AS (SELECT granule_id, r, c, avg(nv) AS m FROM n3 GROUP BY 1, 2, 3)
    SELECT granule_id, r, c, round(a.m, 6) AS reflect, round(b.m, 6) AS clip, round(f.m, 6) AS looks FROM a
    JOIN b USING (granule_id, r, c) JOIN f USING (granule_id, r, c)""", "px")
def _(spark, sf):
    d = ST.box_mean(image(spark, sf), {"reflect": "lv"}, 5, TS)
    d = ST.box_mean(d, {"clip": "lv"}, 5, TS, "clip")
    d = ST.box_mean(d, {"looks": "lv"}, 3, TS, "forward")
    return out(d, reflect="reflect", clip="clip", looks="looks")


_MOM = DEN + nb("n1", "den", "a", 2) + """, m AS (SELECT granule_id, "row", col, r, c, a, avg(nv) AS mu, greatest(avg(nv * nv) - avg(nv) * avg(nv), 0.0) AS va
    FROM n1 GROUP BY ALL)""".replace("GROUP BY ALL", 'GROUP BY granule_id, "row", col, r, c, a')


@query("w03_local_moments", _MOM + """ SELECT granule_id, r, c, round(mu, 6) AS loc_mean, round(va, 6) AS loc_var, round(sqrt(va) / mu, 6) AS loc_cv,
    sqrt(va) / mu > 0.06 AS textured FROM m""", "px")
def _(spark, sf):
    d = ST.textured(ST.local_moments(image(spark, sf), "a", 5, TS), 0.06)
    return d.select(*PIX, *[F.round(c, 6).alias(c) for c in ("loc_mean", "loc_var", "loc_cv")], "textured")


@query("w04_lee", _MOM + """, o AS (SELECT granule_id, "row", col, var_pop(a) AS ov FROM den GROUP BY 1, 2, 3)
    SELECT granule_id, r, c, round(mu + coalesce(va / nullif(va + ov, 0), 0) * (a - mu), 6) AS lee FROM m JOIN o USING (granule_id, "row", col)""", "px")
def _(spark, sf):
    return out(ST.lee(image(spark, sf), "a", 5, TS), lee="lee")


@query("w05_enhanced_lee", _MOM + """ SELECT granule_id, r, c, round(mu + 1e-10 + least(1.0, greatest(0.0, (va / ((mu + 1e-10) * (mu + 1e-10)) - 0.0025) / (va / ((mu + 1e-10) * (mu + 1e-10)) + 1e-10)))
    * (a - mu), 6) AS elee FROM m""", "px")
def _(spark, sf):
    return out(ST.enhanced_lee(image(spark, sf), "a", 5, TS, looks=400), elee="elee")


@query("w06_wiener", _MOM + """, q AS (SELECT granule_id, "row", col, quantile_cont(CASE WHEN va > 0 THEN va END, 0.05) AS nv FROM m GROUP BY 1, 2, 3)
    SELECT granule_id, r, c, round(mu + least(1.0, greatest(0.0, (va - nv) / (va + 1e-10))) * (a - mu), 6) AS wiener
    FROM m JOIN q USING (granule_id, "row", col)""", "px")
def _(spark, sf):
    return out(ST.wiener(image(spark, sf), "a", 5, TS), wiener="wiener")


@query("w07_median", DEN + nb("n1", "den", "a", 1) + " SELECT granule_id, r, c, round(quantile_cont(nv, 0.5), 6) AS med FROM n1 GROUP BY 1, 2, 3", "px")
def _(spark, sf):
    return out(ST.median_filter(image(spark, sf), "a", 3, TS), med="med")


_GRAD = DEN + """, sh AS (SELECT *, lead(a) OVER (PARTITION BY granule_id, c ORDER BY r) AS s_, lag(a) OVER (PARTITION BY granule_id, c ORDER BY r) AS n_,
      lead(a) OVER (PARTITION BY granule_id, r ORDER BY c) AS e_, lag(a) OVER (PARTITION BY granule_id, r ORDER BY c) AS w_ FROM den),
    gd AS (SELECT granule_id, r, c, "row", col, lv, a, CASE WHEN r = "row" THEN s_ - a WHEN r = "row" + 15 THEN a - n_ ELSE (s_ - n_) / 2 END AS gr,
      CASE WHEN c = col THEN e_ - a WHEN c = col + 15 THEN a - w_ ELSE (e_ - w_) / 2 END AS gc FROM sh)"""


@query("w08_gradient", _GRAD + " SELECT granule_id, r, c, round(gr, 6) AS gr, round(gc, 6) AS gc FROM gd", "px")
def _(spark, sf):
    return out(ST.gradient(image(spark, sf), "a", TS, dense=True), gr="gr", gc="gc")


_DIAG = """, l AS (SELECT granule_id, "row", col, r, c, log10(v) AS lg FROM pt),
    p AS (SELECT a.*, s.lg AS n45, w.lg AS n135 FROM l a
      LEFT JOIN l s ON s.granule_id = a.granule_id AND s."row" = a."row" AND s.col = a.col AND s.r = a.r + 1 AND s.c = a.c + 1
      LEFT JOIN l w ON w.granule_id = a.granule_id AND w."row" = a."row" AND w.col = a.col AND w.r = a.r + 1 AND w.c = a.c - 1)"""


@query("w09_diagonal_gradient", _DIAG + """ SELECT granule_id, "row", col, round(avg(abs(n45 - lg)), 6) AS grad45, round(avg(abs(n135 - lg)), 6) AS grad135
    FROM p GROUP BY 1, 2, 3""", "pt")
def _(spark, sf):
    d = ST.by_tile(with_tile(V.px(spark, sf), TS).withColumn("lg", F.log10("v")))
    return ST.diagonal_gradient(d, "lg").select("granule_id", "row", "col", F.round("grad45", 6).alias("grad45"), F.round("grad135", 6).alias("grad135"))


@query("w10_residual_rho1", DEN + nb("n1", "den", "a", 4) + """, b AS (SELECT granule_id, "row", col, r, c, a - avg(nv) AS x FROM n1
      GROUP BY granule_id, "row", col, r, c, a),
    z AS (SELECT granule_id, "row", col, r, c, x - avg(x) OVER (PARTITION BY granule_id, "row", col) AS x FROM b)
    SELECT z.granule_id, z."row", z.col, round(CASE WHEN avg(z.x * z.x) < 1e-20 THEN 0.0 ELSE avg(z.x * d.x) / avg(z.x * z.x) END, 6) AS rho_row,
      round(CASE WHEN avg(z.x * z.x) < 1e-20 THEN 0.0 ELSE avg(z.x * e.x) / avg(z.x * z.x) END, 6) AS rho_col
    FROM z LEFT JOIN z d ON d.granule_id = z.granule_id AND d."row" = z."row" AND d.r = z.r + 1 AND d.c = z.c
      LEFT JOIN z e ON e.granule_id = z.granule_id AND e.col = z.col AND e.r = z.r AND e.c = z.c + 1 GROUP BY 1, 2, 3""", "px")
def _(spark, sf):
    d = ST.residual_rho1(image(spark, sf), "a", TS)
    return d.select("granule_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"),
                    F.round("rho_row", 6).alias("rho_row"), F.round("rho_col", 6).alias("rho_col"))


@query("w11_diagonal_acf", _DIAG + """, i AS (SELECT *, CASE WHEN r BETWEEN "row" + 1 AND "row" + 14 AND c BETWEEN col + 1 AND col + 14 THEN lg END AS x FROM p)
    SELECT granule_id, "row", col, round(CASE WHEN count(*) FILTER (x IS NOT NULL AND n45 IS NOT NULL) >= 50 THEN corr(x, n45) END, 6) AS acf45,
      round(CASE WHEN count(*) FILTER (x IS NOT NULL AND n135 IS NOT NULL) >= 50 THEN corr(x, n135) END, 6) AS acf135 FROM i GROUP BY 1, 2, 3""", "pt")
def _(spark, sf):
    d = ST.by_tile(with_tile(V.px(spark, sf), TS).withColumn("lg", F.log10("v")))
    return ST.diagonal_acf(d, "lg", TS, 50).select("granule_id", "row", "col", F.round("acf45", 6).alias("acf45"), F.round("acf135", 6).alias("acf135"))


TENSOR = _GRAD + nb("t1", "(SELECT *, gr * gr AS rr, gr * gc AS rc, gc * gc AS cc FROM gd)", "rr", 2).replace(
    "n.rr AS nv", "n.rr AS nrr, n.rc AS nrc, n.cc AS ncc") + """, te AS (SELECT granule_id, "row", col, r, c, a, avg(nrr) AS arr, avg(nrc) AS arc, avg(ncc) AS acc
      FROM t1 GROUP BY granule_id, "row", col, r, c, a),
    co AS (SELECT *, sqrt(pow(arr - acc, 2) + 4 * arc * arc) / (arr + acc + 1e-9) AS coh, atan2(2 * arc, acc - arr) AS ang2 FROM te)"""


@query("w12_orientation_agreement", TENSOR + nb("u1", "(SELECT *, a * coh AS w, a * coh * cos(ang2) AS wx, a * coh * sin(ang2) AS wy FROM co)", "w", 3).replace(
    "n.w AS nv", "n.w AS nw, n.wx AS nx, n.wy AS ny") + """ SELECT granule_id, r, c,
    round(sqrt(pow(avg(nx), 2) + pow(avg(ny), 2)) / (avg(nw) + 1e-9), 6) AS agreement FROM u1 GROUP BY 1, 2, 3""", "px")
def _(spark, sf):
    return out(ST.orientation_agreement(image(spark, sf), "a", TS, 7, 5, "central"), agreement="agreement")
