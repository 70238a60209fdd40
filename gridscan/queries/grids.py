"""Grids, affine arithmetic, footprints."""

from pyspark.sql import functions as F

from gridscan.operators import grid as G
from gridscan.queries import views as V
from gridscan.queries.registry import query

_RANGE = """, r AS (SELECT granule_id, height, width, unnest(range(0, height, 16)) AS "row" FROM gran),
    t AS (SELECT granule_id, height, width, "row", unnest(range(0, width, 16)) AS col FROM r)"""


def px_headers(spark, sf):
    """Headers of the px granules: 96 x 96 at 5 m."""
    return V.table(spark, sf, "lineitem").select(V.granule_key().alias("granule_id")).distinct().select(
        "granule_id", F.lit(V.EDGE).alias("height"), F.lit(V.EDGE).alias("width"), F.lit(5.0).alias("px_m"),
        F.lit(0.0).alias("origin_x"), F.lit(0.0).alias("origin_y"))


def swath(spark, sf):
    """A bounds row per header, inset by data-dependent amounts."""
    return V.gran(spark, sf).select(
        "*", (F.col("height") % 7).alias("row_min"), (F.col("height") - F.col("width") % 5).alias("row_max"),
        (F.col("width") % 6).alias("col_min"), (F.col("width") - F.col("height") % 4).alias("col_max"))


_SWATH = """, sw AS (SELECT *, height % 7 AS row_min, height - width % 5 AS row_max, width % 6 AS col_min,
    width - height % 4 AS col_max FROM gran)"""


def neighbours(spark, sf, shrink=1.0):
    """Header pairs (k, k+1) as structs a, b."""
    g = V.gran(spark, sf).withColumn("origin_x", F.col("origin_x") / shrink).withColumn(
        "origin_y", F.col("origin_y") / shrink).withColumn("epsg", F.lit(3031)).withColumn(
        "k", F.substring("granule_id", 2, 6).cast("int"))
    a = g.select("k", F.struct(*[x for x in g.columns if x != "k"]).alias("a"))
    b = g.select((F.col("k") - 1).alias("k"), F.struct(*[x for x in g.columns if x != "k"]).alias("b"))
    return a.join(b, "k")


_PAIRS = """, n AS (SELECT *, CAST(substr(granule_id, 2) AS INTEGER) AS k, origin_x / {s} AS ox, origin_y / {s} AS oy FROM gran),
    pr AS (SELECT a.k, a.granule_id AS ga, b.granule_id AS gb, a.ox AS ax, a.oy AS ay, b.ox AS bx, b.oy AS "by",
      a.px_m AS ap, b.px_m AS bp, a.width AS aw, a.height AS ah, b.width AS bw, b.height AS bh
      FROM n a JOIN n b ON b.k = a.k + 1)"""


@query("g01_tile_grid", _RANGE + ' SELECT granule_id, "row", col FROM t', "gran")
def _(spark, sf):
    return G.tile_grid(V.gran(spark, sf), 16).select("granule_id", F.col("row").cast("long").alias("row"),
                                                     F.col("col").cast("long").alias("col"))


@query("g02_data_bounds", """, d AS (SELECT granule_id, r // 4 AS dr, c // 4 AS dc FROM px
      WHERE r % 4 = 2 AND c % 4 = 2 AND v > 50000 AND r >= CASE WHEN granule_id LIKE 'N%' THEN 30 ELSE 12 END AND c < 70),
    h AS (SELECT DISTINCT granule_id FROM px)
    SELECT granule_id, min(dr) * 4 AS row_min, least((max(dr) + 1) * 4, 96) AS row_max, min(dc) * 4 AS col_min,
      least((max(dc) + 1) * 4, 96) AS col_max, round(count(dr) * 100.0 / (24 * 24), 6) AS coverage_percent
    FROM h LEFT JOIN d USING (granule_id) GROUP BY 1""", "px")
def _(spark, sf):
    inside = (F.col("v") > 50000) & (F.col("r") >= F.when(F.col("granule_id").startswith("N"), 30).otherwise(12)) & (F.col("c") < 70)
    d = V.px(spark, sf).withColumn("v", F.when(inside, F.col("v")))
    b = G.data_bounds(d, px_headers(spark, sf), 4)
    return b.select("granule_id", "row_min", "row_max", "col_min", "col_max",
                    F.round("coverage_percent", 6).alias("coverage_percent"))


@query("g03_swath_tiles", _SWATH + """, r AS (SELECT *, unnest(range(row_min, row_max, 16)) AS "row" FROM sw)
    SELECT granule_id, "row", unnest(range(col_min, col_max, 16)) AS col FROM r""", "gran")
def _(spark, sf):
    return G.swath_tiles(swath(spark, sf), 16).select("granule_id", "row", "col")


@query("g04_tile_scale", """SELECT granule_id, CAST(greatest(1, round_even(5.0 / px_m, 0)) AS INTEGER) AS scale FROM gran""", "gran")
def _(spark, sf):
    g = V.gran(spark, sf).withColumn("px_y_m", F.col("px_m"))
    return G.tile_scale(g).select("granule_id", "scale")


@query("g05_pixel_to_tile", 'SELECT granule_id, "row", col, count(*) AS n FROM pt GROUP BY 1, 2, 3', "pt")
def _(spark, sf):
    return G.with_tile(V.px(spark, sf), V.TS).groupBy("granule_id", "row", "col").agg(F.count(F.lit(1)).alias("n"))


@query("g06_tile_to_world", _RANGE.replace("SELECT granule_id, height", "SELECT granule_id, px_m, origin_x, origin_y, height") + """
    SELECT granule_id, "row", col, origin_x + col * px_m AS x_m, origin_y - "row" * px_m AS y_m,
      origin_x + (col + 8) * px_m AS xc_m, origin_y - ("row" + 8) * px_m AS yc_m FROM t""", "gran")
def _(spark, sf):
    t = G.with_world(G.tile_grid(V.gran(spark, sf), 16), 16)
    return t.select("granule_id", "row", "col", "x_m", "y_m", "xc_m", "yc_m")


@query("g07_world_to_cell", """, i AS (SELECT granule_id, CAST(floor((0 - origin_y + 100) / 2000) AS INTEGER) AS gi,
      CAST(floor((origin_x - 3000) / 2000) AS INTEGER) AS gj FROM gran)
    SELECT granule_id, CASE WHEN gi BETWEEN 0 AND 5 AND gj BETWEEN 0 AND 5 THEN gi ELSE -1 END AS gi,
      CASE WHEN gi BETWEEN 0 AND 5 AND gj BETWEEN 0 AND 5 THEN gj ELSE -1 END AS gj FROM i""", "gran")
def _(spark, sf):
    gi, gj = G.world_cell("origin_x", F.col("origin_y") - 100, 3000.0, 0.0, 2000.0, 6, 6)
    return V.gran(spark, sf).select("granule_id", gi.alias("gi"), gj.alias("gj"))


@query("g08_edge_clip", _RANGE + """ SELECT granule_id, "row", col, least(16, height - "row") AS h,
    least(16, width - col) AS w FROM t""", "gran")
def _(spark, sf):
    return G.clip_footprint(G.tile_grid(V.gran(spark, sf), 16), 16).select("granule_id", "row", "col", "h", "w")


@query("g09_crop_window", _RANGE.replace("SELECT granule_id, height", "SELECT granule_id, px_m, origin_x, origin_y, height") + """,
    k AS (SELECT * FROM t WHERE ("row" + col + height) % 3 = 0 AND "row" > 0)
    SELECT granule_id, min("row") AS row0, min(col) AS col0, least(max("row") + 16, min(height)) - min("row") AS h,
      least(max(col) + 16, min(width)) - min(col) AS w, min(origin_x) + min(col) * min(px_m) AS origin_x,
      min(origin_y) - min("row") * min(px_m) AS origin_y FROM k GROUP BY 1""", "gran")
def _(spark, sf):
    g = V.gran(spark, sf)
    t = G.tile_grid(g, 16).where("(row + col + height) % 3 = 0 AND row > 0").select("granule_id", "row", "col")
    return G.crop_window(t, g, 16)


@query("g10_overlap_crop", _SWATH + """, r AS (SELECT *, unnest(range(row_min, row_max, 10)) AS "row" FROM sw),
    t AS (SELECT *, unnest(range(col_min, col_max, 10)) AS col FROM r),
    s AS (SELECT *, least(16, height - "row") AS h, least(16, width - col) AS w,
      CASE WHEN "row" = row_min THEN 0 ELSE 3 END AS top, CASE WHEN col = col_min THEN 0 ELSE 3 END AS "left" FROM t)
    SELECT granule_id, "row", col, top, "left",
      greatest(CASE WHEN h < 7 OR "row" + 10 >= row_max THEN h ELSE h - 3 END, top + 1) AS bottom,
      greatest(CASE WHEN w < 7 OR col + 10 >= col_max THEN w ELSE w - 3 END, "left" + 1) AS "right",
      greatest(CASE WHEN h < 7 THEN h ELSE h - 3 END, top + 1) AS parity_bottom,
      "row" + top AS out_row, col + "left" AS out_col FROM s""", "gran")
def _(spark, sf):
    t = G.overlap_tiles(swath(spark, sf), 16, 3)
    k = G.center_crop(t, 16, 3)
    p = G.center_crop(t, 16, 3, parity=True).select("granule_id", "row", "col", F.col("bottom").alias("parity_bottom"))
    return k.join(p, ["granule_id", "row", "col"]).select(
        "granule_id", "row", "col", "top", "left", "bottom", "right", "parity_bottom", "out_row", "out_col")


@query("g11_block_average", """SELECT granule_id, r // 4 AS r, c // 4 AS c, round(avg(v), 6) AS v,
    round(CASE WHEN count(v) >= 16 THEN avg(v) END, 6) AS v_strict FROM px GROUP BY 1, 2, 3""", "px")
def _(spark, sf):
    d = V.px(spark, sf)
    a = G.block_average(d, 4)
    b = G.block_average(d, 4, strict=True).withColumnRenamed("v", "v_strict")
    return a.join(b, ["granule_id", "r", "c"]).select("granule_id", "r", "c", F.round("v", 6).alias("v"),
                                                      F.round("v_strict", 6).alias("v_strict"))


@query("g12_paint_tile_scalar", """, m AS (SELECT granule_id, "row", col, max(v) AS top FROM pt GROUP BY 1, 2, 3)
    SELECT granule_id, "row", col, r, c, top FROM pt JOIN m USING (granule_id, "row", col)""", "pt")
def _(spark, sf):
    d = V.px(spark, sf)
    t = G.with_tile(d, V.TS).groupBy("granule_id", "row", "col").agg(F.max("v").alias("top"))
    return G.paint(d, t, V.TS, ["top"]).select("granule_id", "row", "col", "r", "c", "top")


@query("g13_registration", _PAIRS.format(s=512) + """, o AS (SELECT *, ("by" - ay) / bp AS dr, (ax - bx) / bp AS dc FROM pr),
    f AS (SELECT *, abs(ap - bp) <= 1e-6 AND abs(dr - round_even(dr, 0)) <= 1e-4 AND abs(dc - round_even(dc, 0)) <= 1e-4 AS ok FROM o)
    SELECT ga, gb, ok, CASE WHEN ok THEN CAST(round_even(dr, 0) AS INTEGER) END AS dr,
      CASE WHEN ok THEN CAST(round_even(dc, 0) AS INTEGER) END AS dc FROM f""", "gran")
def _(spark, sf):
    r = G.registration(neighbours(spark, sf, 512), strict=False)
    return r.select(F.col("a.granule_id").alias("ga"), F.col("b.granule_id").alias("gb"), "ok", "dr", "dc")


@query("g14_overlap_boxes", _PAIRS.format(s=20) + """, o AS (SELECT ga, gb, greatest(ax, bx) AS x0, greatest(ay - ah * ap, "by" - bh * bp) AS y0,
      least(ax + aw * ap, bx + bw * bp) AS x1, least(ay, "by") AS y1 FROM pr),
    k AS (SELECT *, unnest(range(0, 3)) AS bi FROM o WHERE x1 > x0 AND y1 > y0),
    b AS (SELECT *, unnest(range(0, 3)) AS bj FROM k)
    SELECT ga, gb, CAST(bi AS INTEGER) AS bi, CAST(bj AS INTEGER) AS bj, round(x0 + (x1 - x0) * (bi + 1) / 4 - 20, 6) AS bx0,
      round(y0 + (y1 - y0) * (bj + 1) / 4 + 20, 6) AS by1 FROM b""", "gran")
def _(spark, sf):
    b = G.inset_boxes(G.overlap_bounds(neighbours(spark, sf, 20)), 3, 40.0)
    return b.select(F.col("a.granule_id").alias("ga"), F.col("b.granule_id").alias("gb"), "bi", "bj",
                    F.round("bx0", 6).alias("bx0"), F.round("by1", 6).alias("by1"))


@query("g15_mosaic_extent", """, e AS (SELECT y, min(origin_x) AS x0, max(origin_x + width * px_m) AS x1,
      min(origin_y - height * px_m) AS y0, max(origin_y) AS y1 FROM gran GROUP BY 1)
    SELECT *, abs(x0 / 2560 - round_even(x0 / 2560, 0)) < 1e-6 AND abs(x1 / 2560 - round_even(x1 / 2560, 0)) < 1e-6
      AND abs(y0 / 2560 - round_even(y0 / 2560, 0)) < 1e-6 AND abs(y1 / 2560 - round_even(y1 / 2560, 0)) < 1e-6 AS aligned
    FROM e""", "gran")
def _(spark, sf):
    return G.mosaic_extent(V.gran(spark, sf), ["y"], strict=False)


@query("g16_centre_subtile", _RANGE + ' SELECT granule_id, "row", col, "row" + 4 AS sub_row, col + 4 AS sub_col FROM t', "gran")
def _(spark, sf):
    return G.centre_subtile(G.tile_grid(V.gran(spark, sf), 16), 16, 8).select("granule_id", "row", "col", "sub_row", "sub_col")


@query("g17_dense_grid", """, s AS (SELECT granule_id, r // 16 AS i, c // 16 AS j, 1 + (r // 16) % 2 AS n, max(v) AS p
      FROM px WHERE r % 16 < 4 AND v > 95000 GROUP BY 1, 2, 3, 4),
    e AS (SELECT granule_id, i + di AS ti, j + dj AS tj, max(p) AS p FROM s
      JOIN (SELECT unnest([0, 1]) AS di) ON di < n JOIN (SELECT unnest([0, 1]) AS dj) ON dj < n GROUP BY 1, 2, 3),
    h AS (SELECT DISTINCT granule_id FROM px),
    a AS (SELECT granule_id, unnest(range(0, 6)) AS ti FROM h),
    g AS (SELECT granule_id, ti, unnest(range(0, 6)) AS tj FROM a),
    d AS (SELECT g.*, p FROM g LEFT JOIN e USING (granule_id, ti, tj)),
    b AS (SELECT granule_id, min(ti) AS a, max(ti) AS b, min(tj) AS c, max(tj) AS d FROM d WHERE p IS NOT NULL GROUP BY 1)
    SELECT granule_id, CAST(ti AS INTEGER) AS ti, CAST(tj AS INTEGER) AS tj, p FROM d JOIN b USING (granule_id)
    WHERE ti BETWEEN a - 1 AND b + 1 AND tj BETWEEN c - 1 AND d + 1""".replace("AND d + 1", "AND b.d + 1"), "px")
def _(spark, sf):
    d = G.with_tile(V.px(spark, sf).where("r % 16 < 4 AND v > 95000"), V.TS)
    s = d.groupBy("granule_id", "row", "col").agg(F.max("v").alias("p"))
    s = s.withColumn("stride", (1 + F.floor(F.col("row") / V.TS) % 2) * V.TS)
    g = G.dense_grid(px_headers(spark, sf), s, V.TS, "p", "stride")
    return G.trim_to_data(g, F.col("p").isNotNull(), pad=1)
