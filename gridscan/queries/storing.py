"""Sources and sinks.  Sinks are written to the session's shared scratch folder and read back."""

from pyspark.sql import functions as F

from gridscan.operators.grid import block_average, decimate, with_tile
from gridscan.operators.metrics import threshold_sweep
from gridscan.plans.cascade import to_source_grid
from gridscan.plans.lineage import scratch_path, stored
from gridscan.queries import views as V
from gridscan.queries.grids import px_headers
from gridscan.queries.registry import query
from gridscan.schema import TILE_LABELS
from gridscan.sources import catalog as C
from gridscan.sources import raster as R
from gridscan.sources import tables as T

TILE = ["granule_id", "row", "col"]


def paths(spark, sf):
    """One file name per (customer, nation) pair of the orders, some ids twice."""
    o, k = V.table(spark, sf, "orders"), F.col("o_custkey")
    return o.select(F.concat(F.lit("/data/GSLC_"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("_"),
                             F.lpad((F.floor(k / 1000) % 1000).cast("string"), 3, "0"), F.lit("_"), "o_orderstatus", F.lit(".tif")).alias("path")).distinct()


_PATHS = """WITH pa AS (SELECT DISTINCT concat('/data/GSLC_', lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0'), '_', lpad(CAST((o_custkey // 1000) % 1000 AS VARCHAR), 3, '0'), '_', o_orderstatus, '.tif') AS path FROM orders),
    ct AS (SELECT substr(path, 12, 7) AS granule_id, min(path) AS path, count(*) AS n_files, count(*) > 1 AS ambiguous FROM pa GROUP BY 1)"""


@query("s01_scan_granules", _PATHS + " SELECT * FROM ct")
def _(spark, sf):
    return C.catalog(paths(spark, sf), strict=False)


@query("s02_find_granule", _PATHS + " SELECT granule_id, path FROM ct WHERE granule_id = '007_000'")
def _(spark, sf):
    return C.find_granule(C.catalog(paths(spark, sf), strict=False), "007_000.tif").select("granule_id", "path")


@query("s03_parse_scene", """SELECT o_orderkey, CASE WHEN ok THEN concat('S', o_custkey % 3 + 1) END AS stack, CASE WHEN ok THEN strftime(o_orderdate, '%Y-%m-%d') END AS acq_date,
    CASE WHEN ok THEN concat('M', lpad(CAST(o_custkey % 20 AS VARCHAR), 2, '0')) END AS foot FROM (SELECT *, o_orderstatus <> 'P' AS ok FROM orders)""")
def _(spark, sf):
    o, k = V.table(spark, sf, "orders"), F.col("o_custkey")
    nm = F.concat(F.when(F.col("o_orderstatus") != "P", "BIO_S").otherwise("RAW_S"), (k % 3 + 1).cast("string"), F.lit("_SCS__1S_"),
                  F.date_format("o_orderdate", "yyyyMMdd"), F.lit("T101010_20260101T101011_T_G01_"), F.lit("M"), F.lpad((k % 20).cast("string"), 2, "0"), F.lit("_C01"))
    d = C.parse_scene(o.select("o_orderkey", nm.alias("name")), strict=False)
    return d.select("o_orderkey", "stack", F.date_format("acq_date", "yyyy-MM-dd").alias("acq_date"), "foot")


@query("s04_windowed_read", """, w AS (SELECT granule_id, CASE WHEN granule_id LIKE 'A%' THEN -4 ELSE 85 END AS r0, 40 AS c0 FROM (SELECT DISTINCT granule_id FROM px)),
    a AS (SELECT *, unnest(range(r0, r0 + 16)) AS r FROM w), g AS (SELECT *, unnest(range(c0, c0 + 16)) AS c FROM a)
    SELECT granule_id, CAST(g.r AS INTEGER) AS r, CAST(g.c AS INTEGER) AS c, coalesce(v, 0.0) AS v FROM g LEFT JOIN px USING (granule_id, r, c)""", "px")
def _(spark, sf):
    d = V.px(spark, sf)
    w = d.select("granule_id").distinct().select("granule_id", F.when(F.col("granule_id").startswith("A"), -4).otherwise(85).alias("row"),
                                                 F.lit(40).alias("col"), F.lit(16).alias("h"), F.lit(16).alias("w"))
    return R.read_windows(d, w).select("granule_id", "r", "c", "v")


@query("s04_blocked_layout", "SELECT granule_id, r, c, v FROM px WHERE granule_id = 'RF_0000' AND r BETWEEN 30 AND 49 AND c BETWEEN 10 AND 29", "px")
def _(spark, sf):
    path = scratch_path(spark, "pixels")
    R.write_pixels(V.px(spark, sf), path, block=32)
    return R.read_window(spark.read.parquet(path), "RF_0000", 30, 10, 20, 20, block=32).select("granule_id", "r", "c", "v")


@query("s04_pruned_windows", """, w AS (SELECT granule_id, (hash_row * 7) % 90 AS r0, (hash_row * 11) % 90 AS c0 FROM (SELECT granule_id, CAST(right(granule_id, 4) AS BIGINT) + ascii(granule_id) AS hash_row FROM (SELECT DISTINCT granule_id FROM px) WHERE granule_id NOT LIKE 'N%')),
    a AS (SELECT *, unnest(range(r0, r0 + 12)) AS r FROM w), g AS (SELECT *, unnest(range(c0, c0 + 12)) AS c FROM a)
    SELECT granule_id, CAST(g.r AS INTEGER) AS r, CAST(g.c AS INTEGER) AS c, coalesce(v, 0.0) AS v FROM g LEFT JOIN px USING (granule_id, r, c)""", "px")
def _(spark, sf):
    path = scratch_path(spark, "pixels")
    R.write_pixels(V.px(spark, sf), path, block=16)
    d = spark.read.parquet(path)
    k = F.right("granule_id", F.lit(4)).cast("int") + F.ascii("granule_id")
    w = d.select("granule_id").distinct().where(~F.col("granule_id").startswith("N")).select(
        "granule_id", (k * 7 % 90).alias("row"), (k * 11 % 90).alias("col"), F.lit(12).alias("h"), F.lit(12).alias("w"))
    return R.read_windows(d, stored(w, "windows"), block=16).select("granule_id", "r", "c", "v")


@query("s05_multi_band", 'SELECT granule_id, r, c, hh AS "HH", hv AS "HV", vh AS "VH", vv AS "VV" FROM pols', "pols")
def _(spark, sf):
    return R.pivot_bands(R.unpivot_bands(V.pols(spark, sf)))


@query("s06_decimated_nearest", """SELECT granule_id, r // 4 AS dr, c // 4 AS dc, v, 'nearest' AS how FROM px WHERE r % 4 = 2 AND c % 4 = 2
    UNION ALL SELECT granule_id, r // 4, c // 4, v, 'first' FROM px WHERE r % 4 = 0 AND c % 4 = 0""", "px")
def _(spark, sf):
    d = V.px(spark, sf)
    a = decimate(d, 4).select("granule_id", "dr", "dc", "v", F.lit("nearest").alias("how"))
    return a.unionByName(decimate(d, 4, nearest=False).select("granule_id", "dr", "dc", "v", F.lit("first").alias("how")))


@query("s07_decimated_average", "SELECT granule_id, r // 8 AS r, c // 8 AS c, round(avg(log10(v)), 6) AS lg FROM px GROUP BY 1, 2, 3", "px")
def _(spark, sf):
    d = block_average(V.px(spark, sf).withColumn("lg", F.log10("v")), 8, "lg")
    return d.select("granule_id", "r", "c", F.round("lg", 6).alias("lg"))


def label_rows(spark, sf):
    f = V.feat(spark, sf)
    return f.select(F.col("granule_id").alias("granule"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"),
                    F.when(F.col("label") == 8, "review").when(F.col("y") == 1, "positive").otherwise("none").alias("label"),
                    F.round("p_a", 6).alias("aoi_pos_frac"), F.lit(1.0).alias("data_frac"), F.lit("core").alias("tier"), F.round("e0", 1).alias("dist_km"),
                    F.lit(None).cast("double").alias("grounded_frac"), F.lit(None).cast("string").alias("ice_condition"), F.round("vel", 1).alias("vel_m_yr"),
                    F.lit("survey").alias("source"), F.lit(None).cast("timestamp").alias("timestamp"))


@query("s08_label_csv", """SELECT granule_id AS granule, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, CASE WHEN y = 1 THEN 'positive' ELSE 'none' END AS label,
    round(p_a, 6) AS aoi_pos_frac, round(vel, 1) AS vel_m_yr FROM feat WHERE label <> 8""", "feat")
def _(spark, sf):
    path = scratch_path(spark, "labels")
    label_rows(spark, sf).write.csv(path, header=True)
    return T.read_labels(spark, path, ["positive", "none"]).select("granule", "row", "col", "label", "aoi_pos_frac", "vel_m_yr")


@query("s09_sorted_label_csv", """SELECT granule_id AS granule, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, 'core' AS tier FROM feat""", "feat")
def _(spark, sf):
    path = scratch_path(spark, "labels")
    T.write_labels(label_rows(spark, sf), path)
    return spark.read.schema(TILE_LABELS).csv(path, header=True).select("granule", "row", "col", "tier")


@query("s10_bundle", """SELECT tile, CASE WHEN tile % 4 <> 0 THEN count(*) END AS n_lines, CASE WHEN tile % 3 <> 0 THEN round(avg(prob), 10) END AS edge_coverage FROM seg GROUP BY 1""", "seg")
def _(spark, sf):
    path = scratch_path(spark, "bundle")
    d = V.seg(spark, sf).groupBy("tile").agg(F.when(F.col("tile") % 4 != 0, F.count(F.lit(1))).alias("n_lines"),
                                             F.when(F.col("tile") % 3 != 0, F.round(F.avg("prob"), 10)).alias("edge_coverage"))
    T.write_bundle(T.null_to_sentinels(d, ["n_lines"], ["edge_coverage"]), path, {"tile_size": 16})
    return T.sentinels_to_null(spark.read.parquet(path), ["n_lines"], ["edge_coverage"]).drop("tile_size")


@query("s11_score_csv", """SELECT granule_id AS granule, CAST("row" AS VARCHAR) AS "row", CAST(col AS VARCHAR) AS col, printf('%.1f', x_m) AS x_m, printf('%.1f', y_m) AS y_m,
    CASE WHEN label <> 1 THEN printf('%.4f', p_a) END AS p_rf, printf('%.4f', p_b) AS p_cnn, CASE WHEN label <> 1 THEN CAST(CAST(p_a >= 0.5 AS INTEGER) AS VARCHAR) END AS flag_rf FROM feat WHERE label <> 1 OR p_b IS NOT NULL""", "feat")
def _(spark, sf):
    path = scratch_path(spark, "scores")
    d = V.feat(spark, sf).select("*", F.when(F.col("label") != 1, F.col("p_a")).alias("p_rf"), F.col("p_b").alias("p_cnn"))
    d = d.withColumn("granule_id", F.concat("granule_id", F.lit(".tif")))
    T.write_score_csv(d, path, ["rf", "cnn"], {"rf": 0.5})
    return spark.read.csv(path, header=True)


@query("s12_score_table", """SELECT granule_id, "row", col, round(p_a, 6) AS prob, 0.5::DOUBLE AS gate_thresh, 512 AS stride FROM feat""", "feat")
def _(spark, sf):
    path = scratch_path(spark, "scores")
    T.write_scores(V.feat(spark, sf).select("granule_id", "row", "col", F.round("p_a", 6).alias("prob")), path, {"gate_thresh": 0.5, "stride": 512})
    return spark.read.parquet(path)


@query("s13_tile_results", "SELECT tile, round(avg(CAST(prob > 0.5 AS INTEGER)), 6) AS coverage, count(*) FILTER (prob > 0.5) AS pixels FROM seg GROUP BY 1", "seg")
def _(spark, sf):
    from gridscan.operators.aggregates import coverage
    path = scratch_path(spark, "tile-results")
    T.write_bundle(coverage(V.seg(spark, sf), ["tile"], "prob", 0.5).withColumn("coverage", F.round("coverage", 6)), path)
    return spark.read.parquet(path)


@query("s14_raster_sink", """, h AS (SELECT DISTINCT granule_id FROM px), a AS (SELECT granule_id, unnest(range(0, 96)) AS r FROM h), g AS (SELECT *, unnest(range(0, 96)) AS c FROM a)
    SELECT granule_id, CAST(g.r AS INTEGER) AS r, CAST(g.c AS INTEGER) AS c, round(log10(x.v), 6) AS lg FROM g LEFT JOIN (SELECT * FROM px WHERE v > 50000) x USING (granule_id, r, c)""", "px")
def _(spark, sf):
    path = scratch_path(spark, "raster")
    v = V.px(spark, sf).where("v > 50000").select("granule_id", "r", "c", F.round(F.log10("v"), 6).alias("lg"))
    R.write_pixels(to_source_grid(px_headers(spark, sf), v, ["lg"], 32), path, block=32)
    return spark.read.parquet(path).select("granule_id", "r", "c", "lg")


@query("s15_band_statistics", """, l AS (UNPIVOT (SELECT granule_id, log10(hh) AS hh, log10(hv) AS hv, log10(vh) AS vh, log10(vv) AS vv FROM pols) ON hh, hv, vh, vv INTO NAME band VALUE x)
    SELECT granule_id, upper(band) AS band, round(min(x), 6) AS "min", round(max(x), 6) AS "max", round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(x) AS n_valid FROM l GROUP BY 1, 2""", "pols")
def _(spark, sf):
    d = R.unpivot_bands(V.pols(spark, sf), ["HH", "HV", "VH", "VV"]).withColumn("v", F.log10("v"))
    s = T.band_statistics(d)
    return s.select("granule_id", "band", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std")], "n_valid")


@query("s16_pyramid", """, l1 AS (SELECT granule_id, r // 2 AS r, c // 2 AS c, avg(log10(v)) AS v FROM px GROUP BY 1, 2, 3), l2 AS (SELECT granule_id, r // 2 AS r, c // 2 AS c, avg(v) AS v FROM l1 GROUP BY 1, 2, 3),
    l3 AS (SELECT granule_id, r // 2 AS r, c // 2 AS c, avg(v) AS v FROM l2 GROUP BY 1, 2, 3)
    SELECT granule_id, r, c, round(v, 6) AS v, 1 AS level FROM l1 UNION ALL SELECT granule_id, r, c, round(v, 6), 2 FROM l2 UNION ALL SELECT granule_id, r, c, round(v, 6), 3 FROM l3""", "px")
def _(spark, sf):
    d = T.pyramid(V.px(spark, sf).withColumn("v", F.log10("v")), 3)
    return d.select("granule_id", "r", "c", F.round("v", 6).alias("v"), "level")


@query("s17_json_report", """, t AS (SELECT CAST(unnest([0.25, 0.5, 0.75]) AS DOUBLE) AS theta)
    SELECT theta, count(*) FILTER (prob > theta AND target > 0.4) AS tp, round((count(*) FILTER (prob > theta AND target > 0.4) + 1e-6) / (count(*) FILTER (prob > theta OR target > 0.4) + 1e-6), 6) AS iou FROM seg, t GROUP BY 1""", "seg")
def _(spark, sf):
    d = threshold_sweep(V.seg(spark, sf), "prob", "target", 0.4, [0.25, 0.5, 0.75]).select("theta", "tp", F.round("iou", 6).alias("iou"))
    return T.from_json_report(T.to_json_report(d, "theta"), "theta: double, tp: bigint, iou: double")


@query("s18_pack_shard", """, k AS (SELECT granule_id, "row", col, count(*) FILTER (cls = 1) / 256.0 AS pf FROM pt GROUP BY 1, 2, 3)
    SELECT granule_id, "row", col, round(pf, 6) AS pf, count(*) AS n, list(v2 ORDER BY r, c) AS v2, list(cls ORDER BY r, c) AS cls, round(avg(CAST(cls > 0.2 AS INTEGER)), 6) AS coverage
    FROM pt JOIN k USING (granule_id, "row", col) WHERE pf >= 0.2 GROUP BY 1, 2, 3, 4""", "pt")
def _(spark, sf):
    path = scratch_path(spark, "shard")
    d = V.px(spark, sf)
    lab = with_tile(d, V.TS).groupBy(*TILE).agg((F.count_if(F.col("cls") == 1) / 256).alias("pf")).where("pf >= 0.2")
    shard = T.pack_shard(stored(lab, "shard-labels"), d, V.TS, "v2", "cls", ["pf"]).withColumn("granule_part", R.granule_part())
    T.write_bundle(shard, path, {"source": "px"}, ["granule_part"])
    o = spark.read.parquet(path)
    return o.select("granule_id", "row", "col", F.round("pf", 6).alias("pf"), F.col("n").cast("long").alias("n"), "v2", "cls", F.round("coverage", 6).alias("coverage"))
