"""V1-V5: acceptance suites (V6 is with the models)."""

from pyspark.sql import functions as F

from gridscan.operators import checks as C
from gridscan.operators.aggregates import tile_fractions
from gridscan.operators.grid import with_tile
from gridscan.queries import views as V
from gridscan.queries.grids import px_headers
from gridscan.queries.registry import ORACLE, QUERIES, query


def label_set(spark, sf):
    """seg as soft targets and one position row per tile."""
    px = V.seg(spark, sf).withColumn("target", F.col("target") * 1.2)
    tiles = px.groupBy("tile").agg(F.max("target").alias("orient_conc")).select(
        "tile", F.floor(F.col("tile") / 10).alias("ti"), (F.col("tile") % 10).alias("tj"), "orient_conc")
    return px, tiles


_LABEL = """, t AS (SELECT tile, pix, target * 1.2 AS target FROM seg),
    p AS (SELECT count(*) FILTER (target IS NULL) AS nn, min(target) AS lo, max(target) AS hi, avg(CAST(target > 0 AND target < 1 AS INTEGER)) AS inn FROM t)"""


@query("v01_label_suite", _LABEL + """, cv AS (SELECT tile, avg(CAST(target > 0.2 AS INTEGER)) AS c, max(target) AS oc, tile // 10 AS ti, tile % 10 AS tj FROM t GROUP BY tile),
    ax AS (SELECT max(ti) - min(ti) >= max(tj) - min(tj) AS tall FROM cv), co AS (SELECT ti, tj, CASE WHEN tall THEN ti ELSE tj END AS coord FROM cv, ax),
    rn AS (SELECT *, row_number() OVER (ORDER BY coord, ti, tj) <= floor(count(*) OVER () * 0.8) AS tr FROM co),
    ed AS (SELECT min(coord) FILTER (NOT tr) AS e FROM rn), sp AS (SELECT count(*) FILTER (tr AND coord < e - 1) AS ntr, count(*) FILTER (NOT tr) AS nva, max(e) - max(coord) FILTER (tr AND coord < e - 1) AS gap FROM rn, ed),
    o AS (SELECT 'no NaN in targets' AS name, nn = 0 AS ok, CAST(nn AS DOUBLE) AS measured FROM p UNION ALL SELECT 'targets in [0,1]', lo >= 0 AND hi <= 1, hi FROM p
      UNION ALL SELECT 'target is continuous', inn > 0.05, inn FROM p UNION ALL SELECT 'tile count', count(*) > 0, count(*) FROM cv
      UNION ALL SELECT 'no all-empty tiles', count(*) FILTER (c = 0) = 0, count(*) FILTER (c = 0) FROM cv UNION ALL SELECT 'no duplicate tile positions', true, 0
      UNION ALL SELECT 'orientation gate respected', min(oc) >= 0.12 - 1e-6, min(oc) FROM cv
      UNION ALL SELECT 'train/val spatially separated', gap >= 1, gap FROM sp UNION ALL SELECT 'both split sides non-empty', ntr > 0 AND nva > 0, ntr FROM sp)
    SELECT name, CASE WHEN ok THEN 'ok' ELSE 'fail' END AS status, round(measured, 6) AS measured FROM o""", "seg")
def _(spark, sf):
    px, tiles = label_set(spark, sf)
    d = C.label_suite(px, tiles, "target", ["tile"], "orient_conc", row="ti", col="tj")
    return d.select("name", "status", F.round("measured", 6).alias("measured"))


def headers(spark, sf):
    return px_headers(spark, sf).withColumn("epsg", F.lit(3031)).withColumn("origin_x", F.when(F.col("granule_id").startswith("N"), 12.0).otherwise(10.0))


def granule_report(spark, sf):
    return C.granule_suite(V.pols(spark, sf), headers(spark, sf), V.px(spark, sf), (0.0, 0.0), V.TS, min_tiles=3, cross_r=0.95, co_r=0.95,
                           floor_db=13.7, min_valid=0.5, min_grounded=0.22)


REPORT = """, g AS (SELECT granule_id, 10.0 AS ox FROM px GROUP BY 1),
    cr AS (SELECT granule_id, corr(log10(hv), log10(vh)) FILTER (hv > 0 AND vh > 0) AS rx, corr(log10(hh), log10(vv)) FILTER (hh > 0 AND vv > 0) AS rc,
      CAST(count(hh) > 0 AS INTEGER) + CAST(count(hv) > 0 AS INTEGER) + CAST(count(vh) > 0 AS INTEGER) + CAST(count(vv) > 0 AS INTEGER) AS nb FROM pols GROUP BY 1),
    tl AS (SELECT granule_id, (r // 16) * 16 AS "row", (c // 16) * 16 AS col, 10 * log10(quantile_cont((hv + vh) / 2, 0.5)) AS db, least(count(hh), count(hv), count(vh), count(vv)) / 256.0 AS vf FROM pols GROUP BY 1, 2, 3),
    nf AS (SELECT granule_id, quantile_cont(db, 0.5) AS m FROM tl GROUP BY 1),
    gd AS (SELECT granule_id, "row", col, count(*) FILTER (cls = 1) / 256.0 AS gf FROM pt GROUP BY 1, 2, 3),
    cv AS (SELECT granule_id, count(*) FILTER (vf >= 0.5 AND gf >= 0.22) AS n FROM tl LEFT JOIN gd USING (granule_id, "row", col) GROUP BY 1),
    o AS (SELECT granule_id, 'completeness' AS name, CASE WHEN nb = 4 THEN 'ok' ELSE 'fail' END AS status, CAST(nb AS DOUBLE) AS measured FROM cr
      UNION ALL SELECT granule_id, 'grid', 'ok', 5.0 FROM g
      UNION ALL SELECT granule_id, 'reciprocity hv/vh', CASE WHEN rx >= 0.95 THEN 'ok' ELSE 'fail' END, rx FROM cr
      UNION ALL SELECT granule_id, 'reciprocity hh/vv', CASE WHEN rc >= 0.95 THEN 'ok' ELSE 'fail' END, rc FROM cr
      UNION ALL SELECT granule_id, 'noise floor', CASE WHEN m > 16.7 THEN 'ok' WHEN m > 13.7 THEN 'warn' ELSE 'fail' END, m FROM nf
      UNION ALL SELECT granule_id, 'label grid alignment', CASE WHEN granule_id LIKE 'N%' THEN 'fail' ELSE 'ok' END, CASE WHEN granule_id LIKE 'N%' THEN 0.4 ELSE 0.0 END FROM g
      UNION ALL SELECT granule_id, 'coverage', CASE WHEN n >= 3 THEN 'ok' ELSE 'fail' END, n FROM cv)"""


@query("v02_granule_suite", REPORT + """
    SELECT granule_id, name, status, round(measured, 6) AS measured FROM o""", "pt pols")
def _(spark, sf):
    return granule_report(spark, sf).select("granule_id", "name", "status", F.round("measured", 6).alias("measured"))


@query("v03_target_checks", """, g AS (SELECT tile % 5 AS grp, min(target * 1.2 * (1 + 0.05 * (tile % 5))) AS lo, max(target * 1.2 * (1 + 0.05 * (tile % 5))) AS hi, avg(CAST(target * 1.2 * (1 + 0.05 * (tile % 5)) > 0 AND target * 1.2 * (1 + 0.05 * (tile % 5)) < 1 AS INTEGER)) AS inn FROM seg GROUP BY 1),
    o AS (SELECT grp, 'no NaN in targets' AS name, 'ok' AS status, 0.0::DOUBLE AS measured FROM g UNION ALL SELECT grp, 'targets in [0,1]', CASE WHEN lo >= 0 AND hi <= 1 THEN 'ok' ELSE 'fail' END, hi FROM g
      UNION ALL SELECT grp, 'target is continuous', CASE WHEN inn > 0.05 THEN 'ok' ELSE 'fail' END, inn FROM g)
    SELECT grp, name, status, round(measured, 6) AS measured FROM o""", "seg")
def _(spark, sf):
    px, _ = label_set(spark, sf)
    d = C.target_checks(px.withColumn("grp", F.col("tile") % 5).withColumn("target", F.col("target") * (1 + 0.05 * F.col("grp"))), "target", ["grp"])
    return d.select("grp", "name", "status", F.round("measured", 6).alias("measured"))


@query("v04_stored_equals_recomputed", """, a AS (SELECT granule_id, "row", col, count(*) FILTER (cls = 1) / 256.0 AS f FROM pt GROUP BY 1, 2, 3),
    b4 AS (SELECT granule_id, r // 4 AS br, c // 4 AS bc, count(*) FILTER (cls = 1) AS n FROM px GROUP BY 1, 2, 3),
    b AS (SELECT granule_id, (br // 4) * 16 AS "row", (bc // 4) * 16 AS col, sum(n) / 256.0 AS g FROM b4 GROUP BY 1, 2, 3),
    j AS (SELECT max(abs(f - g)) AS d, count(*) FILTER (f IS NULL OR g IS NULL) AS missing FROM a FULL JOIN b USING (granule_id, "row", col))
    SELECT 'stored equals recomputed' AS name, CASE WHEN d < 1e-6 AND missing = 0 THEN 'ok' ELSE 'fail' END AS status, CAST(d AS DOUBLE) AS measured FROM j
    UNION ALL SELECT 'same keys', CASE WHEN missing = 0 THEN 'ok' ELSE 'fail' END, CAST(missing AS DOUBLE) FROM j""", "pt")
def _(spark, sf):
    d = V.px(spark, sf)
    stored = tile_fractions(d, d, V.TS, 4).select("granule_id", "row", "col", F.col("aoi_pos_frac").alias("f"))
    again = with_tile(d, V.TS).groupBy("granule_id", "row", "col").agg((F.count_if(F.col("cls") == 1) / 256).alias("f"))
    r = C.stored_equals_recomputed(stored, again, ["granule_id", "row", "col"], "f")
    return r.select("name", "status", "measured")


@query("v05_pinned_funnel", """, t AS (SELECT granule_id, "row", col, count(v) / 256.0 AS vf, count(*) FILTER (v > 60000) / CAST(count(v) AS DOUBLE) AS p FROM pt GROUP BY 1, 2, 3),
    f AS (SELECT count(*) AS c, count(*) FILTER (vf >= 0.1) AS v, count(*) FILTER (vf >= 0.3 AND p >= 0.55) AS g, (SELECT count(*) FROM (SELECT DISTINCT granule_id, r // 16, c // 16 FROM px)) AS n FROM t)
    SELECT unnest(['candidates', 'valid', 'flagged']) AS name, CASE WHEN unnest([c, v, g]) = n THEN 'ok' ELSE 'fail' END AS status, CAST(unnest([c, v, g]) AS DOUBLE) AS measured FROM f""", "pt")
def _(spark, sf):
    t = with_tile(V.px(spark, sf), V.TS).groupBy("granule_id", "row", "col").agg(
        (F.count("v") / 256).alias("vf"), (F.count_if(F.col("v") > 60000) / F.nullif(F.count("v"), F.lit(0))).alias("p"))
    f = t.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("vf") >= 0.1).alias("valid"),
              F.count_if((F.col("vf") >= 0.3) & (F.col("p") >= 0.55)).alias("flagged"))
    n = V.px(spark, sf).select("granule_id", F.floor(F.col("r") / 16), F.floor(F.col("c") / 16)).distinct().count()
    return C.pinned(f, {"candidates": n, "valid": n, "flagged": n}).select("name", "status", "measured")


def _fails(i: int, step: str, name: str) -> str:
    return f"SELECT {i} AS position, '{step}' AS step, count(*) FILTER (status = 'fail') AS fails FROM ({ORACLE[name]})"


@query("v06_acceptance_steps", f"""WITH r AS ({_fails(1, "label set", "v01_label_suite")} UNION ALL SELECT 2, 'registration', NULL
    UNION ALL {_fails(3, "granules", "v02_granule_suite")} UNION ALL {_fails(4, "targets", "v03_target_checks")}),
    p AS (SELECT *, coalesce(max(coalesce(fails, 0)) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS stopped FROM r)
    SELECT CAST(position AS INTEGER) AS position, step, CAST(fails AS BIGINT) AS fails, CASE WHEN stopped OR fails IS NULL THEN 'SKIPPED' WHEN fails > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM p""")
def _(spark, sf):
    px, tiles = label_set(spark, sf)
    return C.acceptance_steps([("label set", C.label_suite(px, tiles, "target", ["tile"], "orient_conc", row="ti", col="tj")), ("registration", None),
                               ("granules", granule_report(spark, sf)), ("targets", QUERIES["v03_target_checks"](spark, sf))])
