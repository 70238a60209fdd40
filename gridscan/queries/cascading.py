"""Models, cascades, pluggable stages."""

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from gridscan.functions import scalar as S
from gridscan.functions.stats import looks, resultant
from gridscan.operators import aggregates as A
from gridscan.operators import features as X
from gridscan.operators import filters as FL
from gridscan.operators import metrics as M
from gridscan.operators import models as MD
from gridscan.operators.grid import clip_footprint, data_bounds, swath_tiles, tile_grid, with_tile
from gridscan.operators.joins import common_box, match_ground
from gridscan.operators.splits import map_blocks
from gridscan.plans import acceptance as AC
from gridscan.plans import cascade as CA
from gridscan.plans.lineage import scratch_path, stored
from gridscan.queries import views as V
from gridscan.queries.checking import REPORT, granule_report
from gridscan.queries.evaluating import _AUC, SPECKLE_METRICS, speckle_tiles
from gridscan.queries.featuring import _ORI, _X1 as RADIOMETRIC, X15_RANKED
from gridscan.queries.grids import px_headers
from gridscan.queries.joining import _AB, _TP, box_pairs, tile_p, two_granules
from gridscan.queries.registry import query
from gridscan.queries.stencils import image
from gridscan.sources.raster import write_pixels

FEATURES = ["e0", "e1", "e2", "e3", "e4", "e5"]
SMALL = {"numTrees": 10, "maxDepth": 4}
TILE = ["granule_id", "row", "col"]


def train(spark, sf):
    """feat with a label that the features can learn: y = e0 + e1 > 0."""
    return V.feat(spark, sf).withColumn("y", (F.col("e0") + F.col("e1") > 0).cast("int"))


@query("m01_forest_gate")
def _(spark, sf):
    d = train(spark, sf)
    m = MD.fit_gate(d, FEATURES, preset="single_pol", numTrees=20)
    return M.auc(MD.score_tiles(d, m, FEATURES), "p", "y")


@query("a22_importance_by_prefix")
def _(spark, sf):
    d = train(spark, sf)
    m = MD.fit_gate(d, [*FEATURES, "x_m", "y_m"], **SMALL)
    return A.importance_by_prefix(MD.importances(spark, m, [*FEATURES, "x_m", "y_m"]), ["e", "x"])


@query("m02_out_of_fold")
def _(spark, sf):
    d = train(spark, sf).withColumn("fold", F.col("vec_id") % 3)
    return MD.out_of_fold(d, "fold", FEATURES, **SMALL).select("vec_id", "y", "fold", "oof")


@query("m03_train_gate")
def _(spark, sf):
    d = map_blocks(train(spark, sf), 12800.0).withColumn("half", F.col("vec_id") % 2)
    _, b = MD.train_gate(d, FEATURES, ["bx", "by"], "half", ["vec_id"], k=2, **SMALL)
    return spark.createDataFrame([(b["auc_random"], b["auc_block"], b["threshold"], b["threshold_mode"])],
                                 "auc_random double, auc_block double, threshold double, mode string")


@query("m04_score_tiles")
def _(spark, sf):
    d = train(spark, sf)
    f = [*FEATURES, "vel"]
    return MD.score_tiles(d, MD.fit_gate(d, f, **SMALL), f).select("vec_id", "vel", "p")


@query("m05_cascade", _TP + """ SELECT granule_id, "row", col, round(p, 6) AS gate_prob, coalesce(p >= 0.55, false) AS gate_flag,
    CASE WHEN p >= 0.55 THEN round(p * p + n / 1000.0, 6) END AS seg, coalesce(p >= 0.55 AND p * p + n / 1000.0 >= 0.45, false) AS seg_mask FROM tp""", "pt")
def _(spark, sf):
    t = tile_p(spark, sf).withColumn("p", F.when(F.col("n") > 0, F.col("p")))

    def segment(d):
        return d.withColumn("seg", F.col("p") * F.col("p") + F.col("n") / 1000)
    o = CA.cascade(t, F.col("p"), segment, 0.55, mask_threshold=0.45)
    return o.select(*TILE, F.round("gate_prob", 6).alias("gate_prob"), "gate_flag", F.round("seg", 6).alias("seg"), "seg_mask")


def gate():
    return F.try_divide(F.count_if(F.col("v") > 60000), F.count("v"))


def gate_stage(pix):
    return pix.groupBy(*TILE).agg(gate().alias("gate_prob"))


def segment(pix):
    return pix.withColumn("seg", S.clip((F.log10("v") - 3) / 2.5, 0.0, 1.0))


def scan(spark, sf, stage=None):
    """The granule plan; the gate as an aggregate (default) or as a separate stage with a separate mask table."""
    d = V.px(spark, sf)
    g, m = (stage, d) if stage is not None else (gate(), "cls")
    return CA.scan_granule(d, px_headers(spark, sf), V.TS, 4, g, segment, 0.55, 0.3, mask=m, min_grounded=0.1)


_SCAN = """, bd AS (SELECT granule_id, min(r // 4) * 4 AS r0, least((max(r // 4) + 1) * 4, 96) AS r1, min(c // 4) * 4 AS c0, least((max(c // 4) + 1) * 4, 96) AS c1
      FROM px WHERE v > 0 AND r % 4 = 2 AND c % 4 = 2 GROUP BY 1),
    pa AS (SELECT px.*, ((r - r0) // 16) * 16 + r0 AS "row", ((c - c0) // 16) * 16 + c0 AS col FROM px JOIN bd USING (granule_id) WHERE r >= r0 AND c >= c0),
    q0 AS (SELECT *, unnest(range(r0, r1, 16)) AS "row" FROM bd), q1 AS (SELECT *, unnest(range(c0, c1, 16)) AS col FROM q0),
    gn AS (SELECT granule_id, "row", col, count(*) AS n FROM pa WHERE cls = 1 GROUP BY 1, 2, 3),
    cn AS (SELECT granule_id, "row", col FROM q1 LEFT JOIN gn USING (granule_id, "row", col) WHERE coalesce(n, 0) / (least(16, 96 - "row") * least(16, 96 - col)) >= 0.1),
    sp AS (SELECT pa.* FROM pa SEMI JOIN cn USING (granule_id, "row", col)),
    st AS (SELECT granule_id, "row", col, count(v) / 256.0 AS vf, count(*) FILTER (v > 60000) / CAST(count(v) AS DOUBLE) AS p FROM sp GROUP BY 1, 2, 3 HAVING count(v) / 256.0 >= 0.3),
    sg AS (SELECT sp.granule_id, sp."row", sp.col, r, c, CASE WHEN v IS NOT NULL THEN least(1.0, greatest(0.0, (log10(v) - 3) / 2.5)) END AS seg FROM sp JOIN st USING (granule_id, "row", col) WHERE p >= 0.55)"""


@query("m06_scan_granule", _SCAN + """, sm AS (SELECT granule_id, "row", col, avg(seg) AS m FROM sg GROUP BY 1, 2, 3)
    SELECT granule_id, CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, round(vf, 6) AS valid_frac, round(p, 6) AS gate_prob, p >= 0.55 AS gate_flag, round(m, 6) AS seg_mean
    FROM st LEFT JOIN sm USING (granule_id, "row", col)""", "px")
def scanned_tiles(spark, sf):
    t, _, _ = scan(spark, sf)
    return t.select("granule_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"),
                    *[F.round(c, 6).alias(c) for c in ("valid_frac", "gate_prob", "seg_mean")], "gate_flag")


@query("m06_funnel", _SCAN + """, c AS (SELECT granule_id, count(*) AS candidates FROM cn GROUP BY 1),
    f AS (SELECT granule_id, count(*) AS valid, count(p) AS scored, count(*) FILTER (p >= 0.55) AS flagged FROM st GROUP BY 1)
    SELECT granule_id, candidates, coalesce(valid, 0) AS valid, coalesce(scored, 0) AS scored, coalesce(flagged, 0) AS flagged FROM c LEFT JOIN f USING (granule_id)""", "px")
def _(spark, sf):
    return scan(spark, sf, gate_stage)[2]


@query("m07_export_rasters", _SCAN + """, h AS (SELECT DISTINCT granule_id FROM px), a AS (SELECT granule_id, unnest(range(0, 96)) AS r FROM h), g AS (SELECT *, unnest(range(0, 96)) AS c FROM a),
    fp AS (SELECT granule_id, r, c, p FROM g JOIN st USING (granule_id) WHERE r >= "row" AND r < "row" + 16 AND c >= col AND c < col + 16)
    SELECT granule_id, CAST(g.r AS INTEGER) AS r, CAST(g.c AS INTEGER) AS c, round(p, 6) AS gate_prob, round(seg, 6) AS seg FROM g LEFT JOIN fp USING (granule_id, r, c) LEFT JOIN sg USING (granule_id, r, c)""", "px")
def _(spark, sf):
    t, s, _ = scan(spark, sf)
    d = CA.export_rasters(px_headers(spark, sf), t, s, V.TS, 32)
    return d.select("granule_id", "r", "c", F.round("gate_prob", 6).alias("gate_prob"), F.round("seg", 6).alias("seg"))


# The same scan where every cut rejects tiles.
_CUTS = _SCAN.replace("FROM px", "FROM scene").replace("px.*", "scene.*")


def stored_scene(spark, sf):
    """The scene in a blocked layout: later passes read only the blocks under the tiles that are left."""
    path = scratch_path(spark, "scene")
    write_pixels(V.scene(spark, sf), path, block=32)
    return spark.read.parquet(path)


def scan_cuts(spark, sf, d=None):
    d = stored_scene(spark, sf) if d is None else d
    return CA.scan_granule(d, px_headers(spark, sf), V.TS, 4, gate(), segment, 0.55, 0.3, mask="cls", min_grounded=0.1, block=32)


@query("m06_scan_cuts", _CUTS + """, sm AS (SELECT granule_id, "row", col, avg(seg) AS m FROM sg GROUP BY 1, 2, 3)
    SELECT granule_id, CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, round(vf, 6) AS valid_frac, round(p, 6) AS gate_prob, p >= 0.55 AS gate_flag, round(m, 6) AS seg_mean
    FROM st LEFT JOIN sm USING (granule_id, "row", col)""", "scene")
def _(spark, sf):
    t = scan_cuts(spark, sf)[0]
    return t.select("granule_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"),
                    *[F.round(c, 6).alias(c) for c in ("valid_frac", "gate_prob", "seg_mean")], "gate_flag")


@query("m06_funnel_cuts", _CUTS + """, t AS (SELECT granule_id, count(*) AS tiles FROM q1 GROUP BY 1), c AS (SELECT granule_id, count(*) AS candidates FROM cn GROUP BY 1),
    f AS (SELECT granule_id, count(*) AS valid, count(p) AS scored, count(*) FILTER (p >= 0.55) AS flagged FROM st GROUP BY 1)
    SELECT granule_id, tiles, candidates, coalesce(valid, 0) AS valid, coalesce(scored, 0) AS scored, coalesce(flagged, 0) AS flagged FROM t JOIN c USING (granule_id) LEFT JOIN f USING (granule_id)""", "scene")
def _(spark, sf):
    d = stored_scene(spark, sf)
    all_tiles = swath_tiles(data_bounds(d, px_headers(spark, sf), 4), V.TS).groupBy("granule_id").agg(F.count(F.lit(1)).alias("tiles"))
    return all_tiles.join(scan_cuts(spark, sf, d)[2], "granule_id")


def relative(pix):
    """A segmenter that looks at whole reads: the share of the read's peak."""
    return pix.withColumn("seg", F.try_divide("v", F.max("v").over(Window.partitionBy(*TILE))))


@query("m07_overlapped_export", _CUTS + """, bx AS (SELECT granule_id, min("row") AS y0, least(max("row") + 16, 96) AS y1, min(col) AS x0, least(max(col) + 16, 96) AS x1 FROM cn GROUP BY 1),
    ra AS (SELECT *, unnest(range(y0, y1, 10)) AS "row" FROM bx), rd AS (SELECT granule_id, "row", unnest(range(x0, x1, 10)) AS col FROM ra),
    rs AS (SELECT granule_id, "row", col, count(*) FILTER (v > 60000) / CAST(count(v) AS DOUBLE) AS p, max(v) AS peak FROM rd JOIN scene USING (granule_id)
      WHERE r >= "row" AND r < "row" + 16 AND c >= col AND c < col + 16 GROUP BY 1, 2, 3 HAVING count(v) / 256.0 >= 0.3),
    h AS (SELECT DISTINCT granule_id FROM px), a AS (SELECT granule_id, unnest(range(0, 96)) AS r FROM h), g AS (SELECT *, unnest(range(0, 96)) AS c FROM a),
    k AS (SELECT g.*, y0 + 10 * least(greatest((r - y0 - 3) // 10, 0), (y1 - y0 + 9) // 10 - 1) AS y, x0 + 10 * least(greatest((c - x0 - 3) // 10, 0), (x1 - x0 + 9) // 10 - 1) AS x, y0, x0 FROM g LEFT JOIN bx USING (granule_id)),
    o AS (SELECT granule_id, r, c, CASE WHEN r >= y0 AND r < y + 16 THEN y END AS "row", CASE WHEN c >= x0 AND c < x + 16 THEN x END AS col FROM k)
    SELECT granule_id, CAST(o.r AS INTEGER) AS r, CAST(o.c AS INTEGER) AS c, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, round(p, 6) AS gate_prob, CASE WHEN p >= 0.55 THEN round(v / peak, 6) END AS seg
    FROM o LEFT JOIN rs USING (granule_id, "row", col) LEFT JOIN scene USING (granule_id, r, c)""", "scene")
def _(spark, sf):
    d = CA.export_granule(stored_scene(spark, sf), px_headers(spark, sf), V.TS, 4, gate(), relative, 0.55, margin=3, grid_block=32,
                          min_valid=0.3, mask="cls", min_grounded=0.1, block=32)
    return d.select("granule_id", "r", "c", "row", "col", F.round("gate_prob", 6).alias("gate_prob"), F.round("seg", 6).alias("seg"))


@query("m07_stitched_reads", """, h AS (SELECT DISTINCT granule_id FROM px), a AS (SELECT granule_id, unnest(range(0, 90, 10)) AS "row" FROM h),
    b AS (SELECT *, unnest(range(0, 90, 10)) AS col FROM a),
    rd AS (SELECT *, CASE WHEN "row" = 0 THEN 0 ELSE 3 END AS t, CASE WHEN col = 0 THEN 0 ELSE 3 END AS l,
      CASE WHEN "row" + 10 >= 90 THEN least(16, 96 - "row") ELSE 13 END AS bt, CASE WHEN col + 10 >= 90 THEN least(16, 96 - col) ELSE 13 END AS rt FROM b),
    mx AS (SELECT granule_id, "row", col, t, l, bt, rt, max(v) AS top FROM rd JOIN px USING (granule_id) WHERE r >= "row" AND r < "row" + 16 AND c >= col AND c < col + 16 GROUP BY ALL)
    SELECT granule_id, r, c, mx."row", mx.col, top - v AS seg FROM px JOIN mx USING (granule_id) WHERE r >= mx."row" + t AND r < mx."row" + bt AND c >= mx.col + l AND c < mx.col + rt""".replace(
    "GROUP BY ALL", 'GROUP BY granule_id, "row", col, t, l, bt, rt'), "px")
def _(spark, sf):
    h, d = px_headers(spark, sf), V.px(spark, sf)
    pos = h.select("granule_id", F.explode(F.array(F.lit(0), F.lit(74))).alias("row")).withColumn("col", F.col("row"))
    reads = CA.overlapped_reads(pos, h, V.TS, 3)
    p = CA.pixels_of_reads(d.select("granule_id", "r", "c", "v"), reads, V.TS, 3)
    peak = p.groupBy(*TILE).agg(F.max("v").alias("peak"))
    s = p.join(peak, TILE).withColumn("seg", F.col("peak") - F.col("v"))
    o = CA.stitch(reads, s)
    return o.select("granule_id", "r", "c", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "seg")


@query("m08_side_by_side", """SELECT vec_id, round(p_a, 6) AS p_rf, p_a >= 0.5 AS flag_rf, round(p_b, 6) AS p_cnn, p_b >= 0.6 AS flag_cnn FROM feat""", "feat")
def _(spark, sf):
    d = MD.score_side_by_side(V.feat(spark, sf), {"rf": lambda x: x.withColumn("p_rf", F.col("p_a")), "cnn": lambda x: x.withColumn("p_cnn", F.col("p_b"))},
                              {"rf": 0.5, "cnn": 0.6})
    return d.select("vec_id", F.round("p_rf", 6).alias("p_rf"), "flag_rf", F.round("p_cnn", 6).alias("p_cnn"), "flag_cnn")


@query("m09_whole_scene", "SELECT vec_id, round(p_a, 6) AS p_full, CASE WHEN label <> 9 THEN round(p_b, 6) END AS p_oof FROM feat", "feat")
def _(spark, sf):
    f = V.feat(spark, sf)
    d = MD.whole_scene(f.select("vec_id"), f.select("vec_id", F.col("p_a").alias("p")), f.where("label <> 9").select("vec_id", F.col("p_b").alias("p")), ["vec_id"])
    return d.select("vec_id", F.round("p_full", 6).alias("p_full"), F.round("p_oof", 6).alias("p_oof"))


@query("m10_new_granules", REPORT + """, vd AS (SELECT granule_id, count(*) FILTER (status = 'fail') = 0 AS accepted FROM o GROUP BY 1)""" + RADIOMETRIC + """,
    cp AS (SELECT granule_id, (r // 16) * 16 AS "row", (c // 16) * 16 AS col, count(DISTINCT 100 * (r // 2) + c // 2) AS n_chips FROM pols GROUP BY 1, 2, 3),
    sc AS (SELECT *, CASE WHEN accepted AND ok THEN least(1.0, greatest(0.0, ratio_logstd)) END AS p FROM x1 JOIN vd USING (granule_id))
    SELECT granule_id, "row", col, accepted, round(p, 6) AS p_rule, p >= 0.4 AS flag_rule, CASE WHEN accepted THEN n_chips END AS n_chips
    FROM sc JOIN cp USING (granule_id, "row", col)""", "pt pols")
def _(spark, sf):
    """Granules N* fail the alignment check of the report; their tiles stay, unscored."""
    bands = ["hh", "hv", "vh", "vv"]
    d = CA.score_new_granules(with_tile(V.pols(spark, sf), V.TS), granule_report(spark, sf), lambda w: X.radiometric_features(w, V.TS),
                              {"rule": lambda x: x.withColumn("p_rule", S.clip(F.col("ratio_logstd"), 0.0, 1.0))}, {"rule": 0.4}, strict=False,
                              chips=lambda w: X.chips(w, V.TS, 2, bands).withColumnRenamed("n", "n_chips"))
    return d.select("granule_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "accepted", F.round("p_rule", 6).alias("p_rule"), "flag_rule", F.col("n_chips").cast("long").alias("n_chips"))


@query("e15_block_buffer_sweep")
def _(spark, sf):
    d = train(spark, sf)
    return MD.block_buffer_sweep(d, FEATURES, [13 * 2560.0], [0.0, 5120.0], numTrees=5, maxDepth=3)


def ab_pairs(spark, sf):
    a, b = two_granules(spark, sf)
    m = match_ground(a, b, "x_m", "y_m", "y")
    return m.withColumn("y", (F.col("e0_a") > 0).cast("int")).withColumn("fold", F.col("ky") % 2)


@query("e16_matched_ab")
def _(spark, sf):
    return MD.matched_ab(ab_pairs(spark, sf), ["e0", "e1", "e2"], "fold", numTrees=5, maxDepth=3, min_train=1)


def blend(a, b):
    return lambda d: d.withColumn("oof", a * F.col("e0") + b * F.col("e1"))


def acceptance_chains(spark, sf):
    """Four new granules against a known one: all steps pass; no overlap and a failed A/B; an oriented scene; no labels."""
    z = stored(X.dominant_orientation(image(spark, sf), "a", V.TS), "orientations")
    of = lambda letter: z.where(F.col("granule_id").startswith(letter))
    h, p = box_pairs(spark, sf)
    boxes = stored(common_box(V.px(spark, sf).withColumn("v", F.log10("v")), h, p, 64), "boxes")
    tiles, pairs = stored(speckle_tiles(spark, sf), "speckle-tiles"), stored(ab_pairs(spark, sf).drop("agree"), "pairs")
    common = {"metrics": ["enl", "rho_row"], "features": ["e0", "e1"], "fold": "fold", "min_shared": 20, "reach": 1}
    fair = pairs.withColumns({"e0_b": F.col("e0_a"), "e1_b": F.col("e1_a") + F.col("e1_b") / 2})
    chains = [("R like A", AC.accept_against(spark, "R", "A", of("R"), boxes, tiles, fair, score=blend(1.0, 0.1), **common)),
              ("N unlike A", AC.accept_against(spark, "N", "A", of("N"), None, tiles, pairs, score=blend(1.0, 0.0), **common)),
              ("R oriented", AC.accept_against(spark, "R", "A", of("R"), boxes, tiles, fair, max_R=0.0, **common)),
              ("A unlabelled", AC.accept_against(spark, "A", "R", of("A"), boxes, None, pairs.limit(5), **common))]
    return reduce(DataFrame.unionByName, [c.withColumn("granule", F.lit(n)) for n, c in chains])


def _registration(who: str) -> str:
    return f"""SELECT '{who}' AS granule, 2 AS position, 'registration' AS step, n AS name, CASE WHEN n = 'peak' THEN 'info' WHEN abs(x) <= 1 THEN 'ok' ELSE 'fail' END AS status, x AS measured
      FROM (SELECT unnest(['dy', 'dx', 'peak']) AS n, unnest([dy, dx, peak]) AS x FROM rg) WHERE EXISTS (SELECT 1 FROM bx)"""


def _orientation(who: str, letter: str, most: float) -> str:
    return f"""SELECT '{who}' AS granule, 1 AS position, 'orientation' AS step, 'scene R' AS name, CASE WHEN x <= {most} THEN 'ok' ELSE 'fail' END AS status, x AS measured FROM (SELECT sqrt(pow(avg(ux), 2) + pow(avg(uy), 2)) AS x FROM un WHERE l = '{letter}')
    UNION ALL SELECT '{who}', 1, 'orientation', 'highest region R', 'info', (SELECT max(x) FROM og WHERE l = '{letter}')"""


def _speckle(who: str, new: str, known: str) -> str:
    return f"""SELECT '{who}' AS granule, 3 AS position, 'speckle' AS step, metric || ' ratio' AS name, CASE WHEN x BETWEEN 0.67 AND 1.5 THEN 'ok' ELSE 'warn' END AS status, x AS measured
      FROM (SELECT metric, quantile_cont(x, 0.5) FILTER (src = '{new}') / nullif(quantile_cont(x, 0.5) FILTER (src = '{known}'), 0) AS x
        FROM ml WHERE src IN ('{new}', '{known}') AND (k, "row", col) IN (SELECT (k, "row", col) FROM m WHERE src = '{new}') AND (k, "row", col) IN (SELECT (k, "row", col) FROM m WHERE src = '{known}') GROUP BY 1)"""


def _matched(who: str, control: str, test: str) -> str:
    one = lambda x: f"(SELECT {_AUC} FROM (SELECT y, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rk FROM mp))"
    return f"""SELECT '{who}' AS granule, 4 AS position, 'matched A/B' AS step, n AS name, CASE WHEN x >= b THEN 'ok' ELSE 'fail' END AS status, x AS measured
      FROM (SELECT unnest(['control AUC', 'test minus control']) AS n, unnest([u, v - u]) AS x, unnest([0.85, -0.10]) AS b FROM (SELECT {one(control)} AS u, {one(test)} AS v))"""


@query("v06_four_step_acceptance", _ORI.replace("un AS (SELECT *,", "un AS (SELECT *, left(granule_id, 1) AS l,") + X15_RANKED + SPECKLE_METRICS + _AB.replace(", a AS", ", fa AS").replace(" b AS", " fb AS") + f""",
    qe AS (SELECT l, k, quantile_cont("row", [0, 1.0 / 3, 2.0 / 3, 1])[k + 1] AS rlo, quantile_cont("row", [0, 1.0 / 3, 2.0 / 3, 1])[k + 2] AS rhi,
      quantile_cont(col, [0, 1.0 / 3, 2.0 / 3, 1])[k + 1] AS clo, quantile_cont(col, [0, 1.0 / 3, 2.0 / 3, 1])[k + 2] AS chi FROM un CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1, 2),
    og AS (SELECT l, sqrt(pow(avg(ux), 2) + pow(avg(uy), 2)) AS x FROM un JOIN qe a USING (l) JOIN qe b USING (l) WHERE "row" BETWEEN a.rlo AND a.rhi AND col BETWEEN b.clo AND b.chi GROUP BY l, a.k, b.k HAVING count(*) >= 5),
    s1 AS (SELECT * FROM rk1 WHERE rn = 1), rg AS (SELECT median(dy)::DOUBLE AS dy, median(dx)::DOUBLE AS dx, median(peak) AS peak FROM s1 WHERE peak >= (SELECT median(peak) FROM s1)),
    ml AS (SELECT src, k, "row", col, 'enl' AS metric, enl AS x FROM m UNION ALL SELECT src, k, "row", col, 'rho_row', rho_row FROM m),
    mp AS (SELECT CAST(a.e0 > 0 AS INTEGER) AS y, a.e0 AS a0, a.e1 AS a1, b.e0 AS b0, b.e1 AS b1 FROM fa a JOIN fb b USING (kx, ky)),
    ft AS ({_orientation("R like A", "R", 0.7)} UNION ALL {_registration("R like A")} UNION ALL {_speckle("R like A", "R", "A")} UNION ALL {_matched("R like A", "a0 + 0.1 * a1", "a0 + 0.1 * (a1 + b1 / 2)")}
      UNION ALL {_orientation("N unlike A", "N", 0.7)} UNION ALL {_speckle("N unlike A", "N", "A")} UNION ALL {_matched("N unlike A", "a0", "b0")}
      UNION ALL {_orientation("R oriented", "R", 0.0)} UNION ALL {_orientation("A unlabelled", "A", 0.7)} UNION ALL {_registration("A unlabelled")}),
    sk AS (SELECT * FROM (VALUES ('N unlike A', 2, 'registration', 'lacks boxes'), ('R oriented', 2, 'registration', 'after orientation'), ('R oriented', 3, 'speckle', 'after orientation'),
      ('R oriented', 4, 'matched A/B', 'after orientation'), ('A unlabelled', 3, 'speckle', 'lacks matched'), ('A unlabelled', 4, 'matched A/B', 'lacks pairs')) t(granule, position, step, reason)
      UNION ALL SELECT unnest(['R like A', 'A unlabelled']), 2, 'registration', 'lacks boxes' WHERE NOT EXISTS (SELECT 1 FROM bx))
    SELECT granule, position, step, CASE WHEN max(CAST(status = 'fail' AS INTEGER)) OVER (PARTITION BY granule, position) = 1 THEN 'FAIL' ELSE 'PASS' END AS verdict, NULL AS reason, name, status, round(measured, 6) AS measured FROM ft
    UNION ALL SELECT granule, position, step, 'SKIPPED', reason, NULL, NULL, NULL FROM sk""", "px feat")
def _(spark, sf):
    d = acceptance_chains(spark, sf)
    return d.select("granule", "position", "step", "verdict", "reason", "name", "status", F.round("measured", 6).alias("measured"))


@query("z01_pluggable_stage", "SELECT vec_id, round(p_a, 6) AS gate_prob, p_a >= 0.5 AS gate_flag, CASE WHEN p_a >= 0.5 THEN round(e0 * e0 + e1 * e1, 6) END AS seg FROM feat", "feat")
def _(spark, sf):
    @F.pandas_udf("double")
    def energy(a: pd.Series, b: pd.Series) -> pd.Series:
        return a * a + b * b
    d = CA.cascade(V.feat(spark, sf), F.col("p_a"), lambda t: t.withColumn("seg", energy("e0", "e1")), 0.5, key=["vec_id"])
    return d.select("vec_id", F.round("gate_prob", 6).alias("gate_prob"), "gate_flag", F.round("seg", 6).alias("seg"))


@query("z02_footprint_argument", """, r0 AS (SELECT granule_id, unnest(range(0, 90, 16)) AS "row" FROM (SELECT DISTINCT granule_id FROM px)), gt AS (SELECT granule_id, "row", unnest(range(0, 90, 16)) AS col FROM r0),
    n AS (SELECT granule_id, "row", col, count(*) FILTER (cls = 1) AS n FROM pt GROUP BY 1, 2, 3)
    SELECT granule_id, "row", col, round(coalesce(n, 0) / (CAST(least(16, 90 - "row") AS DOUBLE) * least(16, 90 - col)), 6) AS grounded_frac FROM gt LEFT JOIN n USING (granule_id, "row", col)""", "pt")
def _(spark, sf):
    h = px_headers(spark, sf).withColumn("height", F.lit(90)).withColumn("width", F.lit(90))
    t = clip_footprint(tile_grid(h, V.TS), V.TS)
    d = FL.grounded_fraction(t, V.px(spark, sf), V.TS, h=F.col("h"), w=F.col("w"))
    return d.select("granule_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.round("grounded_frac", 6).alias("grounded_frac"))


@query("z03_native_reducers", """SELECT label, round(pow(avg(vel) / stddev_pop(vel), 2), 6) AS enl, round(sqrt(pow(sum(p_a * cos(2 * e0)), 2) + pow(sum(p_a * sin(2 * e0)), 2)) / (sum(p_a) + 1e-9), 6) AS resultant
    FROM feat GROUP BY 1""", "feat")
def _(spark, sf):
    d = V.feat(spark, sf).withColumn("a2", 2 * F.col("e0"))
    return d.groupBy("label").agg(F.round(looks("vel"), 6).alias("enl"), F.round(resultant("p_a", "a2"), 6).alias("resultant"))


@query("z04_expanders", """, t AS (SELECT granule_id, "row", col FROM pt GROUP BY 1, 2, 3 HAVING count(v) > 150), a AS (SELECT *, unnest(range("row", "row" + 16)) AS r FROM t)
    SELECT granule_id, CAST(r AS INTEGER) AS r, CAST(unnest(range(col, col + 16)) AS INTEGER) AS c FROM a""", "pt")
def _(spark, sf):
    from gridscan.operators.grid import expand
    t = with_tile(V.px(spark, sf), V.TS).groupBy(*TILE).agg(F.count("v").alias("n")).where("n > 150")
    return expand(t, V.TS).select("granule_id", "r", "c")
