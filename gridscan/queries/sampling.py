"""Sampling and top-k."""

from pyspark.sql import functions as F

from gridscan.functions.scalar import confusion_class
from gridscan.functions.stats import iou
from gridscan.operators import sampling as T
from gridscan.operators.grid import tile_grid
from gridscan.queries import views as V
from gridscan.queries.joining import _TP, tile_p
from gridscan.queries.registry import query

_GT = """, r0 AS (SELECT granule_id, height, width, unnest(range(0, height, 16)) AS "row" FROM gran),
    gt AS (SELECT granule_id, "row", unnest(range(0, width, 16)) AS col, height, width FROM r0)"""


def gran_tiles(spark, sf):
    return tile_grid(V.gran(spark, sf), 16).select(
        "granule_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "height", "width")


@query("t01_first_n", _GT + ' SELECT granule_id, "row", col FROM gt ORDER BY "row", col, granule_id LIMIT 50', "gran")
def _(spark, sf):
    return T.first_n(gran_tiles(spark, sf), 50, ["row", "col", "granule_id"]).select("granule_id", "row", "col")


@query("t02_seeded_draw", _GT + """ SELECT granule_id, "row", col FROM gt
    ORDER BY md5(concat('42|', granule_id, '|', "row", '|', col)) LIMIT 300""", "gran")
def _(spark, sf):
    return T.draw(gran_tiles(spark, sf), 300, ["granule_id", "row", "col"], scan_order=["granule_id", "row", "col"]).select("granule_id", "row", "col")


@query("t03_every_kth", _GT + """, n AS (SELECT *, row_number() OVER (PARTITION BY granule_id ORDER BY "row", col) AS rn FROM gt)
    SELECT granule_id, "row", col FROM n WHERE (rn - 1) % 7 = 0""", "gran")
def _(spark, sf):
    return T.every_kth(gran_tiles(spark, sf), 7).select("granule_id", "row", "col")


@query("t04_sample_valid", _GT + """, n AS (SELECT *, row_number() OVER (PARTITION BY granule_id ORDER BY "row", col) AS rn FROM gt),
    v AS (SELECT granule_id, "row", col, row_number() OVER (PARTITION BY granule_id ORDER BY "row", col) AS k FROM n
      WHERE (rn - 1) % 5 = 0 AND height % 4 <> 0 AND ("row" + col) % 3 <> 0),
    c AS (SELECT granule_id, "row", col, md5(concat('42|', granule_id, '|', "row", '|', col)) AS h FROM v WHERE k <= 9),
    f AS (SELECT granule_id, "row", col, md5(concat('42|', granule_id, '|', "row", '|', col)) AS h FROM gt WHERE granule_id NOT IN (SELECT granule_id FROM c)),
    u AS (SELECT *, false AS fallback FROM c UNION ALL SELECT *, true FROM f),
    k AS (SELECT *, row_number() OVER (PARTITION BY granule_id ORDER BY h) AS q FROM u)
    SELECT granule_id, "row", col, fallback FROM k WHERE q <= 3""", "gran")
def _(spark, sf):
    ok = (F.col("height") % 4 != 0) & ((F.col("row") + F.col("col")) % 3 != 0)
    return T.sample_valid(gran_tiles(spark, sf), 3, ok).select("granule_id", "row", "col", "fallback")


@query("t05_spaced_pick", """, cd AS (SELECT granule_id, ti, tj, row_number() OVER (PARTITION BY granule_id ORDER BY md5(concat('42|', granule_id, '|', ti, '|', tj))) AS i FROM feat),
    go AS (SELECT granule_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(ti BIGINT, tj BIGINT)[]) AS taken FROM cd GROUP BY 1
      UNION ALL SELECT go.granule_id, cd.i, CASE WHEN len(list_filter(taken, lambda t: abs(t.ti - cd.ti) < 4 AND abs(t.tj - cd.tj) < 4)) > 0 THEN taken
        ELSE list_append(taken, {'ti': cd.ti, 'tj': cd.tj}) END FROM go JOIN cd ON cd.granule_id = go.granule_id AND cd.i = go.i + 1),
    en AS (SELECT granule_id, arg_max(taken, i) AS taken FROM go GROUP BY 1)
    SELECT granule_id, t.ti AS ti, t.tj AS tj FROM (SELECT granule_id, unnest(taken) AS t FROM en)""", "feat", recursive=True)
def _(spark, sf):
    return T.spaced_pick(V.feat(spark, sf).select("granule_id", "ti", "tj"), 4)


@query("t06_top_hotspots", _TP + ' SELECT granule_id, "row", col, round(p, 6) AS p FROM tp WHERE p IS NOT NULL ORDER BY tp.p DESC, granule_id, "row", col LIMIT 10', "pt")
def _(spark, sf):
    return T.top_k(tile_p(spark, sf), 10, "p", ["granule_id", "row", "col"]).select("granule_id", "row", "col", F.round("p", 6).alias("p"))


@query("t07_per_class", """, k AS (SELECT vec_id, p_a, CASE WHEN y = 1 AND p_a >= 0.5 THEN 'tp' WHEN y = 1 THEN 'fn' WHEN p_a >= 0.5 THEN 'fp' ELSE 'tn' END AS cls FROM feat),
    r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY CASE WHEN cls IN ('tp', 'fp') THEN -p_a ELSE p_a END, vec_id) AS rn FROM k)
    SELECT cls, rn, vec_id FROM r WHERE rn <= 6""", "feat")
def _(spark, sf):
    d = V.feat(spark, sf).withColumn("cls", confusion_class(F.col("y") == 1, F.col("p_a") >= 0.5))
    return T.per_class(d, 6, "cls", "p_a", ["vec_id"]).select("cls", F.col("rn").cast("long").alias("rn"), "vec_id")


@query("t08_spread_thirds", """, t AS (SELECT tile, (count(*) FILTER (prob > 0.5 AND target > 0.4) + 1e-6) /
      (count(*) FILTER (prob > 0.5 OR target > 0.4) + 1e-6) AS iou FROM seg GROUP BY 1),
    r0 AS (SELECT *, row_number() OVER (ORDER BY iou, tile) - 1 AS pos, count(*) OVER () AS n FROM t), r AS (SELECT *, greatest(1, least(12, n) // 3) AS k FROM r0),
    p AS (SELECT tile, round(iou, 6) AS iou, CASE WHEN pos < k THEN 'worst' WHEN pos >= greatest(0, n // 2 - k // 2) AND pos < n // 2 - k // 2 + k THEN 'median' WHEN pos >= n - k THEN 'best' END AS part FROM r)
    SELECT * FROM p WHERE part IS NOT NULL ORDER BY tile LIMIT 12""", "seg")
def _(spark, sf):
    p, t = F.col("prob") > 0.5, F.col("target") > 0.4
    d = V.seg(spark, sf).groupBy("tile").agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    d = d.select("tile", iou("tp", "fp", "fn").alias("iou"))
    return T.spread_thirds(d, "iou", "tile", 12).select("tile", F.round("iou", 6).alias("iou"), "part")


@query("t09_select_flagged", _TP + """, b AS (SELECT 'best' AS how, granule_id, "row", col FROM tp WHERE p >= 0.4 ORDER BY p DESC, granule_id, "row", col LIMIT 8),
    r AS (SELECT 'random' AS how, granule_id, "row", col FROM tp WHERE p >= 0.4 ORDER BY md5(concat('42|', granule_id, '|', "row", '|', col)) LIMIT 8)
    SELECT * FROM b UNION ALL SELECT * FROM r""", "pt")
def _(spark, sf):
    d = tile_p(spark, sf).withColumn("flag", F.coalesce(F.col("p") >= 0.4, F.lit(False)))
    k = ["granule_id", "row", "col"]
    one = [T.select_flagged(d, 8, "flag", h, "p", k).select(F.lit(h).alias("how"), *k) for h in ("best", "random")]
    return one[0].unionByName(one[1])


@query("t10_grounded_draw", _TP + """, g AS (SELECT granule_id, "row", col, count(*) FILTER (cls = 1) / 256.0 AS gf FROM pt GROUP BY 1, 2, 3)
    SELECT granule_id, "row", col FROM tp JOIN g USING (granule_id, "row", col) WHERE gf >= 0.2 AND n >= 130
    ORDER BY md5(concat('7|', granule_id, '|', "row", '|', col)) LIMIT 20""", "pt")
def _(spark, sf):
    from gridscan.operators.filters import grounded_fraction
    g = grounded_fraction(tile_p(spark, sf), V.px(spark, sf), V.TS).where("grounded_frac >= 0.2 AND n >= 130")
    return T.draw(g, 20, ["granule_id", "row", "col"], seed=7).select("granule_id", "row", "col")


@query("t11_positives_first", """SELECT vec_id, CASE WHEN e0 > 0.18 THEN 'hard' ELSE 'core' END AS tier FROM feat WHERE y = 1
    ORDER BY CASE WHEN e0 > 0.18 THEN 0 ELSE 1 END, md5(concat('42|', vec_id)), vec_id LIMIT 60""", "feat")
def _(spark, sf):
    d = V.feat(spark, sf).where("y = 1").withColumn("tier", F.when(F.col("e0") > 0.18, "hard").otherwise("core"))
    return T.positives_first(d, 60, "tier", ["vec_id"]).select("vec_id", "tier")
