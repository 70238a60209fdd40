"""Label sets and splits."""

from pyspark.sql import functions as F

from gridscan.operators import labels as L
from gridscan.operators import splits as SP
from gridscan.operators.aggregates import tile_fractions
from gridscan.operators.grid import tile_grid
from gridscan.queries import views as V
from gridscan.queries.filtering import label_band
from gridscan.queries.grids import px_headers
from gridscan.queries.registry import query


@query("u01_union_labels", """, u AS (SELECT doc_id, lab, 0 AS rk FROM lab_a UNION ALL SELECT doc_id, lab, 1 FROM lab_b WHERE doc_id % 4 <> 0
      UNION ALL SELECT doc_id + 1000000, lab, 1 FROM lab_b)
    SELECT doc_id, min(lab) AS lab, min(rk) AS source_rank FROM u GROUP BY 1 HAVING min(lab) = max(lab)""", "lab_a lab_b")
def _(spark, sf):
    b = V.lab_b(spark, sf)
    b2 = b.where("doc_id % 4 <> 0").unionByName(b.withColumn("doc_id", F.col("doc_id") + 1000000))
    return L.union_labels([V.lab_a(spark, sf), b2], ["doc_id"], "lab").select("doc_id", "lab", "source_rank")


@query("u02_shared_keys", "SELECT doc_id FROM lab_a WHERE lab = 1 INTERSECT SELECT doc_id FROM lab_b WHERE lab = 1", "lab_a lab_b")
def _(spark, sf):
    return L.shared_keys(V.lab_a(spark, sf).where("lab = 1"), V.lab_b(spark, sf).where("lab = 1"), ["doc_id"])


@query("u03_fresh_rows", "SELECT doc_id, lab FROM lab_a WHERE doc_id NOT IN (SELECT doc_id FROM lab_b WHERE lab = 1)", "lab_a lab_b")
def _(spark, sf):
    return L.fresh_rows(V.lab_a(spark, sf), V.lab_b(spark, sf).where("lab = 1"), ["doc_id"])


@query("u04_augmented_copies", """, k AS (SELECT unnest([0, 1, 2]) AS copy)
    SELECT vec_id, round(CASE WHEN copy = 0 THEN e0 ELSE e0 * 4 / (copy + 1) END, 6) AS e0, vec_id % 5 AS fold, copy = 0 AS native, copy FROM feat, k""", "feat")
def _(spark, sf):
    d = V.feat(spark, sf).select("vec_id", F.col("e0"), (F.col("vec_id") % 5).alias("fold"))
    cp = [d.withColumn("e0", F.col("e0") * 4 / (i + 1)) for i in (1, 2)]
    return L.with_augmented(d, cp, "fold").withColumn("e0", F.round("e0", 6))


@query("u05_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return L.duplicate_keys(V.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("w15_first_wins", """SELECT granule, tile, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM arr GROUP BY 1, 2""", "arr")
def _(spark, sf):
    d = V.arr(spark, sf).select("granule", "tile", "event_id", "value")
    return L.first_wins(d, ["granule", "tile"], "event_id")


_GRID = """, gh AS (SELECT DISTINCT granule_id FROM px), ga AS (SELECT granule_id, unnest(range(0, 6)) AS ti FROM gh),
    gg AS (SELECT *, unnest(range(0, 6)) AS tj FROM ga),
    fr AS (SELECT granule_id, r // 16 AS ti, c // 16 AS tj, count(*) FILTER (v > 104000) / 256.0 AS pf, count(v) FILTER (r % 4 = 2 AND c % 4 = 2) / 16.0 AS df FROM px GROUP BY 1, 2, 3),
    g AS (SELECT gg.*, coalesce(pf, 0.0) AS pf, coalesce(df, 0.0) AS df FROM gg LEFT JOIN fr USING (granule_id, ti, tj)),
    ds AS (SELECT a.granule_id, a.ti, a.tj, min(sqrt((a.ti - b.ti) * (a.ti - b.ti) + (a.tj - b.tj) * (a.tj - b.tj))) AS dist FROM g a JOIN g b ON b.granule_id = a.granule_id AND b.pf > 0 GROUP BY 1, 2, 3)"""


@query("l01_derive_labels", _GRID + """, lb AS (SELECT granule_id, ti, tj, pf, dist, CASE WHEN pf > 0.006 OR pf >= 0.003 THEN 'positive' WHEN pf = 0 AND (dist IS NULL OR dist >= 1) AND (dist IS NULL OR dist <= 3) THEN 'none' END AS label,
      CASE WHEN pf > 0 AND pf <= 0.006 AND pf >= 0.003 THEN 'hard' ELSE 'core' END AS tier FROM g LEFT JOIN ds USING (granule_id, ti, tj) WHERE df >= 0.4)
    SELECT granule_id, CAST(ti AS INTEGER) AS ti, CAST(tj AS INTEGER) AS tj, round(pf, 6) AS aoi_pos_frac, label, tier, round(dist * 2.56, 6) AS dist_km FROM lb WHERE label IS NOT NULL""", "px")
def _(spark, sf):
    d = V.px(spark, sf)
    fr = tile_fractions(d.withColumn("cls", (F.col("v") > 104000).cast("int")), d, V.TS, 4)
    g = tile_grid(px_headers(spark, sf), V.TS).select("granule_id", "row", "col").join(fr, ["granule_id", "row", "col"], "left")
    g = g.select("granule_id", (F.col("row") / 16).cast("int").alias("ti"), (F.col("col") / 16).cast("int").alias("tj"),
                 F.coalesce("aoi_pos_frac", F.lit(0.0)).alias("aoi_pos_frac"), F.coalesce("data_frac", F.lit(0.0)).alias("data_frac"))
    o = L.derive_labels(g, "positive", pos=0.006, min_data=0.4, neg_buffer=1, neg_max=3, hard_min=0.003)
    return o.select("granule_id", "ti", "tj", F.round("aoi_pos_frac", 6).alias("aoi_pos_frac"), "label", "tier", F.round("dist_km", 6).alias("dist_km"))


@query("l02_speed_matched", """, f AS (SELECT * FROM feat WHERE vel IS NOT NULL), q AS (SELECT quantile_cont(vel, [0.2, 0.4, 0.6, 0.8]) AS e FROM f),
    b AS (SELECT vec_id, y, len(list_filter(e, lambda x: x <= vel)) AS bin FROM f, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY bin, y ORDER BY md5(concat('42|', vec_id)), vec_id) AS rn FROM b),
    k AS (SELECT bin, least(count(*) FILTER (y = 1), count(*) FILTER (y = 0)) AS k FROM b GROUP BY 1),
    p AS (SELECT vec_id, y, CAST(bin AS INTEGER) AS bin, CASE WHEN rn <= k THEN 'matched' WHEN y = 1 THEN 'spare' END AS part FROM r JOIN k USING (bin))
    SELECT * FROM p WHERE part IS NOT NULL""", "feat")
def _(spark, sf):
    return L.match_by_speed(V.feat(spark, sf), "y", "vel", 5, ["vec_id"]).select("vec_id", "y", "bin", "part")


@query("l03_two_threshold", """SELECT vec_id, CAST(f >= 0.4 AS INTEGER) AS y, label <> 9 AND (f >= 0.4 OR f <= 0.2) AND vel IS NOT NULL AS labelled
    FROM (SELECT *, e3 + 0.3 AS f FROM feat)""", "feat")
def _(spark, sf):
    return L.two_threshold(label_band(spark, sf), "pos_frac", "inbox", 0.4, 0.2, F.col("vel").isNotNull()).select("vec_id", "y", "labelled")


@query("l04_balanced_weights", """, n AS (SELECT y, count(*) AS k FROM feat GROUP BY 1)
    SELECT vec_id, y, round((SELECT count(*) FROM feat) / (2.0 * k), 6) AS weight FROM feat JOIN n USING (y)""", "feat")
def _(spark, sf):
    return L.balanced_weights(V.feat(spark, sf), "y").select("vec_id", "y", F.round("weight", 6).alias("weight"))


@query("l05_spatial_blocks", """SELECT vec_id, ti // 4 AS br, tj // 4 AS bc, CAST(floor(x_m / 20480) AS BIGINT) AS bx, CAST(floor(y_m / 20480) AS BIGINT) AS "by" FROM feat""", "feat")
def _(spark, sf):
    return SP.map_blocks(SP.tile_blocks(V.feat(spark, sf), 4), 20480.0).select("vec_id", "br", "bc", "bx", "by")


@query("l06_random_split", """, r AS (SELECT vec_id, row_number() OVER (ORDER BY md5(concat('42|', vec_id)), vec_id) AS rn, count(*) OVER () AS n FROM feat)
    SELECT vec_id, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'val' END AS part FROM r""", "feat")
def _(spark, sf):
    return SP.random_split(V.feat(spark, sf), 0.8, ["vec_id"]).select("vec_id", "part")


_BAND = """, x AS (SELECT granule_id, max(ti) - min(ti) >= max(tj) - min(tj) AS tall FROM feat GROUP BY 1),
    c AS (SELECT f.*, CASE WHEN tall THEN ti ELSE tj END AS coord FROM feat f JOIN x USING (granule_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY granule_id ORDER BY coord, ti, tj) AS rn, count(*) OVER (PARTITION BY granule_id) AS n FROM c),
    p AS (SELECT *, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'val' END AS part FROM r),
    e AS (SELECT granule_id, min(coord) AS edge FROM p WHERE part = 'val' GROUP BY 1),
    bs AS (SELECT p.* FROM p JOIN e USING (granule_id) WHERE part = 'val' OR coord < edge - 1)"""


@query("l07_band_split", _BAND + " SELECT vec_id, part, coord FROM bs", "feat")
def _(spark, sf):
    return SP.band_split(V.feat(spark, sf), 0.8, 1, ["granule_id"]).select("vec_id", "part", "coord")


@query("l08_block_split", """, f AS (SELECT vec_id, ti, tj, log10(greatest(coalesce(vel, 0.0), 1.0)) AS s, ti // 3 AS br, tj // 3 AS bc FROM feat),
    b AS (SELECT br, bc, count(*) AS n, avg(s) AS s FROM f GROUP BY 1, 2),
    i AS (SELECT *, row_number() OVER (ORDER BY s, br, bc) - 1 AS i, count(*) OVER () AS nb FROM b),
    o AS (SELECT *, CASE WHEN i % 5 = 2 THEN i ELSE i + nb END AS o FROM i),
    c AS (SELECT *, sum(n) OVER (ORDER BY o) - n AS before, sum(n) OVER () AS total FROM o),
    v AS (SELECT br, bc FROM c WHERE before < (1.0 - 0.8) * total),
    vt AS (SELECT f.* FROM f JOIN v USING (br, bc)), tt AS (SELECT f.* FROM f ANTI JOIN v USING (br, bc))
    SELECT vec_id, 'val' AS part FROM vt UNION ALL SELECT vec_id, 'train' FROM tt WHERE NOT EXISTS
      (SELECT 1 FROM vt WHERE abs(vt.ti - tt.ti) <= 1 AND abs(vt.tj - tt.tj) <= 1)""", "feat")
def _(spark, sf):
    d = V.feat(spark, sf).withColumn("s", F.log10(F.greatest(F.coalesce("vel", F.lit(0.0)), F.lit(1.0))))
    return SP.block_split(d, 0.8, "s", 3, 1, seed=42, key=()).select("vec_id", "part")


@query("l09_buffered_split", """, f AS (SELECT vec_id, x_m, y_m, CAST(floor(x_m / 10240) AS BIGINT) AS bx, CAST(floor(y_m / 10240) AS BIGINT) AS bq FROM feat),
    b AS (SELECT bx, bq, count(*) AS n FROM f GROUP BY 1, 2),
    c AS (SELECT *, sum(n) OVER (ORDER BY md5(concat('42|', bx, '|', bq)), bx, bq) - n AS before, sum(n) OVER () AS total FROM b),
    v AS (SELECT bx, bq FROM c WHERE before < round_even(0.2 * total, 0)),
    vt AS (SELECT f.* FROM f JOIN v USING (bx, bq)), tt AS (SELECT f.* FROM f ANTI JOIN v USING (bx, bq))
    SELECT vec_id, 'val' AS part FROM vt UNION ALL SELECT vec_id, 'train' FROM tt WHERE NOT EXISTS (SELECT 1 FROM v WHERE
      x_m BETWEEN v.bx * 10240 - 2560 AND (v.bx + 1) * 10240 + 2560 AND y_m BETWEEN v.bq * 10240 - 2560 AND (v.bq + 1) * 10240 + 2560)""", "feat")
def _(spark, sf):
    return SP.buffered_split(V.feat(spark, sf), 0.2, 10240.0, 2560.0).select("vec_id", "part")


@query("l10_buffered_folds", """, b AS (SELECT CAST(floor(x_m / 12800) AS BIGINT) AS bx, CAST(floor(y_m / 12800) AS BIGINT) AS "by", count(*) AS n_test,
      count(*) FILTER (y = 1) AS test_pos, count(*) FILTER (y = 0) AS test_neg, min(x_m) - 5120 AS x0, max(x_m) + 5120 AS x1, min(y_m) - 5120 AS y0, max(y_m) + 5120 AS y1
      FROM feat GROUP BY 1, 2 HAVING count(*) >= 20 AND count(*) FILTER (y = 1) > 0 AND count(*) FILTER (y = 0) > 0),
    t AS (SELECT b.*, (SELECT count(*) FROM feat f WHERE f.y = 1 AND NOT (x_m BETWEEN x0 AND x1 AND y_m BETWEEN y0 AND y1)) AS train_pos,
      (SELECT count(*) FROM feat f WHERE f.y = 0 AND NOT (x_m BETWEEN x0 AND x1 AND y_m BETWEEN y0 AND y1)) AS train_neg FROM b)
    SELECT * FROM t WHERE train_pos >= 30 AND train_neg >= 30""", "feat")
def _(spark, sf):
    return SP.buffered_folds(V.feat(spark, sf), 12800.0, 5120.0)


@query("l11_leave_one_out", """, n AS (SELECT count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM feat)
    SELECT label, count(*) FILTER (y = 1) AS test_pos, count(*) FILTER (y = 0) AS test_neg, max(p) - count(*) FILTER (y = 1) AS train_pos,
      max(q) - count(*) FILTER (y = 0) AS train_neg, count(*) FILTER (y = 1) > 0 AND count(*) FILTER (y = 0) > 0 AS usable
    FROM (SELECT vec_id, CAST(label // 3 AS INTEGER) AS label, y FROM feat), n GROUP BY 1""", "feat")
def _(spark, sf):
    return SP.leave_one_out(V.feat(spark, sf).withColumn("label", F.floor(F.col("label") / 3).cast("int")), "label")


@query("l12_stratified_folds", """SELECT vec_id, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(concat('42|', vec_id)), vec_id) - 1) % 5 AS INTEGER) AS fold FROM feat""", "feat")
def _(spark, sf):
    return SP.stratified_folds(V.feat(spark, sf), 5, ["vec_id"]).select("vec_id", "fold")


@query("l12_group_folds", """, f AS (SELECT vec_id, y, ti // 4 AS br, tj // 4 AS bc FROM feat), g AS (SELECT br, bc, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS n FROM f GROUP BY 1, 2),
    r AS (SELECT *, (row_number() OVER (ORDER BY p DESC, n DESC, md5(concat('42|', br, '|', bc)), br, bc) - 1) % 10 AS i FROM g)
    SELECT vec_id, CAST(CASE WHEN i < 5 THEN i ELSE 9 - i END AS INTEGER) AS fold FROM f JOIN r USING (br, bc)""", "feat")
def _(spark, sf):
    return SP.group_folds(SP.tile_blocks(V.feat(spark, sf), 4), 5, ["br", "bc"]).select("vec_id", "fold")


@query("l13_check_split", _BAND + """ SELECT granule_id, count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'val') AS n_val,
    min(coord) FILTER (part = 'val') - max(coord) FILTER (part = 'train') AS gap FROM bs GROUP BY 1""", "feat")
def _(spark, sf):
    d = SP.require_both_sides(SP.band_split(V.feat(spark, sf), 0.8, 1, ["granule_id"]))
    return SP.check_split(d, ["granule_id"])
