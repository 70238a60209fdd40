"""Deterministic relations over the benchmark tables: a sparse multi-granule raster, labelled tiles, ...

Each view exists twice, as a DataFrame and as a SQL CTE for the oracle; both grow with the input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TS = 16          # tile edge of the test raster, px
EDGE = 96        # raster edge of one test granule, px
GRID = EDGE // TS


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def granule_key():
    return F.concat("l_returnflag", "l_linestatus", F.lit("_"),
                    F.lpad(F.floor(F.col("l_partkey") / 2000).cast("string"), 4, "0"))


def px(spark, sf) -> DataFrame:
    """Pixels of one granule per (return flag, line status, block of 2000 parts); discount <= .01 is nodata."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(
        granule_key().alias("granule_id"),
        (F.col("l_partkey") % EDGE).cast("int").alias("r"),
        (F.col("l_suppkey") % EDGE).cast("int").alias("c"),
    ).agg(
        F.max(F.when(F.col("l_discount") > 0.01, F.col("l_extendedprice"))).alias("v"),
        F.max("l_quantity").alias("v2"),
        F.max(F.when(F.col("l_tax") >= 0.06, 1).otherwise(0)).alias("cls"),
    )


def scene(spark, sf) -> DataFrame:
    """`px` with tiles that are nearly void and tiles without grounded ice, so that every cut of a scan rejects some."""
    a, b = F.floor(F.col("r") / TS), F.floor(F.col("c") / TS)
    void = ((a + 2 * b) % 5 == 1) & ((F.col("r") + F.col("c")) % 6 != 0)
    return px(spark, sf).select("granule_id", "r", "c", F.when(~void, F.col("v")).alias("v"), F.when((2 * a + b) % 5 == 4, 0).otherwise(F.col("cls")).alias("cls"))


def pols(spark, sf) -> DataFrame:
    """The same grid with four bands, linear intensity; a band is NULL where it has no sample."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(
        granule_key().alias("granule_id"),
        (F.col("l_partkey") % EDGE).cast("int").alias("r"),
        (F.col("l_suppkey") % EDGE).cast("int").alias("c"),
    ).agg(
        F.max(F.when(F.col("l_discount") > 0.01, F.col("l_extendedprice"))).alias("hh"),
        F.max(F.when(F.col("l_tax") > 0.0, F.col("l_quantity"))).alias("hv"),
        F.max(F.when(F.col("l_tax") > 0.0, F.col("l_quantity") * (1 + F.col("l_tax")))).alias("vh"),
        F.max(F.when(F.col("l_discount") > 0.01, F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("vv"),
    )


def ctx(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    return p.groupBy(
        (F.floor(F.col("p_partkey") / 6) % 6).cast("int").alias("gi"),
        (F.col("p_partkey") % 6).cast("int").alias("gj"),
    ).agg((F.sum("p_size") % 50).cast("int").alias("vel"), (F.sum("p_size") % 5).cast("int").alias("cls"))


def gran(spark, sf) -> DataFrame:
    """One raster header per supplier."""
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("G"), F.lpad(k.cast("string"), 6, "0")).alias("granule_id"),
        (40 + k % 60).cast("int").alias("height"), (50 + (k * 7) % 40).cast("int").alias("width"),
        F.when(F.col("s_nationkey") % 2 == 0, 2.5).otherwise(5.0).alias("px_m"),
        ((k % 10) * 2560).cast("double").alias("origin_x"),
        (-F.floor(k / 10) * 2560).cast("double").alias("origin_y"),
        F.when(F.col("s_acctbal") > 5000, 1).otherwise(0).alias("y"),
    )


def feat(spark, sf) -> DataFrame:
    """Labelled, scored tiles on a 2560 m map grid, 25 tiles per map row."""
    e, i = table(spark, sf, "embeddings"), F.col("vec_id")

    def el(k):
        return F.col("embedding")[k].cast("double")

    def prob(k, gain):
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + gain * el(k)))

    return e.select(
        "vec_id", F.concat(F.lit("g"), (i % 4).cast("string")).alias("granule_id"),
        F.floor(i / 25).alias("ti"), (i % 25).alias("tj"),
        (F.floor(i / 25) * 512).alias("row"), ((i % 25) * 512).alias("col"),
        ((i % 25) * 2560).cast("double").alias("x_m"), (-F.floor(i / 25) * 2560).cast("double").alias("y_m"),
        F.when(F.col("label") < 5, 1).otherwise(0).alias("y"), "label",
        *[el(k).alias(f"e{k}") for k in range(6)],
        prob(0, 1.2).alias("p_a"),
        F.when(el(2) > -0.15, prob(1, 1.5)).alias("p_b"),
        (F.col("label") != 3).alias("grounded"),
        F.when(el(3) > -0.2, F.abs(el(3)) * 4000).alias("vel"),
    )


def seg(spark, sf) -> DataFrame:
    """Prediction and target per pixel; tile = supplier."""
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("tile"), F.col("l_partkey").alias("pix")
    ).agg(F.max(F.col("l_discount") * 10).alias("prob"), F.max(F.col("l_tax") * 10).alias("target"))


def lab_a(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("lab"))


def lab_b(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").select("doc_id", (1 - F.col("toxic")).alias("lab"))


def arr(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("arrival"), F.col("user_id").alias("tile"),
        F.col("event_type").alias("granule"), "value")


_GID = "concat(l_returnflag, l_linestatus, '_', lpad(CAST(l_partkey // 2000 AS VARCHAR), 4, '0'))"

CTES = {
    "px": f"""px AS (SELECT {_GID} AS granule_id, CAST(l_partkey % 96 AS INTEGER) AS r,
        CAST(l_suppkey % 96 AS INTEGER) AS c, max(CASE WHEN l_discount > 0.01 THEN l_extendedprice END) AS v,
        max(l_quantity) AS v2, max(CASE WHEN l_tax >= 0.06 THEN 1 ELSE 0 END) AS cls
        FROM lineitem GROUP BY 1, 2, 3)""",
    "scene": """scene AS (SELECT granule_id, r, c, CASE WHEN (r // 16 + 2 * (c // 16)) % 5 <> 1 OR (r + c) % 6 = 0 THEN v END AS v,
        CASE WHEN (2 * (r // 16) + c // 16) % 5 = 4 THEN 0 ELSE cls END AS cls FROM px)""",
    "pt": """pt AS (SELECT *, (r // 16) * 16 AS "row", (c // 16) * 16 AS col FROM px)""",
    "pols": f"""pols AS (SELECT {_GID} AS granule_id, CAST(l_partkey % 96 AS INTEGER) AS r,
        CAST(l_suppkey % 96 AS INTEGER) AS c,
        max(CASE WHEN l_discount > 0.01 THEN l_extendedprice END) AS hh,
        max(CASE WHEN l_tax > 0.0 THEN l_quantity END) AS hv,
        max(CASE WHEN l_tax > 0.0 THEN l_quantity * (1 + l_tax) END) AS vh,
        max(CASE WHEN l_discount > 0.01 THEN l_extendedprice * (1 - l_discount) END) AS vv
        FROM lineitem GROUP BY 1, 2, 3)""",
    "ctx": """ctx AS (SELECT CAST((p_partkey // 6) % 6 AS INTEGER) AS gi, CAST(p_partkey % 6 AS INTEGER) AS gj,
        CAST(sum(p_size) % 50 AS INTEGER) AS vel, CAST(sum(p_size) % 5 AS INTEGER) AS cls FROM part GROUP BY 1, 2)""",
    "gran": """gran AS (SELECT concat('G', lpad(CAST(s_suppkey AS VARCHAR), 6, '0')) AS granule_id,
        CAST(40 + s_suppkey % 60 AS INTEGER) AS height, CAST(50 + (s_suppkey * 7) % 40 AS INTEGER) AS width,
        CASE WHEN s_nationkey % 2 = 0 THEN CAST(2.5 AS DOUBLE) ELSE CAST(5.0 AS DOUBLE) END AS px_m,
        CAST((s_suppkey % 10) * 2560 AS DOUBLE) AS origin_x, CAST(-(s_suppkey // 10) * 2560 AS DOUBLE) AS origin_y,
        CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END AS y FROM supplier)""",
    "feat": """feat AS (SELECT vec_id, concat('g', CAST(vec_id % 4 AS VARCHAR)) AS granule_id, vec_id // 25 AS ti,
        vec_id % 25 AS tj, (vec_id // 25) * 512 AS "row", (vec_id % 25) * 512 AS col,
        CAST((vec_id % 25) * 2560 AS DOUBLE) AS x_m, CAST(-(vec_id // 25) * 2560 AS DOUBLE) AS y_m,
        CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, label,
        CAST(embedding[1] AS DOUBLE) AS e0, CAST(embedding[2] AS DOUBLE) AS e1, CAST(embedding[3] AS DOUBLE) AS e2,
        CAST(embedding[4] AS DOUBLE) AS e3, CAST(embedding[5] AS DOUBLE) AS e4, CAST(embedding[6] AS DOUBLE) AS e5,
        least(1.0, greatest(0.0, 0.5 + 1.2 * CAST(embedding[1] AS DOUBLE))) AS p_a,
        CASE WHEN CAST(embedding[3] AS DOUBLE) > -0.15
             THEN least(1.0, greatest(0.0, 0.5 + 1.5 * CAST(embedding[2] AS DOUBLE))) END AS p_b,
        label <> 3 AS grounded,
        CASE WHEN CAST(embedding[4] AS DOUBLE) > -0.2 THEN abs(CAST(embedding[4] AS DOUBLE)) * 4000 END AS vel
        FROM embeddings)""",
    "seg": """seg AS (SELECT l_suppkey AS tile, l_partkey AS pix, max(l_discount * 10) AS prob,
        max(l_tax * 10) AS target FROM lineitem GROUP BY 1, 2)""",
    "lab_a": "lab_a AS (SELECT doc_id, quality AS lab FROM labels)",
    "lab_b": "lab_b AS (SELECT doc_id, 1 - toxic AS lab FROM labels)",
    "arr": """arr AS (SELECT event_id, ts AS arrival, user_id AS tile, event_type AS granule, value FROM events)""",
}
_NEEDS = {"pt": ["px"], "scene": ["px"]}


def with_views(body: str, *views: str, recursive: bool = False) -> str:
    """`WITH <views> <body>`; `body` may start with more CTEs written as `, name AS (...) SELECT ...`."""
    names: list[str] = []
    for v in views:
        for n in [*_NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    if not names:
        return body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(CTES[n] for n in names) + "\n" + body
