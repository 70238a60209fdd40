"""Structured Streaming over the events table, drained with availableNow and read back from its sink."""

from pyspark.sql import functions as F

from gridscan.functions.scalar import clip, flag
from gridscan.plans.lineage import scratch_path
from gridscan.queries import views as V
from gridscan.queries.registry import query
from gridscan.streaming import arrivals as ST


def arrivals(spark, sf):
    schema = V.table(spark, sf, "events").schema
    s = ST.read_arrivals(spark, sf, schema, "events.parquet")
    return s.select("event_id", F.col("ts").cast("timestamp").alias("arrival"), F.col("user_id").alias("tile"), F.col("event_type").alias("granule"), "value")


def sink(spark):
    p = scratch_path(spark, "stream")
    return f"{p}/out", f"{p}/checkpoint"


@query("y01_score_stream", """SELECT event_id, granule, tile, round(least(1.0, greatest(0.0, value / 50)), 6) AS gate_prob, least(1.0, greatest(0.0, value / 50)) >= 0.5 AS gate_flag FROM arr""", "arr")
def _(spark, sf):
    def scorer(d):
        p = clip(F.col("value") / 50, 0.0, 1.0)
        return d.select("event_id", "granule", "tile", F.round(p, 6).alias("gate_prob"), flag(p, 0.5).alias("gate_flag"))
    out, ck = sink(spark)
    ST.run(ST.append_to(ST.score_stream(arrivals(spark, sf), scorer), out, ck, ["granule"]))
    return spark.read.parquet(out)


@query("y02_drop_redelivered", "SELECT DISTINCT granule, tile FROM arr", "arr")
def _(spark, sf):
    out, ck = sink(spark)
    ST.run(ST.append_to(ST.drop_redelivered(arrivals(spark, sf), ["granule", "tile"]), out, ck))
    return spark.read.parquet(out).select("granule", "tile")


@query("y03_running_mosaic", """SELECT tile // 10 AS gi, tile % 10 AS gj, round(avg(value), 6) AS mean, count(value) AS passes FROM arr GROUP BY 1, 2""", "arr")
def _(spark, sf):
    out, ck = sink(spark)
    ST.run(ST.updates_to(ST.running_mosaic(arrivals(spark, sf), F.floor(F.col("tile") / 10), F.col("tile") % 10, "value"), out, ck))
    return ST.latest(spark, out, ["gi", "gj"]).withColumn("mean", F.round("mean", 6))


@query("y03_windowed_keep_rate", """SELECT strftime(date_trunc('day', arrival), '%Y-%m-%d') AS day, count(value) AS n, count(*) FILTER (value >= 20) AS kept FROM arr GROUP BY 1""", "arr")
def _(spark, sf):
    out, ck = sink(spark)
    s = ST.windowed_keep_rate(arrivals(spark, sf), "value", 20.0)
    ST.run(ST.updates_to(s.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "kept"), out, ck))
    return ST.latest(spark, out, ["day"])


@query("y03_sliding_keep_rate", """, d AS (SELECT date_trunc('day', arrival) AS d0, value FROM arr), s AS (SELECT unnest([d0, d0 - INTERVAL 1 DAY]) AS w, value FROM d)
    SELECT strftime(w, '%Y-%m-%d') AS day, count(value) AS n, count(*) FILTER (value >= 20) AS kept FROM s GROUP BY 1""", "arr")
def _(spark, sf):
    out, ck = sink(spark)
    s = ST.windowed_keep_rate(arrivals(spark, sf), "value", 20.0, size="2 days", slide="1 day")
    ST.run(ST.updates_to(s.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "kept"), out, ck))
    return ST.latest(spark, out, ["day"])


FILES = 4


def deliveries(spark, sf):
    """The events in four deliveries by time, one micro-batch each; later ones repeat some rows of earlier ones.

    The third delivery repeats a part of the second, the fourth brings the first hour of all once more, much too late.
    """
    d = V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    t0, t1 = F.lit(d.agg(F.min("ts")).first()[0]), F.lit(d.agg(F.max("ts")).first()[0])
    part = F.floor(4 * (F.unix_micros("ts") - F.unix_micros(t0)) / (F.unix_micros(t1) - F.unix_micros(t0) + 1))
    folder = scratch_path(spark, "deliveries")
    again = {2: (part == 1) & (F.col("event_id") % 3 == 0), 3: F.col("ts") < t0 + F.expr("INTERVAL 1 HOUR")}
    for k in range(4):
        sent = d.where(part == k)
        if k in again:
            sent = sent.unionByName(d.where(again[k]))
        sent.repartition(FILES, "event_id").write.mode("append").parquet(folder)
    s = ST.read_arrivals(spark, folder, d.schema, files_per_batch=FILES)
    return s.select("event_id", F.col("ts").alias("arrival"), "value")


@query("y02_late_and_repeated", "SELECT event_id, round(value, 6) AS value FROM arr", "arr")
def _(spark, sf):
    out, ck = sink(spark)
    ST.run(ST.append_to(ST.drop_redelivered(deliveries(spark, sf), ["event_id"], delay="5 days"), out, ck))
    return spark.read.parquet(out).select("event_id", F.round("value", 6).alias("value"))


@query("y03_expired_windows", """, dd AS (SELECT *, date_trunc('day', arrival) AS d FROM arr), m AS (SELECT min(arrival) AS a, max(arrival) AS b FROM arr),
    q AS (SELECT dd.*, floor(4 * (epoch_us(arrival) - epoch_us(a)) / (epoch_us(b) - epoch_us(a) + 1)) AS part FROM dd, m),
    al AS (SELECT d, value FROM dd UNION ALL SELECT d, value FROM q WHERE part = 1 AND event_id % 3 = 0 AND d + INTERVAL 1 DAY > (SELECT date_trunc('millisecond', max(arrival)) - INTERVAL 5 DAY FROM q WHERE part = 0))
    SELECT strftime(d, '%Y-%m-%d') AS day, count(value) AS n, count(*) FILTER (value >= 20) AS kept FROM al, m WHERE d + INTERVAL 1 DAY <= b - INTERVAL 5 DAY GROUP BY 1""", "arr")
def _(spark, sf):
    """Days leave the state, and are written, when the watermark passes their end; rows that come after that are left out.

    Spark tells late rows by the watermark of the batch before: the repeated part of the second delivery is in time,
    the first hour of all is not.
    """
    out, ck = sink(spark)
    s = ST.windowed_keep_rate(deliveries(spark, sf), "value", 20.0, delay="5 days")
    ST.run(ST.append_to(s.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "kept"), out, ck))
    return spark.read.parquet(out)
