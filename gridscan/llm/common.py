"""Helpers shared by the text operators: tables, words, written intermediates, Arrow batches, components."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridscan.plans.lineage import scratch_path

#: A word is a run of anything but space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: later jobs start from files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    release(df.sparkSession)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def laid_out(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Like `written`, in buckets by `keys`: later joins and groupings on them need no shuffle of this table.

    The catalog names the table only while it is written; its files stay until `discard`.
    """
    spark = df.sparkSession
    path, n = scratch_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table_name = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).option("path", path).saveAsTable(table_name)
    release(spark)
    back = spark.table(table_name)
    spark.sql(f"DROP TABLE {table_name}")
    back.written_to = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver collect garbage: only then does Spark delete the shuffle files of jobs that have ended."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def n_words(text: Column) -> Column:
    """Words of a text, counted inside generated code; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: str | None) -> list[bytes]:
    """UTF-8 words; bytes.split() cuts at exactly the six characters that end a word."""
    return text.encode().split() if text else []


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, applied elementwise."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive word hashes, order-sensitive; empty when there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n] * ODD
    for i in range(1, k):
        out = (out + h[i:i + n]) * ODD
    return mix(out + np.uint64(k))


def flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated values and int32 offsets of list parts, for Arrow list arrays without Python lists."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return (np.concatenate(parts) if parts else np.empty(0, np.int64)), offsets


def long_lists(parts: list[np.ndarray]) -> pa.Array:
    """Arrow list<int64> of unsigned or signed 64-bit arrays."""
    values, offsets = flat(parts)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.uint64, copy=False).view(np.int64)))


def text_key(id_col: str, text_col: str) -> list[Column]:
    """Names one row by id and content, so that rows that share an id but not a text keep apart."""
    return [F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_content")]


def rows_of(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `docs` named by (`_id`, `_content`) in `chosen`; columns as in `docs`, null ids match."""
    content = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    c = chosen.select(F.col("_id"), F.col("_content"))
    return docs.join(c, F.col(id_col).eqNullSafe(c["_id"]) & (content == c["_content"]), "left_semi")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node of the undirected `edges` (a, b): component = smallest node reachable.

    Large-star / small-star contraction: every round each node links its larger neighbours to the smallest
    one, then its smaller ones; rounds grow with the logarithm of the longest path.  A star's hub only
    aggregates minima map-side and joins, so a hub of any degree is dealt out.
    """
    links = written(both_ways(edges).distinct(), f"{name}-links")
    while True:
        large = star(links, True, name)
        small = written(star(both_ways(large), False, name).distinct(), f"{name}-links")
        # A forest of stars: every child has one parent, and no parent is a child.
        ends = small.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(small.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty():
            roots = small.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return small.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
        links = both_ways(small)


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.where("a <> b").select("a", "b")
    return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def star(links: DataFrame, larger: bool, name: str) -> DataFrame:
    """Child-to-parent edges: neighbours on one side of each node point at its smallest neighbour, or at itself.

    The minima are written first: then both sides of the join are plain shuffles, of which Spark can split a hub's.
    """
    least = written(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-least")
    side = links.where("b > a") if larger else links.where("b < a")
    out = side.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger:
        out = out.union(least.where("m <> a"))
    return out.where("a <> b")
