"""Reproducible shuffle into shards by a Feistel permutation of global row numbers, in DataFrame functions only.

Rows are numbered by a digest of all their columns, so the numbers depend on the rows alone, not on files or
partitions.  A Feistel network over the product of two nearly equal moduli permutes the numbers; a number that
leaves the range of rows walks its cycle until it is back.  Shard and slot are remainder and quotient of the
permuted number: both can be computed for any row number, and `row_number_at` computes the way back.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from gridscan.llm.common import discard, written

PRIME = (1 << 31) - 1
ROUNDS = 6
#: Digests begin with one of so many prefixes; one task orders the digests of one prefix.
PREFIX = 3
#: A row that stands more often than this is dealt out before its copies are written one by one.
COPIES = 1024


def round_keys(seed: int) -> list[int]:
    return [int(hashlib.sha256(f"{seed}:{r}".encode()).hexdigest()[:7], 16) for r in range(ROUNDS)]


def moduli(n: int) -> tuple[int, int]:
    """Two moduli whose product is n or little more: fewer than sqrt(n) + 1 numbers lie beyond n."""
    a = isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def scrambled(v: int, key: int) -> int:
    t = (v + key) % PRIME
    t = t * t % PRIME
    return (t + key) * t % PRIME


def permuted(x: int, n: int, seed: int) -> int:
    """Place of row number x (from 0) among n; the columns below compute the same."""
    a, b = moduli(n)
    keys = round_keys(seed)
    while True:
        left, right = divmod(x, b)
        for r, key in enumerate(keys):
            if r % 2 == 0:
                left = (left + scrambled(right, key)) % a
            else:
                right = (right + scrambled(left, key)) % b
        x = left * b + right
        if x < n:
            return x


def row_number_at(shard: int, slot: int, n: int, shards: int = 24, seed: int = 0) -> int:
    """The row number (from 0) that stands in a slot of a shard: the rounds backwards, along the same cycle."""
    a, b = moduli(n)
    keys = round_keys(seed)
    x = slot * shards + shard
    if not (0 <= shard < shards and 0 <= slot and x < n):
        raise ValueError(f"no slot {slot} in shard {shard} of {n} rows")
    while True:
        left, right = divmod(x, b)
        for r in reversed(range(ROUNDS)):
            if r % 2 == 0:
                left = (left - scrambled(right, keys[r])) % a
            else:
                right = (right - scrambled(left, keys[r])) % b
        x = left * b + right
        if x < n:
            return x


def _once(numbers: DataFrame, n: int, seed: int) -> DataFrame:
    """One pass of the network over the column `place`."""
    a, b = moduli(n)
    out = numbers.withColumns({"_l": F.expr(f"place div {b}L"), "_r": F.col("place") % F.lit(b)})
    for r, key in enumerate(round_keys(seed)):
        side, other, modulus = ("_l", "_r", a) if r % 2 == 0 else ("_r", "_l", b)
        out = (out.withColumn("_t", (F.col(other) + F.lit(key)) % F.lit(PRIME))
               .withColumn("_t", F.col("_t") * F.col("_t") % F.lit(PRIME))
               .withColumn("_t", (F.col("_t") + F.lit(key)) * F.col("_t") % F.lit(PRIME))
               .withColumn(side, (F.col(side) + F.col("_t")) % F.lit(modulus)))
    return out.withColumn("place", F.col("_l") * F.lit(b) + F.col("_r")).drop("_l", "_r", "_t")


def digest(docs: DataFrame) -> Column:
    """md5 over all columns by name: rows of one digest are alike in every column; null and '' differ."""
    parts = [F.coalesce(F.md5(F.col(f"`{c}`").cast("string").cast("binary")), F.lit("-")) for c in sorted(docs.columns)]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, size (bytes of the text plus 8), text_crc32, digest, copies, number (from 0), law, shard, slot, grown_shard.

    Law `rows`: shards differ by one row at most, slots of a shard run from 0 without a gap.  Nothing but the
    rows, `shards` and `seed` decides.  Null text has no bytes; null ids are numbered like others.  Rows alike
    in all columns are counted before they are dealt, and `copies` tells how many there are; texts of any
    length are read once and never moved.  Columns of any name may stand in `docs`, whatever it is called here;
    an empty table gives an empty one.
    """
    text = F.col(f"`{text_col}`")
    alike = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
                        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), digest(docs).alias("digest"))
    stored = written(alike.groupBy("doc_id", "size", "text_crc32", "digest").agg(F.count(F.lit(1)).alias("copies")), "shard-rows")
    n = stored.agg(F.sum("copies")).first()[0] or 0

    rows = stored.withColumn("_bin", F.substring("digest", 1, PREFIX))
    before = W.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)  # one short row per prefix: 4096 at most
    starts = rows.groupBy("_bin").agg(F.sum("copies").alias("_in")).select("_bin", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("_bin").orderBy("digest").rowsBetween(W.unboundedPreceding, -1)
    first = rows.withColumn("_first", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(starts, "_bin")
    first = first.withColumn("_first", F.col("_first") + F.col("_start")).drop("_bin", "_start")

    step = F.lit(COPIES)
    few = first.where(F.col("copies") <= step)
    many = first.where(F.col("copies") > step)
    many = many.withColumn("_block", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {COPIES}L").cast("long"))))
    many = many.repartition("digest", "_block").withColumn("_from", F.col("_first") + F.col("_block") * step).withColumn("_upto", F.least(F.col("_from") + step, F.col("_first") + F.col("copies")))
    one_by_one = lambda d, a, b: d.withColumn("number", F.explode(F.sequence(a, b - 1)))
    columns = ["doc_id", "size", "text_crc32", "digest", "copies", "number"]
    numbered = one_by_one(few, F.col("_first"), F.col("_first") + F.col("copies")).select(columns).union(one_by_one(many, F.col("_from"), F.col("_upto")).select(columns))

    # Fewer than sqrt(n) + 1 numbers leave the range in the first pass, hardly any in a second one.
    passes, going = [], numbered.withColumn("place", F.col("number"))
    while True:
        done = written(_once(going, n, seed), "shard-places")
        passes.append(done.where(F.col("place") < n))
        going = done.where(F.col("place") >= n)
        if going.isEmpty():
            break
    discard(stored)
    return reduce(DataFrame.union, passes).select(
        *columns, F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}L").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def with_rows(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(shard, slot, row): every row of `docs`, whole, as a struct, with its place; `places` is `shard_rows(docs)`."""
    rows = docs.select(digest(docs).alias("digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    once = places.where("copies = 1").select("digest", "shard", "slot")
    often = places.where("copies > 1").select("digest", "shard", "slot")
    # Of rows alike in all columns one is moved, to every place of theirs; a null is told from '' by the digest.
    samples = rows.join(often.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("row").alias("row"))
    both = rows.join(once, "digest").union(samples.join(often, "digest").select("digest", "row", "shard", "slot"))
    return both.select("shard", "slot", "row")


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 0, rows_per_file: int = 100_000) -> None:
    """Parquet files under `path`, a folder a shard, each file a run of slots in order; a file holds `rows_per_file` rows at most."""
    placed = with_rows(docs, shard_rows(docs, shards, seed))
    run = F.expr(f"slot div {rows_per_file}L")
    (placed.repartition("shard", run).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path))
