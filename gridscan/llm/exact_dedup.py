"""Exact de-duplication by content-defined chunk recipes.

A text without white space is cut where a rolling hash of its last 16 bytes says so, hence equal stretches
are cut alike wherever they stand.  Distinct chunks get verified identifiers: the 64-bit hash where all
chunks of that hash are equal, the hash and an ordinal where they are not.  Texts are equal when their
ordered identifier lists are; those short lists, not the texts, are grouped and joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from gridscan.llm.common import long_lists, written

SPACE = b" \t\n\x0b\x0c\r"
GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, np.uint32)
LEAST, MOST = 512, 16384
MASK = np.uint32(0x7FE00000)  # ten bits: a cut in 1024 bytes on average, after the least length


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of `data`, the last one being its length; depends on nearby content only."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8):
        g = h.copy()
        g[s:] += h[:-s] << np.uint32(s)
        h = g
    out, last = [], 0
    for c in (np.flatnonzero((h & MASK) == 0) + 1).tolist():
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST:
            last = c
            out.append(c)
    while n - last > MOST:
        last += MOST
        out.append(last)
    return out + [n] if last < n else out


def normal(text: str | None) -> bytes:
    return text.encode().translate(None, SPACE) if text else b""


def _chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _hashes(parts: list[bytes], bits: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(p) for p in parts), np.uint64, len(parts)) >> np.uint64(64 - bits)


def _recipe_batches(bits: int):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(1).to_pylist()
                data = [normal(t) for t in texts]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array([len(t or "") for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string()),
                    long_lists([_hashes(_chunks(d), bits) for d in data]),
                ], names=["_id", "_content", "n_chars", "text_sha256", "recipe"])

    return body


def _chunk_batches(bits: int, places: bool):
    """(hash, chunk), with the text's digest and the place in it where asked for; at most 4 MB a batch."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        arrays = [pa.array(np.array(cols[0], np.uint64).view(np.int64)), pa.array(cols[1], pa.binary())]
        names = ["hash", "chunk"]
        if places:
            arrays += [pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())]
            names += ["text_sha256", "place"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.slice(at, 256).column(0).to_pylist():
                    data = normal(text)
                    parts = _chunks(data)
                    sha = hashlib.sha256(data).hexdigest() if places else ""
                    rows += [(int(h), p, sha, k) for k, (h, p) in enumerate(zip(_hashes(parts, bits), parts))]
                    held += len(data)
                    if held > 4_000_000:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return body


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256 (of the text without white
    space), n_chars and `_content` (names the row for `rows_of`).

    Of equal texts the row with most code points, then the smallest id stays (a null id last; of rows alike
    in both, one).  Null text counts as empty, and all empty texts are equal.  Other columns of `docs` are
    not read, so their names may clash; an empty table gives an empty one.
    """
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_content"))
    made = base.mapInArrow(_recipe_batches(hash_bits), "_id long, _content long, n_chars long, text_sha256 string, recipe array<bigint>")
    recipes = written(made.withColumn("row", F.monotonically_increasing_id()), "recipes")

    chunks = base.select("_text").mapInArrow(_chunk_batches(hash_bits, False), "hash long, chunk binary").distinct()
    shared = written(chunks.groupBy("hash").count().where("count > 1").select("hash"), "shared-hashes")
    if shared.isEmpty():
        named = recipes.withColumn("told_apart", F.lit(""))
    else:
        # Different chunks of one hash: an ordinal by content completes the identifier.
        ordinal = F.row_number().over(W.partitionBy("hash").orderBy("chunk"))
        variants = chunks.join(shared, "hash", "left_semi").withColumn("ordinal", ordinal)
        places = (base.select("_text").mapInArrow(_chunk_batches(hash_bits, True), "hash long, chunk binary, text_sha256 string, place long")
                  .join(shared, "hash", "left_semi").distinct().join(variants, ["hash", "chunk"]))
        fixes = (places.groupBy("text_sha256")
                 .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "ordinal"))), lambda x: F.concat_ws(":", x["place"], x["ordinal"])), ",").alias("told_apart")))
        named = recipes.join(fixes, "text_sha256", "left").withColumn("told_apart", F.coalesce("told_apart", F.lit("")))

    rank = F.struct((-F.col("n_chars")).alias("n"), F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("row").alias("row"))
    groups = named.groupBy("recipe", "told_apart").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("best"))
    return named.join(groups, ["recipe", "told_apart"]).select(
        F.col("_id").alias("doc_id"), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256", "n_chars", "_content")
