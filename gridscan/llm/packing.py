"""Variable-capacity best-fit packing of texts into sequences of several permitted lengths.

Lengths are packed, not texts: (id, first word, number of words).  A text longer than the largest capacity is
cut into pieces of that capacity and a rest.  Pieces are dealt to shards by a hash, enough shards that each
stays small; a shard packs its pieces in descending order: each goes into the open bin that it fills best,
else opens the bin size of least cost per word it can expect to hold.  At the end every bin is downsized to
the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridscan.llm.common import n_words, written

SIZES = (512, 1024, 2048, 4096)
#: Cost of a bin beside its length: what a sequence costs whatever its length.
OVERHEAD = 16
SHARD_PIECES = 4096


def best_fit(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in the bin) of each piece, then (capacity, words used) of each bin; 0 < lengths <= the largest size."""
    sizes = tuple(sorted(sizes))
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    capacity: list[int] = []
    used: list[int] = []
    room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]  # open bins by what is free in them
    free: list[int] = []  # sorted amounts for which there is an open bin
    left = int(lengths.sum())
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        at = bisect_left(free, n)
        if at < len(free):
            gap = free[at]
            b = room[gap].pop()
            if not room[gap]:
                free.pop(at)
        else:
            # What a larger bin can hold more than this piece is bounded by what is still to come.
            b = len(capacity)
            gap = min((s for s in sizes if s >= n), key=lambda s: ((s + overhead) / min(s, left), s))
            capacity.append(gap)
            used.append(0)
        bins[k], offsets[k] = b, used[b]
        used[b] += n
        left -= n
        if gap > n:
            if not room[gap - n]:
                insort(free, gap - n)
            room[gap - n].append(b)
    filled = np.array(used, np.int64)
    return bins, offsets, np.array(sizes, np.int64)[np.searchsorted(sizes, filled)], filled


def pack(lengths: DataFrame, sizes: tuple[int, ...] = SIZES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Packed pieces of rows (doc_id, n_words): bin_id, capacity, used, offset, doc_id, first_word, n_words.

    Every word of every row is in exactly one piece.  Rows with a null or zero length stay in the result as a
    piece without a bin.  A null id is packed like any other and repeated rows are packed each.  An empty
    table gives an empty one.
    """
    most = max(sizes)
    rows = lengths.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("n_words").cast("long"), F.lit(0)).alias("n"))
    pieces = written(rows.select("doc_id", "n", F.explode(F.when(F.col("n") > most, F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(most).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))).alias("first_word"))
                     .select("doc_id", "first_word", F.least(F.col("n") - F.col("first_word"), F.lit(most).cast("long")).alias("n_words"))
                     .withColumn("row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.where("n_words > 0").withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))

    def one_shard(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row")
        bins, offsets, capacity, used = best_fit(part["n_words"].to_numpy(), sizes)
        return pd.DataFrame({
            "bin_id": [f"{key[0]}-{b}" for b in bins], "capacity": capacity[bins], "used": used[bins], "offset": offsets,
            "doc_id": part["doc_id"].astype("Int64"), "first_word": part["first_word"], "n_words": part["n_words"],
        })

    packed = dealt.groupBy("shard").applyInPandas(one_shard, "bin_id string, capacity long, used long, offset long, doc_id long, first_word long, n_words long")
    none = F.lit(None)
    rest = pieces.where("n_words = 0").select(none.cast("string").alias("bin_id"), *[none.cast("long").alias(c) for c in ("capacity", "used", "offset")], "doc_id", "first_word", "n_words")
    return packed.union(rest)


def pack_documents(docs: DataFrame, sizes: tuple[int, ...] = SIZES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`pack` over the numbers of words of whole texts; other columns are not read."""
    return pack(docs.select(F.col(id_col).alias("doc_id"), n_words(F.col(text_col)).alias("n_words")), sizes)
