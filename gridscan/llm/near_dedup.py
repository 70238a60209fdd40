"""MinHash near-duplicates with tensored banding, every link confirmed on the full shingle sets.

Two small collections of minhash bands, `tables` of `rows` each, give tables x tables bucket keys by combining a
band of one with a band of the other: 2 x tables x rows minhashes do the work of tables x tables x 2 x rows.  A
pair at the least similarity s that links shares no bucket with probability 2 x (1 - s^rows)^tables at most;
`banding` takes as many tables as keep that under `MISS`, whatever s is.

Documents with equal sets form a class first; only class representatives are hashed into buckets.  Inside a
bucket not everybody is compared with everybody:

1. all members meet the smallest one;
2. in buckets that then still hold several components, all meet the largest one;
3. what is left are pairs of different components.  The parity sketches of two sets differ in no more bits
   than the sets differ in elements, so they bound the distance from below, exactly; pairs that this bound
   and the sizes leave open are compared in full, no estimate stands between.

No pair that could join two components goes unexamined, whatever the size of a family of near copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gridscan.llm.common import components, gram_hashes, long_lists, mix, word_hashes, written

SHINGLE = 5
LINK = 85  # per cent of the union
#: Bound on the share of links at the least similarity that meet in no bucket, and of bucket keys a set where rows can be spared.
MISS, KEYS = 6e-4, 170
#: Words of the parity sketch: bit j tells whether an odd number of shingles fall on j.
PARITY = [f"p{k}" for k in range(8)]


def banding(link: int) -> tuple[int, int]:
    """(rows, tables) for links of `link` per cent or more: the most rows that need no more than `KEYS` keys, or one."""
    s, found = link / 100, []
    for rows in range(1, 9):
        tables = 1 if s == 1 else max(1, math.ceil(math.log(MISS / 2) / math.log(1 - s**rows)))
        if rows == 1 or tables**2 <= KEYS and 2 * rows * tables <= 128:
            found.append((rows, tables))
    return found[-1]


def seeds(rows: int, tables: int) -> np.ndarray:
    return mix(np.arange(1, 2 * tables * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of the lower-cased (A-Z only) words; short texts give one."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = word_hashes(found)
    return np.unique(gram_hashes(h, min(size, len(h))))


def least_hashes(s: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Minimum of the set under each of the hash functions, in blocks so that long texts stay small in memory."""
    out = np.full(len(by), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1024):
        np.minimum(out, (s[None, at:at + 1024] * by[:, None]).min(1), out=out)
    return out


def bands(s: np.ndarray, by: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(band values of both collections, words of the parity sketch) of a non-empty set."""
    low = least_hashes(s, by)
    value = np.arange(len(by) // rows, dtype=np.uint64)
    for j in range(rows):
        value = mix(value * np.uint64(31) + low.reshape(-1, rows)[:, j])
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % (64 * len(PARITY)), minlength=64 * len(PARITY)).astype(np.uint8) & 1
    return value, np.packbits(odd).view(np.uint64)


def _signatures(batches: Iterator[pa.RecordBatch], rows: int, tables: int) -> Iterator[pa.RecordBatch]:
    by = seeds(rows, tables)
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            sets = [shingle_set(t) for t in part.column(2).to_pylist()]
            prints = [xxhash.xxh3_128_intdigest(x.tobytes()) for x in sets]
            made = [bands(x, by, rows) if len(x) else (np.empty(0, np.uint64), np.zeros(len(PARITY), np.uint64)) for x in sets]
            half = lambda shift: pa.array(np.array([(p >> shift) & (2**64 - 1) for p in prints], np.uint64).view(np.int64))
            sketch = np.array([m[1] for m in made], np.uint64).reshape(len(made), -1).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array([len(x) for x in sets], pa.int64()), half(64), half(0),
                long_lists([m[0] for m in made]), *[pa.array(np.ascontiguousarray(x)) for x in sketch.T],
            ], names=["_id", "_content", "n", "f0", "f1", "bands", *PARITY])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield pa.RecordBatch.from_arrays([part.column(0), long_lists([shingle_set(t) for t in part.column(1).to_pylist()])], names=["rep", "shingles"])


def _may_link(a: str, b: str, link: int) -> Column:
    """Neither the sizes nor the parity sketches of two members rule a link out; both bounds are exact."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = reduce(add, [F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in PARITY])
    return (100 * F.least(n, m) >= link * F.greatest(n, m)) & ((100 + link) * apart <= (100 - link) * (n + m))


def _linked(pairs: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity.

    The set of `a` travels once a pair; that of `b`, often the same leader, is merged in.
    """
    left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.where((100 + link) * F.size(F.array_intersect("sa", "sb")) >= link * (F.size("sa") + F.size("sb"))).select("a", "b")


def _open(members: DataFrame, component: DataFrame) -> DataFrame:
    """Members with their components, of the buckets that hold more than one."""
    known = written(members.join(component, F.col("m.rep") == F.col("node"), "left").select(*members.columns, F.coalesce("component", "m.rep").alias("component")), "members")
    several = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return written(known.join(several, "key", "left_semi"), "open-members")


def _components(members: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """(node, component) of all members of buckets that link with another.

    What earlier steps joined goes on as stars, so each step only contracts its own links.
    """
    component, stars = None, None
    for leader in (F.min, F.max):
        chosen = written(members.groupBy("key").agg(leader("m").alias("l")), "leaders")
        met = members.join(chosen, "key").where((F.col("m.rep") != F.col("l.rep")) & _may_link("m", "l", link))
        found = written(_linked(met.select(F.col("m.rep").alias("a"), F.col("l.rep").alias("b")).distinct(), sets, link), "links")
        component, stars = _joined(component, stars, found)
        rest = _open(members.select("key", "m"), component)
        if rest.isEmpty():
            return component
        members = rest
    main = written(members.groupBy("key").agg(F.min("component").alias("main")), "main")
    members = written(members.join(main, "key"), "open-members")
    x, y = members.where("component <> main").alias("x"), members.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component"))
                   & ((F.col("y.component") == F.col("y.main")) | (F.col("x.m.rep") > F.col("y.m.rep"))) & _may_link("x.m", "y.m", link))
    found = written(_linked(pairs.select(F.col("x.m.rep").alias("a"), F.col("y.m.rep").alias("b")).distinct(), sets, link), "links")
    return _joined(component, stars, found)[0]


def _joined(component: DataFrame | None, stars: DataFrame | None, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components, and their edges to the smallest member, with the links `found` added."""
    if component is not None and found.isEmpty():
        return component, stars
    component = written(components(found if stars is None else stars.union(found), "near"), "component")
    return component, component.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: int = LINK) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept, `_content` (names the row for `rows_of`).

    Links: Jaccard similarity of the shingle sets of `link` per cent or more.  component_id is the smallest id reachable.
    A null, empty or all-blank text has no shingles and is its own component.  A row with a null id takes the
    component of its equal texts, if they have ids, and is kept only without any.  Repeated rows get the same
    answer each.  Other columns are not read; an empty table gives an empty one.
    """
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_content"), F.col(text_col).alias("_text"))
    schema = "_id long, _content long, n long, f0 long, f1 long, bands array<bigint>, " + ", ".join(f"{x} long" for x in PARITY)
    rows, tables = banding(link)
    sig = written(base.mapInArrow(partial(_signatures, rows=rows, tables=tables), schema), "signatures")

    # Documents of one set are one class, stood for by its smallest id; one id may still stand for several sets.
    best = F.min(F.struct("_id", "_content", "bands", *PARITY))
    classes = written(sig.where("n > 0 AND _id IS NOT NULL").groupBy("f0", "f1", "n").agg(best.alias("c")).select("f0", "f1", "n", F.col("c._id").alias("rep"), "c.*").drop("_id"), "classes")

    # Only keys and names go through the large shuffle; what else members need joins those that share a bucket.
    a, b = F.slice("bands", 1, tables), F.slice("bands", tables + 1, tables)
    keys = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.xxhash64(x, y))))
    hashed = classes.select(F.explode(keys).alias("key"), "rep", "_content")
    filled = hashed.select("key").groupBy("key").count().where("count > 1").select("key")
    shared = written(hashed.join(filled, "key"), "shared-buckets")
    known = classes.select("rep", "_content", F.struct("rep", "_content", "n", *PARITY).alias("m"))
    members = written(shared.join(known, ["rep", "_content"]).select("key", "m"), "members")

    wanted = members.select("m.rep", "m._content").distinct()
    texts = base.join(wanted, (F.col("_id") == F.col("rep")) & (base["_content"] == wanted["_content"])).select("rep", "_text")
    sets = written(texts.mapInArrow(_sets, "rep long, shingles array<bigint>"), "sets")

    component = _components(members, sets, link)
    named = written(classes.join(component, F.col("rep") == F.col("node"), "left").select("f0", "f1", F.col("n").alias("m"), F.coalesce("component", "rep").alias("found")), "named")
    out = sig.join(named, (sig["f0"] == named["f0"]) & (sig["f1"] == named["f1"]) & (sig["n"] == named["m"]), "left")
    out = out.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("found", "_id").alias("component_id"), "_content")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
