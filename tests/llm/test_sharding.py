"""Feistel shards against the plain permutation, on rows with every awkward case."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridscan.llm import sharding


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text {i} é" * (i % 7), "h") for i in range(700)] + [(None, None, "h"), (None, "", "h"), (3, None, None), (5, "x" * 200000, "h")]
    rows += [(9, "copy", "a")] * 2500 + [(10, "same", "b")] * 3 + [(10, "same", "c")] * 2
    # Names used inside stand in the table too.
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return d.withColumn("digest", F.lit("x")).withColumn("place", F.col("doc_id") + 1).withColumn("_bin", F.lit(1)).withColumn("row", F.lit(None).cast("string")).repartition(7)


def test_permutation_and_its_inverse():
    for n in (1, 2, 3, 24, 25, 1000, 1009):
        for seed in (0, 5):
            places = [sharding.permuted(x, n, seed) for x in range(n)]
            assert sorted(places) == list(range(n))
            assert [sharding.row_number_at(p % 24, p // 24, n, 24, seed) for p in places] == list(range(n))
    assert [sharding.permuted(x, 1000, 0) for x in range(50)] != [sharding.permuted(x, 1000, 1) for x in range(50)]
    # Neighbours do not stay neighbours.
    places = [sharding.permuted(x, 5000, 0) for x in range(5000)]
    assert sum(abs(a - b) < 50 for a, b in zip(places, places[1:])) < 200
    for bad in ((24, 0), (0, 42), (16, 41)):
        with pytest.raises(ValueError):
            sharding.row_number_at(*bad, 1000)


def test_shards_are_whole_even_and_reproducible(docs):
    got = sharding.shard_rows(docs, shards=24).collect()
    n = docs.count()
    assert len(got) == n and sorted(r.number for r in got) == list(range(n))
    slots = defaultdict(list)
    for r in got:
        place = sharding.permuted(r.number, n, 0)
        assert (r.shard, r.slot, r.law, r.grown_shard) == (place % 24, place // 24, "rows", None)
        slots[r.shard].append(r.slot)
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    # Numbers follow the digests, whatever the partitions are.
    again = sharding.shard_rows(docs.repartition(3, "source"), shards=24).collect()
    assert sorted((r.digest, r.number, r.shard, r.slot) for r in got) == sorted((r.digest, r.number, r.shard, r.slot) for r in again)
    assert {r.copies for r in got} == {1, 2, 3, 2500}


def test_other_seeds_and_shards(docs):
    some = docs.where("doc_id < 100")
    a, b = (sorted((r.number, r.shard, r.slot) for r in sharding.shard_rows(some, 7, seed).collect()) for seed in (0, 1))
    assert a != b and {s for _, s, _ in a} == set(range(7))


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(docs, n):
    some = docs.limit(n)
    assert sorted((r.shard, r.slot) for r in sharding.shard_rows(some).collect()) == sorted((k, 0) for k in range(n))


def test_rows_come_back_whole_from_files(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), shards=5, rows_per_file=100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("row.*").exceptAll(docs).isEmpty() and docs.exceptAll(back.select("row.*")).isEmpty()
    per_file = back.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"), (F.max("slot") - F.min("slot") + 1).alias("span"), F.countDistinct("shard").alias("shards")).collect()
    assert all(r.n <= 100 and r.span == r.n and r.shards == 1 for r in per_file)
    assert [r.n for r in back.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()].__len__() == 5
