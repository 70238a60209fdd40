"""Repeated passages: words in columns, bounded slices, stretches that move together."""

import brute
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridscan.llm import passages
from gridscan.llm.common import words

TEXTS = ["a bc", None, "", " \n\t", "bc", "x", "éü\x0b\x1cö  a\r\n", "w" * 64 + " " + "w" * 65 + " " + "v" * 300, "12345678 123456789 1234567", " a  "]


def test_words_of_a_column():
    for texts in (TEXTS, TEXTS[1:4], [], ["a"], ["b a", "a", "a b"]):
        column = pa.array(["lead in", *texts, "tail"], pa.string()).slice(1, len(texts))
        found = passages.Words(column)
        want = [w for t in texts for w in words(t)]
        assert [found.data[b:e].tobytes() for b, e in zip(found.begin, found.end)] == want
        assert found.sizes.tolist() == [len(words(t)) for t in texts]
        hashes = found.hashes().tolist()
        assert len(set(zip(hashes, want))) == len(set(hashes)) == len(set(want))


def test_slices_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(passages, "SLICE_BYTES", 100)
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n if n else None for n in [40] * 9 + [0] * 5 + [500, 30, 0]])], names=["text"])
    parts = list(passages.slices(batch, 0, 4))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows <= 4 and (p.num_rows == 1 or len("".join(t or "" for t in p.column(0).to_pylist())) <= 100) for p in parts)


def test_stretches_of_a_shard_move_together():
    """Once every stretch was a row of its own."""
    text = " ".join(f"w{k}" for k in range(400))
    found = passages.Words(pa.array([text]))
    anchor, _, first, n = passages.anchors(found.hashes(), found.sizes, 13)
    runs = [{"first": int(f), "n": int(m), "automaton": 0, "parts": 1} for f, m in zip(first, n)]
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("first", "n", "automaton", "parts")]))
    wanted = passages.gram_hashes(found.hashes(), 13).view(np.int64).tolist()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([7, 8]), pa.array([text, text]), pa.array([runs, runs], kind), pa.array([wanted, None], pa.list_(pa.int64()))], names=["_id", "_content", "_text", "runs", "wanted"])
    dealt = list(passages._dealt(iter([batch]), 13, 1))
    rows = sum(b.num_rows for b in dealt)
    assert rows <= 2 + 3 * len(runs) / passages.PACKED
    covered = np.zeros(400, bool)
    for b in passages._locate(iter(dealt), 13):
        assert set(b.column(0).to_pylist()) == {2} and set(b.column(1).to_pylist()) == {8}
        for start, size in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            covered[start:start + size] = True
    assert covered.all()


def test_small_rows_and_slices(monkeypatch):
    for name, value in (("BASE", 3), ("PACKED", 2), ("SLICE_BYTES", 300)):
        monkeypatch.setattr(passages, name, value)
    test_stretches_of_a_shard_move_together()


def test_odd_texts_among_passages(spark, monkeypatch):
    monkeypatch.setattr(passages, "SHARD_PATTERNS", 20)
    monkeypatch.setattr(passages, "SHARD_STRETCHES", 9)
    shared = [" ".join(f"s{k}é{j}" for j in range(30)) for k in range(3)]
    rows = [(k, f"own{k}\n {shared[k % 3]}  and{k} " + shared[k % 2] * (k % 4)) for k in range(24)] + [(30 + k, t) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = passages.remove_repeats(docs).withColumn("sha", F.sha2("text", 256)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in got} == brute.repeats(rows)
