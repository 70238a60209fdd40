"""Words of texts and near words against all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gridscan.llm import spelling

ABC = "abcdefghijklmnopqrstuvwxyzéèçßÀ×÷ÿ"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain(counts, factor=5):
    """word -> (form, root, n, n_near, form_n)."""
    words = sorted(counts)
    near = {w: [o for o in words if abs(len(o) - len(w)) < 2 and one_edit(w, o)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in words}


def plain_words(rows, least=6, least_n=5, every=199):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += len(run) >= least
    return {w: n for w, n in out.items() if n >= least_n}


def vocabulary(rng, n, letters, lengths):
    words = {"".join(rng.choice(letters) for _ in range(rng.choice(lengths))) for _ in range(n)}
    for w in rng.sample(sorted(words), min(len(words), n // 2)):
        k = rng.randrange(len(w))
        words.add(rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:]]))
    return {w: int(10 ** rng.uniform(0.7, 5)) for w in words}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from(["ab", "abc", ABC]), st.integers(1, 60))
def test_tree_finds_all_pairs(seed, letters, n):
    rng = random.Random(seed)
    length = rng.randrange(4, 9)
    words = sorted(w for w in vocabulary(rng, n + 4, letters, [length]) if len(w) == length)
    for asking in (words, sorted({w[:k] + w[k + 1:] for w in words for k in range(length) if rng.random() < 0.3} | {"b" * (length - 1)})):
        got = Counter((asking[a], words[b]) for x, y in spelling.pairs_in(spelling.letters(words), spelling.letters(asking), size=2000) for a, b in zip(x, y))
        assert got == Counter((a, b) for a in asking for b in words if one_edit(a, b))


def test_boxes_are_pruned():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice(ABC[:26]) for _ in range(9)) for _ in range(4000)})
    vectors = spelling.counts_of(spelling.letters(words))
    tree = spelling.grown(vectors, np.arange(len(words)), spelling.LEAF)
    met = sum(len(leaf.members) * len(rows) for leaf, rows in spelling.reach(tree, vectors, np.arange(len(words)), 1, 1))
    assert met < len(words) ** 2 / 8


def test_words_have_typing_errors():
    texts = ["Le bébé ÉCOLE école Straße naïveté× ab ABCDEFG", "", "x" * 300000, "привет letters123letters", None] + [f"wordnumber{c}{d} " * 3 for c in "abcdefghij" for d in "klmnopqrst"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "without numbers " * 9)]
    for every in (199, 7, 1):
        total = Counter()
        for i, t in rows:
            if t:
                total.update(spelling.typed(i, t, 6, every))
        assert dict(total) == plain_words(rows, 6, 1, every)


def got_of(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.fixture(scope="module")
def counts():
    rng = random.Random(4)
    out = vocabulary(rng, 500, "abcde", [6, 7, 8]) | vocabulary(rng, 300, ABC, [6, 7, 12])
    # Ties of n, a chain of forms, anagrams, very long words.
    out |= {"aaaaaab": 50, "aaaaaac": 50, "aaaaaa": 10, "zzzzzzz": 5, "zzzzzzy": 25, "zzzzzyy": 125, "zzzzyyy": 625, "zzzyyyy": 3125}
    out |= {"q" * 3000: 40, "q" * 3001: 200, "q" * 1500 + "r" + "q" * 1500: 5}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_variants(spark, counts, monkeypatch, small):
    if small:  # many cells, and cells in several slices
        for name, value in (("SAMPLE", 200), ("CELL_WORDS", 30), ("SLICE_WORDS", 40)):
            monkeypatch.setattr(spelling, name, value)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("other", F.lit(1)).repartition(5)
    assert got_of(spelling.spelling_variants(words)) == plain(counts)


def test_no_words(spark):
    words = spark.createDataFrame([], "word string, n long")
    assert spelling.spelling_variants(words).collect() == []
    docs = spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")
    assert spelling.document_variants(docs).collect() == []


def test_documents(spark, counts):
    rng = random.Random(6)
    some = rng.sample(sorted(w for w in counts if len(w) < 99), 150)
    rows = [(i if i % 9 else None, " ".join(rng.choice(some).capitalize() for _ in range(40)) if i % 7 else None) for i in range(120)]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).repartition(6)
    assert got_of(spelling.document_variants(docs, every=19)) == plain(plain_words(rows, every=19))


def test_sketches_lose_no_pair():
    rng = random.Random(3)
    for length in (6, 9):
        words = sorted({"".join(rng.choice(ABC) for _ in range(length)) for _ in range(300)})
        for pick, most in ((lambda w, k: w[:k] + rng.choice(ABC) + w[k + 1:], 2), (lambda w, k: w[:k] + w[k + 1:], 1)):
            edited = [pick(w, rng.randrange(length)) for w in words]
            apart = np.bitwise_count(spelling.sketches(spelling.letters(words)) ^ spelling.sketches(spelling.letters(edited)))
            assert apart.max() <= most


def test_words_are_dealt_in_few_batches(monkeypatch):
    """Once every cell that a batch of words asks was a batch of its own."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice(ABC[:26]) for _ in range(rng.choice([7, 8]))) for _ in range(2000)})
    trees = {n: spelling.grown(spelling.counts_of(spelling.letters([w for w in words if len(w) == n])), np.arange(sum(len(w) == n for w in words)), 20, []) for n in (7, 8)}
    batch = pa.RecordBatch.from_arrays([pa.array(words), pa.array(range(len(words)))], names=["word", "n"])
    rows = {}
    for held in (10**6, 100):
        monkeypatch.setattr(spelling, "HELD", held)
        dealt = list(spelling._dealt(trees, {(7, 3): 2})(iter([batch])))
        assert held == 100 or len(dealt) == 1
        rows[held] = Counter(tuple(r.values()) for b in dealt for r in b.to_pylist())
    assert rows[100] == rows[10**6] and max(rows[100].values()) == 1
    own = Counter((w, n) for _, _, _, w, n, asks in rows[100] if not asks)
    assert own == Counter(zip(words, range(len(words))))
