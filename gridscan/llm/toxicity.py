"""Toxicity by subword bags: averaged n-gram embeddings under a linear softmax, trained jointly in numpy.

A text is the set of its words; a word is the bag of its character n-grams, hashed to rows of one embedding
table.  A misspelling never seen in training still shares most n-gram rows with the word it hides.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridscan.llm.common import mix

#: Bound on labelled rows that training gathers, in the order of a hash of the id.
TRAIN_ROWS = 6000
BUCKETS, DIM, GRAMS = 1 << 17, 4, (3, 5)
#: A text holds few telling words among hundreds; the factor keeps the weights they need small.
SCALE = 40.0


def word_grams(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Table rows of the n-grams of a text's distinct words, the word each belongs to, and the number of words.

    Words are lower-cased and stand between line feeds, which mark their ends inside the n-grams.
    """
    found = sorted(set(text.lower().encode().split())) if text else []
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    a = np.frombuffer(b"\n".join([b"", *found, b""]).decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(a == 10)
    h, rows, word = np.zeros(len(a), np.uint64), [], []
    for n in range(1, GRAMS[1] + 1):
        m = len(a) - n + 1
        h = h[:m] * np.uint64(0x100000001B3) + a[n - 1:]
        if n >= GRAMS[0] and m > 0:
            whole = np.flatnonzero(ends[n - 2:n - 2 + m] == ends[:m])
            rows.append(mix(h[whole] + np.uint64(n)) & np.uint64(BUCKETS - 1))
            word.append(ends[whole] - 1)
    return np.concatenate(rows).astype(np.int64), np.concatenate(word), len(found)


def fit(texts: list[str | None], labels: np.ndarray, epochs: int = 10, rate: float = 1.7, batches: int = 24, seed: int = 1) -> np.ndarray:
    """Weight of every table row for class 1 against class 0, and last the bias: embeddings times softmax.

    A word is the mean of its n-gram embeddings, a text `SCALE` times the mean of its distinct words; n-grams
    count by inverse document frequency.  Embeddings and softmax learn together by gradient steps; the step
    of an embedding is divided by the share of texts that hold it, so rare and common rows learn alike.
    Without both classes the weights are zero and the bias is the smoothed log-odds of class 1.
    """
    ones = int(labels.sum())
    prior = float(np.log((ones + 1) / (len(labels) - ones + 1)))
    if ones in (0, len(labels)):
        return np.append(np.zeros(BUCKETS), prior)
    rng = np.random.default_rng(seed)
    rows, values, sizes = bags(texts)
    seen = np.bincount(rows, minlength=BUCKETS).astype(np.float64)
    idf = np.log((len(sizes) + 1) / (seen + 1))
    starts = np.r_[0, np.cumsum(sizes)]
    for at in range(0, len(rows), 1 << 20):
        values[at:at + (1 << 20)] *= idf[rows[at:at + (1 << 20)]]
    pace = (len(sizes) / (seen + 20))[:, None]
    table, soft, bias = rng.normal(0, 0.02, (BUCKETS, DIM)), rng.normal(0, 1, (DIM, 2)), np.array([0, prior])
    full = np.flatnonzero(sizes)
    batch = max(1, -(-len(full) // batches))  # as many steps at any size
    for epoch in range(epochs):
        order = full[rng.permutation(len(full))]
        for at in range(0, len(order), batch):
            part = order[at:at + batch]
            n = sizes[part]
            first = np.r_[0, np.cumsum(n)[:-1]]
            places = np.arange(n.sum()) + np.repeat(starts[part] - first, n)
            row, value = rows[places], values[places][:, None]
            mean = np.add.reduceat(table[row] * value, first)
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            p /= len(part)
            back = np.repeat(p @ soft.T, n, axis=0) * value
            grad = np.stack([np.bincount(row, back[:, d], BUCKETS) for d in range(DIM)], 1)
            lower = rate * (1 - epoch / epochs)
            soft -= 0.1 * lower * (mean.T @ p)
            bias = bias - 0.1 * lower * p.sum(0)
            table -= lower * pace * grad
    return np.append(idf * (table @ (soft[:, 1] - soft[:, 0])), bias[1] - bias[0])


def shares(word: np.ndarray, n: int) -> np.ndarray:
    """Weight of each n-gram: words weigh alike, and so do the n-grams of a word."""
    return SCALE / n / np.bincount(word, minlength=n)[word]


def bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows and their weights of all texts, one text after the other, and the number of rows of each."""
    # Growing buffers: joining a list of arrays would hold everything twice.
    rows, values, sizes = array("i"), array("f"), []
    for t in texts:
        row, word, n = word_grams(t)
        got, inverse = np.unique(row, return_inverse=True)
        if n:
            rows.frombytes(got.astype(np.int32).tobytes())
            values.frombytes(np.bincount(inverse, shares(word, n), len(got)).astype(np.float32).tobytes())
        sizes.append(len(got))
    return np.frombuffer(rows, np.int32), np.frombuffer(values, np.float32), np.array(sizes, np.int64)


def logits(texts: Iterable[str | None], weights: np.ndarray) -> np.ndarray:
    """Log-odds of class 1 of each text; without words the bias alone."""
    out = []
    for t in texts:
        row, word, n = word_grams(t)
        out.append(weights[-1] + (weights[row] @ shares(word, n) if n else 0.0))
    return np.array(out, np.float64)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train_rows: int, held_out: Column | None = None) -> DataFrame:
    """Text and label of at most `train_rows` labelled documents in the order of a hash of the id.

    Null ids and labels are no labels; of several labels of a document the largest counts; a document that
    stands more than once gives its text once.  `held_out` (a condition on `_id`) takes labels out first.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL")
    if held_out is not None:
        marks = marks.where(~held_out)
    chosen = marks.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text")).join(chosen, "_id")
    return texts.groupBy("_id").agg(F.max("_text").alias("text"), F.max("_y").alias("y")).orderBy(F.xxhash64("_id"), "_id")


def in_fold(id_col: Column) -> Column:
    """The held-out fifth: crc32 of the id as text leaves 0 modulo 5."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Fit on labels outside the held-out fifth; the driver gathers `train_rows` texts at most."""
    rows = labelled_sample(docs, labels, "toxic", train_rows, F.coalesce(in_fold(F.col("_id")), F.lit(True))).collect()
    return fit([r["text"] for r in rows], np.array([int(r["y"] > 0) for r in rows], np.int64))


def scorer(spark, weights: np.ndarray):
    """Column function text -> score in 0..1 (null and empty texts too: the score of no words)."""
    held = spark.sparkContext.broadcast(weights.astype(np.float32))  # one float a table row: 512 KB, whatever the input

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = held.value.astype(np.float64)
        for texts in parts:
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits(texts, w), -500, 500))))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out (null id: false), score, predicted.

    Only the text feeds the score.  Other columns are not read and their names may clash.  Without labels
    of both classes every text gets the smoothed share of toxic ones (a half without any).
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    score = scorer(docs.sparkSession, train(d, labels, train_rows))
    out = d.select("doc_id", F.coalesce(in_fold(F.col("doc_id")), F.lit(False)).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
