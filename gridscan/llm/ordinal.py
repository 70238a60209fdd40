"""Quality by ordinal regression: one weight vector over hashed text features, ordered thresholds between grades.

P(grade <= k) = sigmoid(threshold_k - score).  Grades share the score, so every rating informs all of them;
the expected grade ranks texts, a tail probability selects them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from gridscan.llm.toxicity import in_fold

#: Bound on rated rows that training gathers, in the order of a hash of the id.
TRAIN_ROWS = 6000
BUCKETS = 1 << 16
#: Plain features beside the hashed ones: logarithms and shares that describe the whole text.
DENSE = 8


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed columns, their weights of unit length, dense features); no words: all zero but the constant.

    Hashed are the distinct word shapes (letter case, digits and symbols of a whole word, runs shortened), word
    ends and whole words, whatever their length; a feature's weight does not grow with the length of the text.
    """
    found = text.encode().split() if text else []
    n = len(found)
    if not n:
        return np.empty(0, np.int64), np.empty(0), np.eye(1, DENSE)[0]
    distinct = set(found)
    names = {w[-3:] for w in distinct} | distinct
    data = text.encode()
    shapes = Counter(shape(data.translate(KINDS)).split())
    columns = [xxhash.xxh3_64_intdigest(b"w" + x) % BUCKETS for x in names] + [xxhash.xxh3_64_intdigest(b"s" + x) % BUCKETS for x in shapes]
    weights = np.r_[np.full(len(names), 1 / np.sqrt(len(names))), np.sqrt(np.array(list(shapes.values())) / n)]
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = sum(map(text.count, "#*$%&|<>!"))
    dense = np.array([1, np.log1p(n) / 8, len(distinct) / n, min(symbols / n, 3), len(set(lines)) / max(1, len(lines)), 1 - len(data.translate(None, UPPER)) / len(data),
                      min(sum(map(len, found)) / n / 10, 3), len({*zip(found, found[1:])}) / max(1, n - 1)])
    return np.array(columns, np.int64), weights, dense


UPPER = bytes(range(65, 91))
#: Letters become a or A, digits 0; white space and symbols stay.
KINDS = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


RUN = re.compile(rb"(\S)\1+")


def shape(kinds: bytes) -> bytes:
    """Runs of one kind shortened to one, white space as it is."""
    return RUN.sub(rb"\1", kinds)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """Weights of hashed and dense features and the ascending thresholds between `len(thresholds) + 1` grades."""

    def __init__(self, hashed: np.ndarray, dense: np.ndarray, thresholds: np.ndarray):
        self.hashed, self.dense, self.thresholds = hashed, dense, thresholds

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        columns, weights, dense = features(text)
        return sigmoid(self.hashed[columns] @ weights + self.dense @ dense - self.thresholds)


def fit(texts: list[str | None], grades: np.ndarray, n_grades: int, epochs: int = 30, rate: float = 0.05, decay: float = 1e-5, seed: int = 3) -> Model:
    """Maximum likelihood of the cumulative-link model by Adam; thresholds are a first one plus positive gaps.

    Without rows, all thresholds are zero apart from small gaps, and every tail probability about a half.
    """
    made = [features(t) for t in texts]
    sizes = np.array([len(m[0]) for m in made], np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    columns = np.concatenate([m[0] for m in made] + [np.empty(0, np.int64)])
    weights = np.concatenate([m[1] for m in made] + [np.empty(0)])
    dense = np.array([m[2] for m in made]).reshape(-1, DENSE)
    share = np.cumsum(np.bincount(grades, minlength=n_grades))[:-1]
    base = np.log((share + 1) / (len(grades) - share + 1)) if len(grades) else np.zeros(n_grades - 1)
    gaps = np.log(np.maximum(np.diff(base), 0.05))
    params = [np.zeros(BUCKETS), np.zeros(DENSE), np.r_[base[:1], gaps]]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    rng = np.random.default_rng(seed)
    step, batch = 0, max(1, -(-len(texts) // 24))  # as many steps at any size
    for _ in range(epochs if len(texts) else 0):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            part = order[at:at + batch]
            n = sizes[part]
            places = np.arange(n.sum()) + np.repeat(starts[part] - np.r_[0, np.cumsum(n)[:-1]], n)
            row = np.repeat(np.arange(len(part)), n)
            score = np.bincount(row, params[0][columns[places]] * weights[places], len(part)) + dense[part] @ params[1]
            thresholds = np.cumsum(np.r_[params[2][:1], np.exp(params[2][1:])])
            # Lower and upper ends of each row's grade on the latent scale.
            ends = np.r_[-40.0, thresholds, 40.0]
            lo, hi = sigmoid(ends[grades[part]] - score), sigmoid(ends[grades[part] + 1] - score)
            p = np.maximum(hi - lo, 1e-9)
            d_lo, d_hi = lo * (1 - lo), hi * (1 - hi)
            d_score = (d_hi - d_lo) / p / len(part)
            d_ends = np.bincount(grades[part] + 1, -d_hi / p, n_grades + 1) + np.bincount(grades[part], d_lo / p, n_grades + 1)
            d_thresholds = d_ends[1:n_grades] / len(part)
            tail = np.cumsum(d_thresholds[::-1])[::-1]
            grads = [np.bincount(columns[places], weights[places] * d_score[row], BUCKETS) + decay * params[0], dense[part].T @ d_score, np.r_[tail[:1], tail[1:] * np.exp(params[2][1:])]]
            step += 1
            for x, g, (m, v) in zip(params, grads, moments):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                x -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Model(params[0], params[1], np.cumsum(np.r_[params[2][:1], np.exp(params[2][1:])]))


def grade_texts(docs: DataFrame, ratings: DataFrame, n_grades: int, least_grade: int = 1, least_probability: float = 0.5, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, expected_grade, p_tail (of `least_grade` or more), kept.

    `ratings` has doc_id and grade (0 to n_grades - 1); null ids and grades and the held-out fifth of ids are
    not learnt from, of several ratings the largest counts, `train_rows` rated texts at most are gathered.
    Null and empty texts get the score of no words; a null id is not held out; other columns are not read.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rated = (ratings.select(F.col("doc_id").cast("long").alias("_id"), F.col("grade").cast("int").alias("_y"))
             .where("_id IS NOT NULL AND _y IS NOT NULL").where(~in_fold(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(train_rows))
    rows = d.join(rated, F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.max("text").alias("text"), F.max("_y").alias("y")).orderBy(F.xxhash64("_id"), "_id").collect()
    model = fit([r["text"] for r in rows], np.array([min(max(r["y"], 0), n_grades - 1) for r in rows], np.int64), n_grades)
    held = docs.sparkSession.sparkContext.broadcast((model.hashed, model.dense, model.thresholds))  # 512 KB, whatever the input

    @F.pandas_udf("array<double>")
    def tails(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Model(*held.value)
        for texts in parts:
            yield pd.Series([m.tails(t).tolist() for t in texts], dtype=object)

    out = d.select("doc_id", F.coalesce(in_fold(F.col("doc_id")), F.lit(False)).alias("held_out"), tails("text").alias("tails"))
    out = out.withColumn("expected_grade", F.aggregate("tails", F.lit(0.0), lambda a, x: a + x)).withColumn("p_tail", F.col("tails")[least_grade - 1])
    return out.select("doc_id", "held_out", "expected_grade", "p_tail", (F.col("p_tail") >= least_probability).alias("kept"))
