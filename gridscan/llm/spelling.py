"""Spelling variants: k-d trees over letter-count vectors find words that differ by one edit.

One replaced letter lowers one count and raises another by one; one inserted letter raises one count.  So near
words lie within L1 distance two in the tree of their own length, and within one in that of the next length;
boxes out of that reach are pruned, and candidates are verified letter by letter.

The top of each length's tree is fitted on a bounded sample of words and cuts the words into cells; every word
goes to its own cell and asks all cells whose box it can reach, so the sample decides on balance only.  A cell
builds the rest of its tree itself and answers all that ask it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridscan.llm.common import discard, written

#: Letters of a word: A-Z in either case (lower-cased) and U+00C0 to U+00FF, one byte each in Latin-1.
RUN = "[a-zÀ-ÿ]{%d,}"
COLUMN = np.zeros(256, np.int64)
COLUMN[ord("a"):ord("z") + 1] = np.arange(26)
COLUMN[0xC0:0x100] = np.arange(26, 90)
LETTERS = 90
#: The bit of a letter in a sketch; two letters may share one.
BIT = np.where(np.arange(256) >= ord("a"), np.uint64(1) << (COLUMN % 64).astype(np.uint64), np.uint64(0))
#: Words that one batch counts before it hands them on.
HELD = 200_000
#: The trees' tops: words in the sample, letters of its longest word, cells in all, least words worth a cell of their own.
SAMPLE, LONGEST, CELLS, CELL_WORDS = 65536, 64, 1024, 512
#: Words of a cell that one task holds at a time; larger cells are cut by a hash.
SLICE_WORDS = 100_000
LEAF = 24


# --- words of texts -------------------------------------------------------------------------------------------------

def typed(doc_id: int | None, text: str, least: int, every: int) -> Counter:
    """Counts of the words of one text; where crc32 of `<doc_id>:<run>` is a multiple of `every`, a letter is left out."""
    runs = Counter(re.findall(RUN % least, text.encode().lower().decode()))
    begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), begun)
        if h % every == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1:]
            if len(run) < least:
                continue
        out[run] += n
    return out


def _word_batches(least: int, every: int):
    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for at in range(batch.num_rows):
                text = batch.column(1)[at].as_py()
                if text:
                    counts.update(typed(batch.column(0)[at].as_py(), text, least, every))
                    if len(counts) > HELD:
                        yield batch_of(counts)
                        counts = Counter()
        yield batch_of(counts)

    return body


def word_counts(docs: DataFrame, least_letters: int = 6, least_n: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all texts: runs of letters, A-Z lower-cased, with the typing errors that `typed` makes."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))
    counts = texts.mapInArrow(_word_batches(least_letters, every), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


# --- trees ----------------------------------------------------------------------------------------------------------

def letters(words: list[str]) -> np.ndarray:
    """(words, longest) Latin-1 codes, zero after the end of a word."""
    data = [w.encode("latin-1") for w in words]
    width = max(map(len, data), default=0)
    return np.frombuffer(b"".join(d.ljust(width, b"\0") for d in data), np.uint8).reshape(len(data), width)


def counts_of(codes: np.ndarray) -> np.ndarray:
    """Letter-count vectors (words, 90), the counts of one letter side by side."""
    n = len(codes)
    row, at = np.nonzero(codes)
    return np.bincount(COLUMN[codes[row, at]] * n + row, minlength=LETTERS * n).astype(np.int32).reshape(LETTERS, n).T


def sketches(codes: np.ndarray) -> np.ndarray:
    """One bit a letter: whether its count is odd.  A letter that comes or goes changes one bit."""
    return np.bitwise_xor.reduce(BIT[codes], axis=1)


@dataclass
class Node:
    """An inner node has a letter and the largest count of its left side; a leaf has a cell number or member rows."""
    letter: int = -1
    cut: int = 0
    left: Node | None = None
    right: Node | None = None
    cell: int = -1
    members: np.ndarray | None = None


def cut_of(vectors: np.ndarray) -> tuple[int, int] | None:
    """The letter of widest spread and the count that halves it; None where all vectors are equal."""
    spread = vectors.var(0)
    letter = int(spread.argmax())
    if spread[letter] == 0:
        return None
    values = np.sort(vectors[:, letter])
    cut = int(values[(len(values) - 1) // 2])
    return letter, cut if cut < values[-1] else cut - 1


def grown(vectors: np.ndarray, rows: np.ndarray, leaf: int, cells: list[int] | None = None) -> Node:
    """k-d tree of `rows`; leaves of `leaf` rows or less, or of equal vectors.  With `cells`, leaves get numbers from it."""
    cut = cut_of(vectors[rows]) if len(rows) > leaf else None
    if cut is None:
        if cells is None:
            return Node(members=rows)
        cells.append(len(cells))
        return Node(cell=cells[-1])
    side = vectors[rows, cut[0]] <= cut[1]
    return Node(*cut, grown(vectors, rows[side], leaf, cells), grown(vectors, rows[~side], leaf, cells))


def reach(node: Node, vectors: np.ndarray, asking: np.ndarray, up: int, down: int) -> Iterator[tuple[Node, np.ndarray]]:
    """(leaf, rows of `asking`) for every leaf whose box can be met by raising counts by `up` and lowering them by `down` in all.

    What a row has to change to enter a box is kept along the way: per letter only the tightest cut counts.
    """
    low, high = np.zeros(LETTERS, np.int64), np.full(LETTERS, 1 << 40)

    def visit(node: Node, rows: np.ndarray, ups: np.ndarray, downs: np.ndarray):
        if not len(rows):
            return
        if node.left is None:
            yield node, rows
            return
        at, cut = vectors[rows, node.letter], node.cut
        for child, is_left in ((node.left, True), (node.right, False)):
            bound, old = (high, high[node.letter]) if is_left else (low, low[node.letter])
            new = min(old, cut) if is_left else max(old, cut + 1)
            if is_left:
                u, d = ups, downs + np.maximum(at - new, 0) - np.maximum(at - old, 0)
            else:
                u, d = ups + np.maximum(new - at, 0) - np.maximum(old - at, 0), downs
            keep = (u <= up) & (d <= down)
            bound[node.letter] = new
            yield from visit(child, rows[keep], u[keep], d[keep])
            bound[node.letter] = old

    none = np.zeros(len(asking), np.int64)
    yield from visit(node, asking, none, none)


def verified(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Row by row: do two words (codes of n and n or n + 1 letters) differ by exactly one replaced or inserted letter?"""
    n, wide = short.shape[1], long.shape[1]
    if n == wide:
        return (short != long).sum(1) == 1
    head = (np.cumprod(short == long[:, :n], 1)).sum(1)
    tail = (np.cumprod((short == long[:, 1:])[:, ::-1], 1)).sum(1)
    return head + tail >= n


def pairs_in(words: np.ndarray, asking: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(asking row, word row) of all near pairs; the words have one length, those that ask the same or one less."""
    if not len(words) or not len(asking):
        return
    up, down = (1, 1) if words.shape[1] == asking.shape[1] else (1, 0)
    vectors, theirs = counts_of(words), counts_of(asking)
    bits, their_bits = sketches(words), sketches(asking)
    tree = grown(vectors, np.arange(len(words)), LEAF)
    for leaf, rows in reach(tree, theirs, np.arange(len(asking)), up, down):
        members = leaf.members
        for at in range(0, len(rows), max(1, size // len(members))):
            some = rows[at:at + max(1, size // len(members))]
            # Odd counts differ in no more letters than the counts: no pair is lost before the letters are verified.
            a, b = np.nonzero(np.bitwise_count(bits[members][None] ^ their_bits[some][:, None]) <= up + down)
            a, b = some[a], members[b]
            fit = verified(asking[a], words[b])
            if fit.any():
                yield a[fit], b[fit]


# --- near words -----------------------------------------------------------------------------------------------------

def tops(words: DataFrame) -> dict[int, Node]:
    """The top of the tree of each length, from a sample of at most SAMPLE words of LONGEST letters or less."""
    total = words.count()
    # Hashes under a share of their range: tasks send no more than the sample between them.
    share = int((1 << 30) * min(1.0, SAMPLE / max(total, 1)))
    drawn = words.where((F.length("word") <= LONGEST) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < share))
    sample = sorted(r.word for r in drawn.select("word").collect())[:SAMPLE]
    leaf = max(1, int(len(sample) * max(CELL_WORDS, total / CELLS) / max(total, 1)))
    by_length: dict[int, list[str]] = {}
    for w in sample:
        by_length.setdefault(len(w), []).append(w)
    out = {}
    for length, some in by_length.items():
        vectors = counts_of(letters(some))
        out[length] = grown(vectors, np.arange(len(some)), leaf, [])
    return out


def _dealt(trees: dict[int, Node], slices: dict[tuple[int, int], int] | None):
    """Rows (length, cell, slice, word, n, asks): every word in its own cell, and in all that it asks.

    Without `slices`, own cells alone.  A cell in s slices gets its words into one each, and those that ask into all.
    """
    one = Node(cell=0)

    def batch_of(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        rows, sizes = np.concatenate([o[0] for o in out]), [len(o[0]) for o in out]
        fixed = [pa.array(np.repeat(np.array(x), sizes)) for x in list(zip(*out))[1:]]
        word, n = (batch.column(k).take(pa.array(rows)) for k in (0, 1))
        return pa.RecordBatch.from_arrays([*fixed[:3], word, n, fixed[3]], names=["length", "cell", "slice", "word", "n", "asks"])

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.array(batch.column(0).to_pylist(), object)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            out, held = [], 0
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                vectors = counts_of(letters(words[rows].tolist()))
                everyone = np.arange(len(rows))
                asks = [(length, 0, 0, False)] + ([(length, 1, 1, True), (length + 1, 1, 0, True)] if slices is not None else [])
                for other, up, down, ask in asks:
                    for leaf, some in reach(trees.get(other, one), vectors, everyone, up, down):
                        cuts = (slices or {}).get((other, leaf.cell), 1)
                        mine = rows[some]
                        if cuts > 1 and not ask:
                            hashed = np.fromiter((zlib.crc32(w.encode()) % cuts for w in words[mine]), np.int64, len(mine))
                        for k in range(cuts):
                            out.append((mine if ask or cuts == 1 else mine[hashed == k], other, leaf.cell, k, ask))
                            held += len(out[-1][0])
                            if held > HELD:
                                yield batch_of(batch, out)
                                out, held = [], 0
            if out:
                yield batch_of(batch, out)

    return body


DEALT = "length long, cell long, slice long, word string, n long, asks boolean"


def _answers(group: pa.Table) -> pa.Table:
    """(word, other, other_n) both ways, for the near pairs of one cell."""
    asks = group["asks"].to_numpy()
    words, n = np.array(group["word"].to_pylist(), object), group["n"].to_numpy()
    length = group["length"][0].as_py()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    own = np.flatnonzero(~asks)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for size in (length, length - 1):
        asking = np.flatnonzero(asks & (sizes == size))
        for a, b in pairs_in(letters(words[own].tolist()), letters(words[asking].tolist())):
            a, b = asking[a], own[b]
            # Words of one length ask each other: the pair is told once.
            once = words[a] < words[b] if size == length else np.ones(len(a), bool)
            found.append((a[once], b[once]))
    a, b = (np.concatenate([f[k] for f in found] or [np.empty(0, np.int64)]).astype(np.int64) for k in (0, 1))
    one, other = np.concatenate([a, b]), np.concatenate([b, a])
    return pa.table({"word": pa.array(words[one].tolist(), pa.string()), "other": pa.array(words[other].tolist(), pa.string()), "other_n": pa.array(n[other], pa.int64())})


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, other_n) for all pairs of different words (word, n) one edit apart, both ways; `words` is read several times."""
    trees = tops(words)
    sizes = words.mapInArrow(_dealt(trees, None), DEALT).groupBy("length", "cell").count().where(F.col("count") > SLICE_WORDS).collect()
    slices = {(r.length, r.cell): -(-r["count"] // SLICE_WORDS) for r in sizes}
    dealt = words.mapInArrow(_dealt(trees, slices), DEALT)
    return dealt.groupBy("length", "cell", "slice").applyInArrow(_answers, "word string, other string, other_n long")


def spelling_variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of `words` (word, n; words differ, of letters that RUN allows).

    Near words differ by one inserted, deleted or replaced letter; n_near counts them.  The near word of largest
    n, of equal ones the first in code-point order, is the form of a word if that n is at least `factor` times its
    own, else the form is null.  The root is the last word reached by following forms, the word itself if it
    has none.  Words of any length are compared whole; an empty table gives an empty one.
    """
    stored = written(words.select("word", "n"), "spelling-words")
    near = near_words(stored)
    # The smallest of (-n, word): code points below U+0100 are ordered like their UTF-8 bytes.
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    form_n = -F.col("best.m")
    is_form = form_n >= factor * F.col("n")
    told = stored.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, form_n).alias("form_n"))
    told = written(told, "spelling-forms")
    # Counts grow by `factor` from word to form: chains are short, and every round doubles what is followed.
    ways = written(told.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        moved = not longer.where("moved").isEmpty()
        discard(ways)
        ways = longer
        if not moved:
            break
    discard(stored)
    return told.join(ways.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame, least_letters: int = 6, least_n: int = 5, every: int = 199, factor: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`spelling_variants` of the words of `docs` that `word_counts` gives.

    Null text has no words; a null id stands as nothing before the colon of its checksum.  Rows that stand twice
    count twice.  Texts of any length are read whole, one at a time; other columns are not read.
    """
    return spelling_variants(word_counts(docs, least_letters, least_n, every, id_col, text_col), factor)
