"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a block of texts lie one after the other in symbol arrays.  An index maps each
mergeable pair, by its rank, to all positions at which it stands; active ranks are taken in ascending order,
all occurrences of a rank are merged at once, and the pairs this makes next to them enter the index.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, functions as F

#: Characters of text that are encoded together.
BLOCK_CHARS = 6_000_000
# Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Ranges that `regex` (Unicode 17) calls letters or numbers and the tokenizers library, with the
# tables of the version before, does not.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2,
    0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5,
    0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80,
    0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
    (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE,
    0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


def byte_letters() -> dict[int, str]:
    """How vocabulary files write bytes: printable Latin-1 characters stand for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class Vocabulary:
    """Tables of one tokenizer file: merges by rank, bytes by id, ids of bytes, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        of_letter = {c: b for b, c in letters.items()}
        ids = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(of_letter[c] for c in t) if all(c in of_letter for c in t) else t.encode() for t, i in ids.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of.update({i: t.encode() for t, i in self.added.items()})
        self.byte_ids = np.array([ids[letters[b]] for b in range(256)], np.int64)
        self.size = max(self.bytes_of) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        # Longer first: where one added token starts with another, the longer one is meant.
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it does not merge."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def merge_all(vocabulary: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(token ids of all pieces, end of each piece in them)."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(raw)
    symbol = vocabulary.byte_ids[raw]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.cumsum(lengths)
    after[ends - 1] = -1
    before[ends - lengths] = -1
    alive = np.ones(n, bool)
    # rank_at: rank of the pair that starts at a position; the index lists positions by rank.
    rank_at = np.full(n, -1, np.int64)
    first = np.flatnonzero(after >= 0)
    rank_at[first] = vocabulary.rank(symbol[first], symbol[after[first]])
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(places: np.ndarray) -> None:
        ranks = rank_at[places]
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for r, where in zip(ranks[np.r_[0, cut]].tolist(), np.split(places, cut)):
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(where)

    start = np.flatnonzero(rank_at >= 0)
    if len(start):
        enter(start)
    while active:
        r = heapq.heappop(active)
        found = index.pop(r)
        places = np.concatenate(found) if len(found) > 1 else found[0]
        places = places[rank_at[places] == r]
        if not len(places):
            continue
        if vocabulary.left[r] == vocabulary.right[r]:
            # Runs of one symbol overlap themselves: from the left, every second place of a run.
            taken, keep = set(), []
            for p in sorted(set(places.tolist())):
                if p not in taken:
                    keep.append(p)
                    taken.add(int(after[p]))
            places = np.array(keep, np.int64)
        elif len(found) > 1:
            places = np.unique(places)
        gone = after[places]
        symbol[places] = vocabulary.merged[r]
        alive[gone] = False
        rank_at[gone] = -1
        beyond = after[gone]
        after[places] = beyond
        inner = beyond >= 0
        before[beyond[inner]] = places[inner]
        rank_at[places] = -1
        changed = places[inner]
        rank_at[changed] = vocabulary.rank(symbol[changed], symbol[after[changed]])
        left = before[places]
        left = left[left >= 0]
        rank_at[left] = vocabulary.rank(symbol[left], symbol[after[left]])
        fresh = np.unique(np.concatenate([changed, left]))
        fresh = fresh[rank_at[fresh] >= 0]
        if len(fresh):
            enter(fresh)
    counts = np.add.reduceat(alive, ends - lengths) if n else np.empty(0, np.int64)
    return symbol[alive], np.cumsum(counts)


class Splitter:
    """Pre-tokens of a text, characters of `LATER` read as neither letters nor numbers."""

    def __init__(self):
        self.pattern = regex.compile(PATTERN)
        self.later = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER) + "]")

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not self.later.search(text):
            return self.pattern.findall(text)
        return [text[m.start():m.end()] for m in self.pattern.finditer(self.later.sub("\ue000", text))]


def encode_block(vocabulary: Vocabulary, texts: list[str | None], split: Splitter) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers; added tokens in a text become their ids."""
    known: dict[str, int] = {}
    parts: list[list[int]] = []
    for text in texts:
        out: list[int] = []
        for k, part in enumerate(vocabulary.split.split(text) if vocabulary.split and text else [text or ""]):
            if k % 2:
                out.append(-1 - vocabulary.added[part])
            elif part:
                out += [known.setdefault(p, len(known)) for p in split(part)]
        parts.append(out)
    ids, ends = merge_all(vocabulary, [p.encode() for p in known]) if known else (np.empty(0, np.int64), np.empty(0, np.int64))
    packed = ids.astype("<u4").tobytes()
    cuts = [0, *(ends * 4).tolist()]
    pieces = [packed[a:b] for a, b in zip(cuts, cuts[1:])]
    # Added tokens stand after the pieces, so that a negative number finds theirs.
    added = max(vocabulary.added.values(), default=-1) + 1
    pieces += [k.to_bytes(4, "little") for k in range(added - 1, -1, -1)]
    return [b"".join(map(pieces.__getitem__, out)) for out in parts]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Rows in blocks of `BLOCK_CHARS` characters or bytes in the second column, at least one row each."""
    for batch in batches:
        column = batch.column(1)
        sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(column), 0))
        block = np.cumsum(sizes) // BLOCK_CHARS
        edges = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)] if len(block) else np.array([0])
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            part = batch.slice(a, b - a)
            yield part, part.column(1).to_pylist()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit).

    `path` is the tokenizer file, at the same place on every executor.  Null counts as empty and has no
    tokens; a null id stays null; repeated rows are encoded each; other columns are not read.
    """

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, split = Vocabulary(path), Splitter()
        for part, texts in blocks(batches):
            ids = encode_block(vocabulary, texts, split)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(body, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` (doc_id, n_tokens, ids) with text for its ids; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = Vocabulary(path).bytes_of
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [b"".join([bytes_of.get(i, b"") for i in np.frombuffer(x or b"", "<u4").tolist()]).decode("utf-8", "replace") for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(body, "doc_id long, n_tokens long, ids binary, text string")
