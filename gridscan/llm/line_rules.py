"""Quality rules with cross-document line frequency.

Lines are normalised (lower case, single spaces, digits as 0) and hashed together with their host.  A line
that more than `MAX_DOCS` distinct documents of a host hold is boilerplate: it is removed, and a document that
loses most of its words with it is rejected.  The limit is a number of documents, whatever the size of the host.
Copies are documents: deduplicate first where lines should be counted over different texts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gridscan.llm.common import long_lists, written

#: A line goes when more distinct documents of its host than this have it.
MAX_DOCS = 10
#: A document is depleted when it loses more than this share of its words.
DEPLETED = 0.5
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
DIGITS = str.maketrans("123456789", "000000000")


def line_key(host: str | None, found: list[bytes]) -> int:
    """Signed 64-bit key of a line's normalised words under its host; a null host differs from an empty one."""
    norm = b" ".join(found).decode().lower().translate(DIGITS).encode()
    return xxhash.xxh3_64_intdigest((b"" if host is None else b"@" + host.encode()) + b"\n" + norm) - (1 << 63)


def repeated_words(found: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more in the text."""
    n = len(found)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in found], np.int64)
    if len(ids) == n:
        return 0
    pairs = np.unique(a[:-2] * len(ids) + a[1:-1], return_inverse=True)[1]
    _, which, counts = np.unique(pairs * len(ids) + a[2:], return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:k + n - 2] |= twice
    return int(covered.sum())


def measures(host: str | None, text: str | None) -> tuple[int, int, int, int, int, dict[int, int]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words by line key)."""
    text = text or ""
    by_line: dict[int, int] = {}
    seen: set[bytes] = set()
    found: list[bytes] = []
    dup = 0
    for line in text.encode().split(b"\n"):
        w = line.split()
        if w:
            dup += line in seen
            seen.add(line)
            found += w
            key = line_key(host, w)
            by_line[key] = by_line.get(key, 0) + len(w)
    return len(found), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated_words(found), by_line


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            made = [measures(h, t) for h, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            keys = [np.fromiter(m[5].keys(), np.int64, len(m[5])) for m in made]
            sizes = [np.fromiter(m[5].values(), np.int64, len(m[5])) for m in made]
            yield pa.RecordBatch.from_arrays([
                *part.columns[:3], *[pa.array([m[k] for m in made], pa.int64()) for k in range(5)], long_lists(keys), long_lists(sizes),
            ], names=["_id", "_content", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "sizes"])


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
               max_docs: int = MAX_DOCS, depleted: float = DEPLETED) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, n_removed_words, removed_lines (keys), host and `_content` (names the row for `rows_of`).

    A document is a pair of id and text within a host, so repeated rows count once for a line and are judged
    alike, and rows without an id count once a text.  Null text has no words and fails; a null host is a host of
    its own.  Texts of any length are read whole; other columns are not read; an empty table gives an empty one.
    """
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_content"),
                       F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("_text"))
    found = written(base.mapInArrow(_measure_batches, "_id long, _content long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<bigint>, sizes array<bigint>")
                    .withColumn("row", F.monotonically_increasing_id()), "measures")

    documents = found.groupBy("host", "_id", "_content").agg(F.min("row").alias("row")).select("row")
    lines = found.join(documents, "row", "left_semi").select(F.explode("lines").alias("line"))
    frequent = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_docs).select("line")  # keys name the host
    frequent = written(frequent, "frequent-lines")

    each = found.select("row", F.explode(F.arrays_zip(F.col("lines").alias("line"), F.col("sizes").alias("size"))).alias("x")).select("row", F.col("x.line").alias("line"), F.col("x.size").alias("size"))
    lost = each.join(frequent, "line").groupBy("row").agg(F.sum("size").alias("n_removed_words"), F.collect_set("line").alias("removed_lines"))
    out = found.join(lost, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    kept = ~F.col("base_failed") & (F.col("n_removed_words") <= depleted * F.col("n_words"))
    return out.withColumn("kept", kept).select(F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words",
                                               F.coalesce("removed_lines", F.array().cast("array<bigint>")).alias("removed_lines"), "host", "_content")


def without_lines(docs: DataFrame, report: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of `docs` that `report` keeps, their text without the lines it removes; other columns as they are.

    Rows and judgements meet by id, text and host, nulls like values; rows alike in all three are judged alike and
    all stay.  Null texts, which have no words, are never kept.  An empty table gives an empty one.
    """

    @F.pandas_udf("string")
    def stripped(texts: pd.Series, hosts: pd.Series, removed: pd.Series) -> pd.Series:
        out = []
        for text, host, keys in zip(texts, hosts, removed):
            gone = set(keys)
            out.append("\n".join(x for x in text.split("\n") if not (w := x.encode().split()) or line_key(host, w) not in gone) if gone else text)
        return pd.Series(out, dtype=object)

    r = report.where("kept").select(F.col("doc_id").alias("_id"), "_content", F.col("host").alias("_host"), "removed_lines").dropDuplicates(["_id", "_content", "_host"])
    content = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    joined = docs.join(r, docs[id_col].cast("long").eqNullSafe(r["_id"]) & (content == r["_content"]) & docs[host_col].cast("string").eqNullSafe(r["_host"]))
    return joined.select(*[stripped(docs[text_col], r["_host"], r["removed_lines"]).alias(c) if c == text_col else docs[c] for c in docs.columns])
