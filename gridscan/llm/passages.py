"""Removal of repeated passages by recurring-phrase automata.

1. Anchors: every window of 13 words has one anchor, the least of its seven 7-word hashes.  Equal windows have
   equal anchors, so an anchor that only one text holds clears all windows it stands for.
2. Confirmation: windows whose anchor recurs are counted over all texts; those that recur are confirmed, with
   the smallest document that has them, and their words are taken from that document.
3. Automata: confirmed windows are dealt to shards by anchor; a shard compiles a few Aho-Corasick automata over
   words and streams all stretches of text with their anchors through them, which locates every occurrence.  A
   shard with many stretches is dealt out with its automata repeated, so a passage that a third of all texts
   share is not one task's work.

Every document goes through all steps; copies of one text are judged once, through the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, functions as F

from gridscan.llm.common import ODD, discard, gram_hashes, laid_out, mix, written

WINDOW, GRAM = 13, 7
SHARD_PATTERNS, SHARD_STRETCHES = 10_000, 100_000
#: Automata of a shard, letters of a digit, stretches in a row.
AUTOMATA, BASE, PACKED = 16, 1024, 64
SLICE_BYTES, LONG_WORD = 1 << 22, 64
IN_WORD = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Words:
    """Words of a column of texts in a row: bytes `data`, places `begin` to `end`, and `sizes`, the number of words of each text."""

    def __init__(self, texts: pa.Array):
        texts = pa.compute.fill_null(texts.cast(pa.large_binary()), b"")
        _, offsets, data = texts.buffers()
        self.offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        first, last = self.offsets[0], self.offsets[-1]
        self.offsets = self.offsets - first
        self.data = np.zeros(last - first + 8, np.uint8)  # eight zeros, so that eight bytes can be read anywhere
        if last > first:
            self.data[:-8] = np.frombuffer(data, np.uint8)[first:last]
        inside = IN_WORD[self.data]
        inside[-8:] = False
        ends, filled = inside.copy(), np.flatnonzero(np.diff(self.offsets))
        ends[:-1] &= ~inside[1:]
        last_byte = self.offsets[1:][filled] - 1
        ends[last_byte] = inside[last_byte]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        first_byte = self.offsets[:-1][filled]
        begins[first_byte] = inside[first_byte]
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.sizes = np.diff(np.searchsorted(self.begin, self.offsets))

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word: eight bytes at a time, of words beyond LONG_WORD bytes each for itself."""
        eight = np.ndarray(len(self.data) - 7, np.dtype("<u8"), self.data, strides=(1,))
        size = self.end - self.begin
        out = size.astype(np.uint64) * ODD
        rows, at = np.arange(len(size)), 0
        while len(rows):
            left = size[rows] - at
            out[rows] = mix((out[rows] * ODD) ^ (eight[self.begin[rows] + at] & LOW_BYTES[np.minimum(left, 8)]))
            at += 8
            rows = rows[(left > 8) & (size[rows] <= LONG_WORD)]
        for k in np.flatnonzero(size > LONG_WORD).tolist():
            out[k] = xxhash.xxh3_64_intdigest(self.data[self.begin[k]:self.end[k]])
        return out


def slices(batch: pa.RecordBatch, text: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows and about SLICE_BYTES of the text column."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        n = min(rows, max(1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")) - at))
        yield batch.slice(at, n)
        at += n


def places_in(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all words in a row: the text of each and its place in the text."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def anchors(h: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, text, first window, number of windows) of each run of windows that share an anchor place."""
    span = window - GRAM + 1
    best = gram_hashes(h, GRAM)
    place = np.arange(len(best))
    width = 1
    # Running minimum in doubling steps; the rightmost least hash of a window is its anchor.
    while width < span:
        step = min(width, span - width)
        m = max(0, len(best) - step)
        right = best[step:] <= best[:m]
        place = np.where(right, place[step:], place[:m])
        best = np.where(right, best[step:], best[:m])
        width += step
    text, at = places_in(sizes)
    whole = np.flatnonzero(at[:len(best)] + window <= sizes[text[:len(best)]])
    best, place, text, at = best[whole], place[whole], text[whole], at[whole]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])]) if len(whole) else whole
    return best[new], text[new], at[new], np.diff(np.r_[new, len(whole)])


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _anchor_places(batches: Iterator[pa.RecordBatch], window: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """(anchor, number of rows of a slice with it) or, `whole`, (anchor, id, content, first window, number of windows)."""
    for batch in batches:
        for part in slices(batch, 2, 512):
            found = Words(part.column(2))
            anchor, of, first, n = anchors(found.hashes(), found.sizes, window)
            if not whole:
                _, once = np.unique(mix(anchor + ODD * of.astype(np.uint64)), return_index=True)  # a text counts once
                found, times = np.unique(anchor[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([_longs(found), _longs(times)], names=["anchor", "times"])
                continue
            ids, contents = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([_longs(anchor), _longs(ids[of]), _longs(contents[of]), _longs(first), _longs(n)], names=["anchor", "_id", "_content", "first", "n"])


def _runs(part: pa.RecordBatch, window: int) -> tuple[Words, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (id, content, text, runs): words, text of each run, fields of the runs, first word of each run, all windows, and those of the runs."""
    found = Words(part.column(2))
    runs, counts = part.column(3).flatten(), pa.compute.list_value_length(part.column(3)).to_numpy(zero_copy_only=False)
    fields = [runs.field(k).to_numpy() for k in range(runs.type.num_fields)]
    of = np.repeat(np.arange(len(counts)), counts)
    first, n = fields[:2]
    offsets = np.r_[0, np.cumsum(n)]
    begin = (np.cumsum(found.sizes) - found.sizes)[of] + first
    return found, of, fields, begin, gram_hashes(found.hashes(), window), np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], n)


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(window, anchor, id) of all windows of runs (first, n, anchor)."""
    for batch in batches:
        for part in slices(batch, 2, 512):
            _, of, (_, n, anchor), _, windows, places = _runs(part, window)
            ids = part.column(0).to_numpy(zero_copy_only=False)[of]
            yield pa.RecordBatch.from_arrays([_longs(windows[places]), _longs(np.repeat(anchor, n)), _longs(np.repeat(ids, n))], names=["window", "anchor", "_id"])


PACKS = "lane long, _id array<long>, _content array<long>, first array<long>, automaton array<long>, phrase array<binary>, starts array<array<int>>"


def _dealt(batches: Iterator[pa.RecordBatch], window: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Stretches of text, one a run (first, n, automaton, parts), and patterns: stretches with confirmed windows that first stand in their document.

    A shard and a part are one number; `lane` is twice that for patterns, one more for stretches.  A row has
    several of one lane.
    """
    for batch in batches:
        for part in slices(batch, 2, 2048):
            found, of, (first, n, automaton, parts), begin, windows, places = _runs(part, window)
            ids, contents = (part.column(k).to_numpy(zero_copy_only=False)[of] for k in (0, 1))
            shard = automaton // AUTOMATA
            lane = 2 * (shard + shards * ((ids * 31 + first) % parts)) + 1
            data = found.data.tobytes()
            phrases = [data[b:e] for b, e in zip(found.begin[begin].tolist(), found.end[begin + n + window - 2].tolist())]

            wanted = pa.compute.fill_null(pa.compute.list_value_length(part.column(4)), 0).to_numpy(zero_copy_only=False)
            named = lambda text, w: mix(w.view(np.uint64) + ODD * text.astype(np.uint64))
            known = named(np.repeat(np.arange(len(wanted)), wanted), part.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            held = np.flatnonzero(np.isin(named(np.repeat(of, n), windows[places]), known))
            run = np.repeat(np.arange(len(of)), n)[held]
            start = (places[held] - begin[run]).astype(np.int32)
            runs, at, starts = np.unique(run, return_index=True, return_counts=True)
            # A pattern goes to all parts of its shard.
            copies = parts[runs]
            rows, at, starts = np.repeat(runs, copies), np.repeat(at, copies), np.repeat(starts, copies)
            lanes = 2 * (shard[rows] + shards * (np.arange(len(rows)) - np.repeat(np.cumsum(copies) - copies, copies)))
            offsets = np.r_[0, np.cumsum(starts)]
            start = start[np.arange(offsets[-1]) + np.repeat(at - offsets[:-1], starts)]

            rows, lanes = np.r_[np.arange(len(of)), rows], np.r_[lane, lanes]
            starts = pa.ListArray.from_arrays(np.r_[np.zeros(len(of), np.int64), offsets].astype(np.int32), pa.array(start))
            order = np.argsort(lanes, kind="stable")
            rows, lanes, starts = rows[order], lanes[order], starts.take(pa.array(order))
            new = np.flatnonzero(np.r_[True, lanes[1:] != lanes[:-1]]) if len(lanes) else np.empty(0, np.int64)
            cuts = np.concatenate([np.arange(a, b, PACKED) for a, b in zip(new, np.r_[new[1:], len(lanes)])] or [new]).astype(np.int32)
            packed = lambda x: pa.ListArray.from_arrays(pa.array(np.r_[cuts, len(lanes)].astype(np.int32)), x)
            columns = [_longs(x[rows]) for x in (ids, contents, first, automaton)] + [pa.array([phrases[k] for k in rows.tolist()], pa.binary()), starts]
            yield pa.RecordBatch.from_arrays([_longs(lanes[cuts]), *map(packed, columns)], names=["lane", "_id", "_content", "first", "automaton", "phrase", "starts"])


class Automaton:
    """Aho-Corasick over words.

    A word is spelt as a number in base BASE, each digit in letters of its own, so matches begin and end with
    words.  Words of no pattern are spelt with a letter of no pattern.
    """

    def __init__(self, window: int):
        self.window, self.code, self.first, self.machine, self.known = window, {}, {}, None, {}

    def add(self, phrase: bytes, starts: list[int], doc: int) -> None:
        """Windows of a confirmed passage, at word offsets in it, that first stand in `doc`."""
        code = self.code
        ids = tuple([code.setdefault(w, len(code)) for w in phrase.split()])
        for s in starts:
            key = ids[s:s + self.window]
            self.first[key] = min(doc, self.first.get(key, doc))

    def compile(self) -> None:
        self.digits = 1
        while BASE ** self.digits < len(self.code):
            self.digits += 1
        spelt = ["".join(chr(2 + BASE * d + n // BASE ** d % BASE) for d in range(self.digits)) for n in range(len(self.code))]
        self.spelling, self.other = dict(zip(self.code, spelt)), "\x01" * self.digits
        self.machine = ahocorasick.Automaton()
        for key, doc in self.first.items():
            self.machine.add_word("".join([spelt[n] for n in key]), doc)
        if self.first:
            self.machine.make_automaton()

    def found(self, phrase: bytes) -> tuple[int, list[tuple[int, int]]]:
        """(smallest first document, (word offset, first document) of every confirmed window) of a stretch; like stretches are read once."""
        got = self.known.get(phrase)
        if got is None:
            if len(self.known) > SHARD_STRETCHES:
                self.known.clear()
            spell, other, digits, window = self.spelling.get, self.other, self.digits, self.window
            letters = "".join([spell(w, other) for w in phrase.split()])
            at = [((end + 1) // digits - window, doc) for end, doc in self.machine.iter(letters)] if self.first else []
            got = self.known[phrase] = (min([doc for _, doc in at]), at) if at else NOTHING
        return got


#: No document is below the first document of no window.
NOTHING = ((1 << 63) - 1, [])


def _locate(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by lane, so patterns before stretches, to covered ranges (id, content, start, n).

    A pattern has the word offsets of the windows that its document is the first to hold.
    """
    shard, machines = None, {}
    for batch in batches:
        out: list[list[np.ndarray]] = []
        for row, lane in enumerate(batch.column(0).to_pylist()):
            if lane >> 1 != shard:
                shard, machines = lane >> 1, {}
            # A row holds several stretches of one lane.
            ids, contents, first, automata = (batch.column(k)[row].values.to_numpy() for k in range(1, 5))
            phrases = batch.column(5)[row].values.to_pylist()
            if not lane & 1:
                for i, a, phrase, starts in zip(ids.tolist(), automata.tolist(), phrases, batch.column(6)[row].values.to_pylist()):
                    if a not in machines:
                        machines[a] = Automaton(window)
                    machines[a].add(phrase, starts, i)
                continue
            rows, begins, sizes = [], [], []
            for k, (i, a, phrase) in enumerate(zip(ids.tolist(), automata.tolist(), phrases)):
                machine = machines.get(a)
                if machine is None:
                    continue
                if machine.machine is None:
                    machine.compile()
                least, found = machine.found(phrase)
                if least >= i:
                    continue
                begin = end = -1
                for at, doc in found:
                    if doc < i:
                        if at > end:
                            if end > 0:
                                rows.append(k)
                                begins.append(begin)
                                sizes.append(end - begin)
                            begin = at
                        end = at + window
                rows.append(k)
                begins.append(begin)
                sizes.append(end - begin)
            if rows:
                out.append([ids[rows], contents[rows], first[rows] + begins, np.array(sizes)])
        if out:
            yield pa.RecordBatch.from_arrays([_longs(np.concatenate(x)) for x in zip(*out)], names=["_id", "_content", "start", "n"])


def _kept(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(id, text, ranges) to words that no range covers; a range from -1 covers a copy: all its words, if it has windows."""
    for batch in batches:
        for part in slices(batch, 1, 2048):
            found = Words(part.column(1))
            total, words_before = found.sizes, np.r_[0, np.cumsum(found.sizes)]
            ranges, counts = part.column(2).flatten(), pa.compute.fill_null(pa.compute.list_value_length(part.column(2)), 0).to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(total)), counts)
            start, n = (ranges.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            copy = start < 0
            n = np.where(copy, np.where(total[of] >= window, total[of], 0), n)
            start = words_before[of] + np.where(copy, 0, start)
            covered = np.zeros(len(found.begin) + 1, np.int64)
            np.add.at(covered, start, 1)
            np.add.at(covered, start + n, -1)
            keep = np.flatnonzero(np.cumsum(covered)[:-1] == 0)
            text = np.searchsorted(words_before, keep, "right") - 1
            kept = np.bincount(text, minlength=len(total))
            # A kept word takes along the one byte behind it, as a space, unless it is the last of its text.
            last = np.r_[text[1:] != text[:-1], True] if len(text) else np.empty(0, bool)
            edges = np.zeros(len(found.data) + 1, np.int8)
            edges[found.begin[keep]] += 1
            edges[found.end[keep] + ~last] -= 1
            data = np.where(IN_WORD[found.data], found.data, np.uint8(32))
            taken = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
            bytes_of = np.bincount(text, (found.end - found.begin)[keep] + ~last, len(total)).astype(np.int64)
            offsets = np.r_[0, np.cumsum(bytes_of)].astype(np.int64)
            texts = pa.LargeStringArray.from_buffers(len(total), pa.py_buffer(offsets), pa.py_buffer(data[taken])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), _longs(total), _longs(total - kept), texts], names=["doc_id", "n_words", "n_removed", "text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, text (kept words joined by one space).

    A word goes if a window of `window` words that covers it also starts in a document with a smaller id.
    Windows are judged on the input.  Null and short texts have no windows.  Rows with a null id lose nothing
    and take nothing from others; rows that share an id take nothing from each other.  Other columns are not
    read; an empty table gives an empty one.
    """
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_content"), F.col(text_col).alias("_text"))
    named = base.where("_id IS NOT NULL")

    # Copies of one text: the first stays to be judged, from the others every window goes.  Texts move once, to
    # where all later joins on (id, content) find them.
    counted = named.select("_id", "_content", F.sha2(F.coalesce("_text", F.lit("")), 256).alias("sha")).distinct()
    firsts = written(counted.groupBy("sha").agg(F.min("_id").alias("first_id")), "first-copies")
    copies = written(counted.join(firsts, "sha").groupBy("_id", "_content").agg(F.min(F.col("_id") > F.col("first_id")).alias("copy")), "copies")
    texts = laid_out(named.join(copies, ["_id", "_content"]), ["_id", "_content"], "texts")
    judged = texts.where("NOT copy").select("_id", "_content", "_text")

    # Joins with sets of unique keys hash those and leave the many rows unsorted.
    among = lambda rows, keys, on: rows.join(keys.hint("shuffle_hash"), on, "left_semi")
    times = judged.mapInArrow(lambda b: _anchor_places(b, window, False), "anchor long, times long")
    recurring = written(times.groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1").select("anchor"), "anchors")
    places = judged.mapInArrow(lambda b: _anchor_places(b, window, True), "anchor long, _id long, _content long, first long, n long")
    places = written(among(places, recurring, "anchor"), "places")

    def with_text(runs: DataFrame) -> DataFrame:
        return judged.join(runs, ["_id", "_content"]).select("_id", "_content", "_text", *[c for c in runs.columns if c[0] != "_"])

    # A window has one anchor, so the anchor as a second key changes no group.
    runs = places.groupBy("_id", "_content").agg(F.collect_list(F.struct("first", "n", "anchor")).alias("runs"))
    each = with_text(runs).mapInArrow(lambda b: _windows(b, window), "window long, anchor long, _id long")
    confirmed = written(each.groupBy("window", "anchor").agg(F.min("_id").alias("_id"), F.max("_id").alias("hi")).where("_id < hi").select("anchor", "_id", "window"), "confirmed")

    shards = max(1, -(-confirmed.count() // SHARD_PATTERNS))
    telling = written(confirmed.select("anchor").distinct(), "telling-anchors")
    used = among(places, telling, "anchor").withColumn("automaton", F.pmod(F.xxhash64("anchor"), F.lit(shards * AUTOMATA))).withColumn("shard", F.floor(F.col("automaton") / AUTOMATA))
    parts = written(used.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD_STRETCHES).cast("long").alias("parts")), "shard-parts")
    runs = used.join(parts, "shard").groupBy("_id", "_content").agg(F.collect_list(F.struct("first", "n", "automaton", "parts")).alias("runs"))
    wanted = confirmed.groupBy("_id").agg(F.collect_set("window").alias("wanted"))
    runs = written(runs.join(wanted, "_id", "left"), "runs")
    discard(places, recurring, telling, confirmed, parts)
    dealt = with_text(runs).mapInArrow(lambda b: _dealt(b, window, shards), PACKS)
    # One long key: rows are sorted by radix, not compared.
    both = dealt.repartition(F.shiftright("lane", 1)).sortWithinPartitions("lane")
    located = both.mapInArrow(lambda b: _locate(b, window), "_id long, _content long, start long, n long")

    ranges = located.union(copies.where("copy").select("_id", "_content", F.lit(-1).cast("long"), F.lit(0).cast("long")))
    ranges = written(ranges.groupBy("_id", "_content").agg(F.collect_set(F.struct("start", "n")).alias("ranges")), "ranges")
    discard(runs, firsts, copies)
    out = texts.join(ranges, ["_id", "_content"], "left").select(F.col("_id").alias("doc_id"), "_text", "ranges")
    out = out.union(base.where("_id IS NULL").select("_id", "_text", F.lit(None).cast(out.schema["ranges"].dataType)))
    return out.mapInArrow(lambda b: _kept(b, window), "doc_id long, n_words long, n_removed long, text string")
