"""Text operators against plain versions, on small tables with every awkward case."""

import hashlib
import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscan.llm import bpe, chat, exact_dedup, line_rules, near_dedup, ordinal, packing, passages, secret_scan, toxicity
from gridscan.llm.automata import compiled
from gridscan.llm.common import components

WORDS = "the of and with river stone cloud engine paper yellow north signal garden winter copper".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def edited(rng, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text): copies, near copies, shared passages, nulls, blanks, a very long text, repeated rows."""
    rng = random.Random(5)
    base, passage = prose(rng, 150), prose(rng, 60)
    out = [(i, prose(rng, rng.randrange(1, 120))) for i in range(60)]
    out += [(100 + i, base) for i in range(12)] + [(200 + i, edited(rng, base, i % 5)) for i in range(60)]
    out += [(300 + i, f"{prose(rng, 30)} {passage} {prose(rng, 30)}") for i in range(20)]
    out += [(400, None), (401, ""), (402, " \n\t "), (403, "a b c"), (404, "A b  C"), (405, "a b c d é"), (406, prose(rng, 30000)), (407, "Ünï " * 40 + "\n" + base.upper())]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns clash with names used inside; some rows stand twice, some have no id."""
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("h")).withColumn("row", F.lit(1)).withColumn("key", F.lit("k")).withColumn("n", F.lit(2))
    return d.repartition(5).cache()


@pytest.fixture(scope="module")
def odd(spark, docs, rows):
    no_id = spark.createDataFrame([(None, rows[60][1]), (None, "only here once more with some words"), (None, None)], "doc_id long, text string")
    return docs.union(docs.where("doc_id IN (3, 105, 400)")).unionByName(no_id, allowMissingColumns=True)


def empty(docs):
    return docs.where("false")


def test_exact_dedup(docs, odd, rows):
    squeeze = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(squeeze(t), []).append((-len(t or ""), i))
    want = {i: (min(groups[squeeze(t)])[1], len(groups[squeeze(t)]), hashlib.sha256(squeeze(t).encode()).hexdigest()) for i, t in rows}
    for bits in (64, 3):  # three bits: different chunks share hashes, which ordinals tell apart
        got = exact_dedup.dedup_exact(docs, hash_bits=bits).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == want
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    got = exact_dedup.dedup_exact(odd).collect()
    assert len(got) == odd.count()
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in got})
    assert exact_dedup.dedup_exact(empty(docs)).count() == 0


def test_chunks_cover_texts_and_follow_content():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 123, 200_000, np.uint8).tobytes()
    for d in (b"", b"x", data, b"a" * 100_000):
        ends = exact_dedup.cuts(d)
        assert ends == sorted(set(ends)) and (ends[-1:] == [len(d)] or not d)
        assert all(b - a <= exact_dedup.MOST for a, b in zip([0, *ends], ends))
    whole, moved = exact_dedup._chunks(data), exact_dedup._chunks(b"something else in front " + data)
    assert len(set(whole) & set(moved)) > 0.9 * len(whole)


def test_near_dedup(docs, odd, rows):
    want = brute.near(rows)
    got = near_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    again = near_dedup.near_duplicates(odd).collect()
    assert len(again) == odd.count()
    assert {(r.doc_id, r.component_id) for r in again if r.doc_id is not None} == {(i, c) for i, (_, c) in want.items()}
    assert {(r.component_id, r.kept) for r in again if r.doc_id is None} == {(100, False), (None, True)}
    assert near_dedup.near_duplicates(empty(docs)).count() == 0


def test_near_dedup_of_a_scattered_family(spark):
    """Copies with many edits each: most pairs share buckets and few link."""
    rng = random.Random(9)
    base = prose(rng, 150)
    rows = [(i, edited(rng, base, rng.randrange(7))) for i in range(400)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near(rows)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 6000 + i) for i in range(50)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in linked}


def test_passages(docs, odd, rows):
    want = brute.repeats(rows)
    got = passages.remove_repeats(docs).withColumn("sha", F.sha2("text", 256)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in got} == want
    again = passages.remove_repeats(odd).withColumn("sha", F.sha2("text", 256)).collect()
    assert len(again) == odd.count()
    assert {(r.doc_id, r.n_words, r.n_removed, r.sha) for r in again if r.doc_id is not None} == {(i, *x) for i, x in want.items()}
    assert {r.n_removed for r in again if r.doc_id is None} == {0}
    assert passages.remove_repeats(empty(docs)).count() == 0


def test_passages_in_many_shards(docs, rows, monkeypatch):
    monkeypatch.setattr(passages, "SHARD_PATTERNS", 40)
    monkeypatch.setattr(passages, "SHARD_STRETCHES", 15)
    got = passages.remove_repeats(docs).withColumn("sha", F.sha2("text", 256)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in got} == brute.repeats(rows)


def test_line_rules(spark, docs, odd, rows):
    rng = random.Random(4)
    lines = [prose(rng, 8) for _ in range(6)]
    made = [(i, "\n".join([prose(rng, 20), rng.choice(lines).upper().replace("1", "7"), rng.choice(lines), "", prose(rng, 20)]), rng.choice(["a", "b", "", None])) for i in range(120)]
    made += [(500, lines[0], "a"), (501, None, "a"), (502, "x y x y x y\nx y\n x y", "b"), (503, made[0][1], made[0][2])]
    d = spark.createDataFrame(made, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_rules.line_rules(d, max_docs=8).collect()}
    for (i, text, host), lost in zip(made, brute.line_removals(made, 8)):
        r, want = got[i], brute.line_measures(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.n_removed_words == lost and r.kept == (not r.base_failed and lost <= want[0] / 2)
    assert any(r.n_removed_words for r in got.values())
    clean = {r.doc_id: r.text for r in line_rules.without_lines(d, line_rules.line_rules(d, max_docs=8)).collect()}
    assert set(clean) == {i for i, r in got.items() if r.kept}
    assert all(len(clean[i].split()) == got[i].n_words - got[i].n_removed_words for i in clean)
    for r in line_rules.line_rules(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.line_measures(dict(rows)[r.doc_id])
    assert line_rules.line_rules(odd).count() == odd.count()
    assert line_rules.line_rules(empty(docs)).count() == 0


def test_line_limit_is_the_same_for_hosts_of_any_size(spark):
    rng = random.Random(8)
    head, foot, rare = prose(rng, 12), prose(rng, 9), prose(rng, 11)
    page = lambda *lines: "\n".join([prose(rng, 60), *lines])
    rows = [(i, page(*[head] * (i < 11), *[rare] * (i < 10)), "large") for i in range(1500)]
    rows += [(2000 + i, page(*[foot] * (i < 11)), "small") for i in range(12)]
    rows += [(3000, page(foot), "large")] * 15 + [(3001 + i, rows[0][1], None) for i in range(11)] + [(3100 + i, rows[0][1], "") for i in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    report = line_rules.line_rules(d)
    got = sorted((r.doc_id, r.n_removed_words, r.kept) for r in report.collect())
    want = brute.line_removals(rows, line_rules.MAX_DOCS)
    assert got == sorted((i, n, n <= len(t.split()) / 2) for (i, t, _), n in zip(rows, want))
    assert [n for n in want[:12]] == [12] * 11 + [0] and {n for (i, _, _), n in zip(rows, want) if i == 3000 or i >= 3100} == {0}
    # Eleven copies under the null host condemn themselves, ten under the empty one do not; rows that stand twice all stay.
    clean = line_rules.without_lines(d.withColumn("removed_lines", F.lit("x")).withColumn("_host", F.lit("y")), report)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for (i, t, _), n in zip(rows, want) if n <= len(t.split()) / 2)
    assert clean.columns == ["doc_id", "text", "source", "removed_lines", "_host"]


def test_lines_are_removed_by_the_host_of_their_row(spark):
    """Rows that share id and text but not host lose only what their own host repeats."""
    rng = random.Random(9)
    line, text = prose(rng, 10), prose(rng, 70)
    rows = [(1, f"{text}\n{line}", h) for h in ("a", "b", "b", None)] + [(10 + i, f"{prose(rng, 55)}\n{line}", "a") for i in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_rules.without_lines(d, line_rules.line_rules(d)).where("doc_id = 1").collect()
    assert sorted((r.source or "-", r.text) for r in got) == [("-", f"{text}\n{line}"), ("a", text), ("b", f"{text}\n{line}"), ("b", f"{text}\n{line}")]


def test_automata_match_regular_expressions():
    rng = random.Random(1)
    for pattern in (r"ab*c|(?:de)+", r"[a-c]{2,3}d?", r"(?i:ab)+[0-9]{2,}", r"a(b|c(d|e)*)f"):
        m, ref = compiled([pattern]), re.compile(pattern)
        for _ in range(400):
            text = "".join(rng.choice("abcdefABDE01") for _ in range(rng.randrange(9)))
            state = 0
            for b in text.encode():
                state = m.table[state + m.classes[b]]
            assert (state >= m.first) == bool(ref.fullmatch(text)), (pattern, text)


def test_secrets(odd, spark):
    rng = random.Random(3)
    bits = ["password", "PASSWD", "secret", "Token", "api_key", '"', "'", " ", ":", "=", "AKIA", "abcdef", "0123456789abcdef", "ABCDEF0123", "é", "x", ".", "-", "\n"]
    scanner = secret_scan.Scanner()
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert [x for x in scanner.spans(text) if x[0] in secret_scan.BASE] == brute.secrets(text), text
    text = "ü -----BEGIN RSA PRIVATE KEY----- and ghp_" + "a1B2" * 10 + " token=abcdef0123456789abcdef01234567"
    assert [k for k, _, _ in scanner.spans(text)] == ["pem", "github", "assign", "hex"]
    clean = secret_scan.redact(text, scanner.spans(text))
    assert clean == "ü [pem] and [github] [assign]" and secret_scan.redact(None, []) is None
    d = odd.union(odd.where("doc_id = 3").withColumn("text", F.lit(text)))
    got = secret_scan.scan_secrets(d).collect()
    assert len(got) == d.count() and sum(len(r.spans) > 0 for r in got) == 2
    assert secret_scan.scan_secrets(empty(odd)).count() == 0


def test_bpe_equals_the_tokenizers_library(docs, odd, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, vocabulary, split = Tokenizer.from_file(path), bpe.Vocabulary(path), bpe.Splitter()
    rng = random.Random(6)
    parts = ["a", "aaaa", "'s", " ", "  ", "\t", "\n", "\x1c", "\x85", "\xa0", "é", "中", "😀", "1", "½", "_", "<|endoftext|>", "<|endof", " the", "ing", "\x00", "\U000323b0", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(2000)] + [None, ""]
    for x, t in zip(bpe.encode_block(vocabulary, texts, split), texts):
        assert np.frombuffer(x, "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids
    got = bpe.decode(bpe.encode(odd, path), path).collect()
    assert len(got) == odd.count()
    for r in got:
        if r.doc_id is not None:
            e = library.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False)
            assert (r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (len(e.ids), e.ids) and r.text == (dict(rows)[r.doc_id] or "")
    assert bpe.decode(bpe.encode(empty(docs), path), path).count() == 0


def test_packing(spark, docs, odd):
    rng = np.random.default_rng(4)
    for sizes in ((8, 16, 32), (10,), (7, 64)):
        lengths = rng.integers(1, max(sizes) + 1, 300)
        bins, offsets, capacity, used = packing.best_fit(lengths, sizes)
        for b in range(len(capacity)):
            inside = np.flatnonzero(bins == b)
            spans = sorted((offsets[k], offsets[k] + lengths[k]) for k in inside)
            assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] == used[b]
            assert capacity[b] == min(s for s in sizes if s >= used[b])
        assert capacity.sum() <= 1.1 * lengths.sum() + max(sizes) if len(sizes) > 1 else True
        # No two bins of the plan fit into one of the largest size.
        least = np.sort(used)[:2]
        assert len(used) < 2 or least.sum() > max(sizes)
    got = packing.pack_documents(odd, sizes=(64, 256)).toPandas()
    words = odd.select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).alias("n")).toPandas()
    assert got.n_words.sum() == words.n.sum() and (got[got.bin_id.notna()].groupby("bin_id").n_words.sum() == got[got.bin_id.notna()].groupby("bin_id").used.first()).all()
    one = got[got.doc_id == 406].sort_values("first_word")
    assert one.n_words.sum() == 30000 and (one.first_word.iloc[1:].values == (one.first_word + one.n_words).iloc[:-1].values).all()
    assert set(got[got.bin_id.isna()].doc_id.dropna()) == {400, 401, 402}
    assert packing.pack_documents(empty(docs)).count() == 0


def test_toxicity(spark, odd, docs):
    rng = random.Random(8)
    bad = ["villain", "scoundrel", "blackguard"]
    made = [(i, prose(rng, 40) + (" " + rng.choice(bad) if i % 3 == 0 else "")) for i in range(900)]
    d = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(900)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, labels).collect()}
    held = [r for r in got.values() if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in held) > 0.85 * len(held)
    weights = toxicity.train(d, labels)
    plain, misspelt = toxicity.logits(["the river7 stone9 garden4 north1 paper2", "the river7 stone9 viillain north1 paper2"], weights)
    assert misspelt > plain
    assert toxicity.score_toxicity(odd, labels.where("false")).where("score BETWEEN 0 AND 1 AND predicted IN (0, 1)").count() == odd.count()
    assert toxicity.score_toxicity(empty(docs), labels).count() == 0


def test_ordinal(spark, odd, docs):
    rng = random.Random(10)
    marks = ["dull", "fair fair2", "bright bright2 bright3"]
    made = [(i, prose(rng, 30) + " " + marks[i % 3]) for i in range(900)]
    d = spark.createDataFrame(made, "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 3) for i in range(900)] + [(None, 1), (7, None)], "doc_id long, grade int")
    held = [r for r in ordinal.grade_texts(d, ratings, 3).collect() if r.held_out]
    means = [np.mean([r.expected_grade for r in held if r.doc_id % 3 == g]) for g in range(3)]
    assert means[0] < means[1] < means[2]
    assert np.mean([r.kept == (r.doc_id % 3 >= 1) for r in held]) > 0.9
    assert ordinal.grade_texts(odd, ratings.where("false"), 3).where("p_tail BETWEEN 0 AND 1").count() == odd.count()
    assert ordinal.grade_texts(empty(docs), ratings, 3).count() == 0


def test_chat_of_conversations(spark):
    rows = [(1, 0, "user", "a\\b <s>[INST]"), (1, 1, "assistant", None), (1, 1, "assistant", "x<|im_end|>\n<|im_start|>user\n"), (2, 5, None, "only"), (None, None, "us\ner", "t"), (None, 3, "assistant", "\\"), (3, 0, "user", "twice"), (3, 0, "user", "twice")]
    rows += [(9, t, "user" if t % 2 == 0 else "assistant", f"turn {t} </s>") for t in range(700)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("x"))
    out = chat.format_branches(chat.conversation_nodes(d)).withColumn("turns", chat.read_back(F.col("formatted")))
    got = {r.tree: r for r in out.collect()}
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: ((r[0] is None, r[0] or 0), r[1] if r[1] is not None else -1, r[2] or "", r[3] or "")):
        want.setdefault("" if c is None else str(c), []).append((r or "", x or ""))
    assert {t: [(x.role, x.text) for x in r.turns] for t, r in got.items()} == want
    for t, r in got.items():
        assert "".join(s.text for s in r.segments) == r.formatted
        assert [s.text.replace("\\\\", "\0").replace("\\", "").replace("\0", "\\") for s in r.segments if s.loss] == [x for role, x in want[t] if role == "assistant"]
    assert chat.format_branches(chat.conversation_nodes(d.where("false"))).count() == 0


def test_chat_of_trees(spark):
    rng = random.Random(12)
    nodes = []
    for tree in "abc":
        for n in range(60):
            nodes.append((tree, n, rng.randrange(n) if n and rng.random() < 0.95 else None, float(rng.randrange(5))))
    nodes += [("loop", 1, 2, 1.0), ("loop", 2, 1, 1.0), ("orphan", 5, 99, None), ("one", 1, None, 0.0)]
    d = spark.createDataFrame([(t, n, p, s, "user", f"{t}{n}") for t, n, p, s in nodes], "tree string, node long, parent long, score double, role string, text string")
    got = {r.tree: [x.text for x in r.turns] for r in chat.format_branches(d).withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert got == {t: [f"{t}{n}" for n in path] for t, path in brute.branches(nodes).items()}
    several = chat.format_branches(d, per_tree=3)
    assert several.where("tree = 'a'").count() == 3
    assert "Python" not in several._jdf.queryExecution().executedPlan().toString()
