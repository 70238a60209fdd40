"""Cases in which an operator once did less than its whole job."""

import base64
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridscan.llm import near_dedup, ordinal, secret_scan


def test_private_keys_go_with_their_bodies():
    body = base64.b64encode(random.Random(1).randbytes(600)).decode()
    lines = [body[k:k + 64] for k in range(0, len(body), 64)]
    scanner = secret_scan.Scanner()
    clean = lambda t: secret_scan.redact(t, scanner.spans(t))
    for kind in ("", "RSA ", "ENCRYPTED "):
        first, last = f"-----BEGIN {kind}PRIVATE KEY-----", f"-----END {kind}PRIVATE KEY-----"
        for glue in ("\n", "\r\n", "\n    ", "\\n", " ", '"\n"', ""):
            key = glue.join([first, *lines, last])
            assert clean(f"ü a {key} b, {key}\nc") == "ü a [pem] b, [pem]\nc"
            assert clean(glue.join([first, *lines])) == "[pem]"
            assert clean(glue.join([first, *lines]) + ". Then") == "[pem]. Then"
        headed = "\n".join([first, "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF", "", *lines])
        assert clean(f"{headed}\n{last}\nb") == "[pem]\nb" and clean(headed) == "[pem]"
        assert clean(f"{first}\n{last} b {first}") == "[pem] b [pem]"
        # Prose after a first line stays.
        assert clean(f"the line {first} and more.\nNote: this") == "the line [pem] and more.\nNote: this"
    text = "\n".join(["-----BEGIN PRIVATE KEY-----", "token=abcdef0123456789abcdef01234567", *lines, "-----END PRIVATE KEY-----"])
    assert [k for k, _, _ in scanner.spans(text)] == ["pem", "assign", "hex"] and clean(text) == "[pem]"


def between(n, first, last):
    """(doc_id, text) of families of two, whose similarities lie between the two shares."""
    rng = random.Random(11)
    out = []
    for k in range(n):
        w = [f"w{rng.randrange(10**9)}" for _ in range(204)]
        keep = rng.uniform(2 * first / (1 + first), 2 * last / (1 + last))  # of 200 shingles each
        cut = round(200 * (1 - keep))
        out += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[cut:] + [f"x{rng.randrange(10**9)}" for _ in range(cut)]))]
    return out


@pytest.mark.parametrize("link", [85, 80, 60])
def test_near_copies_at_a_link_percentage(spark, link):
    rows = between(150, 0.5, 0.99)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, link=link).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near(rows, link)


def test_banding_finds_links_as_surely_at_any_percentage():
    assert near_dedup.banding(85) == (4, 11)
    for link in range(50, 100):
        rows, tables = near_dedup.banding(link)
        assert 2 * (1 - (link / 100) ** rows) ** tables <= near_dedup.MISS and 2 * rows * tables <= 128


def test_pipeline_drops_near_copies_from_four_fifths(spark):
    rows = between(40, 0.81, 0.84)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()} == set(range(0, 80, 2))


def test_grades_see_whole_words():
    blob = "aB3+" * 5000
    for one, other in ((blob + "=" + blob, blob + "==-" + blob), ("x" * 40 + "1" * 40 + "tail", "x" * 40 + "1-" * 20 + "tail"), ("предложение", "приложение"), ("人工知能の研究", "自然言語の研究")):
        a, b = ordinal.features(one), ordinal.features(other)
        assert set(a[0]) != set(b[0])
    for text in (blob, "Ab1 ccc--D\x0b  e", "привет мир"):
        columns, weights, _ = ordinal.features(text)
        assert len(columns) == len(weights) and np.isclose((weights**2).sum(), 2, atol=0.5)
    assert ordinal.shape(b"aaA00 --a  a") == b"aA0 -a  a"
