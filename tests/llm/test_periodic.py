"""Periodic runs against a plain search, on planted, random, odd and very repetitive texts."""

import hashlib
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.llm import periodic, queries

DOCS = "doc_id long, text string"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(12, 2 * q):
                found.setdefault((s, i + q - s), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def planted_words(doc_id, words):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain(doc_id, text):
    words = planted_words(doc_id, (text or "").encode().split())
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def answers(df):
    rows = queries.digests_of_runs(periodic.runs(periodic.planted(df))).collect()
    return [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in rows]


def by_text(rows):
    return sorted(rows, key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert by_text(answers(df)) == by_text(plain(r.doc_id, r.text) for r in df.collect() if True)


def repetitive(rng):
    """Runs of one word, of short and long periods, broken ones, runs in runs, words of two kinds only."""
    w = lambda n, k: [f"w{i}" for i in rng.integers(0, k, n)]
    unit = w(40, 500)
    yield ["a"] * 400
    yield ["a", "b"] * 150 + ["c"] + ["a", "b"] * 7
    yield unit * 6 + w(9, 5) + unit * 3
    yield (["x"] * 13 + ["y"]) * 9
    yield ((["x", "y"] * 7 + ["z"]) * 5 + ["q"] * 30) * 3
    yield w(700, 2)
    yield w(900, 3)
    long = w(300, 4000)
    yield w(5, 9) + long * 2 + long[:100] + w(5, 9)
    broken = long * 4
    broken[650] = "other"
    yield broken
    yield w(3, 2) * 4
    yield ["s"] * 11
    yield ["s"] * 12


def test_repetitive_texts(spark):
    rng = np.random.default_rng(2)
    rows = [(3 * i + 1, " ".join(t)) for i, t in enumerate([x for _ in range(3) for x in repetitive(rng)])]
    assert by_text(answers(spark.createDataFrame(rows, DOCS))) == by_text(plain(*r) for r in rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "one two"), (None, None), (4, "a " * 30), (4, "a " * 30), (5, "x" * 9000), (6, "日本\xa0 語\x1c a\x0bb " * 20), (-7, "é\x00 " * 12)]
    df = spark.createDataFrame(rows, DOCS).withColumn("runs", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("start", F.lit(2))
    assert by_text(answers(df)) == by_text(plain(*r) for r in rows)
    assert answers(df.where("false")) == []


@pytest.mark.parametrize("always", ["pairs", "transform"])
def test_counts_are_the_same_either_way(monkeypatch, always):
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, k, n) for k, n in ((1, 50), (2, 301), (40, 1000), (9, 0), (9, 1), (3, 2))]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    codes = np.concatenate([t + 100 * i for i, t in enumerate(texts)])
    monkeypatch.setattr(periodic, "PAIR_NS", 0 if always == "pairs" else 10**9)
    counts, base = periodic.lag_counts(codes, starts)
    for d, t in enumerate(texts):
        want = [0] + [int((t[q:] == t[:-q]).sum()) for q in range(1, len(t) // 2 + 1)]
        assert counts[base[d] : base[d + 1]].tolist() == want


def test_a_very_long_text_of_one_word_is_searched_at_one_lag(monkeypatch):
    searched = []
    monkeypatch.setattr(periodic, "_long_lag", lambda words, lag: searched.append(lag) or ())
    n = 200_000
    assert periodic.periodic_runs(np.zeros(n, np.int64), np.array([0, n])) == [[(0, n, 1)]]
    assert searched == []
