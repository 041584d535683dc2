"""Best-fit packing: exact round trips, the plain best fit, and how few sequences come of it."""

import os
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from trailweave.llm import best_fit
from trailweave.llm.tokens import word_bpe_49k

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string"
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


class Letters:
    """A token a character; stands in for a vocabulary."""

    def ids(self, text):
        return np.frombuffer(text.encode("utf-32-le"), "<u4")

    def many(self, texts):
        return [self.ids(t) for t in texts]


def sequences(rows, length):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for q in by.values():
        at = 0
        for r in sorted(q, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
            assert len(r.ids) == 4 * r.length > 0
        assert at <= length
    return by


def round_trip(rows, texts, ids, length):
    """Every document is whole: cut only if longer than length, into whole pieces and a rest."""
    docs = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.piece):
        docs[r.doc_id].append(r)
    want = defaultdict(list)
    for doc_id, text in texts:
        want[doc_id].append([*ids(text or ""), 0])
    assert docs.keys() == want.keys()
    for doc_id, pieces in docs.items():
        assert sum(r.length for r in pieces) == sum(map(len, want[doc_id]))
        for r in pieces:
            assert r.start == r.piece * length
        got = Counter(bytes(r.ids) for r in pieces)
        cut = [w[i : i + length] for w in want[doc_id] for i in range(0, len(w), length)]
        assert got == Counter(np.array(c, "<u4").tobytes() for c in cut)


def test_ids_equal_those_of_tokenizers(spark):
    t = word_bpe_49k()
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect() if os.path.isdir(SF) else []
    odd = ["", " ", "a", "Hello, WORLD's 12,345!!! don't...", "<|endoftext|> a<|startoftext|>. b.<|endoftext|>", "é\xa0b é. ́x", "日本語 テスト。 日本.", "\x00\x1c a\x85b\x0bc", "x" * 3000 + ".", "KK İİ ΑΣ. Σ;", "it's 's ' s a.'s b.' c'.", "a.b, c..,; .5 5. -. ,", "ß¨.", "ﬁ ½."]
    for text in odd + [r.text for r in rows]:
        assert t.ids(text or "").tolist() == t.any.encode(text or "", add_special_tokens=False).ids
    fresh = type(t)(t.json_path)  # odd and plain words learnt in one call
    assert [x.tolist() for x in fresh.many(odd)] == [t.ids(x).tolist() for x in odd]


def test_best_fit_is_the_plain_one():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(1, 101, 400))[::-1]
    bins, places = best_fit.best_fit(sizes, 100)
    room: list[int] = []
    for s, b, p in zip(sizes.tolist(), bins.tolist(), places.tolist()):
        least = min((r for r in room if r >= s), default=None)
        if least is None:
            assert b == len(room)
            room.append(100)
        else:
            assert room[b] == least
        assert p == 100 - room[b]
        room[b] -= s


def test_odd_documents(spark):
    texts = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "null id."), (None, None), (4, "word " * 9000), (5, "a" * 5000), (6, "日本 語\x00")]
    df = spark.createDataFrame(texts, DOCS).withColumn("bin", F.lit("x")).withColumn("offset", F.lit(1)).withColumn("ids", F.lit(2))
    rows = best_fit.pack(df, word_bpe_49k).collect()
    sequences(rows, 2048)
    round_trip(rows, texts, word_bpe_49k().ids, 2048)
    assert best_fit.pack(df.where("false"), word_bpe_49k).count() == 0


@pytest.mark.parametrize("kind", ["mixed", "over half", "tiny"])
def test_many_blocks_give_as_few_sequences_as_one(spark, kind):
    rng = np.random.default_rng(11)
    sizes = {"mixed": rng.integers(0, 150, 3000), "over half": rng.integers(55, 90, 700), "tiny": rng.integers(0, 3, 3000)}[kind]
    texts = [(i, "x" * int(n)) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(texts, DOCS).repartition(9)
    rows = best_fit.pack(df, Letters, length=100, block_tokens=10_000, fan_in=3, spare=0, handed_on=16).collect()
    by = sequences(rows, 100)
    round_trip(rows, texts, Letters().ids, 100)
    pieces = np.array([p for n in sizes.tolist() for p in [100] * ((n + 1) // 100) + [(n + 1) % 100] if p])
    whole = best_fit.best_fit(np.sort(pieces)[::-1], 100)[0].max() + 1
    assert len(by) <= whole * 1.02 + 2
