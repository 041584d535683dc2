"""Operator 9 works on slices: the same words and grams as a plain reading of each text."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trailweave.llm import suffix_tree

ODD = [None, "", " \t\n\x0b\x0c\r ", "a", "A  b\n\n\nC", "\x00 \x00\x1c\x1d \x85\xa0 İ ẞ", "x" * 40, "  ab ab\tab ", "日本 語 ", " " * 1000 + "z"]


def plain_grams(texts, depth):
    for text in texts:
        data = b"\n" * depth + b" ".join(suffix_tree.words_of(text)) + b"\n"
        yield [int.from_bytes(data[i - depth : i + 1], "big") for i in range(depth, len(data))]


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([i % 3 > 0 for i in range(len(texts))])], ["text", "trains"])


@pytest.mark.parametrize("depth", [0, 1, 4, 6])
@pytest.mark.parametrize("texts", [ODD, ODD[:3], []])
def test_grams_of_odd_texts(depth, texts):
    want = list(plain_grams(texts, depth))
    keys, sizes = suffix_tree.grams([suffix_tree.words_of(t) for t in texts], depth)
    assert keys.tolist() == [k for ks in want for k in ks] and sizes.tolist() == [len(ks) for ks in want]
    counts = Counter({k: 0 for ks in want for k in ks})
    counts.update(k for i, ks in enumerate(want) if i % 3 for k in ks)
    got = Counter()
    for b in suffix_tree._gram_counts(depth)(iter([batch(texts)])):
        got.update(dict(zip(b["gram"].to_pylist(), b["n"].to_pylist())))
    assert dict(got) == dict(counts)


@pytest.mark.parametrize("gathered", [6, 3_000_000])
@pytest.mark.parametrize("texts", [ODD, ODD[:3]])
def test_words_of_odd_texts(gathered, texts, monkeypatch):
    monkeypatch.setattr(suffix_tree, "GATHERED", gathered)
    got = Counter()
    for b in suffix_tree._word_counts(iter([batch(texts), batch(texts)])):
        for word, n in zip(b["word"].to_pylist(), b["n"].to_pylist()):
            got[word] += n
    want = Counter(w for t in texts * 2 for w in [*suffix_tree.words_of(t), b"\n"])
    assert got == want


def test_lookup_finds_all_keys_and_no_others():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 2**63, 20_000).astype(np.uint64))
    held, others = keys[::2], keys[1::2]
    for load in (0.6, 1.0 - 1e-4):
        table = suffix_tree.Lookup(held, np.arange(len(held)), load)
        value, found = table(held)
        assert found.all() and value.tolist() == list(range(len(held)))
        assert not table(others)[1].any()


def test_the_last_key_for_a_place_is_found_first():
    keys = np.unique(np.random.default_rng(2).integers(1, 2**63, 1000).astype(np.uint64))
    table = suffix_tree.Lookup(keys, np.zeros(len(keys)))
    last = dict(zip(table._home(keys).tolist(), keys.tolist()))
    assert len(last) < len(keys) and all(table.keys[place] == key for place, key in last.items())


def test_no_text_is_cut_into_python_words(monkeypatch):
    """op9_scores took 1019 CPU seconds a GB: each word was an object, and each text was cut and joined again three times."""

    def cut(text):
        raise AssertionError("a text was cut into words")

    monkeypatch.setattr(suffix_tree, "words_of", cut)
    assert sum(len(b) for b in suffix_tree._word_counts(iter([batch(ODD)])))
    assert sum(len(b) for b in suffix_tree._gram_counts(6)(iter([batch(ODD)])))
