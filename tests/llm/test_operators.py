"""The operators on small tables: odd inputs, brute force, exact round trips, held-out accuracy."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailweave.llm import chat, lines, minhash, mixing, neighbours, packing, quality, sharding, substrings, suffix_tree
from trailweave.llm.components import components
from trailweave.llm.tokens import byte_bpe_50k

DOCS = "doc_id long, text string, source string, lang string"
WORDS = [f"w{i}" for i in range(400)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS, n))


def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows."""
    rng = np.random.default_rng(1)
    long = "\n".join(sentence(rng, 40) for _ in range(300))
    a = sentence(rng, 60)
    near = a.split()
    near[30] = "changed"
    rows = [(1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, "one", "b"), (5, "One two three four", "b"), (6, a, None), (6, a, None), (7, a, "c"), (8, " ".join(near), "c"), (None, a, "a"), (None, None, None), (9, long, "a"), (10, "x" * 5000, "d"), (11, "日本 語\x00 é\xa0z", "d"), (-5, a + "\n" + sentence(rng, 12), "a")]
    return [(*r, None) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    # columns that clash with names the operators use inside or return
    return spark.createDataFrame(odd_rows(), DOCS).withColumn("size", F.lit("x")).withColumn("keys", F.lit(1)).withColumn("line", F.lit(2)).withColumn("node", F.lit(3)).withColumn("shard", F.lit("s"))


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def random_docs(spark):
    rng = np.random.default_rng(7)
    rows, base = [], [[list(rng.choice(WORDS, rng.integers(8, 30))) for _ in range(rng.integers(1, 5))] for _ in range(40)]
    for i in range(160):
        text = [list(line) for line in base[rng.integers(40)]]
        for _ in range(rng.integers(0, 4)):
            line = text[rng.integers(len(text))]
            at = rng.integers(len(line))
            kind = rng.integers(3)
            line[at : at + (kind != 1)] = [] if kind == 0 else [f"new{rng.integers(9)}"]
        rows.append((i, "\n".join(" ".join(x) for x in text), f"s{i % 5}", None))
    return spark.createDataFrame(rows, DOCS)


def words_of(text):
    return (text or "").encode().split()


# 1 packing


def unpacked(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    pieces = []
    for q in by.values():
        at = 0
        for r in sorted(q, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
            assert len(r.ids) == 4 * r.length
            pieces.append(r)
        assert at <= 1024
    return pieces


def test_packing_round_trip(odd, none):
    pieces = unpacked(packing.pack(odd, byte_bpe_50k, group_docs=4).collect())
    docs = defaultdict(list)
    for r in sorted(pieces, key=lambda r: r.start):
        docs[r.doc_id].append(r)
    tokens = byte_bpe_50k().any
    for doc_id, group in docs.items():
        texts = [t for d, t, *_ in odd_rows() if d == doc_id]
        want = Counter()
        for t in texts:
            want.update([*tokens.encode(t or "", add_special_tokens=False).ids, 0])
        got = np.concatenate([np.frombuffer(r.ids, "<u4") for r in group])
        assert Counter(got.tolist()) == want
        if len(texts) == 1:
            assert got.tolist() == [*tokens.encode(texts[0] or "", add_special_tokens=False).ids, 0]
            assert [r.start for r in group] == np.cumsum([0] + [r.length for r in group])[:-1].tolist()
    assert packing.pack(none, byte_bpe_50k).count() == 0


def test_first_fit_is_the_plain_one():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(1, 100, 300))[::-1]
    room: list[int] = []
    want = []
    for s in sizes:
        at = next((i for i, r in enumerate(room) if r >= s), None)
        if at is None:
            room.append(100)
            at = len(room) - 1
        room[at] -= s
        want.append(at)
    assert packing.first_fit(sizes, 100).tolist() == want


@pytest.mark.parametrize("text", ["", "<|endoftext|> a", "a  b\n\n c\t d", "é\xa0b", "x" * 3000, "日本語 テスト", "\x00\x1c a\x85b", " " * 2000, "don't 12,345 !!!? Straße"])
def test_ids_equal_those_of_tokenizers(text):
    t = byte_bpe_50k()
    assert t.ids(text).tolist() == t.any.encode(text, add_special_tokens=False).ids


def test_added_tokens_have_their_own_ids():
    import public_tokenizers as files
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(str(files.path("byte_bpe_50k.json")))
    text = "a <|endoftext|> b"
    assert byte_bpe_50k().ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids and len(byte_bpe_50k().ids(text)) == 4


# 2 mixing


def plain_targets(sizes, total, most):
    weights = dict(zip(sizes, (x for _ in sizes for x in (5.0, 2.0, 1.0))))
    left, open_, out = total * sum(sizes.values()), dict(sizes), {}
    while open_:
        w = sum(weights[s] for s in open_)
        full = [s for s in open_ if left * weights[s] / w >= most * sizes[s]]
        if not full:
            return out | {s: left * weights[s] / w for s in open_}
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        open_ = {s: n for s, n in open_.items() if s not in full}
    return out


def test_mixing(random_docs, odd, none):
    rows = mixing.mix(random_docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    targets = plain_targets(dict(sorted(sizes.items())), 1.5, 2.0)
    for r in rows:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source] and r.taken <= 2 * r.size and r.taken == r.copies * r.size
    for s in sizes:
        assert abs(sum(r.taken for r in rows if r.source == s) - targets[s]) <= 2 * max(r.size for r in rows if r.source == s)
    assert sorted((r.doc_id, r.copies) for r in mixing.mix(random_docs.repartition(7)).collect()) == sorted((r.doc_id, r.copies) for r in rows)
    got = mixing.mix(odd).collect()
    assert len(got) == len(odd_rows()) and {r.size for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix(none).count() == 0


# 3 lines


def plain_lines(docs):
    """Earliest lines by (doc_id, place); a line goes if an earlier equal one, or an earlier one within one word's edit, exists."""

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < lines.NEAR_WORDS:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    first, out = {}, {}
    ordered = sorted({(d is None, d or 0, t) for d, t in docs if t is not None})
    for nameless, d, t in ordered:
        for i, line in enumerate(t.split("\n")):
            w = tuple(words_of(line))
            if len(w) >= lines.MIN_WORDS:
                first.setdefault(w, (nameless, d, i))
    gone = {w for w, p in first.items() if any(q < p and near(w, v) for v, q in first.items())}
    for nameless, d, t in ordered:
        kept = []
        for i, line in enumerate(t.split("\n")):
            w = tuple(words_of(line))
            if len(w) < lines.MIN_WORDS or (w not in gone and first[w] == (nameless, d, i)):
                kept.append(line)
        out[(None if nameless else d, t)] = "\n".join(kept)
    return out


@pytest.mark.parametrize("table", ["random_docs", "odd"])
def test_lines_against_brute_force(table, request):
    docs = request.getfixturevalue(table)
    before = docs.select("doc_id", "text").collect()
    want = plain_lines([(r.doc_id, r.text) for r in before])
    got = lines.dedup_lines(docs)
    assert got.columns[: len(docs.columns)] == docs.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, ((r.doc_id, None if r.text is None else want[(r.doc_id, r.text)]) for r in before)))


def test_lines_of_permuted_and_doubled_cells(spark):
    rows = ["| a | b | c | d | e |", "| b | a | c | d | e |", "| b | a | c | d | f |", "| 5 | 5 | c | d | e |", "| 0 | 0 | c | d | e |", "| 0 | 0 | c | d | g |", "| 0 | 0 | d | c | g |"]
    rng = np.random.default_rng(10)
    rows += ["| " + " | ".join(rng.choice(list("abc"), rng.integers(5, 8))) + " |" for _ in range(300)]
    docs = spark.createDataFrame([(i, text, "s", None) for i, text in enumerate(rows)], DOCS)
    want = plain_lines(list(enumerate(rows)))
    assert want[(2, rows[2])] == "" == want[(5, rows[5])]
    assert {(r.doc_id, r.text) for r in lines.dedup_lines(docs).collect()} == {(i, want[(i, text)]) for i, text in enumerate(rows)}


def test_lines_of_an_empty_table(none):
    assert lines.dedup_lines(none).count() == 0


# 4 chat


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi <|end|> \\ there"), (1, 1, "assistant", "yo"), (1, 1, "bob", None), (1, None, None, "last"), (1, 2, "system", "be nice"), (1, 0, "user", "hi <|end|> \\ there"), (None, 1, "user", "x"), (3, 1, "system", "alone")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("speaker", F.lit(0))
    got = chat.perspectives(turns, part_turns=2).collect()
    assert {(r.conv_id, r.speaker) for r in got} == {(1, "user"), (1, "assistant"), (1, "bob"), (1, "unknown"), (None, "user")}
    for speaker, texts in {"user": ["hi <|end|> \\ there"], "assistant": ["yo"], "bob": [""], "unknown": ["last"]}.items():
        own = [r.rendered[s.start : s.end] for r in sorted((r for r in got if r.conv_id == 1 and r.speaker == speaker), key=lambda r: r.part) for s in r.spans]
        assert [x.replace("<\\|", "<|").replace("\\\\", "\\") for x in own] == texts
    whole = "".join(r.rendered for r in sorted((r for r in got if r.conv_id == 1 and r.speaker == "bob"), key=lambda r: r.part))
    assert whole == "<|user:user|>\nhi <\\|end|> \\\\ there<|end|>\n<|user:assistant|>\nyo<|end|>\n<|assistant|>\n<|end|>\n<|system|>\nbe nice<|end|>\n<|user:unknown|>\nlast<|end|>\n"
    assert chat.perspectives(turns.where("false")).count() == 0


# 5 sharding


def test_hash_tree_moves_rows_into_the_new_shard_only():
    keys = np.random.default_rng(2).integers(0, 2**63, 40_000).astype(np.uint64)
    last = sharding.shard_of(keys, sharding.Tree((1.0,)))
    for n in range(2, 60):
        now = sharding.shard_of(keys, sharding.Tree((1.0,) * n))
        assert set(now[now != last]) <= {n - 1}
        last = now
    counts = np.bincount(sharding.shard_of(keys, sharding.Tree((1.0,) * 40)), minlength=40)
    assert counts.min() > 850 and counts.max() < 1150
    weighted = np.bincount(sharding.shard_of(keys, sharding.Tree((1.0, 2.0, 3.0, 2.0))), minlength=4) / len(keys)
    assert np.allclose(weighted, [1 / 8, 2 / 8, 3 / 8, 2 / 8], atol=0.01)


def test_hash_tree_confines_moves_to_the_changed_shard():
    keys = sharding.mixed(np.arange(100_000, dtype=np.uint64))
    before = sharding.shard_of(keys, sharding.Tree((1.0,) * 40))
    assert np.bincount(before, minlength=40).min() > 2200
    for changed in (0, 5, 20, 39):
        weights = [1.0] * 40
        weights[changed] = 2.0
        after = sharding.shard_of(keys, sharding.Tree(tuple(weights)))
        moved = before != after
        assert 0.018 < moved.mean() < 0.03 and (after[moved] == changed).all()
        weights[changed] = 0.0
        after = sharding.shard_of(keys, sharding.Tree(tuple(weights)))
        moved = before != after
        assert (moved == (before == changed)).all()


def test_shards_of_odd_rows(odd, none):
    tree, grown = sharding.Tree((1.0,) * 3), sharding.Tree((1.0,) * 4)
    rows = sharding.shards(odd, tree, grown).collect()
    assert len(rows) == len(odd_rows())
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 3)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r.shard for r in rows if r.doc_id == 6}) == 1
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 11} == {(16 + len("日本 語\x00 é\xa0z".encode()), zlib.crc32("日本 語\x00 é\xa0z".encode()))}
    assert sharding.shards(none, tree, grown).count() == 0


# 6 neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(12, size=600)] + 0.4 * rng.normal(size=(600, 16))
    v[400:500] = v[400]  # one very frequent vector
    rows = [(i, v[i].tolist()) for i in range(600)]
    bad = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0, None] * 8), (1080, [1.0] * 3), (1100, [float("inf")] + [0.0] * 15), (None, v[0].tolist()), (20, v[20].tolist())]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, near=8).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        score = v @ v[q]
        order = [i for i in np.lexsort((np.arange(600), -score.round(9))) if i != q][:20]
        hits += len({i for i, _ in found} & set(order))
        assert len(found) == 20 and all(s == pytest.approx(score[i]) for i, s in found) and q not in {i for i, _ in found}
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    assert hits >= 0.9 * 20 * len(got)
    few = neighbours.nearest(df.where("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] == sorted(range(1, 5), key=lambda i: -float(v[i] @ v[0]))
    assert neighbours.nearest(df.where("false"), F.col("vec_id") == 0).count() == 0


def test_neighbours_without_clusters(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(20_000, 64)).astype("f4")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>")
    queries = list(range(0, 20_000, 200))
    got = defaultdict(set)
    for r in neighbours.nearest(df, F.col("vec_id") % 200 == 0).collect():
        got[r.query_id].add(r.vec_id)
    score = v[queries] @ v.T
    score[np.arange(len(queries)), queries] = -9
    true = np.argsort(-score, axis=1)[:, :20]
    assert all(len(got[q]) == 20 for q in queries)
    assert sum(len(got[q] & set(t)) for q, t in zip(queries, true.tolist())) >= 0.9 * 20 * len(queries)


def test_many_ties_go_to_the_smallest_vec_ids(spark):
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [1.0, float(i), 0.0]) for i in range(200, 0, -1)]
    rows += [(1000 + i, [1.0, float(i), 1.0]) for i in range(3)] + [(999, [1.0, 7.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for block in (8192, 16):
        got = neighbours.nearest(df, F.col("vec_id") == 0, block=block, aimed=1.0).orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in got] == [(i, 1.0) for i in range(1, 21)]


# 7 quality


def test_quality_base_counts(odd, none):
    got = {(r.doc_id, r.n_words): r for r in quality.content_rules(odd, *quality.DEFAULT).collect()}
    assert got[(1, 0)].base_failed and not got[(1, 0)].kept and got[(5, 4)].word_chars == 15
    text = "a b c a b c d # $x\nrow one\nrow one\n\nrow two"
    (n, chars, symbols, dups, repeats), x, sizes = quality.measured(text)
    words = text.split()
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    assert (n, chars, symbols, dups, repeats) == (len(words), sum(map(len, words)), 2, 1, len(inside)) and len(x) == 4 == len(sizes)
    assert quality.content_rules(none, *quality.DEFAULT).count() == 0


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(1)
    for _ in range(40):
        s, t = rng.normal(size=7), rng.normal(size=(2, 2))
        value = lambda y: sum(s[i] * y[i] for i in range(7)) + sum(t[y[i], y[i + 1]] for i in range(6))
        best = max(([(k >> i) & 1 for i in range(7)] for k in range(128)), key=value)
        assert quality.viterbi(s, t).tolist() == best


def test_a_good_text_holds_lines_of_both_labels(spark):
    rng = np.random.default_rng(21)
    shared = ["Home.", "Read more", "Share this page", "All rights reserved"]
    docs, labels = [], []
    for i in range(120):
        good = i % 3 > 0
        body = [sentence(rng, 30) + "." for _ in range(4)] if good else [" ".join(w + "###" for w in sentence(rng, 30).split()) for _ in range(4)]
        docs.append((i, "\n".join([shared[i % 4], *body[:2], shared[(i + int(rng.integers(4))) % 4], *body[2:], shared[(i // 4) % 4]]), "s", "en"))
        labels.append((i, int(good)))
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    weights = quality.trained(d.where("doc_id < 90"), y)
    for i, text, _, _ in docs[90:]:
        _, x, _ = quality.measured(text)
        if i % 3:
            assert quality.viterbi(x @ weights[0], weights[1]).tolist() == [0, 1, 1, 0, 1, 1, 0]
        else:
            assert quality.viterbi(x @ weights[0], weights[1])[[1, 2, 4, 5]].tolist() == [0, 0, 0, 0]


def test_quality_fits_all_lines_of_long_texts():
    rng = np.random.default_rng(4)
    x, y = np.zeros((500, quality.N_FEATURES)), np.zeros(500, np.int8)
    x[:, 0], x[:, 1] = 1.0, rng.random(500)
    y[:] = x[:, 1] < 0.5
    x[: quality.CHAIN, 1], y[: quality.CHAIN] = 0.9, 1  # the first lines say the contrary of all others
    weights, transition = quality.fitted([x], [y], rounds=100)
    assert (quality.viterbi(x @ weights, transition) == y)[quality.CHAIN :].mean() > 0.8


def test_quality_learns_from_labels(spark):
    rng = np.random.default_rng(2)
    docs, labels = [], []
    for i in range(160):
        good = i % 2
        text = "\n".join((sentence(rng, 20) + ".") if good else " | ".join(rng.choice(WORDS, 12)) for _ in range(5))
        docs.append((i, text, "s", None))
        labels.append((i, good))
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    weights = quality.trained(d.where("doc_id < 80"), y)
    held = quality.content_rules(d.where("doc_id >= 80"), *weights).collect()
    assert np.mean([r.kept == bool(r.doc_id % 2) for r in held]) >= 0.95
    assert quality.kept_documents(d.where("doc_id >= 80"), *weights).count() == sum(r.kept for r in held)
    assert quality.trained(d, y.where("quality = 1")) is quality.DEFAULT


# 8 substrings


def test_chunks_resist_insertions():
    rng = np.random.default_rng(3)
    text = sentence(rng, 400)
    s, e, w = substrings.chunks(text)
    assert s[0] == 0 and e[-1] == len(text) and (s[1:] == e[:-1]).all() and w.sum() == 400
    moved = substrings.chunks("two more " + text)
    old = {text[a:b].strip() for a, b in zip(s, e)}
    new = {("two more " + text)[a:b].strip() for a, b in zip(moved[0], moved[1])}
    assert len(old - new) <= 4
    slow = 0
    for b in text.encode()[:200]:
        slow = ((slow << 1) + int(substrings._GEAR[b])) % 2**32
    assert substrings.gear_hashes(np.frombuffer(text.encode(), np.uint8))[199] == slow


def test_substrings_against_brute_force(spark):
    rng = np.random.default_rng(31)
    passage, other = sentence(rng, 80), sentence(rng, 60)
    rows = [(i, " ".join([sentence(rng, 50), passage if i % 3 == 0 else sentence(rng, 70), sentence(rng, 30), other if i % 4 == 1 else ""])) for i in range(40)]
    rows += [(40, rows[3][1]), (None, rows[7][1]), (41, None), (42, "")]
    chunks = [(i, t, [(" ".join((t or "").encode()[s:e].decode().split()), n) for s, e, n in zip(*(x.tolist() for x in substrings.chunks(t or "")))]) for i, t in rows]
    first, want = {}, {}
    for i, _, found in sorted(chunks, key=lambda r: (r[0] is None, r[0] or 0)):
        for at, (words, _) in enumerate(found):
            first.setdefault(words, (i, at))
    for i, t, found in chunks:
        again = [first[words] != (i, at) for at, (words, _) in enumerate(found)]
        begins, spans, at = np.cumsum([0, *[n for _, n in found]]), [], 0
        while at < len(again):
            to = at
            while to < len(again) and again[to]:
                to += 1
            if begins[to] - begins[at] >= substrings.RUN_WORDS:
                spans.append((int(begins[at]), int(begins[to] - begins[at])))
            at = max(to, at + 1)
        words = (t or "").split()
        left = [w for k, w in enumerate(words) if not any(a <= k < a + n for a, n in spans)]
        want[i] = (spans, left)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit("x")).withColumn("mine", F.lit(1))
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in substrings.dedup_substrings(docs).collect()}
    assert got == {i: s for i, (s, _) in want.items()} and sum(map(bool, got.values())) > 10
    for r in substrings.without_spans(docs).select("row.*", "removed_words").collect():
        spans, left = want[r.doc_id]
        assert r.gone == "x" and r.removed_words == sum(n for _, n in spans) and (r.text or "").split() == left and (r.text is None) == (r.doc_id == 41)


def test_substrings(spark, odd, none):
    rng = np.random.default_rng(4)
    passage = sentence(rng, 60)
    rows = [(i, sentence(rng, 50) + "\n" + (passage if i % 3 == 0 else sentence(rng, 60)) + " " + sentence(rng, 50), "s", None) for i in range(30)]
    got = {r.doc_id: r for r in substrings.dedup_substrings(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i for i, r in got.items() if r.repeated} == {i for i in range(3, 30, 3)}
    assert all(30 <= got[i].removed_words <= 80 and 0 in got[i].first_docs for i in range(3, 30, 3))
    both = substrings.dedup_substrings(odd).collect()
    assert len(both) == len(odd_rows())
    whole = {r.doc_id: r.removed_words for r in both}
    assert whole[7] == 60 and 45 <= whole[6] <= 60 and whole[-5] == 0 and whole[1] == 0
    assert substrings.dedup_substrings(none).count() == 0


# 9 suffix tree


def plain_score(tree, data):
    pairs = dict(zip(tree.pairs.tolist(), tree.pair_logs.tolist()))
    contexts = dict(zip(tree.contexts.tolist(), tree.context_logs.tolist()))
    total, history = 0.0, b"\n" * tree.depth
    for byte in data:
        for d in range(tree.depth, -1, -1):
            context = history[len(history) - d :] if d else b""
            key = int.from_bytes(context + bytes([byte]), "big") | (d + 1) << 56
            if d == 0:
                total += tree.root[byte]
            elif key in pairs:
                total += pairs[key]
                break
            else:
                total += contexts.get(int.from_bytes(context, "big") | (d + 1) << 56, 0.0)
        history += bytes([byte])
    return total


def test_suffix_tree(spark, odd, none):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["tick tock", "ding dong", "a", "b"], 30)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "s", None) for i, t in enumerate(texts)], DOCS)
    training = docs.where("doc_id < 45")
    tree = suffix_tree.tree_of(training, depth=4)
    for t in ["tick tock a", "never seen", ""]:
        keys, sizes = suffix_tree.grams([suffix_tree.words_of(t)], 4)
        assert tree.scorer()(keys).sum() == pytest.approx(plain_score(tree, b" ".join(t.encode().split()) + b"\n"), rel=1e-5)
    # the next symbols of any history have chances that add up to 1, but for the 257th part of the root
    keys = np.array([int.from_bytes(b" toc", "big") << 8 | b for b in range(256)], np.uint64)
    assert (10 ** tree.scorer()(keys)).sum() == pytest.approx(1, abs=0.005)
    got = suffix_tree.scores(docs, training).where("doc_id >= 45").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    rows = suffix_tree.scores(odd, odd.where(~suffix_tree.held_out())).collect()
    train = [t for d, t, *_ in odd_rows() if zlib.crc32(str("" if d is None else d).encode()) % 10]
    c = Counter()
    for t in train:
        c.update(w.lower() for w in words_of(t))
        c["end"] += 1
    total = sum(c.values())
    base = lambda t: sum(np.log10((c[w] + 0.1) / (total + 0.1 * (len(c) + 1))) for w in [*(w.lower() for w in words_of(t)), "end"])
    want = sorted((len(words_of(t)) + 1, round(base(t), 6)) for _, t, *_ in odd_rows())
    assert sorted((r.n_tokens, round(r.base_score, 6)) for r in rows) == want and {r.train_tokens for r in rows} == {total}
    assert suffix_tree.scores(none, none).count() == 0
    assert suffix_tree.scores(docs.limit(2), none).count() == 2


@pytest.mark.parametrize("sent_share", [0.0, 1e-3, 1.0])
def test_scores_are_those_of_the_whole_tree(spark, sent_share):
    rng = np.random.default_rng(13)
    texts = [" ".join(rng.choice(WORDS[:40], 50)) for _ in range(80)] + ["rare zq\x00 zq", "rare zq\x00 zx", "\x00" * 9, None]
    docs = spark.createDataFrame([(i, t, "s", None) for i, t in enumerate(texts)], DOCS)
    trains = F.col("doc_id") % 4 != 1
    tree = suffix_tree.tree_of(docs.where(trains), depth=5)
    want = [plain_score(tree, b" ".join(words_of(t)) + b"\n") for t in texts]
    for training in (trains, docs.where(trains)):
        got = {r.doc_id: r.score for r in suffix_tree.scores(docs, training, depth=5, sent_share=sent_share).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-4)


def test_pairs_stay_in_the_tree_at_any_size(spark):
    # 20 million symbols would have called for four occurrences, not two
    texts = spark.createDataFrame([("zq",), ("zq",), ("x y " * 1000,)], "text string").select("text", F.lit(True).alias("trains"))
    many = texts.where("text = 'zq'").unionAll(texts.where("text <> 'zq'").select(F.repeat("text", F.lit(5000)).alias("text"), "trains"))
    logs, symbols = suffix_tree.chances(many, depth=1)
    assert symbols >= 19_000_000
    assert {r.gram: r.log for r in logs.collect()}[int.from_bytes(b"zq", "big")] > -3


# 10 near duplicates


def plain_components(docs):
    sets = {}
    for d, t in docs:
        w = [x.lower() for x in words_of(t)]
        sets[(d, t)] = frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(zip(w, w[1:], w[2:], w[3:], w[4:]))
    keys = [k for k in sets if k[0] is not None]
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in keys:
        for b in keys:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: (len(sets[k]), find(k)[0] if k[0] is not None else None) for k in sets}


@pytest.mark.parametrize("table", ["random_docs", "odd"])
def test_near_duplicates_against_brute_force(table, request):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    plain = plain_components([(d, t or "") for d, t in rows])
    want = sorted(map(repr, ((d, *plain[(d, t or "")], d is None or plain[(d, t or "")][1] == d) for d, t in rows)))
    got = sorted(map(repr, ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())))
    assert got == want


def test_near_duplicates_of_an_empty_table(none):
    assert minhash.near_duplicates(none).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[1000:])
    same = np.mean(minhash.signature(a) == minhash.signature(b))
    assert abs(same - 1 / 3) < 0.12


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(40, 41), (41, 40), (50, 50), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 41: 40}


def test_deep_levels_do_not_depend_on_batches(monkeypatch):
    rng = np.random.default_rng(3)
    full = np.unique(rng.integers(97, 100, (4000, 5)) @ (256 ** np.arange(5)))  # depth 4: endings of two symbols
    known = np.unique(full & 0xFFFFFF)
    gram = np.r_[full, known]
    n = np.r_[rng.integers(0, 9, len(full)), rng.integers(-2, 0, 256)[(known >> 8) % 256]]
    low = np.r_[np.zeros(len(full)), np.full(len(known), 0.2)]
    order = np.argsort((gram >> 8) & 0xFFFF, kind="stable")
    rows = pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (gram, n, low)], ["gram", "n", "low"])

    def made(together, size):
        monkeypatch.setattr(suffix_tree, "TOGETHER", together)
        out = suffix_tree._deep(4, 2, 2, 1.0, 20.0)(rows.slice(i, size) for i in range(0, len(rows), size))
        return sorted(r for b in out for r in zip(*(c.to_pylist() for c in b.columns)))

    whole = made(10**6, len(gram))
    assert len(whole) == len(full) and len({r[2] for r in whole}) > 1
    for together, size in ((1, 7), (50, 20)):
        got = made(together, size)
        assert [r[:2] for r in got] == [r[:2] for r in whole]
        assert np.allclose([r[2] for r in got], [r[2] for r in whole])
