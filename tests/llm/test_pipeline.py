"""The pipeline on a small corpus, against a plain composition of its five stages."""

import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import DOCS, WORDS, plain_components, plain_lines, plain_targets, sentence, words_of

import corpus_pipeline
from trailweave.llm import quality
from trailweave.llm.tokens import byte_bpe_50k


def corpus():
    rng = np.random.default_rng(11)
    rows = []
    for i in range(70):
        text = "\n".join(sentence(rng, 25) + "." for _ in range(4))
        rows.append((i, text, f"s{i % 4}", "en"))
    for i in range(70, 90):  # near copies
        words = rows[i - 70][1].split(" ")
        words[int(rng.integers(5, len(words) - 5))] = "changed"
        rows.append((i, " ".join(words), "s1", None))
    rows += [(i, rows[i - 90][1], "s2", "en") for i in range(90, 96)]  # exact copies
    rows += [(i, "\n".join(" | ".join(rng.choice(WORDS, 15)) for _ in range(6)), "s0", "en") for i in range(96, 120)]  # junk
    rows += [(120, None, "s0", None), (121, "", None, None), (122, rows[3][1] + "\n" + sentence(rng, 60) + ".", None, "en"), (None, "\n".join(sentence(rng, 30) + "." for _ in range(3)), "s3", None)]
    rows.append(rows[5])
    return rows


def test_pipeline(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).withColumn("_td_gone", F.lit(1)).withColumn("copies", F.lit("x"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 70), 0) for i in [*range(0, 40), *range(96, 112)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    # quality: the fitted weights judge each text alone
    weights = quality.trained(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))

    def good(text):
        (n, _, _, _, repeated), x, sizes = quality.measured(text or "")
        return n >= 50 and 100 * repeated <= 50 * n and float(quality.viterbi(x @ weights[0], weights[1]) @ np.array(sizes)) >= 0.5 * n

    kept = [r for r in rows if good(r[1])]
    assert {r[0] for r in kept} == {r[0] for r in rows if r[0] is None or r[0] < 96 or r[0] == 122}
    lines = plain_lines([(r[0], r[1]) for r in kept])
    kept = [(r[0], lines[(r[0], r[1])], r[2]) for r in kept]
    kept = [r for r in kept if words_of(r[1])]
    near = plain_components([(r[0], r[1]) for r in kept])
    kept = list(dict.fromkeys(r for r in kept if r[0] is None or near[(r[0], r[1])][1] == r[0]))
    sizes = Counter()
    for r in kept:
        sizes[r[2]] += len(words_of(r[1]))
    targets = plain_targets({s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, s or ""))}, 1.5, 2.0)

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r[0]: r for r in kept}
    tokens = {i: [*byte_bpe_50k().any.encode(r[1], add_special_tokens=False).ids, 0] for i, r in texts.items()}
    took = Counter()
    got = defaultdict(Counter)
    for p in pieces:
        assert p.doc_id in texts and p.doc_tokens == len(tokens[p.doc_id])
        assert np.frombuffer(p.ids, "<u4").tolist() == tokens[p.doc_id][p.start : p.start + p.length]
        got[p.doc_id].update(range(p.start, p.start + p.length))
    for i, at in got.items():
        assert len(set(at.values())) == 1 and len(at) == len(tokens[i])
        copies = next(iter(at.values()))
        assert copies <= 2
        took[texts[i][2]] += copies * len(words_of(texts[i][1]))
    for s, target in targets.items():
        assert abs(took[s] - target) <= 2 * max(len(words_of(r[1])) for r in kept if r[2] == s)


def test_line_dedup_of_short_lines(spark):
    rows = [(1, "Read more\nHome\none two three four five six\nAbout us here now"), (2, "Read  more\nNews\none two three 4 five six\nAbout us here now"), (3, "Home\n\nNews\nfive words are enough here"), (4, "five words are not here\nRead more")]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    # equal lines of any length go, near ones from five words on
    assert got == {1: rows[0][1], 2: "News", 3: "\nfive words are enough here"}


def test_near_dedup_of_unlike_texts_of_one_doc_id(spark):
    rng = np.random.default_rng(12)
    a, b, c, d = (sentence(rng, 80) for _ in range(4))
    near = lambda text: " ".join([*text.split()[:-1], "changed"])
    # doc_id 5: two unlike texts, one a near copy of an earlier document; 7: two near texts and a repeated row; 8: an unlike text and a copy of it
    rows = [(1, a), (5, near(a)), (5, b), (7, c), (7, near(c)), (7, c), (8, d), (9, d), (9, near(b)), (None, a), (None, a), (3, ""), (3, ""), (3, None)]
    docs = spark.createDataFrame([(i, t, "s", None) for i, t in rows], DOCS).withColumn("rows", F.lit(1)).withColumn("of_key", F.lit("x"))
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    sevens = [k for k in kept if k[0] == 7]
    assert len(sevens) == 1 and kept.pop(sevens[0]) == 1 and sevens[0][1] in (c, near(c))
    assert kept == {(1, a): 1, (5, b): 1, (8, d): 1, (None, a): 2, (3, ""): 1, (3, None): 1}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
