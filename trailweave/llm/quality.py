"""Operator 7, quality rules: a linear-chain CRF labels each line content or boilerplate; the share of content decides.

Lines are the \\n-split parts of a text that hold a word. A chain has one node a line, a vector of line
features, and transition weights between neighbours' labels; Viterbi decoding finds the best sequence.
The weights are fitted by gradient ascent on the exact conditional likelihood, over all lines of at most SAMPLE
labelled documents (those of the smallest hash of doc_id).

Labels are given for documents, not for lines; those of lines are latent and found in turns with the weights:
1. At first a line has its document's label; but one that REPEATED documents of the sample or more share, or that
   its own document has said before, is boilerplate in a good document too. A line that only copies of one
   document share counts once: its neighbours are the same there.
2. Weights are fitted to these labels; then each chain is labelled anew by Viterbi, with PRIOR in favour of the
   label that the line had, and the weights are fitted again. So a line of a rejected document that looks like
   content becomes content, and a line of a good one that looks like boilerplate becomes boilerplate.

Cases: a null or empty text has no words, all counts 0, and fails the base rules. Null doc_ids, repeated rows
and ties need no rule, since each row is judged alone. An empty table gives an empty result. Other columns of
the input are not read. Without labels of both kinds the weights are DEFAULT.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import lean, released

#: Most labelled documents that the fit reads.
SAMPLE = 2000
#: Lines of a chain in the fit; a longer text is several chains there, with all its lines.
CHAIN = 64
#: Documents (with unlike lines around it) that share a line, from which on it is taken for boilerplate; weight of a line's label when lines are labelled anew.
REPEATED, PRIOR = 3, 3.0
#: A document stays if content lines hold at least this share of its words.
CONTENT_SHARE = 0.5
N_FEATURES = 10
#: Weights for tables without labels: (content's weight of each feature, transition matrix boilerplate/content).
DEFAULT = (np.array([2.0, -8.0, -6.0, -6.0, -4.0, 1.0, -0.5, 0.0, 0.0, 0.0]), np.array([[1.0, 0.0], [0.0, 1.0]]))

_SYMBOLS = b"#*$%&|<>"


KINDS = {"base_failed": pa.bool_(), "kept": pa.bool_(), "content_share": pa.float64()}


def line_features(line: str, words: list[bytes], seen_before: bool) -> tuple[float, ...]:
    """Ten numbers from 0 to 1, of the line alone but for seen_before."""
    n = len(words)
    symbols = sum(map(line.count, "#*$%&|<>"))
    bare = symbols / n
    capitals = sum(1 for w in words if len(w) > 1 and w.decode("utf-8", "replace").isupper()) / n
    distinct = len(set(words)) / n
    shouts = min(1.0, line.count("!") / n)
    end = line.rstrip()[-1:]
    return (1.0, min(1.0, bare), capitals, 1 - distinct if n > 3 else 0.0, shouts, float(end in ".?!…"), float(seen_before), float(n < 4), float(n < 12), min(1.0, n / 50))


def lines_of(text: str) -> list[bytes]:
    """The lines of a text that hold a word, as bytes."""
    return [line for line in text.encode("utf-8", "surrogatepass").split(b"\n") if line.split()]


def measured(text: str) -> tuple[tuple[int, int, int, int, int], np.ndarray, list[int]]:
    """The base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); the lines' features; the lines' words."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    n_symbols = len(data) - len(data.translate(None, _SYMBOLS))
    seen: set[str] = set()
    dups, features, sizes = 0, [], []
    for line in text.split("\n"):
        of_line = line.encode("utf-8", "surrogatepass").split()
        if of_line:
            again = line in seen
            dups += again
            seen.add(line)
            features.append(line_features(line, of_line, again))
            sizes.append(len(of_line))
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            inside = np.zeros(n + 3, np.int32)
            at = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows)).nonzero()[0]
            np.add.at(inside, at, 1)
            np.add.at(inside, at + 3, -1)
            repeated = int((np.cumsum(inside)[:n] > 0).sum())
    return (n, word_chars, n_symbols, dups, repeated), np.array(features, float).reshape(-1, N_FEATURES), sizes


def viterbi(scores: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The best labels (1: content) of a chain; scores: content's advantage at each line. Ties go to content."""
    n = len(scores)
    best0, best1 = 0.0, float(scores[0])
    (t00, t01), (t10, t11) = transition.tolist()
    back = np.empty((n, 2), np.int8)
    for i in range(1, n):
        s = float(scores[i])
        from1to0, from1to1 = best1 + t10 >= best0 + t00, best1 + t11 >= best0 + t01
        back[i] = from1to0, from1to1
        best0, best1 = (best1 + t10 if from1to0 else best0 + t00), (best1 + t11 if from1to1 else best0 + t01) + s
    labels = np.empty(n, np.int8)
    labels[-1] = best1 >= best0
    for i in range(n - 1, 0, -1):
        labels[i - 1] = back[i, labels[i]]
    return labels


def fitted(chains: list[np.ndarray], labels: list[np.ndarray], rounds: int = 150, rate: float = 0.5, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """CRF weights by gradient ascent; chains: the features of each chain's lines, labels: the lines' labels."""
    kept = [(x[i : i + CHAIN], y[i : i + CHAIN]) for x, y in zip(chains, labels) for i in range(0, len(x), CHAIN)]
    if len({int(v) for _, y in kept for v in np.unique(y)}) < 2:
        return DEFAULT
    longest = max(len(x) for x, _ in kept)
    x, y = np.zeros((len(kept), longest, N_FEATURES)), np.zeros((len(kept), longest), np.int8)
    mask = np.zeros((len(kept), longest), bool)
    for i, (f, of) in enumerate(kept):
        x[i, : len(f)], y[i, : len(f)], mask[i, : len(f)] = f, of, True
    lines = mask.astype(float)
    steps = lines[:, 1:]
    weights, transition = np.zeros(N_FEATURES), np.zeros((2, 2))
    squares = [1e-8, 1e-8]
    for _ in range(rounds):
        node = np.stack([np.zeros(x.shape[:2]), x @ weights], -1)
        forward = np.empty_like(node)
        forward[:, 0] = node[:, 0]
        for t in range(1, longest):
            step = np.logaddexp(forward[:, t - 1, 0, None] + transition[0], forward[:, t - 1, 1, None] + transition[1]) + node[:, t]
            forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
        backward = np.zeros_like(node)
        pair = np.zeros((len(kept), longest - 1, 2, 2)) if longest > 1 else None
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        for t in range(longest - 2, -1, -1):
            later = backward[:, t + 1] + node[:, t + 1]
            both = transition[None] + later[:, None, :]
            backward[:, t] = np.where(mask[:, t + 1, None], np.logaddexp(both[:, :, 0], both[:, :, 1]), 0.0)
            pair[:, t] = np.exp(forward[:, t, :, None] + both - total[:, None, None])
        content = np.exp(forward[..., 1] + backward[..., 1] - total[:, None])
        slope = (((y - content) * lines)[..., None] * x).sum((0, 1)) / lines.sum() - ridge * weights
        moves = np.zeros((2, 2))
        if pair is not None and steps.sum():
            for before in (0, 1):
                for after in (0, 1):
                    moves[before, after] += (steps * (y[:, :-1] == before) * (y[:, 1:] == after)).sum()
            moves -= (pair * steps[..., None, None]).sum((0, 1))
            moves = moves / steps.sum() - ridge * transition
        for k, (value, g) in enumerate(((weights, slope), (transition, moves))):
            squares[k] = squares[k] + g * g
            value += rate * g / np.sqrt(squares[k])
    return weights, transition


def first_labels(lines: list[list[bytes]], kinds: list[int], repeated: int = REPEATED) -> list[np.ndarray]:
    """A first label (1: content) of each line of documents: lines, digests of each one's lines; kinds, the documents' labels.

    A line is boilerplate if its document is, if it came before in it, or if repeated documents or more share it,
    each time after another line.
    """
    after: dict[bytes, set[bytes]] = {}
    for of in lines:
        for before, line in zip([b"", *of], of):
            after.setdefault(line, set()).add(before)
    found = []
    for of, kind in zip(lines, kinds):
        seen: set[bytes] = set()
        labels = np.zeros(len(of), np.int8)
        for i, line in enumerate(of):
            labels[i] = kind == 1 and line not in seen and len(after[line]) < repeated
            seen.add(line)
        found.append(labels)
    return found


def trained(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Weights from at most sample labelled documents; the lines' features are made in tasks, and only they come to the driver."""
    chosen = (
        labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    )
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            made = [measured(t or "")[1].ravel() for t in texts]
            digests = [[blake2b(line, digest_size=8).digest() for line in lines_of(t or "")] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality").cast(pa.int32()), pa.array(made, pa.list_(pa.float64())), pa.array(digests, pa.list_(pa.binary()))], ["doc_id", "quality", "features", "lines"])

    # a doc_id that many rows share counts with as many rows in all at most
    found = rows.mapInArrow(lean(features), "doc_id long, quality int, features array<double>, lines array<binary>").orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(sample).toArrow()
    kinds = found["quality"].to_pylist()
    if len(set(kinds)) < 2:
        return DEFAULT
    chains = [np.asarray(f.values, float).reshape(-1, N_FEATURES) for f in found["features"]]
    of_lines = first_labels(found["lines"].to_pylist(), kinds)
    weights = fitted(chains, of_lines, rounds=60)
    if weights is DEFAULT:
        return DEFAULT
    anew = [viterbi(x @ weights[0] + PRIOR * (2.0 * y - 1.0), weights[1]) if len(x) else y for x, y in zip(chains, of_lines)]
    return fitted(chains, anew)


def content_rules(documents: DataFrame, weights: np.ndarray, transition: np.ndarray, content_share: float = CONTENT_SHARE) -> DataFrame:
    """doc_id, base counts, base_failed, content_share, content_lines, n_lines, kept of each row of documents (doc_id, text)."""

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "content_lines", "n_lines", "kept"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                base, x, sizes = measured(text or "")
                n, repeated = base[0], base[4]
                failed = n < 50 or 100 * repeated > 50 * n
                labels = viterbi(x @ weights, transition) if len(x) else np.zeros(0, np.int8)
                share = float(labels @ np.array(sizes, float)) / n if n else 0.0
                rows.append((*base, failed, share, int(labels.sum()), len(labels), not failed and share >= content_share))
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, KINDS.get(n, pa.int64())) for n, c in zip(names, columns)]], ["doc_id", *names])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, content_lines long, n_lines long, kept boolean"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(judge), schema)


def kept_documents(documents: DataFrame, weights: np.ndarray, transition: np.ndarray, content_share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of documents, all their columns, that the rules keep: judged row by row, so no join is needed."""

    @F.arrow_udf("boolean")
    def keeps(texts: pa.Array) -> pa.Array:
        def one(text: str | None) -> bool:
            (n, _, _, _, repeated), x, sizes = measured(text or "")
            if n < 50 or 100 * repeated > 50 * n:
                return False
            return float(viterbi(x @ weights, transition) @ np.array(sizes, float)) >= content_share * n

        judged = pa.array([one(t.as_py()) for t in texts], pa.bool_())
        released()
        return judged

    return documents.where(keeps(F.col("text")))
