r"""Operator 11, detection of periodic runs of words, by counting matches at each lag.

A run is a stretch of words with smallest period q, at least max(LEAST, 2 * q) long, that no neighbour extends. At lag q
it shows as max(q, LEAST - q) matches (words q apart that are the same) in a row, an island. So the matches at every lag
are counted first, exactly: those of a document's frequent words by a Fourier transform (the autocorrelation of where a
word stands, summed over words in the spectrum, rounded to whole numbers), those of rare words by the differences of
their places; a word is frequent where its pairs would cost more than its transform. Only lags with enough matches are
searched for islands. Matches that a known run of period p explains at the lags 2p, 3p ... are taken off first, since an
island there has the same ends and a smaller period; so a text of one word over and over is searched at lag 1 alone.

Lags up to SMALL are searched in all documents of a slice at once. At a longer lag q every (q / 8)th place is looked at
first, as an island holds 8 of these in a row; only around such rows all places are compared.

Words are counted in the document alone, so nothing is shuffled; documents come in slices of bounded bytes, and a longer
text is a slice of its own, whole.

Cases: a null text has no words and no runs. Repeated rows are answered each. A null doc_id is like others. Texts of any
length are whole. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import lean

LEAST, SMALL = 12, 32
#: Nanoseconds, roughly: of a pair's difference, of a place of a transform times its logarithm, of any transform.
PAIR_NS, TRANSFORM_NS, FIXED_NS = 15, 2, 30_000
#: Differences that are counted at once.
TOGETHER = 1 << 20

Run = tuple[int, int, int]  # start, length, period


def enough(lag: np.ndarray | int) -> np.ndarray:
    """The matches in a row that a run of this period has at least."""
    return np.maximum(lag, LEAST - lag)


def islands(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2] - edges[::2]


def _transform_size(n: int) -> int:
    """Places of a transform in which lags up to n / 2 don't wrap around."""
    return 1 << (n + n // 2).bit_length()


def lag_counts(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches at each lag up to half of each document. codes: words of documents one after the other, equal only within a
    document; starts: where the documents begin, and the end. Second: where a document's lags begin (at lag 0)."""
    sizes = np.diff(starts)
    half = sizes // 2
    base = np.concatenate([[0], np.cumsum(half + 1)])
    counts = np.zeros(base[-1], np.int64)
    by_word = np.argsort(codes, kind="stable")
    ordered = codes[by_word]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(codes) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(codes)))
    doc_of = np.searchsorted(starts, by_word[first], side="right") - 1
    places = np.array([_transform_size(n) for n in sizes.tolist()], np.int64)[doc_of]
    frequent = PAIR_NS * times * times > 2 * (TRANSFORM_NS * places * np.log2(np.maximum(places, 2)) + FIXED_NS)

    heavy = defaultdict(list)
    for w in np.flatnonzero(frequent).tolist():
        heavy[int(doc_of[w])].append(w)
    for d, words in heavy.items():
        size = _transform_size(int(sizes[d]))
        power = np.zeros(size // 2 + 1)
        for w in words:
            stands = np.zeros(size)
            stands[by_word[first[w] : first[w] + times[w]] - starts[d]] = 1
            spectrum = np.fft.rfft(stands)
            power += spectrum.real**2 + spectrum.imag**2
        counts[base[d] : base[d + 1]] += np.rint(np.fft.irfft(power, size)[: half[d] + 1]).astype(np.int64)

    light = np.repeat(~frequent, times)
    after = np.repeat(first + times, times) - np.arange(len(codes)) - 1  # later places of the same word
    reach, offset = np.repeat(half[doc_of], times), np.repeat(base[doc_of], times)
    at = np.flatnonzero(light & (after > 0))
    step, held, found = 1, 0, []
    while len(at):
        lag = by_word[at + step] - by_word[at]
        near = lag <= reach[at]
        at = at[near]
        found.append(offset[at] + lag[near])
        held += len(at)
        step += 1
        at = at[after[at] >= step]
        if held > TOGETHER or not len(at):
            counts += np.bincount(np.concatenate(found), minlength=len(counts))
            held, found = 0, []
    counts[base[:-1]] = 0
    return counts, base


def _long_lag(words: np.ndarray, lag: int) -> Iterator[tuple[int, int]]:
    """Start and length of the islands of a document at a lag over SMALL that are at least as long as the lag."""
    step, end = lag // 8, len(words) - lag
    looked = np.arange(0, end, step)
    begin, length = islands(words[looked] == words[looked + lag])
    for b, n in zip(begin.tolist(), length.tolist()):
        if n >= lag // step:
            lo, hi = max(0, (b - 1) * step + 1), min((b + n) * step, end)
            starts, lengths = islands(words[lo:hi] == words[lo + lag : hi + lag])
            for s, m in zip(starts.tolist(), lengths.tolist()):
                if m >= lag:
                    yield lo + s, m


def periodic_runs(codes: np.ndarray, starts: np.ndarray) -> list[list[Run]]:
    """The runs of each document, by start and then period; codes and starts as in lag_counts."""
    counts, base = lag_counts(codes, starts)
    lags = np.arange(len(counts)) - np.repeat(base[:-1], np.diff(base))
    hopeful = np.flatnonzero((lags > 0) & (counts >= enough(lags)))
    docs = np.searchsorted(base, hopeful, side="right") - 1
    runs: list[dict[tuple[int, int], int]] = [{} for _ in range(len(starts) - 1)]
    lags = lags[hopeful]
    for lag in np.unique(lags[lags <= SMALL]).tolist():
        begin, length = islands(codes[:-lag] == codes[lag:])
        long = length >= enough(lag)
        begin, length = begin[long], length[long]
        doc = np.searchsorted(starts, begin, side="right") - 1
        for d, b, n in zip(doc.tolist(), (begin - starts[doc]).tolist(), length.tolist()):
            runs[d].setdefault((b, n + lag), lag)
    far = lags > SMALL
    for d in np.unique(docs[far]).tolist():
        words, left = codes[starts[d] : starts[d + 1]], counts[base[d] : base[d + 1]].copy()

        def explained(length: int, period: int) -> None:
            multiples = np.arange(2 * period, length // 2 + 1, period)
            left[multiples] -= length - multiples

        for (_, length), period in runs[d].items():
            explained(length, period)
        for lag in lags[far & (docs == d)].tolist():
            if left[lag] < lag:
                continue
            for b, n in _long_lag(words, lag):
                if (b, n + lag) not in runs[d]:
                    runs[d][b, n + lag] = lag
                    explained(n + lag, lag)
    return [sorted((b, n, q) for (b, n), q in found.items()) for found in runs]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        codes = np.fromiter((numbers[w] for text in words for w in text), np.int64, int(starts[-1]))
        codes += np.repeat(np.arange(len(words)), sizes) * max(1, len(numbers))
        runs = periodic_runs(codes, starts)
        texts = []
        for text, found in zip(words, runs):
            if found:
                edges = np.zeros(len(text) + 1, np.int64)
                for begin, length, period in found:
                    edges[begin + period] += 1
                    edges[begin + length] -= 1
                text = [text[i] for i in np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()]
            texts.append(b" ".join(text))
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        flat = [pa.array([r[k] for found in runs for r in found], pa.int64()) for k in range(3)]
        struct = pa.StructArray.from_arrays(flat, names=["start", "length", "period"])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct), pa.array(texts, pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )


def runs(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed of documents (doc_id, text).

    Words are numbered from 0. collapsed: the words without those that a run repeats, joined by one space; of each run its
    first period stays.
    """
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(lean(_found), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(documents: DataFrame) -> DataFrame:
    """doc_id and text, with runs planted in a tenth of the texts, by h, the crc32 of the decimal doc_id (null: empty).

    If h % 10 = 0, each word i >= a becomes word a + (i - a) % p, where g = h / 10 (whole), a = g % n and
    p = 1 + (n - a) / (3 + g % 8) (whole), of n words.
    """
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g, n = F.floor(h / 10), F.greatest(F.size(words), F.lit(1))
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(cycle, F.lit(1), n - a)), " ")
    return read.select("doc_id", F.when(h % 10 == 0, text).otherwise(F.col("text")).alias("text"))
