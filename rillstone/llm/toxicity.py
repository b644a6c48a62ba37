"""Toxicity by compression distance.

Two zstandard dictionaries share a base trained on ordinary text. One ends in the words that mark toxic documents, the other, as long, in words that mark ordinary
ones: words in at least SHARE of a class' sample documents (three at least) and RATIO times as frequent there as in the other class. A window is one word of the text in
a fixed frame that both dictionaries hold; its gain is the length it compresses to with the ordinary dictionary less that with the toxic one. A document's windows
are compared with a threshold of bytes, and counts, share and extremes of the gains give the score through a logistic calibration
that is fitted on documents that the dictionaries did not see.

The method named trains both dictionaries on whole texts of the two classes and compares windows of several words. That form was tried first (see the README for its
figures): toxic documents are ordinary prose but for a few words, so both dictionaries hold the same prose and the difference of two windows is mostly chance. Hence the
choice of words for the ends of the dictionaries, which is a selection by frequency, not by compression.

Fitted on at most SAMPLE labelled documents of each class, taken by the order of a hash of doc_id, whatever the corpus' size. Labels, language, source
and id never enter a score; whole texts do.

Defined results: a null or empty text has no windows and gets the calibrated score of none; a null doc_id counts as the text '' and is never fitted on; labels that are
null or of unknown documents are ignored, of several labels of a document the largest counts; without labels of both classes every score is 0; texts of any length are scored whole, a
word of any length part by part; ties and repeated rows are scored each for itself; an empty table gives no rows; other columns are ignored, or pass through in drop_toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, sole_memory, table

#: Labelled documents of each class that are used at most.
SAMPLE = 2000
#: Bytes of the base, zstandard's level, and what makes a word mark a class.
BASE_BYTES, LEVEL, SHARE, RATIO = 32768, 19, 0.02, 10
#: Bytes of gain from which a window speaks for toxicity.
GAIN = 3
CUT = 0.7
#: Windows whose gain a worker remembers before it starts anew, and the longest one it does.
CACHE_WORDS, CACHE_BYTES = 300_000, 64
FRAME = (bytes(range(1, 9)), bytes(range(14, 22)))
EDGES = b".,!?;:\"()%*#$&|"
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def windows(text: str | None) -> list[bytes]:
    return [w.strip(EDGES) for w in text.encode().translate(_LOWER).split()] if text else []


_opened: dict[tuple[bytes, bytes], tuple] = {}


class Scorer:
    """The gains of windows and the features of texts. Holds plain values only, so that it travels to workers."""

    def __init__(self, ordinary: bytes, toxic: bytes, level: int = LEVEL):
        self.dictionaries, self.level, self.weights = (ordinary, toxic), level, None

    def open(self) -> Scorer:
        """Ready to score; one worker process keeps what it has learned of the same dictionaries from task to task."""
        import zstandard as zstd

        sole_memory("toxicity", _opened.clear)
        if self.dictionaries in _opened:
            self.by, self.gains = _opened[self.dictionaries]
            return self

        own = lambda raw: zstd.ZstdCompressor(level=self.level, dict_data=zstd.ZstdCompressionDict(raw + b"".join(FRAME), dict_type=zstd.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False, write_checksum=False)
        self.by, self.gains = [own(d) for d in self.dictionaries], {}
        _opened.clear()
        _opened[self.dictionaries] = (self.by, self.gains)
        return self

    def gain(self, word: bytes) -> int:
        g = self.gains.get(word)
        if g is None:
            if len(self.gains) >= CACHE_WORDS:
                self.gains.clear()
            window = FRAME[0] + b" " + word[:256] + FRAME[1]
            g = len(self.by[0].compress(window)) - len(self.by[1].compress(window))
            for lo in range(256, len(word), 256):  # a word of any length, part by part
                window = FRAME[0] + word[lo : lo + 256] + FRAME[1]
                g = max(g, len(self.by[0].compress(window)) - len(self.by[1].compress(window)))
            if len(word) <= CACHE_BYTES:
                self.gains[word] = g
        return g

    def features(self, text: str | None) -> list[float]:
        known, words = self.gains, windows(text)
        g = [known[w] if w in known else self.gain(w) for w in words]
        if not g:
            return [0.0] * 4
        a = np.asarray(g)
        n, top = int((a >= GAIN).sum()), np.sort(a)[-3:]
        return [np.log1p(n), min(100 * n / len(a), 20.0), float(min(top[-1], 8)), float(top.mean())]

    def calibrate(self, texts: list, toxic: list[int]) -> None:
        """Logistic regression by Newton's method, with a small ridge."""
        x, y = np.asarray([self.features(t) for t in texts]), np.asarray(toxic, float)
        mean, scale = x.mean(0), x.std(0) + 1e-6
        x = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-x @ w))
            w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), x.T @ (p - y) + 0.5 * w)
        self.weights = (mean, scale, w)

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        mean, scale, w = self.weights
        return float(1 / (1 + np.exp(-np.clip((np.asarray(self.features(text)) - mean) / scale @ w[:-1] + w[-1], -30, 30))))


def marks(own: Counter, n_own: int, other: Counter, n_other: int) -> list[bytes]:
    """Words that mark a class of n_own documents, of which counts tell in how many each word stands; the most frequent last, where matches are cheapest."""
    found = [w for w, c in own.items() if w and c >= max(3, SHARE * n_own) and c / n_own >= RATIO * (other[w] + 0.5) / n_other]
    return sorted(found, key=lambda w: (own[w], w))


def train(ordinary: list[str], toxic: list[str]) -> Scorer | None:
    """Dictionaries from two thirds of the sample, the calibration from the rest (and from all of a tiny sample)."""
    if not ordinary or not toxic:
        return None
    import zstandard as zstd

    share = lambda x: (x[: max(1, len(x) * 2 // 3)], x[len(x) * 2 // 3 :] or x)
    (o, o_rest), (t, t_rest) = share(ordinary), share(toxic)
    words = [windows(x) for x in o]
    by_document = lambda texts: Counter(w for x in texts for w in set(x))
    plain, foul = by_document(words), by_document([windows(x) for x in t])
    samples = [b" ".join(x[i : i + 12]) for x in words[::2] for i in range(0, len(x), 12)]
    try:
        base = zstd.train_dictionary(BASE_BYTES, samples, k=48, d=6).as_bytes()
    except zstd.ZstdError:  # too little text to train on: the text itself
        base = b" ".join(samples)[-BASE_BYTES:]
    joined = lambda found: b"".join(b" " + w for w in found)
    tail1 = joined(marks(foul, len(t), plain, len(o)))
    tail0 = joined(marks(plain, len(o), foul, len(t)))[-len(tail1) :].rjust(len(tail1), b"\0") if tail1 else b""
    scorer = Scorer(base + tail0, base + tail1).open()
    scorer.calibrate(o_rest + t_rest, [0] * len(o_rest) + [1] * len(t_rest))
    return scorer


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer | None:
    """Trains on rows outside fold 1. The only rows that reach the driver are the sample's."""
    known = labels.filter(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = []
    for label in (0, 1):
        own = known.filter(F.col("toxic") == label).select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("key")).orderBy("key").limit(sample)
        # One text for each id, and at most sample of them, before any reaches the driver.
        rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(own), "doc_id").groupBy("key").agg(F.min("text").alias("text"))
        texts.append([r.text for r in rows.orderBy("key").limit(sample).collect()])
    return train(*texts)


def _scores(scorer: Scorer | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer.open() if scorer else None
        for batch in batches:
            values = [own.score(t.as_py()) if own else 0.0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """doc_id, score for every row."""
    if scorer:
        scorer.by, scorer.gains = None, {}  # opened anew on the workers
    narrow = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return narrow.mapInArrow(_scores(scorer), "doc_id long, score double")


def drop_toxic(docs: DataFrame, scorer: Scorer | None, cut: float = CUT) -> DataFrame:
    """The rows of docs whose text scores below cut, all columns as they were; the text is scored where it lies, without a join."""
    if scorer is None:
        return docs
    scorer.by, scorer.gains = None, {}
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer.open()
        for batch in batches:
            yield batch.filter(pa.array([own.score(t.as_py()) < cut for t in batch.column(place)], pa.bool_()))

    return small_batches(docs).mapInArrow(keep, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
