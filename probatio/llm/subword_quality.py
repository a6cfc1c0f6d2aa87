"""Quality scores from supervised subword embeddings.

A document is the mean of learned vectors of its words, its word pairs and the character n-grams
of its words, all hashed into one table; a softmax over the mean gives the label. Vectors and
output weights are trained together by stochastic gradient descent in numpy, on a bounded sample
of labelled rows; every document is scored where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import id_and_text
from probatio.llm.words import BASE, Letters, WordIndex, batch_bytes, groups, mix, split_words


@dataclass(frozen=True)
class Settings:
    """``max_rows``: most labelled rows the model is fitted on, those of smallest id hash."""

    buckets: int = 1 << 17
    dims: int = 16
    sizes: tuple[int, ...] = (3, 4)
    max_rows: int = 4000
    epochs: int = 8
    rate: float = 0.5
    seed: int = 7


class Features:
    """Hashed features of documents, by way of a table of distinct words: per word its buckets."""

    def __init__(self, settings: Settings, limit: int = 200_000):
        self.s, self.index = settings, WordIndex(limit)
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.empty(0, np.uint64)

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word, word number and bucket of each of the words' own features)."""
        letters = Letters(words)
        hashes = letters.word_hashes()
        owners, found = [np.arange(len(words))], [hashes]
        for n in self.s.sizes:
            owner, h = letters.ngrams(n)
            owners.append(owner)
            found.append(h)
        return hashes, np.concatenate(owners), self.bucket(np.concatenate(found))

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes % np.uint64(self.s.buckets)).astype(np.int64)

    def pairs(self, hashes: np.ndarray) -> np.ndarray:
        """Bucket of each neighbouring pair; a word followed by itself is one feature for all words."""
        left, right = hashes[:-1], hashes[1:]
        return self.bucket(np.where(left == right, np.uint64(1), mix(left * BASE + right)))

    def document(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(distinct buckets, their counts) of one whole text."""
        words = split_words(text)
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.float32)
        distinct, times = np.unique(np.array(words, dtype=object), return_inverse=True)
        hashes, owner, bucket = self.of_words(list(distinct))
        counts = np.bincount(bucket, np.bincount(times, minlength=len(distinct))[owner], self.s.buckets)
        counts += np.bincount(self.pairs(hashes[times]), minlength=self.s.buckets)
        used = np.flatnonzero(counts)
        return used, counts[used].astype(np.float32)


@dataclass
class Model:
    """``vectors`` (buckets x dims), ``weights`` (dims x 2), ``bias`` (2)."""

    settings: Settings
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def slopes(self) -> np.ndarray:
        """What one occurrence of a bucket adds to the log odds of label 1, before the mean is
        taken: the softmax of a mean of vectors needs no more than this."""
        return self.vectors @ (self.weights[:, 1] - self.weights[:, 0])

    def level(self) -> float:
        return float(self.bias[1] - self.bias[0])


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings) -> Model:
    """Stochastic gradient descent over (buckets, counts, label) rows with a falling rate. Without
    rows the model scores 0.5; with one label it learns that."""
    rng = np.random.default_rng(settings.seed)
    model = Model(settings, rng.uniform(-1, 1, (settings.buckets, settings.dims)).astype(np.float32) / settings.dims,
                  np.zeros((settings.dims, 2), np.float32), np.zeros(2, np.float32))
    steps, done = settings.epochs * max(1, len(rows)), 0
    for _ in range(settings.epochs):
        for k in rng.permutation(len(rows)):
            used, counts, label = rows[k]
            rate = settings.rate * (1 - done / steps)
            done += 1
            share = counts / max(counts.sum(), 1)
            mean = share @ model.vectors[used]
            logits = mean @ model.weights + model.bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            back = model.weights @ p
            model.weights -= rate * np.outer(mean, p)
            model.bias -= rate * p
            model.vectors[used] -= (rate * share)[:, None] * back * len(used) ** 0.5
    return model


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % folds


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), folds: int = 5, held: int = 0,
          label_col: str = "quality") -> Model:
    """Fits on at most ``settings.max_rows`` labelled rows outside the held-out fold. Their features,
    at most ``buckets`` numbers a row, are made by Spark; the fit runs on them in one process.
    Null labels and labels without a text are left out; an id labelled twice is read twice."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")) \
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held)) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_rows)
    sample = id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(settings)
        for batch in batches:
            rows = [features.document(t) for t in batch_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([u.astype("<u4").tobytes() for u, _ in rows], pa.binary()),
                pa.array([c.astype("<f4").tobytes() for _, c in rows], pa.binary()), batch.column("label")],
                names=["doc_id", "used", "counts", "label"])

    made = sample.mapInArrow(run, "doc_id long, used binary, counts binary, label int").collect()
    made.sort(key=lambda r: (r.doc_id, r.label, bytes(r.used)))
    return fit([(np.frombuffer(r.used, "<u4").astype(np.int64), np.frombuffer(r.counts, "<f4"), int(r.label == 1))
                for r in made], settings)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", table_limit: int = 200_000) -> DataFrame:
    """(doc_id, score) for each input row: the model's probability of label 1 for its whole text.
    Null and empty texts get what the bias alone says. Narrow; memory is bounded by an Arrow batch
    and a table of distinct words."""
    settings, slopes, level = model.settings, model.slopes().astype(np.float64), model.level()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, index = Features(settings), WordIndex(table_limit)
        hashes, sums, counts = np.empty(0, np.uint64), np.empty(0), np.empty(0)
        for batch in batches:
            texts, out = batch_bytes(batch.column("text")), []
            for a, b in groups([len(t) for t in texts]):
                parts = [split_words(t) for t in texts[a:b]]
                n = np.fromiter(map(len, parts), np.int64, b - a)
                numbers, new, emptied = index.numbers([w for p in parts for w in p])
                if emptied:
                    hashes, sums, counts = hashes[:0], sums[:0], counts[:0]
                if new:
                    h, owner, bucket = features.of_words(new)
                    hashes = np.concatenate([hashes, h])
                    sums = np.concatenate([sums, np.bincount(owner, slopes[bucket], len(new))])
                    counts = np.concatenate([counts, np.bincount(owner, minlength=len(new))])
                doc = np.repeat(np.arange(b - a), n)
                total = np.bincount(doc, sums[numbers], b - a)
                times = np.bincount(doc, counts[numbers], b - a)
                if len(numbers) > 1:
                    together = doc[:-1] == doc[1:]
                    pair = features.pairs(hashes[numbers])[together]
                    total += np.bincount(doc[:-1][together], slopes[pair], b - a)
                    times += np.bincount(doc[:-1][together], minlength=b - a)
                logit = total / np.maximum(times, 1) + level
                out.append(1 / (1 + np.exp(-np.clip(logit, -500, 500))))
            scores = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
