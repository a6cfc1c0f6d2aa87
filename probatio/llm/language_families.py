"""Language identification in two steps: the family first, then the languages within it.

Linear support vector machines over hashed words and character n-grams: one against the rest tells
the family, and within a family one machine for each pair of its languages votes. All of them are
trained in numpy by stochastic subgradient steps on a bounded sample; every document is scored where it
lies, over a table of distinct words, as each machine is linear in the mean of a text's features.

Null texts and texts without a letter are ``und`` with score 0, and so is everything if no row has a
language. Languages without a known family share one. A repeated row is scored again; a null id
belongs to the fold of an empty text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import id_and_text
from probatio.llm.words import Letters, WordIndex, batch_bytes, groups, split_words

#: Families of common languages, by ISO 639-1 code (fixed values; ``families`` replaces them).
FAMILIES = {
    "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "bg": "slavic", "cs": "slavic", "hr": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "uk": "slavic",
}
OTHER, UNKNOWN = "other", "und"
_ASCII, _LETTER = re.compile(rb"[A-Za-z]"), re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Settings:
    """``rows_per_language``: about how many rows of a language the machines are fitted on, chosen by a
    hash of id and text, and at most that times the number of languages in all. ``most_languages``: the most
    frequent languages that are told apart, which bounds the number of pairs."""

    buckets: int = 1 << 16
    sizes: tuple[int, ...] = (2, 3, 4)
    rows_per_language: int = 800
    most_languages: int = 20
    epochs: int = 6
    rate: float = 2.0
    decay: float = 1e-4
    seed: int = 11


def has_letter(text: bytes) -> bool:
    return bool(_ASCII.search(text)) or (not text.isascii() and bool(_LETTER.search(text.decode("utf-8", "replace"))))


class Features:
    """Hashed features of lower-cased words: the word itself and its character n-grams."""

    def __init__(self, settings: Settings):
        self.s = settings

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word number, bucket) of every feature."""
        letters = Letters(words)
        owners, hashes = [np.arange(len(words))], [letters.word_hashes()]
        for n in self.s.sizes:
            owner, h = letters.ngrams(n)
            owners.append(owner)
            hashes.append(h)
        return np.concatenate(owners), (np.concatenate(hashes) % np.uint64(self.s.buckets)).astype(np.int64)

    def document(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(distinct buckets, their share of all features) of one whole text."""
        words = split_words(text.lower())
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.float32)
        distinct, times = np.unique(np.array(words, dtype=object), return_counts=True)
        owner, bucket = self.of_words(list(distinct))
        counts = np.bincount(bucket, times[owner], self.s.buckets)
        used = np.flatnonzero(counts)
        return used, (counts[used] / counts.sum()).astype(np.float32)


Row = tuple[np.ndarray, np.ndarray]


def machine(rows: list[Row], sides: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """(weights, bias) of a support vector machine; ``sides`` is +1 or -1 for each row.

    Subgradient steps on the hinge loss with a falling rate and shrinking weights. Features are scaled to unit length
    while fitting, and the scale of a typical row is folded into the weights at the end.
    """
    weights, bias, scale = np.zeros(settings.buckets), 0.0, 1.0
    rng = np.random.default_rng(settings.seed)
    norms = np.array([float(np.sqrt((s * s).sum())) or 1.0 for _, s in rows])
    share = {side: 0.5 / max(1, (sides == side).sum()) * len(rows) for side in (1, -1)}  # both sides weigh the same
    steps, done = settings.epochs * max(1, len(rows)), 0
    for _ in range(settings.epochs):
        for k in rng.permutation(len(rows)):
            used, values = rows[k]
            x, side = values / norms[k], sides[k]
            rate = settings.rate * (1 - done / steps)
            done += 1
            margin = side * (scale * (weights[used] @ x) + bias)
            scale *= 1 - rate * settings.decay
            if margin < 1:
                weights[used] += rate * share[side] * side / scale * x
                bias += 0.1 * rate * share[side] * side
    return weights * scale / (float(np.median(norms)) if len(rows) else 1.0), bias


@dataclass
class Model:
    """``languages`` by family; ``weights`` (buckets x machines) and ``bias``: first a machine per family if
    there are several, then one per pair of languages of a family."""

    settings: Settings
    families: list[tuple[str, list[str]]]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores for rows of margins, a column per machine. The score is the chosen
        family's chance times that of the chosen language against its closest rival."""
        chance = 1 / (1 + np.exp(-np.clip(margins, -50, 50)))
        n_families = len(self.families)
        several = n_families > 1
        family = margins[:, :n_families].argmax(axis=1) if several else np.zeros(len(margins), np.int64)
        score = chance[np.arange(len(margins)), family] if several else np.ones(len(margins))
        names, at = np.empty(len(margins), object), n_families if several else 0
        for f, (_, languages) in enumerate(self.families):
            mine, pairs = family == f, list(combinations(range(len(languages)), 2))
            votes = np.zeros((int(mine.sum()), len(languages)))
            closest = np.ones_like(votes)
            for k, (a, b) in enumerate(pairs, at):
                p = chance[mine, k]
                votes[:, a] += (p >= 0.5) + p * 1e-3  # an equal number of votes is settled by the margins
                votes[:, b] += (p < 0.5) + (1 - p) * 1e-3
                closest[:, a], closest[:, b] = np.minimum(closest[:, a], p), np.minimum(closest[:, b], 1 - p)
            at += len(pairs)
            top = votes.argmax(axis=1)
            names[mine] = np.array(languages, object)[top]
            score[mine] *= closest[np.arange(len(top)), top]
        return list(names), score


def fit(rows: list[Row], langs: list[str], settings: Settings, families: dict[str, str]) -> Model:
    by_family: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        by_family.setdefault(families.get(lang, OTHER), []).append(lang)
    order, lang_of = sorted(by_family.items()), np.array(langs, object)
    family_of = np.array([families.get(x, OTHER) for x in langs], object)
    made = [machine(rows, np.where(family_of == name, 1, -1), settings) for name, _ in order] if len(order) > 1 else []
    for _, languages in order:
        for a, b in combinations(languages, 2):
            mine = np.flatnonzero((lang_of == a) | (lang_of == b))
            made.append(machine([rows[i] for i in mine], np.where(lang_of[mine] == a, 1, -1), settings))
    weights = np.stack([w for w, _ in made], axis=1) if made else np.empty((settings.buckets, 0))
    return Model(settings, order, weights.astype(np.float32), np.array([b for _, b in made]))


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % folds


def train(docs: DataFrame, settings: Settings = Settings(), families: dict[str, str] | None = None, folds: int = 5, held: int = 0,
          lang_col: str = "lang") -> Model:
    """Fits on a sample of the rows outside the held-out fold that have a language and a text. Their
    features, at most ``buckets`` numbers a row, are made by Spark; the fit runs on them in one process."""
    known = id_and_text(docs, "doc_id", "text", docs[lang_col].cast("string").alias("lang")) \
        .where(F.col("lang").isNotNull() & (F.col("text") != "") & (fold(F.col("doc_id"), folds) != held))
    shares = known.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(settings.most_languages)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.join(F.broadcast(shares), "lang").withColumn("draw", draw) \
        .where(F.col("draw") * F.col("rows") < settings.rows_per_language) \
        .dropDuplicates(["doc_id", "lang", "text"]).orderBy("draw", "doc_id", "lang").limit(settings.rows_per_language * settings.most_languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(settings)
        for batch in batches:
            rows = [features.document(t) for t in batch_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([
                batch.column("lang"), batch.column("draw"), pa.array([u.astype("<u4").tobytes() for u, _ in rows], pa.binary()),
                pa.array([s.astype("<f4").tobytes() for _, s in rows], pa.binary())], names=["lang", "draw", "used", "shares"])

    made = sample.select("lang", "draw", "text").mapInArrow(run, "lang string, draw double, used binary, shares binary").collect()
    made.sort(key=lambda r: (r.lang, r.draw, bytes(r.used)))
    return fit([(np.frombuffer(r.used, "<u4").astype(np.int64), np.frombuffer(r.shares, "<f4")) for r in made],
               [r.lang for r in made], settings, FAMILIES if families is None else families)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", table_limit: int = 200_000) -> DataFrame:
    """(doc_id, lang_pred, score) for each input row. Narrow; memory is bounded by an Arrow batch and a
    table of distinct words."""
    settings, machines = model.settings, model.weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, index = Features(settings), WordIndex(table_limit)
        sums, counts = np.empty((0, machines)), np.empty(0)
        for batch in batches:
            texts, names, scores = batch_bytes(batch.column("text")), [], []
            for a, b in groups([len(t) for t in texts]):
                parts = [split_words(t.lower()) for t in texts[a:b]]
                n = np.fromiter(map(len, parts), np.int64, b - a)
                numbers, new, emptied = index.numbers([w for p in parts for w in p])
                if emptied:
                    sums, counts = sums[:0], counts[:0]
                if new:
                    owner, bucket = features.of_words(new)
                    more = np.stack([np.bincount(owner, model.weights[bucket, m], len(new)) for m in range(machines)], axis=1) \
                        if machines else np.empty((len(new), 0))
                    sums, counts = np.concatenate([sums, more]), np.concatenate([counts, np.bincount(owner, minlength=len(new))])
                doc = np.repeat(np.arange(b - a), n)
                times = np.maximum(np.bincount(doc, counts[numbers], b - a), 1)
                margins = np.empty((b - a, machines))
                for m in range(machines):
                    margins[:, m] = np.bincount(doc, sums[numbers, m], b - a) / times + model.bias[m]
                if model.families:
                    langs, chance = model.predict(margins)
                else:
                    langs, chance = [UNKNOWN] * (b - a), np.zeros(b - a)
                told = [has_letter(t) for t in texts[a:b]]
                names += [x if ok else UNKNOWN for x, ok in zip(langs, told, strict=True)]
                scores += list(np.where(told, chance, 0.0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")
