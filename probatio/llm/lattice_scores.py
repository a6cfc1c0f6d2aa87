"""Document probabilities summed over all segmentations into subwords.

The vocabulary is an existing one. Its pieces get unigram scores from the training documents, as
its own file holds merge ranks and no probabilities. A text is its words, each behind a marker,
and one end symbol. No piece holds a marker behind another character, so the sum over all
segmentations of a document is the product of the sums over its words, each found by a forward
recursion in log space, once per distinct word of the corpus. Characters outside the vocabulary
are spelled in byte pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import id_and_text, package_path, sentencepiece_model
from probatio.llm.words import batch_bytes, split_words
from probatio.session import written

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: The end symbol as a word; no word is empty.
END = b""
#: Distinct words a task counts before it hands them on.
FLUSH = 400_000
#: Words whose scores each worker holds; all others are joined.
HEAD_WORDS = 200_000
SHORT = 48


# ---- counting --------------------------------------------------------------------------------
def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over (text, training): c counts training occurrences; words of other documents
    are listed with 0. Tasks count before they shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, other = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            rows = [*learned.items(), *((w, 0) for w in other if w not in learned)]
            learned.clear()
            other.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.int64())],
                                              names=["word", "c"])

        for batch in batches:
            for text, training in zip(batch_bytes(batch.column("text")), batch.column("training").to_pylist(), strict=True):
                into = learned if training else other
                into.update(split_words(text.lower()))
                into[END] += 1
                if len(learned) + len(other) > FLUSH:
                    yield flush()
        yield flush()

    return docs.select("text", "training").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def count_pieces(words: DataFrame, path: str) -> DataFrame:
    """(piece, n): how often each piece occurs when the library segments the training words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = sentencepiece_model(path)
        total = np.zeros(sp.vocab_size(), np.int64)
        for batch in batches:
            ids = sp.encode([w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()], num_threads=1)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            weights = np.repeat(batch.column("c").to_numpy(), lengths)
            flat = np.fromiter((i for row in ids for i in row), np.int64, int(lengths.sum()))
            # exact sums of integers: a float's 53 bits hold what one batch can reach
            total += np.bincount(flat, weights, sp.vocab_size()).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "n"])

    known = words.where((F.col("c") > 0) & (F.col("word") != F.lit(END)))
    return known.mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))


# ---- the lattice -----------------------------------------------------------------------------
class Lattice:
    """Forward recursion over a vocabulary with log10 scores. ``scores``: text of a piece to its
    score; ``byte_scores``: score of each of the 256 byte pieces."""

    def __init__(self, scores: dict[str, float], byte_scores: np.ndarray):
        self.scores, self.byte_scores = scores, byte_scores
        self.longest = max(map(len, scores), default=1)
        self.single = np.random.default_rng(5).integers(1, 2 ** 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        keys = self._hash_all(list(scores))
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.fromiter(scores.values(), np.float64, len(scores))[order]

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def _codes(self, codes: np.ndarray) -> np.ndarray:
        return self.single[codes & 0xFFFF] + codes.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)

    def _hash_all(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.uint64)
        for k, text in enumerate(texts):
            h = np.zeros(1, np.uint64)
            for x in self._codes(np.array([ord(c) for c in text], np.int64)):
                h = h * self.BASE + x
            out[k] = h[0]
        return out

    def _spelled(self, char: str) -> float:
        """Score of a character in byte pieces."""
        return float(self.byte_scores[list(char.encode("utf-8", "surrogatepass"))].sum())

    def long_word(self, word: str) -> float:
        """One word of any length: work in proportion to its length."""
        ahead = [0.0]
        for j in range(1, len(word) + 1):
            terms = [ahead[j - 1] + self._spelled(word[j - 1])]
            for i in range(max(0, j - self.longest), j):
                score = self.scores.get(word[i:j])
                if score is not None:
                    terms.append(ahead[i] + score)
            top = max(terms)
            ahead.append(top + float(np.log10(sum(10 ** (t - top) for t in terms))))
        return ahead[-1]

    def same_length(self, words: list[str]) -> np.ndarray:
        """Words of one length, all at once."""
        n = len(words[0])
        codes = np.array([[ord(c) for c in w] for w in words], np.int64).T
        distinct, where = np.unique(codes, return_inverse=True)
        spelled = np.array([self._spelled(chr(c)) for c in distinct])[where].reshape(codes.shape)
        values = self._codes(codes)
        ahead = np.full((n + 1, len(words)), -np.inf)
        ahead[0] = 0
        # hashes[i]: of the characters from i to the current end
        hashes = np.zeros((n, len(words)), np.uint64)
        for j in range(1, n + 1):
            low = max(0, j - self.longest)
            hashes[low:j] = hashes[low:j] * self.BASE + values[j - 1]
            flat = hashes[low:j].reshape(-1)
            at = np.minimum(np.searchsorted(self.keys, flat), len(self.keys) - 1)
            found = np.where(self.keys[at] == flat, self.values[at], -np.inf).reshape(j - low, -1)
            terms = np.vstack([ahead[low:j] + found, ahead[j - 1] + spelled[j - 1]])
            top = terms.max(axis=0)
            ahead[j] = top + np.log10((10 ** (terms - top)).sum(axis=0))
        return ahead[n]

    def score(self, words: list[str]) -> np.ndarray:
        """log10 of the probability of each marked word."""
        out = np.empty(len(words))
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_length.setdefault(len(word), []).append(k)
        for n, places in by_length.items():
            if n > SHORT or len(places) < 8:
                out[places] = [self.long_word(words[k]) for k in places]
            else:
                for a in range(0, len(places), 4096):
                    some = places[a:a + 4096]
                    out[some] = self.same_length([words[k] for k in some])
        return out


def unigram(pieces: list[tuple[int, int]], ends: int, path: str) -> tuple[dict[str, float], np.ndarray, float]:
    """(scores, byte scores, end score): add-one smoothed log10 shares of all pieces and the end."""
    sp = sentencepiece_model(path)
    n = np.ones(sp.vocab_size())
    for piece, count in pieces:
        n[piece] += count
    usable = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    total = n[usable].sum() + ends + 1
    shares = np.log10(n / total)
    scores = {sp.id_to_piece(i): float(shares[i]) for i in usable if not sp.is_byte(i)}
    as_bytes = np.array([shares[sp.piece_to_id(f"<0x{b:02X}>")] for b in range(256)])
    return scores, as_bytes, float(np.log10((ends + 1) / total))


def score_words(words: DataFrame, lattice: Lattice, end_score: float) -> DataFrame:
    """(word, c, lp): log10 probability of each distinct word over all its segmentations."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("word").to_pylist()
            lp = lattice.score([MARK + w.decode("utf-8", "replace") for w in raw])
            lp[[k for k, w in enumerate(raw) if w == END]] = end_score
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(lp)], names=["word", "c", "lp"])

    return words.mapInArrow(run, "word binary, c long, lp double")


# ---- documents -------------------------------------------------------------------------------
def score_documents(docs: DataFrame, training: str, model: str | None = None, id_col: str = "doc_id",
                    text_col: str = "text", head_words: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, training, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    ``training``: SQL condition on the id that says which documents the counts come from. Words of
    the ``head_words`` largest counts are looked up in each worker; a document's other words are
    joined with the table of distinct words and summed by row. A null or empty text has one token,
    its end. Without training documents all counts are 0 and shares are uniform.
    """
    path = model or package_path(MODEL)
    source = id_and_text(docs, id_col, text_col).withColumn("training", F.expr(training))
    counted = written(count_words(source), "words")
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    ends = counted.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    # one row per piece of the vocabulary at most
    scores, as_bytes, end_score = unigram([tuple(r) for r in count_pieces(counted, path).collect()], ends, path)
    words = written(score_words(counted, Lattice(scores, as_bytes), end_score), "word-scores") \
        .withColumn("lc", F.log10(F.col("c") + 1.0))
    head = docs.sparkSession.sparkContext.broadcast({
        bytes(r.word): (r.c > 0, r.lc, r.lp) for r in words.orderBy(F.desc("c"), "word").limit(head_words).toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        for batch in batches:
            rows = []
            for text in batch_bytes(batch.column("text")):
                counts = Counter(split_words(text.lower()))
                counts[END] += 1
                n, n_known, lc, lp, rest = 0, 0, 0.0, 0.0, []
                for word, times in counts.items():
                    n += times
                    at = known.get(word)
                    if at is None:
                        rest.append((word, times))
                    else:
                        n_known += times * at[0]
                        lc += times * at[1]
                        lp += times * at[2]
                rows.append((n, n_known, lc, lp, [w for w, _ in rest], [t for _, t in rest]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("training"),
                                              *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                                             names=["doc_id", "training", "n_tokens", "n_known", "lc", "lp", "words", "times"])

    rows = written(source.mapInArrow(run, "doc_id long, training boolean, n_tokens long, n_known long, lc double, lp double, "
                                          "words array<binary>, times array<int>")
                   .withColumn("row", F.monotonically_increasing_id()), "document-words")
    rest = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), "w.times")
    added = rest.join(words, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.col("lc")).alias("more_lc"), F.sum(F.col("times") * F.col("lp")).alias("more_lp"))
    none = F.lit(0.0)
    return rows.drop("words", "times").join(added, "row", "left").select(
        "doc_id", "training", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("lc") + F.coalesce("more_lc", none) - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        (F.col("lp") + F.coalesce("more_lp", none)).alias("score"))
