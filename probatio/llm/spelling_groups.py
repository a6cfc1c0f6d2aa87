"""Spelling variants: words one edit apart, found by dense tiles of prefix and suffix comparisons.

Two words are one inserted, deleted or replaced code point apart exactly if their lengths differ by at
most one and their common prefix and common suffix together reach the longer length minus one. Words
are laid out as padded matrices of code points, once from the front and once from the back, and
blocks of them are compared with each other column by column.

Which blocks meet: of two such words the common prefix or the common suffix reaches half of the longer
length minus one. So each word is put, for its own length and for the next, under a half from
the front and a half from the back, and only words under one half are tiled. A half that very many
words have is laid out as a grid of blocks, so no task holds more than two of them.

Counting: each task sums the words of its texts in a table of bounded size; the sums are added by word.
Words beyond Latin-1 letters are separators. Null and empty texts hold no word; a repeated row counts
again; a null id is an empty text in the checksum. Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import id_and_text
from probatio.llm.words import slices
from probatio.session import written

#: Words a task counts before it passes its sums on.
COUNTED = 300_000
#: Most rows and code points of a tile; most words under a half before they become a grid of blocks.
TILE, POINTS, GRID = 128, 1 << 22, 2000
_LETTERS = bytes(b if chr(b).isascii() and chr(b).isalpha() or b >= 0xC0 else 0x20 for b in range(256)).lower()


def words_of(text: str) -> list[bytes]:
    """Runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8, with A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(_LETTERS).decode("latin-1").encode().split()


def shortened(word: bytes, h: int) -> bytes:
    """The word without its code point h % length."""
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1:]).encode()


def word_counts(docs: DataFrame, delete_every: int = 0, least_length: int = 6, least_count: int = 5, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(word, n) of all words of at least ``least_length`` code points and ``least_count`` occurrences.

    With ``delete_every``, a word of a document loses one code point if that number divides the
    checksum of ``<doc_id>:<word>``, which gives a corpus known misspellings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[bytes] = Counter()

        def passed() -> pa.RecordBatch:
            kept = [(w, n) for w, n in sums.items() if n and len(w) >= least_length]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())],
                                              names=["word", "n"])

        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                sums.update(words)
                if delete_every and words:
                    distinct = list(set(words))
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    checks = np.fromiter(map(zlib.crc32, distinct, repeat(start)), np.int64, len(distinct))
                    for i in np.flatnonzero(checks % delete_every == 0):
                        n = words.count(distinct[i])
                        sums[distinct[i]] -= n
                        sums[shortened(distinct[i], int(checks[i]))] += n
                if len(sums) > COUNTED:
                    yield passed()
                    sums.clear()
        yield passed()

    counted = id_and_text(docs, id_col, text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.select(F.col("word").cast("string").alias("word"), "n") \
        .where((F.col("n") >= least_count) & (F.char_length("word") >= least_length))


class Tile:
    """Words as matrices of code points from the front and from the back, zeros behind."""

    def __init__(self, words: list[str]):
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        width = int(self.length.max())
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        codes = codes.astype(np.uint8) if codes.max() < 256 else codes
        row = np.repeat(np.arange(len(words)), self.length)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        self.front = np.zeros((width, len(words)), codes.dtype)
        self.back = np.zeros((width, len(words)), codes.dtype)
        self.front[place, row] = codes
        self.back[self.length[row] - 1 - place, row] = codes


def tile_ends(lengths: list[int], most: int) -> list[int]:
    """Where tiles end, so that each has at most ``most`` rows and, padded, ``POINTS`` code points, or one row."""
    ends, start, width = [], 0, 0
    for i, n in enumerate(lengths):
        width = max(width, n)
        if i > start and (i - start >= most or width * (i - start + 1) > POINTS):
            ends.append(i)
            start, width = i, n
    return [*ends, len(lengths)]


def _common(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Length of the common start of each pair of columns."""
    alive = np.ones((one.shape[1], other.shape[1]), bool)
    total = np.zeros(alive.shape, np.uint8 if len(one) < 256 else np.int32)
    for x, y in zip(one, other, strict=False):  # beyond the narrower tile nothing is common
        alive &= x[:, None] == y[None, :]
        if not alive.any():
            break
        total += alive
    return total


def compared(one: Tile, other: Tile) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(near, common prefix, longer length) of each pair from two tiles."""
    prefix, suffix = _common(one.front, other.front), _common(one.back, other.back)
    longer = np.maximum(one.length[:, None], other.length[None, :])
    apart = np.abs(one.length[:, None] - other.length[None, :])
    reach = prefix.astype(np.int64) + suffix
    # equal words reach twice their length
    return (apart <= 1) & (reach >= longer - 1) & ((apart == 1) | (reach < 2 * longer)), prefix, longer


def near_pairs(vocabulary: DataFrame, grid: int = GRID, tile: int = TILE) -> DataFrame:
    """(a, n_a, b, n_b) once for each two words of (word, n) that are one edit apart. Words are distinct."""
    length = F.char_length("word")
    placed = vocabulary.select("word", "n", F.explode(F.array(length, length + 1)).alias("longest")) \
        .withColumn("half", F.ceil((F.col("longest") - 1) / 2).cast("int")) \
        .select("word", "n", "longest", "half", F.explode(F.array(F.lit(True), F.lit(False))).alias("front")) \
        .withColumn("key", F.xxhash64("longest", "front", F.when(
            F.col("front"), F.left("word", F.col("half"))).otherwise(F.right("word", F.col("half"))))).drop("half")
    sizes = placed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    blocks = F.ceil(F.col("held") / grid).cast("int")
    cells = placed.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("word"), blocks).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))) \
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "longest", "front", "word", "n")
    parts = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def settle(rows: pa.Table) -> pa.RecordBatch:
        """Near pairs among whole cells."""
        key, i, j, block, longest, n = (rows[c].to_numpy() for c in ("key", "i", "j", "block", "longest", "n"))
        front, words = rows["front"].to_numpy(), rows["word"].to_pylist()
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        cell, across = np.cumsum(first), i != j
        ends, found = tile_ends(list(map(len, words)), tile), [[], []]
        starts = [0, *ends[:-1]]
        tiles = [Tile(words[a:b]) for a, b in zip(starts, ends, strict=True)]
        for p, (a, b) in enumerate(zip(starts, ends, strict=True)):
            for q in range(p, len(tiles)):
                c = starts[q]
                if cell[c] > cell[b - 1]:
                    break
                near, prefix, longer = compared(tiles[p], tiles[q])
                x, y = np.nonzero(near)
                prefix, longer = prefix[x, y], longer[x, y]
                x, y = x + a, y + c
                # each pair once: where its longer length is the cell's, under the front half if that is common
                half = longer // 2
                once = ((x < y) & (cell[x] == cell[y]) & (longest[x] == longer) & (longest[y] == longer) & (front[x] == front[y])
                        & (front[x] == (prefix >= half)) & ~(across[x] & (block[x] == block[y])))
                found[0].append(x[once])
                found[1].append(y[once])
        x, y = (np.concatenate(f) for f in found)
        word = rows["word"].combine_chunks()
        return pa.RecordBatch.from_arrays([word.take(pa.array(x)), pa.array(n[x]), word.take(pa.array(y)), pa.array(n[y])],
                                          names=["a", "n_a", "b", "n_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            fresh = pa.Table.from_batches([batch])
            held = fresh if held is None else pa.concat_tables([held, fresh])
            key, i, j = (held[c].to_numpy() for c in ("key", "i", "j"))
            last = (key == key[-1]) & (i == i[-1]) & (j == j[-1])
            whole = int(np.argmax(last))
            if whole:
                yield settle(held.slice(0, whole).combine_chunks())
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield settle(held.combine_chunks())

    return cells.mapInArrow(run, "a string, n_a long, b string, n_b long")


def spelling_forms(vocabulary: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word of (word, n).

    ``form`` is the most frequent word one edit away (ties: smallest in code-point order) if it occurs at
    least ``ratio`` times as often; ``root`` is where following forms ends. Every step multiplies the
    frequency, so chains are short; they are halved in each round.
    """
    vocabulary = written(vocabulary, "vocabulary")
    pairs = written(near_pairs(vocabulary), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    per_word = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("top"))
    said = written(vocabulary.join(per_word, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("top.n") >= ratio * F.col("n"), F.struct(F.col("top.near").alias("form"), (-F.col("top.n")).alias("n"))).alias("f"))
        .select("word", "n", "n_near", "f.form", F.col("f.n").alias("form_n")), "forms")
    chain, ahead = said.where("form IS NOT NULL").select("word", F.col("form").alias("root")), 1
    while ahead:
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        chain = written(chain.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        ahead = chain.where("moved").limit(1).count()
        chain = chain.drop("moved")
    return said.join(chain, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_groups(docs: DataFrame, delete_every: int = 0, least_length: int = 6, least_count: int = 5, ratio: int = 5,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`spelling_forms` of the words of all documents."""
    return spelling_forms(word_counts(docs, delete_every, least_length, least_count, id_col, text_col), ratio)
