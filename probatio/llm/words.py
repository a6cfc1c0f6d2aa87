"""Vectorised words: splitting bytes, hashing words and their n-grams, tables of distinct words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RANDOM = np.random.default_rng(20240229)
BYTE = _RANDOM.integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: bytes) -> list[bytes]:
    """Runs without blank, tab or line break of any kind: what bytes.split() takes as space."""
    return text.split()


def batch_bytes(column: pa.Array) -> list[bytes]:
    """A text column as bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def groups(sizes: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes add up to about ``most``; one larger item is a range of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which bounds what is unpacked at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Letters:
    """Words laid out as <word><word>..., ready for hashing."""

    def __init__(self, words: list[bytes]):
        self.data = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8)
        self.lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.word = np.repeat(np.arange(len(words)), self.lengths)
        self.codes = BYTE[self.data]

    def word_hashes(self) -> np.ndarray:
        place = np.arange(len(self.data)) - self.starts[self.word]
        powers = np.cumprod(np.full(int(self.lengths.max()), BASE, np.uint64))
        return mix(np.add.reduceat(self.codes * powers[place], self.starts))

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word number, hash) of each n-gram of bytes inside a word's brackets."""
        last = len(self.data) - n + 1
        if last <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = np.zeros(last, np.uint64)
        for j in range(n):
            h = h * BASE + self.codes[j:j + last]
        inside = self.word[:last] == self.word[n - 1:]
        return self.word[:last][inside], mix(h[inside] + np.uint64(n))


class WordIndex:
    """Numbers distinct words. The owner keeps arrays by number and fills them for new words; when
    ``limit`` is passed everything is forgotten, which bounds memory and changes no result."""

    def __init__(self, limit: int):
        self.limit, self.number = limit, {}

    def numbers(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes], bool]:
        """(number of each word, words that are new, was the table emptied)."""
        distinct = set(words)
        new = [w for w in distinct if w not in self.number]
        emptied = len(self.number) + len(new) > self.limit and bool(self.number)
        if emptied:
            self.number.clear()
            new = list(distinct)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)), new, emptied


def pieces_at_blanks(texts: pa.Array, unusual: str, by_hand: Callable[[str], list[str]]) -> pa.ListArray:
    """Each text cut at its blanks, without them; a text that matches ``unusual`` is cut ``by_hand``."""
    lists = pc.split_pattern(texts, " ")
    odd = pc.match_substring_regex(texts, unusual)
    if not pc.any(odd).as_py():
        return lists
    chosen = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    place = np.arange(len(texts))
    place[chosen] = len(texts) + np.arange(len(chosen))
    cut = pa.array([by_hand(t) for t in texts.take(pa.array(chosen)).to_pylist()], lists.type)
    return pa.concat_arrays([lists, cut]).take(pa.array(place))


class IdTable:
    """Ids of distinct words. Words are numbered; their ids lie in one array, and those of a text are
    gathered from it by number. A subclass's ``_encoded`` gives the ids of new words. The words
    themselves are one Arrow column, in which Arrow looks a group's words up: as Python strings in
    a dictionary they took ten times the memory, in every worker of an executor.

    When ``limit`` words are held, those met in one group of texts only are forgotten, and
    of the others the less used half: that bounds memory and changes no result.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self._keep(pa.array([], pa.string()), np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64))

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(places of the words in some order, arrays that hold their ids in that order, how many each has)."""
        raise NotImplementedError

    def _keep(self, words: pa.Array, pool: np.ndarray, lengths: np.ndarray, uses: np.ndarray) -> None:
        self.words, self.pool, self.lengths, self.uses = words, pool, lengths, uses
        self.starts = np.cumsum(lengths) - lengths

    def _forget(self) -> None:
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > self.limit // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[:self.limit // 2]])
        self._keep(self.words.take(pa.array(kept)), self.gather(kept), self.lengths[kept], self.uses[kept] // 2)

    def _learn(self, words: pa.Array) -> np.ndarray:
        order, found, lengths = self._encoded(words.to_pylist())
        numbers = np.empty(len(words), np.int64)
        numbers[order] = len(self.words) + np.arange(len(words))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
        self.pool = np.concatenate([self.pool, *found])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])
        self.words = pa.concat_arrays([self.words, words.take(pa.array(order))])
        return numbers

    def _known(self, words: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)

    def numbers(self, distinct: pa.Array | list[str]) -> np.ndarray:
        """The number of each of a group's distinct words; what an earlier call gave may be void."""
        distinct = pa.array(distinct, pa.string()) if isinstance(distinct, list) else distinct.cast(pa.string())
        out = self._known(distinct)
        if len(self.words) and len(self.words) + int((out < 0).sum()) > self.limit:
            self._forget()
            out = self._known(distinct)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            out[missing] = self._learn(distinct.take(pa.array(missing)))
        self.uses[out] += 1
        return out

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of words, one after the other."""
        lengths = self.lengths[numbers]
        before = np.cumsum(lengths) - lengths
        return self.pool[np.arange(int(lengths.sum())) + np.repeat(self.starts[numbers] - before, lengths)]

    def sizes(self, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How many ids each text has, being made of ``counts`` of the words ``numbers``."""
        upto = np.append(0, np.cumsum(self.lengths[numbers]))
        return np.diff(upto[np.append(0, np.cumsum(counts))])


def give_back() -> None:
    """Memory that Arrow and the C library hold but no longer use goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which gives unused memory back after its last batch: a worker stays when its task has
    ended, beside the workers and the JVM of all later stages."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()
    return tidied


_TABLES: dict[tuple, object] = {}


def worker_table(kind: type, path: str, limit: int):
    """The worker's table of a kind, kept from task to task."""
    if (kind, path, limit) not in _TABLES:
        _TABLES[kind, path, limit] = kind(path, limit)
    return _TABLES[kind, path, limit]
