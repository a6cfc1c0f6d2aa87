"""Ranked lexical search by range-maximum tables over posting lists.

Each posting list of a query's term carries a sparse table of range maxima over its impacts. A
search starts with one interval that holds all documents of a block. The sum over the query's
terms of the largest impact in an interval bounds every score in it, so the interval of the highest
bound is taken first: the document of its largest single impact is scored exactly, and the interval
is split there. Intervals that can no longer reach the result are dropped, and the search ends when
none is left. Documents of equal score rank by id, which intervals respect: their documents are in
ascending order, and an interval whose bound only equals the worst result stays if it may hold a smaller id.

Layout: texts are read once and become rows (doc_id, n, terms, tfs) of the query set's terms; these
rows are written, and the statistics are sums over them. Then every task cuts its rows into
blocks of bounded size, searches each block for every item, and keeps the best documents so far, which
also prune its next blocks. Only a task's best are shuffled. Queries are taken in sets of about ``most_terms``
distinct terms, so what goes to the tasks does not grow with the number of items.

Null and empty texts hold no term and are never found; an item without terms, or whose terms occur
nowhere, has no rows. A repeated document or item row counts and ranks as a row of its own. A null doc_id ranks
after all others of its score. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import ascii_lower, id_and_text
from probatio.llm.words import batch_bytes, slices
from probatio.operators.skew import top_per_key
from probatio.session import written

#: A term: letters, digits, and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


@dataclass(frozen=True)
class Limits:
    """``depth``: results per item. ``most_terms``: about how many terms of items are searched in one
    pass. ``block_documents`` and ``block_postings``: size of what a task indexes at a time."""

    depth: int = 50
    most_terms: int = 100_000
    block_documents: int = 16_384
    block_postings: int = 1_000_000


def terms_of(text: bytes) -> list[bytes]:
    """All terms of a text in UTF-8, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def term_weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    """What one occurrence list adds to a score, before the term's weight; at most 10^6."""
    m = 50 + (50 * n * n_documents) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: its number of terms with repeats, and
    which of the numbered terms it holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, counts, terms, tfs = [], [], [], []
            for text in batch_bytes(batch.column("text")):
                words = terms_of(text)
                found = [(numbers[w], k) for w, k in Counter(words).items() if w in numbers]
                sizes.append(len(words))
                counts.append(len(found))
                terms.extend(t for t, _ in found)
                tfs.extend(k for _, k in found)
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            out = pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(np.array(sizes, np.int64) > 0))

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Best:
    """The best documents of one item so far: scores falling, then ids rising, null ids last."""

    def __init__(self, depth: int):
        self.depth = depth
        self.scores = self.ids = np.empty(0, np.int64)
        self.nulls = np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        s, i, z = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.nulls, nulls)))
        order = np.lexsort((i, z, -s))[:self.depth]
        self.scores, self.ids, self.nulls = s[order], i[order], z[order]

    def open(self, bounds: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> np.ndarray:
        """May intervals of these bounds and first documents still change the result?"""
        if len(self.scores) < self.depth:
            return bounds > 0
        worst, last, last_null = self.scores[-1], self.ids[-1], self.nulls[-1]
        earlier = (nulls < last_null) | ((nulls == last_null) & (ids < last))
        return (bounds > worst) | ((bounds == worst) & earlier)


@dataclass
class Block:
    """Posting lists of a block of documents, one after the other, with their range-maximum table.

    ``keys``: term * documents + document, rising; ``impact``: of each posting; ``table[k][i]``: place
    of the first largest impact among the 2^k postings from i.
    """

    ids: np.ndarray
    nulls: np.ndarray
    keys: np.ndarray
    impact: np.ndarray
    table: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        longest, total = len(self.ids), len(self.keys)
        levels = max(1, int(longest).bit_length())
        self.table = np.empty((levels, total), np.int32)
        self.table[0] = np.arange(total)
        for k in range(1, levels):
            half, below = 1 << (k - 1), self.table[k - 1]
            self.table[k] = below
            left, right = below[:-half], below[half:]
            if len(right):
                self.table[k][:len(left)] = np.where(self.impact[left] >= self.impact[right], left, right)

    def largest(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, impact) of the first largest posting in each range a..b; impact 0 in empty ranges."""
        n = b - a
        k = np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1
        left, right = self.table[k, np.where(n > 0, a, 0)], self.table[k, np.where(n > 0, b - (1 << k), 0)]
        place = np.where(self.impact[left] >= self.impact[right], left, right)
        return place, np.where(n > 0, self.impact[place], 0)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best, most: int = 256) -> int:
        """Adds the block's documents to ``best`` where they belong; returns how many were scored."""
        if not len(self.keys):
            return 0
        size = len(self.ids)
        base = terms.astype(np.int64) * size
        a, b = np.searchsorted(self.keys, base), np.searchsorted(self.keys, base + size)
        held = b > a
        base, weights, a, b = base[held], weights[held], a[None, held], b[None, held]
        if not len(base):
            return 0
        low, high, scored, taken = np.zeros(1, np.int64), np.full(1, size, np.int64), 0, 4
        bound, split = self._bounds(a, b, weights)
        while len(low):
            keep = best.open(bound, self.ids[low], self.nulls[low])
            low, high, a, b, bound, split = (x[keep] for x in (low, high, a, b, bound, split))
            if not len(low):
                break
            order = np.lexsort((low, -bound))
            now, later = order[:taken], order[taken:]
            taken = min(most, taken * 2)
            at = split[now]
            place = np.searchsorted(self.keys, base[None, :] + at[:, None])
            inside = np.minimum(place, len(self.keys) - 1)
            has = (place < len(self.keys)) & (self.keys[inside] == base[None, :] + at[:, None])
            score = np.where(has, self.impact[inside], 0) @ weights
            best.add(score, self.ids[at], self.nulls[at])
            scored += len(at)
            below, above = at > low[now], at + 1 < high[now]
            parts = [np.concatenate(x) for x in (
                (low[now][below], at[above] + 1), (at[below], high[now][above]),
                (a[now][below], (place + has)[above]), (place[below], b[now][above]))]
            more, where = self._bounds(parts[2], parts[3], weights)
            low, high, a, b, bound, split = (np.concatenate([x[later], y]) for x, y in zip(
                (low, high, a, b, bound, split), (*parts, more, where), strict=True))
        return scored

    def _bounds(self, a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the largest impacts, document of the single largest) of each interval."""
        place, value = self.largest(a, b)
        value = value * weights[None, :]
        top = place[np.arange(len(place)), value.argmax(axis=1)]
        return value.sum(axis=1), self.keys[top] % len(self.ids)


def _block(parts: list[pa.RecordBatch], n_documents: int, n_terms: int) -> Block:
    """Posting lists of some rows of :func:`postings`."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    ids = rows["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
    nulls = rows["doc_id"].is_null().to_numpy()
    order = np.lexsort((ids, nulls))
    position = np.empty(len(order), np.int64)
    position[order] = np.arange(len(order))
    counts = pa.compute.list_value_length(rows["terms"]).to_numpy()
    terms, tfs = (pa.compute.list_flatten(rows[c]).to_numpy().astype(np.int64) for c in ("terms", "tfs"))
    keys = terms * len(order) + np.repeat(position, counts)
    by_key = np.argsort(keys, kind="stable")
    impact = impacts(tfs, np.repeat(rows["n"].to_numpy(), counts), n_documents, n_terms)
    return Block(ids[order], nulls[order], keys[by_key], impact[by_key])


def _searched(found: DataFrame, queries: list[tuple[int, np.ndarray]], weights: np.ndarray, n_documents: int, n_terms: int,
              limits: Limits) -> DataFrame:
    """(item_no, doc_id, score): the best documents of each task's rows for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {no: Best(limits.depth) for no, _ in queries}
        parts, rows, held = [], 0, 0

        def settle() -> None:
            block = _block(parts, n_documents, n_terms)
            for no, terms in queries:
                block.search(terms, weights[terms], best[no])

        for batch in slices(batches):
            size = pa.compute.sum(pa.compute.list_value_length(batch.column("terms"))).as_py() or 0
            if parts and (rows + batch.num_rows > limits.block_documents or held + size > limits.block_postings):
                settle()
                parts, rows, held = [], 0, 0
            parts.append(batch)
            rows, held = rows + batch.num_rows, held + size
        if parts:
            settle()
        for no, b in best.items():
            if len(b.ids):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(b.ids), no, np.int64)), pa.array(b.ids, pa.int64(), mask=b.nulls), pa.array(b.scores)],
                    names=["item_no", "doc_id", "score"])

    return found.mapInArrow(run, "item_no long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` its best documents."""
    words = F.array_distinct(F.regexp_extract_all(ascii_lower(items[item_text_col].cast("string")), F.lit(TERM), F.lit(0)))
    asked = written(items.select(F.monotonically_increasing_id().alias("item_no"), items[item_col].alias("item_id"), words.alias("terms"))
                    .where(F.size("terms") > 0), "search-items")
    texts = id_and_text(docs, id_col, text_col)
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    sets = max(1, math.ceil(total / limits.most_terms))
    out = None
    for k in range(sets):  # a set of items at a time, so that what goes to the tasks is bounded
        chosen = asked.where(F.pmod(F.xxhash64("item_no"), F.lit(sets)) == k)
        rows = chosen.select("item_no", "terms").collect()
        numbers = {w.encode(): i for i, w in enumerate(sorted({w for r in rows for w in r.terms}))}
        found = written(postings(texts, numbers), "postings")
        n_documents, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(numbers), np.int64)
        for t, df in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row per asked term
            weights[t] = term_weight(n_documents, df)
        queries = [(r.item_no, np.array([numbers[w.encode()] for w in r.terms])) for r in rows]
        best = _searched(found.where(F.size("terms") > 0), queries, weights, n_documents, max(1, n_terms), limits)
        ranked = top_per_key(best, ["item_no"], [F.desc("score"), F.asc_nulls_last("doc_id")], limits.depth, "doc_id")
        ranked = ranked.join(F.broadcast(chosen.select("item_no", "item_id")), "item_no").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.union(ranked)
    return out
