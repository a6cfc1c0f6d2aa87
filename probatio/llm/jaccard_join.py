"""Exact Jaccard join of word-shingle sets, and the components of its links.

1. Copies are one text. Of each text's shingles, the smallest by hash are compared with all others'
   (:mod:`shared_tokens`): a set with a partner shares all but a fifth of its shingles with it, so
   texts whose smallest shingles are mostly their own have none and drop out.
2. The rest is joined on prefixes with frequent shingles last, which gathers possible partners
   into families; families are cut into blocks of bounded size.
3. Within a block: inverted lists in order of set size, so a search skips to the sizes that can
   match; a set like one already searched derives bounds for its answers from that one's answers;
   sets already in one component are not compared again.
4. Across blocks of one family, sets outside its largest component ("guests", in blocks of their own)
   meet the blocks that hold one of their prefix shingles, in cells of one block of guests and one
   other block. The smaller set of a pair has its shared shingle in a shorter prefix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import id_and_text, packed, unpacked
from probatio.llm.shared_tokens import shared_tokens, shorten
from probatio.llm.words import BASE, Letters, WordIndex, batch_bytes, give_back, groups, mix, slices, split_words, tidy
from probatio.operators.components import connected_components
from probatio.operators.skew import attach_by_key
from probatio.session import written

WORDS, PERCENT = 5, 80
#: Frequent shingles told to each worker; they only set an order, so leaving some out harms no result.
FREQUENT = 200_000
BLOCK_SETS = 2000


def needed(n: np.ndarray | int, percent: int = PERCENT):
    """Shingles a set of ``n`` must share with any partner."""
    return -(-percent * n // 100)


def overlap_needed(n: np.ndarray | int, m: np.ndarray | int, percent: int = PERCENT):
    """Least intersection with percent * union at most 100 * intersection."""
    return -(-percent * (n + m) // (100 + percent))


# ---- sets ------------------------------------------------------------------------------------
class Shingles:
    """Hashed shingle sets of whole texts, words by way of a table of distinct words."""

    def __init__(self, words: int = WORDS, limit: int = 150_000):
        self.words, self.index, self.hashes = words, WordIndex(limit), np.empty(0, np.uint64)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted distinct hashes of each text's shingles; none for a text without words."""
        out: list[np.ndarray] = []
        for a, b in groups([len(t) for t in texts]):
            parts = [split_words(t.lower()) for t in texts[a:b]]
            numbers, new, emptied = self.index.numbers([w for p in parts for w in p])
            if emptied:
                self.hashes = self.hashes[:0]
            if new:
                self.hashes = np.concatenate([self.hashes, Letters(new).word_hashes()])
            h, at = self.hashes[numbers], 0
            size = self.words
            rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
            for j in range(size):
                rolled = rolled * BASE + h[j:j + len(rolled)]
            rolled = mix(rolled)
            for p in parts:
                n = len(p)
                if n >= size:
                    out.append(np.unique(rolled[at:at + n - size + 1]))
                elif n:
                    whole = np.array([n], np.uint64)
                    for x in h[at:at + n]:
                        whole = mix(whole * BASE + x)
                    out.append(whole)
                else:
                    out.append(np.empty(0, np.uint64))
                at += n
        return out


def probe_size(n: int, percent: int) -> int:
    """Smallest shingles compared with all texts: a tenth more than may be missing."""
    return min(n, n - needed(n, percent) + max(1, n // 10))


def _with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(docs, id_col, text_col).withColumn("key", F.xxhash64("text", F.length("text")))


def text_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n, set_key, tokens) per text, repeated as often as its row of smallest id: the size of its set, a hash of the set, and the set itself
    where it may have a partner. ``docs``: (doc_id, text, key); only the row of smallest id of each
    key is read further, and rows are joined by key and id, so that copies are spread."""
    def probes():
        shingles = Shingles(words)
        return lambda texts: [s[:probe_size(len(s), percent)].tobytes() for s in shingles.sets(texts)]

    shared = shared_tokens(docs, probes).select("key", (F.length("tokens") / 8).cast("int").alias("shared"))
    lowest = F.coalesce("doc_id", F.lit(-(1 << 63)))
    firsts = docs.select("key", lowest.alias("_id")).groupBy("key").agg(F.min("_id").alias("_id")).join(shared, "key", "left") \
        .withColumnRenamed("key", "_key")
    read = docs.withColumn("_first", lowest).join(firsts, (F.col("key") == F.col("_key")) & (F.col("_first") == F.col("_id"))) \
        .select("key", "text", F.coalesce("shared", F.lit(0)).alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in slices(batches):
            sets = shingles.sets(batch_bytes(batch.column("text")))
            sizes = [len(s) for s in sets]
            kept = []
            for s, n, hits in zip(sets, sizes, batch.column("shared").to_pylist(), strict=True):
                missing = n - needed(n, percent)
                kept.append(s.tobytes() if n and hits >= probe_size(n, percent) - missing else None)
            sums = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
            names = mix(sums + np.array(sizes, np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), pa.array(names), pa.array(kept, pa.binary())],
                                             names=["key", "n", "set_key", "tokens"])

    return read.mapInArrow(tidy(run), "key long, n long, set_key long, tokens binary")


# ---- families --------------------------------------------------------------------------------
def _frequent(sets: DataFrame, most: int) -> np.ndarray:
    """Shingles of two or more sets of one task, the most frequent first by count; at most ``most``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4000):
            blobs = batch.column("tokens").to_pylist()
            tokens, counts = np.unique(np.frombuffer(b"".join(blobs), "<u8"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[counts > 1].view(np.int64)), pa.array(counts[counts > 1])], names=["token", "n"])

    rows = sets.select("tokens").mapInArrow(tidy(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")) \
        .orderBy(F.desc("n"), "token").limit(most).toArrow()
    # as Arrow columns: collect() would merge every partition's first ``most`` rows in the driver, and make an object of each
    tokens, counts = (rows.column(c).to_numpy() for c in ("token", "n"))
    return tokens[np.lexsort((tokens, counts))].view(np.uint64)


def _prefix(tokens: np.ndarray, rank: np.ndarray, n: int, percent: int) -> np.ndarray:
    """The tokens of which a partner must have one, of a set of ``n`` with ``tokens`` shared by others:
    the rest come first and match nothing, then those of lowest rank, then of lowest hash."""
    return tokens[np.lexsort((tokens, rank))][:len(tokens) - needed(n, percent) + 1]


def shared_parts(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(set_key, n, tokens) of the ``sets`` (set_key, tokens) that may have a partner: ``tokens`` now are
    those that another set holds, enough of them for a partner. Intersections lie among these."""
    buckets = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = shared_tokens(sets.select(F.col("set_key").alias("key"), F.col("tokens").alias("text")), lambda: lambda blobs: blobs, buckets) \
        .withColumnRenamed("tokens", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, sizes, kept = [], [], []
            for key, blob, found in zip(*(batch.column(c).to_pylist() for c in ("set_key", "tokens", "shared")), strict=True):
                tokens = np.frombuffer(blob, "<u8")
                mine = tokens[np.isin(shorten(tokens, buckets), np.frombuffer(found, "<u8"))]
                if len(mine) >= needed(len(tokens), percent):
                    keys.append(key)
                    sizes.append(len(tokens))
                    kept.append(mine.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary())],
                                             names=["set_key", "n", "tokens"])

    return sets.join(shared, F.col("set_key") == F.col("key")).select("set_key", "tokens", "shared").mapInArrow(
        tidy(run), "set_key long, n long, tokens binary")


def ranking(sets: DataFrame, frequent: int = FREQUENT) -> Callable[[np.ndarray], np.ndarray]:
    """The order of shingles: a function from shingles to ranks, 0 for all but the frequent ones."""
    ordered = _frequent(sets, frequent)
    place = np.argsort(ordered)
    lookup = ordered[place]

    def ranks(tokens: np.ndarray) -> np.ndarray:
        if not len(lookup):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(lookup, tokens), len(lookup) - 1)
        return np.where(lookup[at] == tokens, place[at] + 1, 0)

    return ranks


def families(sets: DataFrame, ranks: Callable[[np.ndarray], np.ndarray], percent: int = PERCENT) -> DataFrame:
    """(id, cluster_id): family of each set that shares a prefix shingle with another; ``sets`` has
    (set_key, n, tokens). Each task ties its own sets, and sends one set per shingle to meet others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4000):
            found = []
            for n, blob in zip(batch.column("n").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                tokens = np.frombuffer(blob, "<u8")
                found.append(_prefix(tokens, ranks(tokens), n, percent))
            if not found:
                continue
            tokens = np.concatenate(found)
            owner = np.repeat(batch.column("set_key").to_numpy(), [len(f) for f in found])
            order = np.lexsort((owner, tokens))
            tokens, owner = tokens[order], owner[order]
            first = np.ones(len(tokens), bool)
            first[1:] = tokens[1:] != tokens[:-1]
            leader = owner[first][np.cumsum(first) - 1]
            ties = pd.DataFrame({"a": owner, "b": leader})[leader != owner].drop_duplicates()
            yield pa.RecordBatch.from_arrays([pa.array(tokens[first].view(np.int64)), pa.array(owner[first]), pa.nulls(int(first.sum()), pa.int64())],
                                             names=["token", "a", "b"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(ties), pa.int64()), pa.array(ties["a"].to_numpy()), pa.array(ties["b"].to_numpy())],
                                             names=["token", "a", "b"])

    rows = written(sets.select("set_key", "n", "tokens").mapInArrow(tidy(run), "token long, a long, b long"), "prefixes")
    met = rows.where(F.col("token").isNotNull())
    leaders = met.groupBy("token").agg(F.min("a").alias("leader"), F.max("a").alias("last")).where("leader <> last")
    ties = met.join(leaders, "token").where("a <> leader").select("a", F.col("leader").alias("b")).distinct()
    return connected_components(ties.unionByName(rows.where(F.col("b").isNotNull()).select("a", "b")), "a", "b")


# ---- exact search within a block ---------------------------------------------------------------
class Block:
    """Sets in memory, searched in order of size."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, percent: int):
        order = np.argsort(sizes, kind="stable")
        self.order, self.percent, self.sizes = order, percent, sizes[order]
        self.held = np.array([len(sets[k]) for k in order], np.int64)  # tokens that other sets have, too
        flat, ids = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
        self.ids, self.n_tokens = ids.astype(np.int64), len(flat)
        self.ends = np.cumsum(self.held)
        self.starts = self.ends - self.held
        counts = np.bincount(self.ids, minlength=self.n_tokens)
        by_rarity = np.empty(self.n_tokens, np.int64)
        by_rarity[np.argsort(counts, kind="stable")] = np.arange(self.n_tokens)
        prefixes = []
        for k, n in enumerate(self.sizes):
            mine = self.ids[self.starts[k]:self.ends[k]]
            prefixes.append(mine[np.argsort(by_rarity[mine])][:len(mine) - needed(n, percent) + 1])
        self.prefixes = prefixes
        tokens = np.concatenate(prefixes)
        owner = np.repeat(np.arange(len(sets)), [len(p) for p in prefixes])
        at = np.argsort(tokens, kind="stable")  # each list stays in order of size
        self.lists, self.bounds = owner[at], np.searchsorted(tokens[at], np.arange(self.n_tokens + 1))
        self.mask = np.zeros(self.n_tokens, bool)

    def tokens(self, k: int) -> np.ndarray:
        return self.ids[self.starts[k]:self.ends[k]]

    def overlaps(self, k: int, others: np.ndarray) -> np.ndarray:
        """Exact intersections of set ``k`` with each of ``others``."""
        self.mask[self.tokens(k)] = True
        lengths = self.held[others]
        first = np.cumsum(lengths) - lengths
        where = np.arange(int(lengths.sum())) + np.repeat(self.starts[others] - first, lengths)
        out = np.add.reduceat(self.mask[self.ids[where]].astype(np.int64), first)
        self.mask[self.tokens(k)] = False
        return out

    def candidates(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(smaller sets that share a prefix token and are large enough, tokens shared), most shared first."""
        low = np.searchsorted(self.sizes, needed(self.sizes[k], self.percent))
        parts = []
        for t in self.prefixes[k]:
            mine = self.lists[self.bounds[t]:self.bounds[t + 1]]
            a, b = np.searchsorted(mine, (low, k))  # skip what is too small and what comes later
            if a < b:
                parts.append(mine[a:b])
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found, times = np.unique(np.concatenate(parts), return_counts=True)
        order = np.argsort(-times, kind="stable")
        return found[order], times[order]

    def links(self, labels: np.ndarray | None = None, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links enough to tie every component; sets of one label count as tied already, and sets of one
        side are not compared. Numbers are those of the list given at the start."""
        side = None if sides is None else sides[self.order]
        root = np.arange(len(self.sizes)) if labels is None else np.unique(labels[self.order], return_inverse=True)[1]
        out, answers = [], {}
        for k in range(len(self.sizes)):
            rest, _ = self.candidates(k)
            if side is not None:
                rest = rest[side[rest] != side[k]]
            rest = rest[root[rest] != root[k]]
            like, seen, known = None, [], []
            while len(rest):
                if like is not None and len(answers[like][0]):
                    # set relation: |k and c| is at most |like and c| plus what k has and like lacks
                    near, counts = answers[like]
                    at = np.minimum(np.searchsorted(near, rest), len(near) - 1)
                    bound = np.where(near[at] == rest, counts[at] + extra, self.sizes[k])
                    rest = rest[bound >= overlap_needed(self.sizes[k], self.sizes[rest], self.percent)]
                    if not len(rest):
                        break
                some = rest[:1] if not seen else rest[:256]
                rest = rest[len(some):]
                got = self.overlaps(k, some)
                seen.append(some)
                known.append(got)
                for c in some[got >= overlap_needed(self.sizes[k], self.sizes[some], self.percent)]:
                    if root[c] != root[k]:
                        out.append((int(self.order[k]), int(self.order[c])))
                        root[root == root[k]] = root[c]
                if like is None and int(some[0]) in answers:
                    like, extra = int(some[0]), int(self.held[k] - got[0])
                rest = rest[root[rest] != root[k]]
            if seen:
                near, counts = np.concatenate(seen), np.concatenate(known)
                order = np.argsort(near)
                answers[k] = (near[order], counts[order])
        return out


def _block_links(sets: DataFrame, group: list[str], percent: int) -> DataFrame:
    """(a, b) links of (set_key, n, tokens, label, side) within each group, which must be of bounded
    size; sets of one side, unless null, are compared elsewhere."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("set_key").sort_values("set_key")
        keys = rows["set_key"].to_numpy()
        block = Block([np.frombuffer(b, "<u8") for b in rows["tokens"]], rows["n"].to_numpy(np.int64), percent)
        found = block.links(*[None if rows[c].isna().any() else rows[c].to_numpy() for c in ("label", "side")])
        del block
        give_back()
        return pd.DataFrame([(keys[a], keys[b]) for a, b in found], columns=["a", "b"]).astype("int64")

    return sets.groupBy(*group).applyInPandas(run, "a long, b long")


def _visits(sets: DataFrame, places: DataFrame, ranks: Callable[[np.ndarray], np.ndarray], percent: int) -> DataFrame:
    """(set_key, family, low, high, label, side): the cells in which each set meets others. ``places``:
    (set_key, family, unit, label), units of guests being negative.

    Of a pair that links, the smaller set has a common shingle among its first
    n - overlap_needed(n, n) + 1 and the larger one has the same among its prefix. So a set visits a
    unit if they share a prefix shingle, in the shorter prefix of either, under different labels. A
    shingle of one label, or in no shorter prefix, is dropped first; what comes back to the sets is
    the list of a shingle's units, of which a family has as many as blocks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, close = [], []
            for n, blob in zip(batch.column("n").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                tokens = np.frombuffer(blob, "<u8")
                found.append(_prefix(tokens, ranks(tokens), n, percent))
                close.append(np.arange(len(found[-1])) < len(tokens) - overlap_needed(n, n, percent) + 1)
            if not found:
                continue
            counts = [len(f) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(close)), *[
                pa.array(np.repeat(batch.column(c).to_numpy(), counts)) for c in ("set_key", "family", "unit", "label")]],
                names=["token", "close", "set_key", "family", "unit", "label"])

    rows = written(sets.join(places, "set_key").select("set_key", "n", "tokens", "family", "unit", "label").mapInArrow(
        tidy(run), "token long, close boolean, set_key long, family long, unit long, label long"), "postings")
    per_unit = rows.groupBy("token", "unit").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                                 F.max("close").alias("close"), F.count("*").alias("held"))
    per_token = per_unit.groupBy("token").agg(
        F.min("low").alias("_low"), F.max("high").alias("_high"), F.max("close").alias("_close"), F.sum("held").alias("held"),
        F.collect_list(F.struct("unit", "low", "high", "close")).alias("units")).where("_close and _low <> _high").select("token", "held", "units")
    met = attach_by_key(rows, written(per_token, "units"), "token", "held", "set_key").where(F.col("units").isNotNull())
    others = F.filter("units", lambda u: (F.least(u["unit"], F.col("unit")) < 0) & (F.col("close") | u["close"])
                      & ((u["low"] != F.col("label")) | (u["high"] != F.col("label"))))
    met = met.select("set_key", "family", "label", "unit", F.explode(F.transform(others, lambda u: u["unit"])).alias("other")).distinct()
    return met.select("set_key", "family", F.least("unit", "other").alias("low"), F.greatest("unit", "other").alias("high"), "label",
                      F.when(F.col("unit") != F.col("other"), F.col("unit")).alias("side"))


def link_sets(sets: DataFrame, percent: int = PERCENT, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(id, cluster_id) of each set with a link; ``sets``: (set_key, tokens), repeated rows allowed."""
    sets = written(shared_parts(sets, percent), "shared-parts")
    ranks = ranking(sets)
    family = written(families(sets, ranks, percent), "families")
    sizes = family.groupBy("cluster_id").agg(F.count("*").alias("size")) \
        .withColumn("blocks", F.ceil(F.col("size") / block_sets).cast("int"))
    placed = attach_by_key(family, sizes.select("cluster_id", "size", "blocks"), "cluster_id", "size", "id") \
        .select(F.col("id").alias("set_key"), F.col("cluster_id").alias("family"), "blocks",
                F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    none = {c: F.lit(None).cast("long") for c in ("label", "side")}
    held = sets.dropDuplicates(["set_key"]).join(placed, "set_key").withColumns(none)
    inner = written(_block_links(held, ["family", "block"], percent), "block-links")
    wide = placed.where("blocks > 1")
    if wide.isEmpty():
        return connected_components(inner, "a", "b")
    held = held.where("blocks > 1").drop("label", "side")

    def labelled(links: DataFrame) -> DataFrame:
        found = connected_components(links, "a", "b").select(F.col("id").alias("set_key"), F.col("cluster_id").alias("label"))
        out = wide.join(found, "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
        return written(out, "labels")

    # one set for the largest component of each block: they tie the large components together
    first = labelled(inner)
    largest = first.groupBy("family", "block", "label").agg(F.count("*").alias("size"), F.min("set_key").alias("set_key")) \
        .groupBy("family", "block").agg(F.max_by("set_key", F.struct("size", "set_key")).alias("set_key"))
    leaders = held.join(largest.select("set_key"), "set_key").withColumns(none).withColumn("part", F.floor(F.col("block") / block_sets))
    tied = written(inner.unionByName(_block_links(leaders, ["family", "part"], percent)), "block-links")
    second = labelled(tied)
    main = second.groupBy("family", "label").agg(F.count("*").alias("size")).groupBy("family").agg(
        F.max_by("label", F.struct("size", "label")).alias("main"), (F.sum("size") - F.max("size")).alias("guests"))
    marked = attach_by_key(second.withColumn("w", F.lit(1)), main.withColumn("weight", F.lit(1)), "family", "weight", "set_key")
    guest = F.pmod(F.xxhash64("set_key"), F.ceil(F.col("guests") / block_sets))
    places = written(marked.select("set_key", "family", "label", F.when(F.col("label") == F.col("main"), F.col("block").cast("long"))
                                   .otherwise(-1 - guest).alias("unit")), "places")
    visits = _visits(held.select("set_key", "n", "tokens"), places, ranks, percent)
    across = _block_links(held.select("set_key", "n", "tokens").join(visits, "set_key"), ["family", "low", "high"], percent)
    return connected_components(written(tied.unionByName(across), "links"), "a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row.

    Two documents link when 100 * intersection is at least ``percent`` * union of their sets of
    ``words``-word shingles, A-Z lowered; a shorter text is one shingle. A text without words, null
    too, links with nothing. A component is named by its smallest id; rows that share an id or a
    text are in one component if they link, and a null id never names one that has another.
    """
    keyed = _with_keys(docs, id_col, text_col)
    texts = written(text_sets(keyed, words, percent), "text-sets")
    ids = written(keyed.select("doc_id", "key"), "text-keys")
    clusters = link_sets(texts.where(F.col("tokens").isNotNull()).select("set_key", "tokens"), percent)
    sets = texts.where("n > 0").select("set_key").distinct().join(clusters.withColumnRenamed("id", "set_key"), "set_key", "left") \
        .select("set_key", F.coalesce("cluster_id", "set_key").alias("cluster"))
    per_text = ids.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    # a text whose row of smallest id is repeated was read once for each
    joined = texts.select("key", "n", "set_key").distinct().join(per_text, "key").join(sets, "set_key", "left")
    names = joined.where("n > 0").groupBy("cluster").agg(F.min("first_id").alias("component_id"), F.count("*").alias("texts"))
    named = attach_by_key(joined, names, "cluster", "texts", "key").select("key", "copies", "n", "component_id")
    spread = ids.withColumn("_row", F.xxhash64("doc_id", "key"))
    out = attach_by_key(spread, named, "key", "copies", "_row")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_shingles"),
                      F.coalesce("component_id", "doc_id").alias("component_id"), "key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that a row of smaller id stands for: one per component.
    Rows of one id and one component all stay if they have the smallest id, and so do rows without an id, as no
    smaller one can be told."""
    dropped = near_duplicates(docs, id_col, text_col).where("doc_id <> component_id").select(
        F.col("doc_id").alias("id"), "key").distinct()
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    keyed = packed(docs, docs[id_col].cast("long").alias("id"), F.xxhash64(text, F.length(text)).alias("key"))
    return unpacked(keyed.join(dropped, ["id", "key"], "left_anti"), docs.columns)
