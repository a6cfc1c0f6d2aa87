"""Pairs and clusters across documents (survey section 2.6, second half).

No operator here compares all pairs of documents, and none gathers the files of a
pattern into one array: files of a pattern are rows of a bridge table.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import lexicons as lx
from probatio.functions import text as tx
from probatio.operators.entities import names_in
from probatio.operators.components import connected_components
from probatio.operators.skew import attach_by_key
from probatio.session import written


# ---- values that occur together (D06, D07) -----------------------------------------
def _value_sets(ev: DataFrame, values: Column) -> DataFrame:
    return ev.select("doc_id", F.sort_array(values).alias("vals"))


#: Values of a set up to which its pairs are made in place; larger sets become a grid of cells.
PAIR_BLOCK = 500


def _pairs_of(sets: DataFrame, *keep: str, block: int | None = None) -> DataFrame:
    """All pairs a < b of each row's sorted array ``vals``, one row at a time (no array of pairs).

    A set of more than ``block`` values is cut into blocks, and every two of them are a cell that any task
    may take, so a directory with very many names is no single task. ``sets`` should be stored, as it is read twice.
    """
    block = block or PAIR_BLOCK
    small = sets.where(F.size("vals") <= block).select(*keep, F.col("vals").alias("left"), F.col("vals").alias("right"), F.lit(0).alias("j"))
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size("vals") - 1) / block).cast("int")),
                       lambda i: F.slice("vals", i * block + 1, block))
    cells = sets.where(F.size("vals") > block).select(*keep, cuts.alias("cuts")) \
        .select(*keep, "cuts", F.posexplode("cuts").alias("i", "left")) \
        .select(*keep, "left", F.posexplode(F.slice("cuts", F.col("i") + 1, F.size("cuts"))).alias("j", "right")) \
        .repartition(*[F.col(c) for c in keep], F.element_at("left", 1), F.element_at("right", 1))
    first = small.unionByName(cells).select(*keep, "right", "j", F.posexplode("left").alias("i", "a"))
    # within a block (j = 0) a value meets those behind it, in another block all
    rest = F.when(F.col("j") == 0, F.slice("right", F.col("i") + 2, F.size("right"))).otherwise(F.col("right"))
    return first.select(*keep, "a", F.explode(rest).alias("b"))


def _cooccurrence(ev: DataFrame, values: Column, names: tuple[str, str], step: float, cap: float,
                  min_files: int) -> DataFrame:
    """Files per pair of values, ``first_file`` being the smallest id.

    Files with the same set of values (copies, templates) are counted as one set with a
    multiplicity, so pairs are built once per distinct set, and counted by partial sums.
    """
    sets = _value_sets(ev, values).groupBy("vals").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"),
        F.max(F.size("vals")).alias("k")).where("k >= 2")
    # a value of fewer files is in no pair: only the others are paired
    sets = written(sets.withColumn("set_id", F.xxhash64("vals")), "value-sets")
    one = sets.select("set_id", "n", "first_doc", "last_doc", F.explode("vals").alias("v"))
    used = one.groupBy("v").agg(F.sum("n").alias("files"), F.count("*").alias("n_sets")).where(F.col("files") >= min_files)
    sets = attach_by_key(one, used.select("v", "n_sets", "files"), "v", "n_sets", "set_id").where("files IS NOT NULL") \
        .groupBy("set_id", "n", "first_doc", "last_doc").agg(F.sort_array(F.collect_set("v")).alias("vals"))
    pairs = _pairs_of(written(sets, "value-sets"), "n", "first_doc", "last_doc").groupBy("a", "b").agg(
        F.sum("n").alias("n_files"), F.min("first_doc").alias("first_file"), F.max("last_doc").alias("last_file"))
    return pairs.where(F.col("n_files") >= min_files).select(
        F.col("a").alias(names[0]), F.col("b").alias(names[1]), "n_files", "first_file", "last_file",
        F.least(F.lit(cap), F.col("n_files") * step).alias("confidence"))


def name_cooccurrence(ev: DataFrame, min_files: int = 2, names: Column | None = None) -> DataFrame:
    """Names that appear together in several files; ``names`` where they have been found before."""
    return _cooccurrence(ev, names_in(F.col("content")) if names is None else names, ("name1", "name2"), 0.3, 0.9, min_files)


def term_cooccurrence(ev: DataFrame, terms: list[str] | None = None, min_files: int = 2) -> DataFrame:
    """Legal terms that appear together in several files."""
    return _cooccurrence(ev, tx.matched_words(F.lower("content"), terms or lx.LEGAL_TERMS),
                         ("term1", "term2"), 0.25, 0.7, min_files)


def _pair_files(sets: DataFrame, min_files: int) -> DataFrame:
    """(a, b, doc_id) for pairs of values in several files. Sets (doc_id, vals) are written once; values of
    fewer files go before pairs are made; a pair in very many files comes back by :func:`attach_by_key`."""
    sets = written(sets.withColumn("row", F.monotonically_increasing_id()), "value-sets")
    one = sets.select("row", "doc_id", F.explode("vals").alias("v"))
    used = one.groupBy("v").agg(F.count("*").alias("files")).where(F.col("files") >= min_files).withColumn("kept", F.lit(True))
    sets = attach_by_key(one, used, "v", "files", "row").where("kept").groupBy("row", "doc_id").agg(
        F.sort_array(F.collect_set("v")).alias("vals"))
    rows = _pairs_of(written(sets, "value-sets"), "doc_id").withColumn("pair", F.concat_ws("\0", "a", "b"))
    kept = rows.groupBy("pair").agg(F.count("*").alias("files")).where(F.col("files") >= min_files)
    return attach_by_key(rows, kept.withColumn("kept", F.lit(True)), "pair", "files", "doc_id").where("kept").select("a", "b", "doc_id")


def name_pair_files(ev: DataFrame, min_files: int = 2) -> DataFrame:
    """D06, the files of each pattern: one row per pair of names and file."""
    return _pair_files(_value_sets(ev, names_in(F.col("content"))), min_files).toDF("name1", "name2", "doc_id")


def term_pair_files(ev: DataFrame, terms: list[str] | None = None, min_files: int = 2) -> DataFrame:
    """D07, the files of each pattern: one row per pair of terms and file."""
    found = tx.matched_words(F.lower("content"), terms or lx.LEGAL_TERMS)
    return _pair_files(_value_sets(ev, found), min_files).toDF("term1", "term2", "doc_id")


def _communication_rows(ev: DataFrame) -> DataFrame:
    lower = F.col("lower_text")
    groups = F.array_compact(F.array(*[F.when(tx.any_hit(lower, words), F.lit(name))
                                       for name, words in lx.COMMUNICATION_GROUPS.items()]))
    return ev.select("doc_id", F.lower("content").alias("lower_text")).select(
        "doc_id", F.explode(groups).alias("communication_type"))


def communication_files(ev: DataFrame, min_files: int = 2) -> DataFrame:
    """D09, the files of each group. The other side of the join has one row per configured group."""
    rows = written(_communication_rows(ev), "communication")
    kept = rows.groupBy("communication_type").agg(F.count("*").alias("files")).where(F.col("files") >= min_files)
    return rows.join(F.broadcast(kept.select("communication_type")), "communication_type", "left_semi")


def communication_clusters(ev: DataFrame, min_files: int = 2) -> DataFrame:
    """Groups of communication words and how many files use them (three groups)."""
    rows = _communication_rows(ev)
    return (rows.groupBy("communication_type").agg(F.count("*").alias("n_files"), F.min("doc_id").alias("first_file"))
            .where(F.col("n_files") >= min_files)
            .withColumn("confidence", F.least(F.lit(0.8), F.col("n_files") * 0.2)))


def date_files(events: DataFrame, min_files: int = 2) -> DataFrame:
    """D10, the files of each date: one row per date and file, with its number of events there."""
    rows = written(events.groupBy("event_date", "doc_id").agg(F.count("*").alias("n_events")), "date-files")
    kept = rows.groupBy("event_date").agg(F.count("*").alias("files")).where(F.col("files") >= min_files)
    return attach_by_key(rows, kept.withColumn("kept", F.lit(True)), "event_date", "files", "doc_id").where("kept") \
        .select("event_date", "doc_id", "n_events")


def temporal_clusters(events: DataFrame, min_files: int = 2) -> DataFrame:
    """Dates that several files refer to. Counted per (date, file) first."""
    per_file = events.groupBy("event_date", "doc_id").agg(F.count("*").alias("n"))
    return (per_file.groupBy("event_date").agg(F.sum("n").alias("event_count"), F.count("*").alias("n_files"),
                                               F.min("doc_id").alias("first_file"))
            .where(F.col("n_files") >= min_files)
            .withColumn("confidence", F.least(F.lit(0.8), F.col("n_files") * 0.3)))


# ---- D08: content similarity ---------------------------------------------------------
def top_words(ev: DataFrame, top: int = 20, min_len: int = 5) -> DataFrame:
    """The most frequent long words of each text, ties by first occurrence, as a sorted array.

    Counting stays inside the row (an Arrow batch at a time), so the words of the corpus are not
    shuffled.
    """
    pattern = re.compile(r"\w{%d,}" % min_len)

    @F.pandas_udf("array<string>")
    def frequent(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(w for w, _ in Counter(pattern.findall(t)).most_common(top)))

    return ev.select("doc_id", frequent(F.lower(F.coalesce("content", F.lit("")))).alias("words")) \
        .where(F.size("words") > 0)


#: Pairs whose bits or words are compared at once.
PAIRS_AT_ONCE, WORDS_AT_ONCE = 1 << 18, 1 << 13


def _common(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For word sets as the columns of two tables (padded by -1 and -2): (number of common words, place of the first
    in ``left``)."""
    hit = np.zeros(left.shape, bool)
    for words in right:
        hit |= left == words
    return hit.sum(axis=0), hit.argmax(axis=0)


def _overlaps(cells: np.ndarray, own: np.ndarray, at: np.ndarray, lists: pa.ListArray, threshold: float,
              steps: tuple[int, int]) -> Iterator[tuple]:
    """(row a, row b, similarity) of the pairs of sets within cells whose words overlap by more than ``threshold`` and
    whose first common word is the cell's; a is no larger than b.

    Rows are ordered by cell, and by falling size in it. ``own`` is the block a row is of, 0 if all rows of a cell are to
    be compared with each other. ``steps``: pairs whose bits, and whose words, are compared at once.
    """
    pairs_at_once, words_at_once = steps
    small_t = 2 * threshold / (1 + threshold)
    offsets, rows = lists.offsets.to_numpy(), len(lists)
    n = np.diff(offsets)
    words = np.unique(lists.values.to_numpy()[offsets[0]:offsets[-1]], return_inverse=True)[1].astype(np.int32)
    owner, place = np.repeat(np.arange(rows), n), np.arange(len(words)) - np.repeat(offsets[:-1] - offsets[0], n)
    table = np.full((rows, n.max()), -1, np.int32)
    table[owner, place] = words
    # each word sets one of 128 bits: words that only one of two sets has are at least the bits that differ
    bit = (words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)
    masks = np.zeros((2, rows), np.uint64)
    np.bitwise_or.at(masks, ((bit >> np.uint64(6)).astype(np.int64), owner), np.uint64(1) << (bit & np.uint64(63)))
    short = at < np.maximum(1, n - np.ceil(n * small_t - 1e-9).astype(np.int64) + 1)

    start = np.flatnonzero(np.append([True], cells[1:] != cells[:-1]))
    begin = np.repeat(start, np.diff(np.append(start, rows)))
    smaller = np.flatnonzero(short)
    counts = smaller - begin[smaller]
    ends = np.cumsum(counts)
    first = 0
    while first < len(smaller):
        done = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, done + pairs_at_once, side="right")))
        c, of = counts[first:stop], smaller[first:stop]
        a = np.repeat(of, c)
        b = np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(begin[of], c)
        first = stop
        # no more words are shared than follow the first shared one, nor than the bits allow
        n_a, n_b = n[a], n[b]
        most = np.minimum(n_a - at[a], n_b - at[b])
        may = ((n_a < n_b) | short[b]) & (n_a > n_b * threshold) & (most / (n_a + n_b - most) > threshold) & ((own[a] == 0) | (own[a] != own[b]))
        a, b, both, most = a[may], b[may], (n_a + n_b)[may], most[may]
        differ = sum(np.bitwise_count(m[a] ^ m[b]).astype(np.int64) for m in masks)
        most = np.minimum(most, (both - differ) // 2)
        may = most / (both - most) > threshold
        a, b, both = a[may], b[may], both[may]
        for i in range(0, len(a), words_at_once):
            x, y = a[i:i + words_at_once], b[i:i + words_at_once]
            left, right = np.ascontiguousarray(table[x].T), np.ascontiguousarray(table[y].T)
            right[right < 0] = -2
            common, where = _common(left, right)
            similarity = common / (both[i:i + words_at_once] - common)
            found = (where == at[x]) & (similarity > threshold)
            yield x[found], y[found], similarity[found]


def content_similarity(ev: DataFrame, top: int = 20, min_len: int = 5, threshold: float = 0.3,
                       block: int = 5000) -> DataFrame:
    """Documents whose top words overlap by more than ``threshold`` (Jaccard), exactly.

    1. Documents with the same set of top words (copies, templates) become one set with its
       smallest document as representative: relation ``same``, similarity 1, one row per member.
       A third of all documents being copies thus gives linearly many rows, not squared.
    2. Distinct sets meet at *prefixes* of their words in order of
       rising frequency: a pair above the threshold must share one of the first
       n - ceil(t n) + 1 words of the larger set and n - ceil(2t/(1+t) n) + 1 of the smaller.
       Frequent words stay outside the prefixes, so hot index entries hardly arise.
       Sets of equal size meet over the short prefix on both sides.
    3. Entries of one word are a cell; those of a word in more than ``block`` documents are cut into blocks, and
       every two of them are a cell that any task may take. A task goes through its cells in order,
       many at a time, and compares words as numbers in whole columns, not pair by pair.
    4. What two sets can share at most follows from the places of the word in both and from the words' bits,
       128 per set; words are compared only where that is enough.
    5. A pair is kept only at its first common word, so no duplicates have to be removed later.

    Every pair of documents above the threshold follows from the rows: both in one ``same``
    group, or their representatives in one ``overlap`` row; ``n_pairs`` counts them.
    """
    docs = written(top_words(ev, top, min_len).withColumn("set_key", F.array_join("words", " ")), "top-words")
    sets = written(docs.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.first("words").alias("words"))
                   .withColumn("set", F.monotonically_increasing_id()), "sets")
    # sorted rows are numbered in their order, so numbers compare as (n_docs, w) do
    freq = written(docs.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n_docs"))
                   .orderBy("n_docs", "w").withColumn("no", F.monotonically_increasing_id()), "words").withColumn("df", F.col("n_docs"))

    tokens = attach_by_key(sets.select("set", "rep", "members", F.explode("words").alias("w")), freq, "w", "n_docs", "set")
    ranked = written(tokens.groupBy("set", "rep", "members").agg(F.array_sort(F.collect_list(F.struct("no", "df"))).alias("ordered")),
                     "word-sets")  # at most ``top`` words per set
    n = F.size("ordered")
    prefix = F.greatest(F.lit(1), (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))
    entries = ranked.select("set", "rep", "members", F.transform("ordered", lambda x: x["no"]).alias("words"), n.alias("n"),
                            F.posexplode(F.slice("ordered", F.lit(1), prefix)).alias("at", "e")).where("e.df > 1")
    # a frequent word's entries are laid out as a grid of blocks, so no task holds them all
    g = F.ceil(F.col("e.df") / block).cast("int")
    laid = entries.withColumn("own", F.pmod(F.xxhash64("set"), g).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), g - 1))) \
        .select(F.col("e.no").alias("no"), F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "n", "at",
                F.when(F.col("own") == F.col("k"), 0).otherwise(F.col("own") + 1).alias("own"), "rep", "members", "words")

    steps = PAIRS_AT_ONCE, WORDS_AT_ONCE

    def by_bit_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(rows: pa.RecordBatch, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
            sizes, members = rows.column("n").to_numpy(), rows.column("members").to_numpy()
            for a, b, similarity in _overlaps(cells, rows.column("own").to_numpy(), rows.column("at").to_numpy(), rows.column("words"), threshold, steps):
                if len(a):
                    rep_a, rep_b = (rows.column("rep").take(pa.array(x)) for x in (a, b))
                    yield pa.RecordBatch.from_arrays([rep_a, rep_b, *map(pa.array, (sizes[a] == sizes[b], similarity, members[a] * members[b]))],
                                                     names=["rep_a", "rep_b", "even", "similarity", "n_pairs"])

        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            if batch is not None:
                held.append(batch)
            if not held:
                continue
            rows = pa.concat_batches(held)
            key = np.stack([rows.column(c).to_numpy() for c in ("no", "i", "j")])
            opens = np.append([True], (key[:, 1:] != key[:, :-1]).any(axis=0))
            # the last cell may go on in the next batch
            whole = rows.num_rows if batch is None else int(np.flatnonzero(opens)[-1])
            if whole:
                yield from compared(rows.slice(0, whole), np.cumsum(opens)[:whole])
            held = [rows.slice(whole)] if whole < rows.num_rows else []

    rep = dict(docs.dtypes)["doc_id"]
    met = laid.repartition("no", "i", "j").sortWithinPartitions("no", "i", "j", F.desc("n")) \
        .mapInArrow(by_bit_count, f"rep_a {rep}, rep_b {rep}, even boolean, similarity double, n_pairs long")
    overlap = met.where(~F.col("even") | (F.col("rep_a") != F.col("rep_b"))).select(
        F.least("rep_a", "rep_b").alias("doc1"), F.greatest("rep_a", "rep_b").alias("doc2"),
        F.lit("overlap").alias("relation"), "similarity", "n_pairs")
    reps = sets.where("members > 1").select("set_key", "members", "rep")
    same = attach_by_key(docs.select("doc_id", "set_key"), reps, "set_key", "members", "doc_id") \
        .where(F.col("doc_id") != F.col("rep")).select(
            F.col("rep").alias("doc1"), F.col("doc_id").alias("doc2"), F.lit("same").alias("relation"),
            F.lit(1.0).alias("similarity"), F.lit(1).cast("bigint").alias("n_pairs"))
    return overlap.unionByName(same).withColumn("confidence", F.least(F.lit(0.9), F.col("similarity")))


# ---- D15: neighbours by vectors --------------------------------------------------------
def _unit(vectors: pd.Series) -> np.ndarray:
    data = np.stack(vectors.to_numpy()).astype("float64")
    norm = np.linalg.norm(data, axis=1, keepdims=True)
    return data / np.where(norm == 0, 1.0, norm)


def semantic_neighbors(vectors: DataFrame, threshold: float = 0.85, n_pivots: int = 64, block: int = 2000) -> DataFrame:
    """Pairs of vectors with cosine at least ``threshold``, exactly.

    Equal vectors are first reduced to one (relation ``same``). The rest is a join in metric space:
    each vector belongs to the cell of its nearest pivot and also visits every cell that
    could hold a partner; by the triangle inequality these are cells at most 2r further than its
    own, with r the distance that belongs to the threshold. A pair is reported in the cell of the
    one with the lower cell number, so once. Large cells are cut into blocks on both sides, so that a
    task never holds more than about ``block`` vectors of either, however full a cell is.
    Pivots are a fixed number of rows.
    """
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    # equal vectors by their text; adding zero makes -0 and 0 one
    keyed = vectors.select("vec_id", "embedding", F.md5(F.transform("embedding", lambda x: x + F.lit(0).cast("float")).cast("string")).alias("vec_key"))
    groups = keyed.groupBy("vec_key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members"), F.first("embedding").alias("embedding"))
    distinct = groups.select("rep", "embedding")
    pivots = _unit(pd.Series([r["embedding"] for r in distinct.orderBy(  # n_pivots rows, a fixed number
        F.xxhash64("rep"), "rep").limit(n_pivots).collect()]))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) == 0:
                continue
            dist = np.sqrt(np.maximum(0.0, 2 - 2 * _unit(batch["embedding"]) @ pivots.T))
            reach = dist <= dist.min(axis=1, keepdims=True) + 2 * radius + 1e-9
            home = dist.argmin(axis=1)
            yield pd.DataFrame({"rep": batch["rep"], "embedding": batch["embedding"], "home": home.astype("int32"),
                                "reach": [np.flatnonzero(r).astype("int32") for r in reach]})

    placed = written(distinct.mapInPandas(
        cells, "rep bigint, embedding array<float>, home int, reach array<int>"), "vector-cells")

    sizes = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("residents")) \
        .join(placed.select(F.explode("reach").alias("cell")).groupBy("cell").agg(F.count("*").alias("visitors")), "cell")
    grid = F.broadcast(sizes.select(  # one row per pivot
        "cell", F.ceil(F.col("residents") / block).cast("int").alias("nr"),
        F.ceil(F.col("visitors") / block).cast("int").alias("nv")))
    spread = F.xxhash64("rep")
    left = (placed.select(F.col("home").alias("cell"), "rep", "embedding", "home").join(grid, "cell")
            .withColumn("rb", F.pmod(spread, "nr").cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("nv") - 1))))
    right = (placed.select(F.explode("reach").alias("cell"), "rep", "embedding", "home").where("cell <= home")
             .join(grid, "cell").withColumn("vb", F.pmod(spread, "nv").cast("int"))
             .withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("nr") - 1))))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame({"id1": [], "id2": [], "similarity": []})
        sim = _unit(a["embedding"]) @ _unit(b["embedding"]).T
        i, j = np.nonzero(sim >= threshold)
        ia, ib = a["rep"].to_numpy()[i], b["rep"].to_numpy()[j]
        ha, hb = a["home"].to_numpy()[i], b["home"].to_numpy()[j]
        keep = (ha < hb) | ((ha == hb) & (ia < ib))
        return pd.DataFrame({"id1": np.minimum(ia, ib)[keep], "id2": np.maximum(ia, ib)[keep],
                             "similarity": sim[i, j][keep]})

    left, right = (s.select("cell", "rb", "vb", "rep", "embedding", "home") for s in (left, right))
    right = right.toDF(*right.columns)  # names of its own, as both sides come from one table
    near = left.groupBy("cell", "rb", "vb").cogroup(right.groupBy("cell", "rb", "vb")).applyInPandas(
        compare, "id1 bigint, id2 bigint, similarity double").withColumn("relation", F.lit("near"))
    same = attach_by_key(keyed.select("vec_id", "vec_key"), groups.where("members > 1").select("vec_key", "members", "rep"),
                         "vec_key", "members", "vec_id").where("vec_id <> rep").select(
        F.col("rep").alias("id1"), F.col("vec_id").alias("id2"), F.lit(1.0).alias("similarity"), F.lit("same").alias("relation"))
    return near.unionByName(same)


# ---- D16: clusters ---------------------------------------------------------------------
def semantic_clusters(vectors: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Cluster of each vector over its D15 neighbours; a vector without any is its own."""
    found = connected_components(semantic_neighbors(vectors, threshold))
    return vectors.select(F.col("vec_id").alias("id")).join(found, "id", "left").select(
        "id", F.coalesce("cluster_id", "id").alias("cluster_id"))
