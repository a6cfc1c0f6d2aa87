"""Repeated byte strings across documents, by prefix-free parsing.

A rolling hash over the bytes sets triggers, which depend on nothing but the bytes around them:
each string of ``length`` bytes holds a trigger, and equal strings hold the same ones at the same
places. Triggers cut every text into phrases, so the corpus is a parse over a dictionary.

1. Triggers that two texts share are found by their hashes; all others lead nowhere.
2. The dictionary: around each shared trigger the phrase of up to ``length - window`` bytes on either
   side. Equal phrases are one entry with the smallest document that holds it.
3. Entries of one trigger are put in suffix order: at each offset their strings of ``length`` bytes
   are sorted, and each run of equal strings takes the smallest document of its entries. A trigger
   that very many texts hold is no group: its entries become rows of hashed strings, whose smallest
   documents Spark finds with partial aggregation and joins back.
4. The parse: each document looks up its phrases, and what begins in a smaller document goes.

Full suffix ranks of the corpus are never needed, as runs of equal strings of ``length`` bytes are
what suffix order is used for; so suffixes are compared over that length only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import id_and_text
from probatio.llm.shared_tokens import shared_tokens, shorten
from probatio.llm.words import BASE, BYTE, batch_bytes, groups, mix
from probatio.operators.skew import attach_by_key
from probatio.session import written

LENGTH, TRIGGER = 50, 16
#: A trigger in more texts than twice this is never one group; about as many entries make a group.
HOT_TEXTS, GROUP_ENTRIES = 100_000, 100_000
NO_ID = -(1 << 63)


# ---- triggers --------------------------------------------------------------------------------
def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` bytes (a power of two), by doubling."""
    h, power, have = BYTE[data], BASE, 1
    while have < size:
        h = h[:-have] * power + h[have:]
        power, have = power * power, have * 2
    return mix(h)


def _sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each window of ``size`` values, by doubling."""
    have, out = 1, values
    while have * 2 <= size:
        out = pick(out[:-have], out[have:])
        have *= 2
    if have < size:
        out = pick(out[:len(values) - size + 1], out[size - have:])
    return out


def triggers(data: np.ndarray, length: int = LENGTH, window: int = TRIGGER) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of triggers: a place is one if its hash is least in some string of ``length``
    bytes; of equal ones all are. A text shorter than that has none."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = rolling(data, window)
    span = length - window + 1
    least = _sliding(h, span, np.minimum)
    # a place's hash is the least of a window if it is the largest of the minima it lies under
    pad = np.zeros(span - 1, np.uint64)
    over = _sliding(np.concatenate([pad, least, pad]), span, np.maximum)
    places = np.flatnonzero(over == h)
    return places, h[places]


def _slices(texts: list[bytes], most: int = 1 << 22, overlap: int = 2 * LENGTH) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text number, offset, bytes) of pieces of bounded size; neighbours overlap, so that every
    string of ``LENGTH`` bytes, and every trigger's surroundings, lie whole in one of them."""
    for k, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        for at in range(0, max(1, len(data) - overlap), most):
            yield k, at, data[at:at + most + overlap]


def _triggers_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    parts = [(p + at, h) for _, at, piece in _slices([data]) for p, h in [triggers(piece)]]
    if len(parts) == 1:
        return parts[0]
    places, first = np.unique(np.concatenate([p for p, _ in parts]), return_index=True)
    return places, np.concatenate([h for _, h in parts])[first]


def _trigger_sets():
    return lambda texts: [np.unique(_triggers_of(t)[1]).tobytes() for t in texts]


# ---- dictionary and parse ----------------------------------------------------------------------
SIDE = LENGTH - TRIGGER
#: A phrase as bytes: how much of either side there is, the left side from the trigger backwards, and
#: the trigger with its right side; both padded with zeros.
WIDTH = 2 + SIDE + LENGTH


def phrases(text: bytes, shared: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, trigger hashes, phrases) of a text's shared triggers, a row of ``WIDTH`` bytes each."""
    places, hashes = _triggers_of(text)
    chosen = np.isin(shorten(hashes, buckets), shared)
    places, hashes = places[chosen], hashes[chosen]
    padded = np.zeros(len(text) + SIDE + LENGTH, np.uint8)
    padded[SIDE:SIDE + len(text)] = np.frombuffer(text, np.uint8)
    rows = np.empty((len(places), WIDTH), np.uint8)
    rows[:, 0] = np.minimum(places, SIDE)
    rows[:, 1] = np.minimum(len(text) - places, LENGTH)
    at = places[:, None] + SIDE
    rows[:, 2:2 + SIDE] = padded[at - 1 - np.arange(SIDE)]
    rows[:, 2 + SIDE:] = padded[at + np.arange(LENGTH)]
    return places, hashes, rows


def phrase_keys(rows: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), -(-WIDTH // 8) * 8), np.uint8)
    wide[:, :WIDTH] = rows
    h = np.zeros(len(rows), np.uint64)
    for column in wide.view("<u8").T:
        h = mix(h * BASE + column)
    return h.view(np.int64)


def as_binary(rows: np.ndarray) -> pa.Array:
    """A byte table as a binary column, one value per row."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def distinct_entries(keys: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each distinct key is met first, smallest first id, largest last id)."""
    _, where, number = np.unique(keys, return_index=True, return_inverse=True)
    low, high = first[where].copy(), last[where].copy()
    np.minimum.at(low, number, first)
    np.maximum.at(high, number, last)
    return where, low, high


def _runs(words: np.ndarray, groups: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the rows of a byte table within groups: (order, how many bytes each row shares
    with the one before it in that order; -1 at the first of a group)."""
    n = len(words)
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = words
    keys = padded.view(">u8")
    order = np.lexsort([*keys.T[::-1], groups])
    ordered, same = words[order], groups[order]
    differ = ordered[1:] != ordered[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.append([-1], np.where(same[1:] == same[:-1], shared, -1))


def first_documents(trigger: np.ndarray, rows: np.ndarray, smallest: np.ndarray) -> np.ndarray:
    """For dictionary entries (trigger, phrase, first document): per entry and offset, the smallest
    document of all entries that hold the same ``LENGTH`` bytes at that offset; the largest long
    where no such string lies in the entry.

    The entries of a trigger are put in suffix order from the trigger rightwards, and in the order
    of their reversed prefixes from the trigger leftwards. A string takes so many bytes on the left
    and so many on the right; entries that hold the same one are those in one run of either order.
    """
    n, left, right = len(rows), rows[:, 0].astype(np.int64), rows[:, 1].astype(np.int64)
    order_left, shared_left = _runs(rows[:, 2:2 + SIDE], trigger, SIDE)
    order_right, shared_right = _runs(rows[:, 2 + SIDE:], trigger, LENGTH)
    out = np.full((n, SIDE + 1), np.iinfo(np.int64).max, np.int64)
    run_left, run_right = np.empty(n, np.int64), np.empty(n, np.int64)
    for before in range(SIDE + 1):  # bytes of the string on the left of its trigger
        after = LENGTH - before
        inside = np.flatnonzero((left >= before) & (right >= after))
        if not len(inside):
            continue
        run_left[order_left] = np.cumsum(shared_left < before)
        run_right[order_right] = np.cumsum(shared_right < after)
        pair = run_left[inside] * (n + 1) + run_right[inside]
        order = np.argsort(pair)
        opens = np.flatnonzero(np.append([True], pair[order][1:] != pair[order][:-1]))
        least = np.minimum.reduceat(smallest[inside[order]], opens)
        out[inside[order], SIDE - before] = np.repeat(least, np.diff(np.append(opens, len(order))))
    return out


ENTRY = np.dtype([("offset", "u1"), ("end", "u1"), ("first_id", "<i8")])


def pack_entries(first: np.ndarray, last: np.ndarray) -> list[bytes]:
    """Per entry, its runs of offsets with one document, those that remove something from ``last``."""
    n, width = first.shape
    opens = np.ones((n, width), bool)
    opens[:, 1:] = first[:, 1:] != first[:, :-1]
    row, column = np.nonzero(opens)
    ends = np.where(np.append(row[1:] != row[:-1], True), width, np.append(column[1:], 0))
    useful = first[row, column] < last[row]
    runs = np.zeros(int(useful.sum()), ENTRY)
    runs["offset"], runs["end"], runs["first_id"] = column[useful], ends[useful], first[row, column][useful]
    data, stops = runs.tobytes(), np.cumsum(np.bincount(row[useful], minlength=n)) * ENTRY.itemsize
    return [data[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]


def removed(runs: list[bytes], ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the occurrence, start, end): byte ranges that entries remove from the documents
    ``ids`` in which they occur at ``places``."""
    which = np.repeat(np.arange(len(runs)), np.fromiter(map(len, runs), np.int64, len(runs)) // ENTRY.itemsize)
    entry = np.frombuffer(b"".join(runs), ENTRY)
    hits = entry["first_id"] < ids[which]
    which, entry = which[hits], entry[hits]
    base = places[which] - SIDE
    return which, base + entry["offset"], base + entry["end"] - 1 + LENGTH


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


# ---- Spark -----------------------------------------------------------------------------------
def _affected(docs: DataFrame, buckets: int) -> DataFrame:
    """(row, id, doc_id, n_bytes, state, text, tokens, kept_sha256), written: what each row needs further.

    Rows are joined with the texts by (text key, id), so of the rows of one text only those of its
    smallest id meet their text's triggers; the others are whole repeats (``copy``).
    The texts are written by zstd, as they stay to the end.
    """
    keyed = docs.withColumn("key", F.xxhash64("text", F.length("text"))).withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
    # all triggers are shuffled for these, and need not lie beside the texts that are dealt out next
    shared = written(shared_tokens(keyed, _trigger_sets, buckets), "shared-triggers", drop_shuffles=True)
    firsts = keyed.groupBy("key").agg(F.min("id").alias("_id")).join(shared, "key", "left").select(
        F.col("key").alias("_key"), "_id", "tokens")
    read = keyed.join(firsts, (F.col("key") == F.col("_key")) & (F.col("id") == F.col("_id")), "left")
    long_enough = F.octet_length("text") >= LENGTH
    state = F.when(F.col("_key").isNull() & long_enough, "copy").when(F.col("tokens").isNotNull(), "shared").otherwise("own")
    return written(read.withColumn("state", state).select(
        F.monotonically_increasing_id().alias("row"), "id", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "state",
        F.when(F.col("state") == "shared", F.col("text")).alias("text"), F.when(F.col("state") == "shared", F.col("tokens")).alias("tokens"),
        F.sha2(F.when(F.col("state") == "copy", F.lit("")).otherwise(F.col("text")), 256).alias("kept_sha256")), "affected", "zstd", drop_shuffles=True)


def _phrases_of(batch: pa.RecordBatch, names: list[str], buckets: int, hot: np.ndarray | None = None, of_hot: bool = False) -> Iterator[tuple]:
    """(places, hashes, phrase rows, *values of ``names`` for each phrase), some texts at a time; given ``hot``, of
    the hot triggers only or of the others only."""
    tokens = [np.unique(np.frombuffer(x, "<u8")) for x in batch.column("tokens").to_pylist()]
    if hot is not None and len(hot):
        tokens = [t[np.isin(t, hot, invert=not of_hot)] for t in tokens]
        left = [i for i, t in enumerate(tokens) if len(t)]
        batch, tokens = batch.take(pa.array(left, pa.int64())), [tokens[i] for i in left]
    texts = batch_bytes(batch.column("text"))
    values = [batch.column(c).to_numpy() for c in names]
    for a, b in groups([len(t) for t in texts], 1 << 22):
        found = [phrases(t, x, buckets) for t, x in zip(texts[a:b], tokens[a:b], strict=True)]
        counts = [len(f[0]) for f in found]
        yield (*(np.concatenate(c) for c in zip(*found, strict=True)), *(np.repeat(v[a:b], counts) for v in values))


def _weigh_triggers(rows: DataFrame, hot_texts: int) -> tuple[np.ndarray, int]:
    """(hot triggers by their short names, sorted; all pairs of text and trigger).

    Each of the t tasks tells only triggers in more than hot_texts / t of its texts, and a trigger is hot
    if the told counts exceed ``hot_texts``; so one that is not has at most twice as many texts. Hot ones
    are fewer than the pairs divided by ``hot_texts``, which is raised with the pairs so that they are
    at most a million.
    """
    held = rows.select("tokens")
    total = held.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    pairs = total // 8
    hot_texts = max(hot_texts, pairs // 1_000_000)
    least = hot_texts // max(1, held.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            # a token stands once in each text's list
            new, n = np.unique(np.frombuffer(b"".join(batch_bytes(batch.column("tokens"))), "<u8"), return_counts=True)
            together, where = np.unique(np.concatenate([tokens, new]), return_inverse=True)
            tokens, counts = together, np.bincount(where, np.concatenate([counts, n])).astype(np.int64)
        many = counts > least
        yield pa.RecordBatch.from_arrays([pa.array(tokens[many].view(np.int64)), pa.array(counts[many])], names=["token", "n"])

    told = held.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > hot_texts)
    return np.sort(np.array([r["token"] for r in told.select("token").collect()], np.int64)).view(np.uint64), pairs


def _dictionary(rows: DataFrame, buckets: int, n_groups: int, hot: np.ndarray, of_hot: bool) -> DataFrame:
    """(group, phrase, first_id, last_id), once per group of texts and phrase, of the hot triggers or of the others.

    Entries of one trigger have the same group. A phrase holds its trigger and is what its key is made from, so
    neither is sent along.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hashes, table, ids in _phrases_of(batch, ["id"], buckets, hot, of_hot):
                where, low, high = distinct_entries(phrase_keys(table), ids, ids)
                yield pa.RecordBatch.from_arrays([pa.array((hashes[where] % np.uint64(n_groups)).astype(np.int32)),
                                                  as_binary(table[where]), pa.array(low), pa.array(high)],
                                                 names=["group", "phrase", "first_id", "last_id"])

    return rows.select("id", "text", "tokens").mapInArrow(run, "group int, phrase binary, first_id long, last_id long")


def _triggers_in(table: np.ndarray) -> np.ndarray:
    """A number for the trigger of each phrase."""
    halves = np.ascontiguousarray(table[:, 2 + SIDE:2 + SIDE + TRIGGER]).view("<u8")
    return mix(mix(halves[:, 0]) * BASE + halves[:, 1]).view(np.int64)


def _ordered(entries: DataFrame) -> DataFrame:
    """(phrase_key, runs) of entries that can remove something. Entries of one trigger meet in one
    group, a document's copies of a phrase having become one entry per batch before."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        table = np.frombuffer(b"".join(rows["phrase"]), np.uint8).reshape(-1, WIDTH)
        keys = phrase_keys(table)
        where, low, high = distinct_entries(keys, rows["first_id"].to_numpy(np.int64), rows["last_id"].to_numpy(np.int64))
        table = table[where]
        packed = pack_entries(first_documents(_triggers_in(table), table, low), high)
        return pd.DataFrame({"phrase_key": keys[where], "runs": packed})[lambda r: r["runs"] != b""]

    return entries.groupBy("group").applyInPandas(run, "phrase_key long, runs binary")


def string_hashes(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, hash of 16 bytes) of each string of ``LENGTH`` bytes that lies whole in a phrase."""
    left, right = table[:, 0].astype(np.int64), table[:, 1].astype(np.int64)
    whole = np.concatenate([table[:, 2:2 + SIDE][:, ::-1], table[:, 2 + SIDE:]], axis=1)
    rows, offsets, hashes = [], [], []
    for at in range(SIDE + 1):
        inside = np.flatnonzero((left >= SIDE - at) & (right >= at + TRIGGER))
        wide = np.zeros((len(inside), -(-LENGTH // 8) * 8), np.uint8)
        wide[:, :LENGTH] = whole[inside, at:at + LENGTH]
        pair = np.zeros((len(inside), 2), np.uint64)
        for column in wide.view("<u8").T:
            pair[:, 0] = mix(pair[:, 0] * BASE + column)
            pair[:, 1] = mix((pair[:, 1] ^ column) * BASE + np.uint64(1))
        rows.append(inside)
        offsets.append(np.full(len(inside), at))
        hashes.append(pair)
    return np.concatenate(rows), np.concatenate(offsets), np.concatenate(hashes)


def _by_strings(entries: DataFrame) -> DataFrame:
    """What :func:`_ordered` gives, for entries of hot triggers: no trigger and no string is a group in a task."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                table = np.frombuffer(b"".join(part.column("phrase").to_pylist()), np.uint8).reshape(-1, WIDTH)
                keys = phrase_keys(table)
                where, low, high = distinct_entries(keys, part.column("first_id").to_numpy(), part.column("last_id").to_numpy())
                table = table[where]
                row, offset, hashes = string_hashes(table)
                yield pa.RecordBatch.from_arrays([as_binary(hashes.view(np.uint8)), pa.array(keys[where][row]), pa.array(offset.astype(np.int32)),
                                                  pa.array(low[row]), pa.array(high[row])],
                                                 names=["string", "phrase_key", "offset", "first_id", "last_id"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found").to_pylist()
            first = np.full((len(found), SIDE + 1), np.iinfo(np.int64).max, np.int64)
            for row, items in zip(first, found, strict=True):
                for x in items:
                    row[x["offset"]] = x["least"]
            last = np.full(len(found), np.iinfo(np.int64).max)
            yield pa.RecordBatch.from_arrays([batch.column("phrase_key"), pa.array(pack_entries(first, last), pa.binary())], names=["phrase_key", "runs"])

    strings = written(entries.select("phrase", "first_id", "last_id").mapInArrow(
        cut, "string binary, phrase_key long, offset int, first_id long, last_id long").withColumn("string", F.hex("string")), "strings", drop_shuffles=True)
    per_string = strings.groupBy("string").agg(F.count("*").alias("n"), F.min("first_id").alias("least"), F.max("last_id").alias("most")) \
        .where("least < most").drop("most")
    met = attach_by_key(strings, per_string, "string", "n", "phrase_key").where("least < last_id")
    return met.groupBy("phrase_key").agg(F.collect_set(F.struct("offset", "least")).alias("found")).mapInArrow(pack, "phrase_key long, runs binary")


def _parse(rows: DataFrame, buckets: int) -> DataFrame:
    """(phrase_key, row, id, place): the phrases of each row, in place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, _, table, row, ids in _phrases_of(batch, ["row", "id"], buckets):
                yield pa.RecordBatch.from_arrays(list(map(pa.array, (phrase_keys(table), row, ids, places))),
                                                 names=["phrase_key", "row", "id", "place"])

    return rows.select("row", "id", "text", "tokens").mapInArrow(run, "phrase_key long, row long, id long, place long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, end>>, kept_sha256), one row per input row.

    ``spans`` are the maximal runs of bytes (of the text in UTF-8, null as empty) covered by a string
    of 50 bytes that also starts in a document of smaller id. Rows of equal id do not remove each
    other's bytes; a null id is smaller than all others.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _affected(id_and_text(docs, id_col, text_col), buckets)
    shared = rows.where(F.col("state") == "shared")
    hot, pairs = _weigh_triggers(shared, HOT_TEXTS)
    n_groups = max(4 * buckets, pairs // GROUP_ENTRIES)
    runs = _ordered(_dictionary(shared, buckets, n_groups, hot, False))
    if len(hot):  # texts without a hot trigger are passed over in the second reading
        runs = runs.unionByName(_by_strings(_dictionary(shared, buckets, n_groups, hot, True)))
    runs = written(runs, "dictionary", drop_shuffles=True)
    met = _parse(shared, buckets).join(runs, "phrase_key")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, start, end = removed(batch.column("runs").to_pylist(), batch.column("id").to_numpy(), batch.column("place").to_numpy())
            yield pa.RecordBatch.from_arrays(list(map(pa.array, (batch.column("row").to_numpy()[which], start, end))),
                                             names=["row", "start", "end"])

    hits = met.select("row", "id", "place", "runs").mapInArrow(ranges, "row long, start long, end long")
    per_row = hits.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("hits"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for state, n, text, found, sha in zip(*(batch.column(c).to_pylist() for c in ("state", "n_bytes")), batch_bytes(batch.column("text")),
                                                  *(batch.column(c).to_pylist() for c in ("hits", "kept_sha256")), strict=True):
                mine = [(0, n)] if state == "copy" else merge([(h["start"], h["end"]) for h in found or []])
                spans.append([{"start": a, "end": b} for a, b in mine])
                if state == "shared":
                    digest, at = hashlib.sha256(), 0
                    for a, b in [*mine, (n, n)]:
                        digest.update(text[at:a])
                        at = b
                    sha = digest.hexdigest()
                kept.append(sha)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(spans, kind), pa.array(kept, pa.string())],
                                             names=["doc_id", "n_bytes", "spans", "kept_sha256"])

    joined = rows.drop("tokens", "id").join(per_row, "row", "left")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept_sha256 string")
