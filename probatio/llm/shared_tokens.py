"""Which hashed tokens does more than one row hold?

Each task sorts what its rows bring, settles what two of them share on the spot, and sends one
packed entry per other token to the token's bucket, so a token that a third of all rows hold is
one entry per task there. Buckets sort what arrives and tell the owners.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from probatio.llm.words import batch_bytes, slices, tidy

#: Tokens a task sorts at once, and most rows among them (their numbers take two bytes).
SORT_TOKENS, SORT_ROWS = 1_500_000, 60_000
SETTLED = 0xFFFF


ANSWER = "home int, keys binary, counts binary, tokens binary"


def answers(keys: np.ndarray, owners: np.ndarray, tokens: np.ndarray, n: int) -> list[pa.Array]:
    """Columns of ``ANSWER``: (key, token) pairs, packed by the partition that a key is at home in."""
    home = (keys.view(np.uint64) % np.uint64(n)).astype(np.int32)[owners]
    order = np.lexsort((owners, home))
    home, owners, tokens = home[order], owners[order], tokens[order]
    used, starts = np.unique(home, return_index=True)
    columns: list[list[bytes]] = [[], [], []]
    for a, b in zip(starts, np.append(starts[1:], len(home)), strict=True):
        mine, counts = np.unique(owners[a:b], return_counts=True)
        columns[0].append(keys[mine].tobytes())
        columns[1].append(counts.astype("<i4").tobytes())
        columns[2].append(tokens[a:b].tobytes())
    return [pa.array(used, pa.int32()), *[pa.array(c, pa.binary()) for c in columns]]


def shared_tokens(rows: DataFrame, maker: Callable[[], Callable[[list[bytes]], list[bytes]]],
                  buckets: int | None = None) -> DataFrame:
    """(key, tokens) for ``rows`` of (key long, text): of each text's tokens, those that another key
    holds too. ``maker`` is called once per task and gives the function from texts to their tokens
    (64-bit, little-endian). Keys with none are left out; rows of equal key
    count as one. Tokens are compared by 32 bits within
    buckets: a few that nobody shares may be told as shared, never the other way round.

    ``buckets`` defaults to the session's shuffle partitions, which grow with the data.
    """
    n = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "owners", "home", "keys", "counts", "tokens"]

        def settle(keys: list[int], blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            all_keys, who = np.unique(np.array(keys, np.int64), return_inverse=True)
            counts = np.fromiter((len(b) // 8 for b in blobs), np.int64, len(blobs))
            tokens, owners = np.frombuffer(b"".join(blobs), "<u8"), np.repeat(who, counts)
            order = np.lexsort((owners, tokens))
            tokens, owners = tokens[order], owners[order]
            once = np.ones(len(tokens), bool)
            once[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])
            tokens, owners = tokens[once], owners[once]
            first = np.ones(len(tokens), bool)
            first[1:] = tokens[1:] != tokens[:-1]
            group = np.cumsum(first) - 1
            twice = np.bincount(group)[group] > 1
            if twice.any():
                done = answers(all_keys, owners[twice], shorten(tokens[twice], n), n)
                m = len(done[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(m, dtype=np.int32) % n), pa.nulls(m, pa.binary()), *done], names=names)
            tokens, owners = tokens[first], np.where(twice, SETTLED, owners)[first]
            bucket = ((tokens >> np.uint64(32)) % np.uint64(n)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            tokens, owners, bucket = tokens[order], owners[order], bucket[order]
            used, starts = np.unique(bucket, return_index=True)
            columns: list[list] = [[], [], []]
            for a, b in zip(starts, np.append(starts[1:], len(bucket)), strict=True):
                mine, number = np.unique(owners[a:b], return_inverse=True)
                known = mine != SETTLED
                columns[0].append(tokens[a:b].astype("<u4").tobytes())
                columns[1].append(np.where(known[number], number, SETTLED).astype("<u2").tobytes())
                columns[2].append(all_keys[mine[known]].tobytes())
            low, number, held_by = (pa.array(c, pa.binary()) for c in columns)
            m = len(used)
            yield pa.RecordBatch.from_arrays([pa.array(used), number, pa.nulls(m, pa.int32()), held_by, pa.nulls(m, pa.binary()), low], names=names)

        keys, blobs, held, tokens_of = [], [], 0, maker()
        for batch in slices(batches):
            for key, blob in zip(batch.column("key").to_pylist(), tokens_of(batch_bytes(batch.column("text"))), strict=True):
                if not blob:
                    continue
                if blobs and (held + len(blob) // 8 > SORT_TOKENS or len(keys) >= SORT_ROWS):
                    yield from settle(keys, blobs)
                    keys, blobs, held = [], [], 0
                keys.append(key)
                blobs.append(blob)
                held += len(blob) // 8
        if blobs:
            yield from settle(keys, blobs)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners, keys, n_keys = [], [], [], 0
        for batch in batches:
            settled = pa.compute.is_valid(batch.column("home"))
            done = batch.filter(settled)
            if done.num_rows:
                yield done.select(["home", "keys", "counts", "tokens"])
            open_ = batch.filter(pa.compute.invert(settled))
            for bucket, t, o, k in zip(*(open_.column(c).to_pylist() for c in ("bucket", "tokens", "owners", "keys")), strict=True):
                low = np.frombuffer(t, "<u4").astype(np.uint64)
                tokens.append(low | (np.uint64(bucket) << np.uint64(32)))
                number = np.frombuffer(o, "<u2").astype(np.int64)
                owners.append(np.where(number == SETTLED, -1, number + n_keys))
                keys.append(np.frombuffer(k, "<i8"))
                n_keys += len(keys[-1])
        if not tokens:
            return
        all_tokens, all_owners = np.concatenate(tokens), np.concatenate(owners)
        all_keys, who = np.unique(np.concatenate(keys), return_inverse=True)
        all_owners = np.where(all_owners < 0, -1, np.append(who, -1)[all_owners])
        order = np.lexsort((all_owners, all_tokens))
        all_tokens, all_owners = all_tokens[order], all_owners[order]
        # a token is shared if two owners, or an owner and a mark that others have settled it, meet
        first = np.ones(len(all_tokens), bool)
        first[1:] = all_tokens[1:] != all_tokens[:-1]
        other = np.ones(len(all_tokens), bool)
        other[1:] = first[1:] | (all_owners[1:] != all_owners[:-1])
        group = np.cumsum(first) - 1
        shared = (np.bincount(group, other)[group] > 1) & (all_owners >= 0) & other
        if shared.any():
            yield pa.RecordBatch.from_arrays(answers(all_keys, all_owners[shared], all_tokens[shared], n), names=["home", "keys", "counts", "tokens"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], []]
        for batch in batches:
            for k, c, t in zip(*(batch.column(c).to_pylist() for c in ("keys", "counts", "tokens")), strict=True):
                parts[0].append(np.repeat(np.frombuffer(k, "<i8"), np.frombuffer(c, "<i4")))
                parts[1].append(np.frombuffer(t, "<u8"))
        if parts[0]:
            keys, tokens = map(np.concatenate, parts)
            order = np.lexsort((tokens, keys))
            keys, tokens = keys[order], tokens[order]
            once = np.append([True], (keys[1:] != keys[:-1]) | (tokens[1:] != tokens[:-1]))
            keys, tokens = keys[once], tokens[once]
            used, starts = np.unique(keys, return_index=True)
            offsets = np.append(starts, len(keys)).astype(np.int64) * 8
            for a in range(0, len(used), 20_000):
                b = min(a + 20_000, len(used))
                yield pa.RecordBatch.from_arrays([pa.array(used[a:b]), pa.array(
                    [tokens[x // 8:y // 8].tobytes() for x, y in zip(offsets[a:b], offsets[a + 1:b + 1], strict=True)], pa.binary())],
                    names=["key", "tokens"])

    sent = rows.select("key", "text").mapInArrow(tidy(split), "bucket int, owners binary, home int, keys binary, counts binary, tokens binary")
    return sent.repartitionById(n, "bucket").mapInArrow(tidy(meet), ANSWER).repartitionById(n, "home").mapInArrow(tidy(gather), "key long, tokens binary")


def shorten(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """How :func:`shared_tokens` names a token in its answers."""
    return (tokens & np.uint64(0xFFFFFFFF)) | (((tokens >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32))
