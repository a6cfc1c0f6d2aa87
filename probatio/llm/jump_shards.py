"""Sharding by jump consistent hashing: no ring table, and a shard appended takes only its share.

A key's jumps are a fixed rising sequence that does not depend on the number of shards; its shard
among n is the last jump below n. So n + 1 shards keep every key but those that jump to n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import bind
from probatio.operators.skew import blocked_row_number

# fixed values of the published algorithm: the multiplier of its generator, and 2 to the 31, 33, 63 and 64
MULTIPLIER = 2862933555777941757
TWO_31, TWO_33, TWO_63, TWO_64 = 2 ** 31, 2 ** 33, 2 ** 63, 2 ** 64


def _dec(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(38,0)")


def jumps(key: Column, below: int) -> Column:
    """All jumps of a 64-bit key below ``below``, in rising order (array<int>, first is 0).

    The generator needs a product modulo 2^64, which longs refuse to wrap: it is taken in exact
    decimals. Each step of the fold either adds one jump or, once past the end, does nothing.
    """
    start = F.struct(F.when(key < 0, key.cast("decimal(38,0)") + _dec(TWO_64)).otherwise(
        key.cast("decimal(38,0)")).cast("decimal(38,0)").alias("key"),
        F.lit(0).cast("bigint").alias("next"), F.array().cast("array<int>").alias("path"))

    def step(state: Column, _: Column) -> Column:
        grown = F.pmod((state["key"] * _dec(MULTIPLIER) + F.lit(1)).cast("decimal(38,0)"), _dec(TWO_64)).cast("decimal(38,0)")
        moved = bind(grown, lambda key: F.struct(
            key.alias("key"),
            F.floor((state["next"] + 1).cast("double") * (F.lit(float(TWO_31)) / (
                # decimals round their quotient to six digits, so the rest goes first
                F.floor((key - F.pmod(key, _dec(TWO_33))) / _dec(TWO_33)) + 1).cast("double"))).cast("bigint").alias("next"),
            F.concat(state["path"], F.array(state["next"].cast("int"))).alias("path")))
        return F.when(state["next"] < below, moved).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(below)), start, step)["path"]


def assign(docs: DataFrame, shards: int, grow_to: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """Adds ``shard`` (0 .. shards-1) and, with ``grow_to``, ``grown_shard`` to every row: a pure
    column expression. Equal ids share a shard; a null id counts as -1."""
    most = max(shards, grow_to or 0)
    path = jumps(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), most)

    def last_below(found: Column, n: int) -> Column:
        return F.array_max(F.filter(found, lambda b: b < n))

    both = bind(path, lambda p: F.struct(last_below(p, shards).alias("shard"), (
        last_below(p, grow_to) if grow_to else F.lit(None).cast("int")).alias("grown_shard")))
    out = docs.withColumn("_jumps", both)
    return out.select(*[c for c in out.columns if c not in ("_jumps", "shard", "grown_shard")],
                      F.col("_jumps.shard").alias("shard"), F.col("_jumps.grown_shard").alias("grown_shard"))


def slots(rows: DataFrame, block_rows: int = 1 << 16) -> DataFrame:
    """Adds ``slot``, gapless from 0 within each shard, in order of (doc_id, text_crc32).

    A shard's rows are numbered in blocks of ids, and each block starts after the rows of the
    blocks before it, so no task holds a whole shard. Null ids form a block of their own.
    """
    block = F.coalesce(F.floor(F.col("doc_id") / F.lit(block_rows)), F.lit(-(1 << 62)))
    numbered = blocked_row_number(rows.withColumn("_order", F.struct("doc_id", "text_crc32", "size")),
                                  ["shard"], "_order", block, "slot")
    return numbered.withColumn("slot", F.col("slot") - 1).drop("_order")


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per input row.

    ``size`` is the text's bytes plus 16; a null text has none. Only these figures are shuffled,
    never a text.
    """
    text = F.encode(docs[text_col].cast("string"), "UTF-8")
    small = docs.select(docs[id_col].cast("long").alias("doc_id"),
                        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
                        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"), F.lit("key").alias("law"))
    return slots(assign(small, shards, shards + 1)).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
