"""Running totals and scans over the rows of a key, where no task, frame or list holds a whole key.

:func:`running` is a prefix sum over range partitions: rows are laid out in order, every partition's
total per key is one row, and the sum of the totals before it goes ahead of the partition's own
rows. :func:`scan` composes maps, which is associative but no sum, as a tree: blocks of a bounded
number of rows are scanned in doubling steps, their totals are scanned in the same way, and come back to
the blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatio.session import written

TOTALS = {"sum": F.sum, "max": F.max}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, tuple[str, Column]],
            label: str = "running", parts: int | None = None) -> DataFrame:
    """``df`` with, for each name in ``values``, the sum or maximum of a column over the rows of its key
    that come before it in ``order``; a sum over no rows is 0, a maximum is null.

    Rows are written once, in ``parts`` range partitions of (keys, order), by default as many as the session's
    shuffle partitions; ``df`` is read twice, as ranges are found by a sample. A key with very many rows spans many of them; each task's frame ends with its
    partition. Rows without a key are a key of their own.
    """
    keys, order = list(keys), list(order)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select("*", *[value.alias(f"_v_{name}") for name, (_, value) in values.items()])
    laid = written(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), label)
    per_part = laid.groupBy(*keys, "_part").agg(*[TOTALS[kind](f"_v_{name}").alias(f"_v_{name}") for name, (kind, _) in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per_part.select(*keys, "_part", F.count("*").over(earlier).alias("_n"),
                            *[TOTALS[kind](f"_v_{name}").over(earlier).alias(f"_v_{name}") for name, (kind, _) in values.items()])
    both = laid.withColumn("_row", F.lit(True)).unionByName(
        ahead.where("_n > 0").drop("_n").withColumn("_row", F.lit(False)), allowMissingColumns=True)
    before = Window.partitionBy(*keys, "_part").orderBy("_row", *order).rowsBetween(Window.unboundedPreceding, -1)

    def total(name: str, kind: str) -> Column:
        out = TOTALS[kind](f"_v_{name}").over(before)
        return (F.coalesce(out, F.lit(0)) if kind == "sum" else out).alias(name)

    return both.select("*", *[total(name, kind) for name, (kind, _) in values.items()]).where("_row").select(*df.columns, *values)


def clamp(a: Column, c: Column, lo: Column, hi: Column) -> Column:
    """The map x -> min(hi, max(lo, a x + c)) as one value; ``a`` is not negative."""
    return F.struct(*[x.cast("double").alias(n) for x, n in ((a, "a"), (c, "c"), (lo, "lo"), (hi, "hi"))])


def applied(f: Column, x: Column) -> Column:
    """A clamped map at ``x``; null is the map that changes nothing."""
    return F.when(f.isNull(), x).otherwise(F.least(F.greatest(f["a"] * x + f["c"], f["lo"]), f["hi"]))


def after(first: Column, second: Column) -> Column:
    """``second`` after ``first``, which is a clamped map again."""
    both = clamp(first["a"] * second["a"], second["a"] * first["c"] + second["c"], applied(second, first["lo"]), applied(second, first["hi"]))
    return F.when(first.isNull(), second).when(second.isNull(), first).otherwise(both)


def scan(rows: DataFrame, keys: Sequence[str], no: str, step: str, block: int = 128) -> DataFrame:
    """``rows`` with ``upto``, the composition of the maps ``step`` of all rows of the key up to this one, and
    ``before``, the same without this one (null for the first row). ``no`` numbers a key's rows from 0.

    A block is ``block`` consecutive rows. Within it log2(block) windows compose each row's map with the one 1, 2,
    4, ... rows before it. The maps of full blocks, a ``block``-th of the rows, are scanned in turn; the number of
    rounds is the logarithm of the longest key.
    """
    keys = list(keys)
    window = Window.partitionBy(*keys, "_block").orderBy(no)
    current = rows.withColumn("_block", F.floor(F.col(no) / block)).withColumn("_upto", F.col(step))
    reach = 1
    while reach < block:
        current = current.withColumn("_upto", after(F.lag("_upto", reach).over(window), F.col("_upto")))
        reach *= 2
    current = written(current.withColumn("_before", F.lag("_upto").over(window)), "scan")
    full = current.where(F.col(no) % block == block - 1)
    if full.limit(1).count() == 0:
        return current.withColumnsRenamed({"_upto": "upto", "_before": "before"}).drop("_block")
    totals = scan(full.select(*keys, F.col("_block").alias("_no"), F.col("_upto").alias("_step")), keys, "_no", "_step", block)
    ahead = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col("_no") + 1).alias("_next"), F.col("upto").alias("_ahead"))
    same = F.col("_block") == F.col("_next")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return current.join(ahead, same, "left").select(
        *rows.columns, after(F.col("_ahead"), F.col("_upto")).alias("upto"), after(F.col("_ahead"), F.col("_before")).alias("before"))


def folded(rows: DataFrame, keys: Sequence[str], no: str, step: str, start: Column, carry: Sequence[str], block: int = 64) -> DataFrame:
    """(keys, carry, value_before, value) of each row: ``start`` sent through the maps ``step`` of a key's rows one by one.

    A key's rows are cut into blocks of ``block``, which become lists of at most that length. Each list is folded to
    one map, the maps of the blocks are scanned, and every block is then folded again from its own start. So within
    a block the steps are the very sums and products of the sequential rule, and from one block to the next, too,
    unless no bound was met in a whole block.
    """
    keys = list(keys)
    lists = written(rows.groupBy(*keys, F.floor(F.col(no) / block).alias("_no")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(no).alias("_i"), F.col(step).alias("_step"), *carry))).alias("_rows")), "blocks")
    first = lists.withColumn("_map", F.aggregate(
        F.slice("_rows", 2, block), F.col("_rows")[0]["_step"], lambda f, r: F.struct(*[
            x.alias(n) for n, x in (("a", f["a"] * r["_step"]["a"]), ("c", r["_step"]["a"] * f["c"] + r["_step"]["c"]),
                                    ("lo", applied(r["_step"], f["lo"])), ("hi", applied(r["_step"], f["hi"])))])))
    begun = scan(first.select(*keys, "_no", "_map"), keys, "_no", "_map").select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_no").alias("_at"), applied(F.col("before"), start).alias("_start"))
    same = F.col("_no") == F.col("_at")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    values = F.aggregate("_rows", F.array("_start"), lambda seen, r: F.array_append(seen, applied(r["_step"], F.element_at(seen, -1))))
    each = lists.join(begun, same).withColumn("_values", values).select(*keys, "_values", F.posexplode("_rows").alias("_p", "_r"))
    return each.select(*keys, *[F.col("_r")[c].alias(c) for c in carry], F.col("_values")[F.col("_p")].alias("value_before"),
                       F.col("_values")[F.col("_p") + 1].alias("value"))
