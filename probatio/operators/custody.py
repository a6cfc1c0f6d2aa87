"""Custody over time (S11): what changed from one run's inventory to the next.

The ledger has a row per run and file (``rel_path``, ``sha256``, ``size``, ..., ``run_ts``), stored by run; runs follow each
other by ``run_ts``, and a run lists a path once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def custody_latest(ledger: DataFrame) -> DataFrame:
    """The newest row of each path, whichever run it is from: a maximum, formed before the shuffle."""
    rest = [c for c in ledger.columns if c not in ("rel_path", "run_ts")]
    return ledger.groupBy("rel_path").agg(F.max(F.struct("run_ts", *rest)).alias("r")).select("rel_path", "r.*")


def custody_compare(ledger: DataFrame, before: str, after: str) -> DataFrame:
    """(rel_path, change) between two runs; only the partitions of these two are read."""
    def of(run: str, name: str) -> Column:
        return F.max(F.when(F.col("run_ts") == run, F.col("sha256"))).alias(name)

    both = ledger.where(F.col("run_ts").isin(before, after)).groupBy("rel_path").agg(of(before, "old"), of(after, "new"))
    return both.select("rel_path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "missing")
                       .when(F.col("old") == F.col("new"), "unchanged").otherwise("modified").alias("change"))


def custody_changes(ledger: DataFrame) -> DataFrame:
    """(run_ts, rel_path, change) for each run and file against the run before it; a file that is gone is ``missing`` in the
    first run without it. A path's rows are as many as there are runs, and the list of runs is one row per run."""
    runs = ledger.select("run_ts").distinct()
    order = Window.orderBy("run_ts")  # one row per run
    runs = runs.select("run_ts", F.row_number().over(order).alias("no"), F.lead("run_ts").over(order).alias("next_run"))
    path = Window.partitionBy("rel_path").orderBy("no")
    rows = ledger.select("run_ts", "rel_path", "sha256").join(F.broadcast(runs), "run_ts") \
        .withColumn("old_no", F.lag("no").over(path)).withColumn("old", F.lag("sha256").over(path)).withColumn("new_no", F.lead("no").over(path))
    seen_before = F.col("old_no") == F.col("no") - 1
    here = F.struct(F.col("run_ts").alias("run_ts"), F.when(F.coalesce(~seen_before, F.lit(True)), "added").when(
        F.col("old").eqNullSafe(F.col("sha256")), "unchanged").otherwise("modified").alias("change"))
    gone = F.when(F.col("next_run").isNotNull() & F.coalesce(F.col("new_no") != F.col("no") + 1, F.lit(True)),
                  F.struct(F.col("next_run").alias("run_ts"), F.lit("missing").alias("change")))
    return rows.select("rel_path", F.explode(F.array_compact(F.array(here, gone))).alias("c")).select("c.run_ts", "rel_path", "c.change")
