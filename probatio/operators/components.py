"""Connected components of any table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatio.operators.skew import attach_by_key
from probatio.session import written


#: Up to so many links, hubs are not spread: a node's rows are at most twice as many, of 16 bytes.
FEW_LINKS = 1_000_000


def _star(links: DataFrame, large: bool, spread: bool = True) -> DataFrame:
    """One star step over (u, v) with u < v: the large step ties the greater neighbours of each node
    to its minimum, the small step ties its smaller neighbours and itself. To ``spread`` the rows of hubs
    takes two more shuffles."""
    low_first, high_first = links.select("u", "v"), links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    both = low_first.union(high_first) if large else high_first
    low = both.groupBy("u").agg(F.count("*").alias("degree"), F.least(F.min("v"), F.col("u")).alias("m"))
    linked = attach_by_key(both, low, "u", "degree", "v") if spread else both.join(low, "u")
    if large:
        out = linked.where("v > u").select(F.col("m").alias("u"), F.col("v"))
    else:
        out = linked.select(F.col("m").alias("u"), F.col("v")).union(low.select(F.col("m").alias("u"), F.col("u").alias("v")))
    return out.where("u <> v").distinct()


def _mark(links: DataFrame) -> tuple:
    """Count and hash sum, which tell two tables of links apart."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str = "id1", b: str = "id2") -> DataFrame:
    """(id, cluster_id) for each node of a link to another node; a component is named by its
    smallest id. Links from a node to itself and null ends say nothing.

    Alternates large-star and small-star until a round changes nothing; both are known to settle.
    Minima are partial aggregates and, among more than ``FEW_LINKS`` links, hubs are spread, so a node with
    very many links is no single group. Each step is written to the shared folder, which ends its lineage.
    """
    current = written(links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct(), "links")
    mark = _mark(current)
    while mark[0]:
        spread = mark[0] > FEW_LINKS
        current = written(_star(written(_star(current, True, spread), "links"), False, spread), "links")
        before, mark = mark, _mark(current)
        if mark == before:
            break
    # every node now hangs directly on the smallest node of its component
    return current.select(F.col("v").alias("id"), F.col("u").alias("cluster_id")).union(
        current.select(F.col("u").alias("id"), F.col("u").alias("cluster_id")).distinct())
