"""Running a stream over what is there now, with results in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from probatio.session import fresh_path


def started(stream: DataFrame, path: str) -> StreamingQuery:
    """Append-mode run until all input is read; results under ``path``/out, state under ``path``/state."""
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out")
         .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def drained(stream: DataFrame, label: str) -> DataFrame:
    """The table of everything that an append-mode run over all input emits."""
    spark = stream.sparkSession
    path = fresh_path(spark, label)
    started(stream, path)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def late_rows(q: StreamingQuery) -> int:
    """Rows that the state operators of a run have dropped as later than the watermark, told by its progress. Before an
    aggregation these are a task's partial sums: late rows of one period and kind in one task count once."""
    return sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])


def upserted(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Update-mode run: each batch adds its changed rows, the newest row per key counts.

    A batch is one folder and is overwritten when repeated, so a restart does not count twice.
    """
    spark = stream.sparkSession
    path = fresh_path(spark, label)

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    q = (stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{path}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.read.parquet(f"{path}/out")
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")
