"""Streams over several files, with a restart, against the batch operators."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from probatio.operators import ai_tables as ai
from probatio.sources.evidence import stream_table
from probatio.streaming import jobs
from probatio.streaming.run import late_rows, started

SCHEMA = "usage_key long, request_id long, ts timestamp, success boolean"


def drain(stream, path):
    (stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out")
     .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination())


def test_rate_state_in_order_with_late_requests_and_restarts(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i % 2, i, start + dt.timedelta(minutes=i), i % 9 == 0) for i in range(60)]
    late = {20, 21, 40}  # these come one batch after their time
    batches = [[r for r in rows if r[1] < 25 and r[1] not in late], [r for r in rows if 25 <= r[1] < 60 and r[1] != 40 or r[1] in (20, 21)],
               [rows[40], (0, 60, start + dt.timedelta(minutes=200), True)]]
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        drain(jobs.stream_rate_state(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")), tmp_path)
    got = {r["request_id"]: r["multiplier"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r["request_id"]: r["multiplier"] for r in ai.rate_multiplier(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == pytest.approx(want)  # all but the last request, which the watermark has not passed


def test_rate_state_tells_every_request_and_starts_anew_after_a_pause(spark, tmp_path):
    """Several files with a restart after each; a last row closes the stream, a request beyond the watermark is dropped."""
    start, day = dt.datetime(2024, 1, 1), dt.timedelta(days=1)
    rows = [(i % 3, i, start + dt.timedelta(minutes=i), i % 7 == 0) for i in range(45)]
    paused = [(0, 100 + i, start + 10 * day + dt.timedelta(minutes=i), False) for i in range(4)]
    closing = [(9, 999, start + 30 * day, True)]
    too_late = [(1, 500, start + dt.timedelta(minutes=1), False)]
    for batch in (rows[:20], rows[20:], paused, closing, too_late):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        drain(jobs.stream_rate_state(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")), tmp_path)
    got = {r["request_id"]: r["multiplier"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    before = {r["request_id"]: r["multiplier"] for r in ai.rate_multiplier(spark.createDataFrame(rows, SCHEMA)).collect()}
    anew = {r["request_id"]: r["multiplier"] for r in ai.rate_multiplier(spark.createDataFrame(paused, SCHEMA)).collect()}
    assert got == pytest.approx({**before, **anew}) and 500 not in got


def test_dropped_rows_are_counted(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    schema, counts = "ts timestamp, event_type string, value double", []
    for hours in ([0, 1, 2, 50], [51, 3, 4], [60, 49, 5]):  # 3, 4 and 5 come after the watermark has passed their day
        spark.createDataFrame([(start + dt.timedelta(hours=h), f"kind{h}", 1.0) for h in hours], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.stream_periods(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        counts.append(late_rows(started(stream, str(tmp_path))))
    assert counts == [0, 2, 1]
    kept = spark.read.parquet(f"{tmp_path}/out").agg(F.sum("events")).first()[0]
    assert kept == 3  # those of the first day that were in time; the later days are still open


def test_first_copy_wins_across_files(spark, tmp_path):
    for n, ids in enumerate(([1, 2], [3, 4])):
        rows = [(i, "same" if i != 4 else "other", dt.datetime(2024, 1, 1, n)) for i in ids]
        spark.createDataFrame(rows, "doc_id long, file_hash string, modified_ts timestamp").coalesce(1) \
            .write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("doc_id long, file_hash string, modified_ts timestamp").parquet(f"{tmp_path}/in")
        drain(jobs.stream_dedup(stream).select("doc_id", "file_hash"), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r["file_hash"] for r in got) == ["other", "same"]
    assert {r["doc_id"] for r in got if r["file_hash"] == "same"} <= {1, 2}


def test_an_old_file_that_arrives_late_still_comes_out(spark, tmp_path):
    schema = "doc_id long, file_hash string, modified_ts timestamp"
    for n, day in enumerate((dt.datetime(2024, 6, 1), dt.datetime(2024, 6, 2), dt.datetime(2020, 1, 1))):
        spark.createDataFrame([(n, f"hash{n}", day)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        drain(jobs.stream_dedup(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).select("doc_id", "file_hash"), tmp_path)
    assert sorted(r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2]


def test_sessions_merge_at_exactly_the_gap(spark, tmp_path):
    hours = [0, 6, 12, 30, 100]
    spark.createDataFrame([(7, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for h in hours], "user_id long, ts timestamp") \
        .coalesce(1).write.parquet(f"{tmp_path}/in")
    drain(jobs.stream_sessions(spark.readStream.schema("user_id long, ts timestamp").parquet(f"{tmp_path}/in")), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("first_ts").select("events").collect()
    assert [r["events"] for r in got] == [3, 1]  # the last session is still open


def test_rate_state_calls_the_store_per_block_of_requests():
    puts = []

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Handle:
        def getValueState(self, *_):
            return Value()

        def getMapState(self, *_):
            return type("Map", (), {"updateValue": lambda _self, key, value: puts.append(key)})()

        def registerTimer(self, at):
            pass

    state = jobs.RateState(1000)
    state.init(Handle())
    rows = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=10_000, freq="s"), "request_id": range(10_000), "success": [True] * 10_000})
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda _self: 0})()
    for _ in range(2):
        list(state.handleInputRows((1,), iter([rows]), clock))
    assert len(puts) == len(set(puts)) == 6


def test_rate_state_keeps_the_rest_of_blocks(spark, tmp_path):
    """Blocks that the watermark passes in part keep the rest; a request that comes twice counts once."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i % 2, i, start + dt.timedelta(minutes=i), i % 9 == 0) for i in range(600)]
    for batch in (rows[:400], rows[400:] + rows[500:510], [(9, 999, start + dt.timedelta(days=3), True)]):
        spark.createDataFrame(batch[::-1], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    drain(jobs.stream_rate_state(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), waiting=64), tmp_path)
    got = sorted((r["request_id"], r["multiplier"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted((r["request_id"], r["multiplier"]) for r in ai.rate_multiplier(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want])


def test_batches_of_a_table_have_files_of_their_own(spark, tmp_path):
    """No task writes a whole batch, and rows come in ascending order from batch to batch."""
    spark.range(0, 40_000, 1, 8).selectExpr("id AS doc_id", "repeat('x', 10) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    stream = stream_table(spark, str(tmp_path), "documents", "doc_id", file_rows=100)
    seen = []

    def put(batch, batch_id):
        seen.append(batch.agg(F.min("doc_id"), F.max("doc_id"), F.count("*"), F.count_distinct("file")).first())
    stream.withColumn("file", F.input_file_name()).writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sum(s[2] for s in seen) == 40_000 and all(a[1] < b[0] for a, b in zip(seen, seen[1:]))
    assert len(seen) == 4 and {s[3] for s in seen} == {2}
