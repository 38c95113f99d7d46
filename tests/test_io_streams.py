"""File formats, guards, and stream results against batch results."""

from __future__ import annotations

import json
import struct

import pytest
from pyspark.sql import functions as F

from regatta.operators import history as H
from regatta.sources import experiments as X
from regatta.sources import idx as I
from regatta.streaming import metrics as M
from regatta.streaming import state as S
from regatta.streaming.sinks import run_and_follow, run_partials, run_to_end, run_to_table


@pytest.fixture
def idx_folder(tmp_path):
    pixels = bytes(range(12))
    (tmp_path / "train-images.idx").write_bytes(struct.pack(">4I", 2051, 3, 2, 2) + pixels)
    (tmp_path / "train-labels.idx").write_bytes(struct.pack(">2I", 2049, 3) + bytes([7, 0, 9]))
    (tmp_path / "wrong-images.idx").write_bytes(struct.pack(">4I", 1234, 3, 2, 2) + pixels)
    (tmp_path / "short-images.idx").write_bytes(struct.pack(">4I", 2051, 3, 2, 2) + pixels[:5])
    return str(tmp_path)


def test_idx_scan(spark, idx_folder, monkeypatch):
    monkeypatch.setattr(I, "RANGE_BYTES", 4)
    images, rejected = I.read_images(spark, f"{idx_folder}/*images*")
    rows = images.orderBy("sample_id").collect()
    assert [r.sample_id for r in rows] == [0, 1, 2]
    assert rows[2].features == pytest.approx([v / 255 for v in (8, 9, 10, 11)])
    problems = {r.path.rsplit("/", 1)[1]: r.problem for r in rejected.collect()}
    assert problems == {"wrong-images.idx": "magic 1234, expected 2051", "short-images.idx": "truncated body"}
    data = I.load_dataset(spark, idx_folder).orderBy("sample_id").collect()
    assert [(r.split, r.label) for r in data] == [("train", 7), ("train", 0), ("train", 9)]


def document(seed, version="1.0"):
    model = {"layers": [[1.0, 2.0]], "bias": [0.5], "version": 1}
    return {
        "version": version, "savedAt": "2024-05-01T10:00:00.000Z",
        "serverConfig": {"aggregationMethod": "fedavg", "seed": seed}, "globalModel": model,
        "roundHistory": [
            {"round": r, "globalLoss": 1.0 / (r + 1), "globalAccuracy": 0.5, "aggregationTime": 2.0,
             "clusterMetrics": [{"clusterId": 0, "accuracy": 0.5, "clientIds": ["client-0"], "weights": model}],
             "clientMetrics": [{"clientId": "client-0", "clientName": "A", "loss": 1.0, "accuracy": 0.4,
                                "testAccuracy": 0.3, "gradientNorm": 0.1, "weights": model}],
             "globalModelWeights": model} for r in range(3)],
        "clientModels": [{"clientId": "client-0", "weights": model}],
    }


def test_documents(spark, tmp_path):
    for name, doc in [("first run", document(1)), ("second", document(2)), ("old", document(3, None))]:
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "broken.json").write_text("{ not json")
    good, bad = X.split_valid(X.read_documents(spark, str(tmp_path)))
    assert {r.experiment for r in bad.collect()} == {"old", "broken"}
    summary = {r.experiment: (r.rounds, r.entities, r.aggregation) for r in X.summarise(good).collect()}
    names = set(summary)
    assert len(names) == 2 and "second" in names and summary["second"] == (3, 1, "fedavg")
    assert X.rounds_of(good).count() == 6
    assert X.entity_rows_of(good).first().test_accuracy == 0.3
    assert X.cluster_rows_of(good).first().members == ["client-0"]
    out = str(tmp_path / "out")
    X.write_documents(good, out)
    back = X.read_documents(spark, out, multi_line=False)
    assert back.count() == 2
    row = back.first()
    assert row.clientModels[0].weights.bias == [0.5]
    assert row.roundHistory[0].globalModelWeights is None
    assert row.roundHistory[0].clientMetrics[0].weights is None
    assert row.roundHistory[0].clientMetrics[0].accuracy == 0.4


def test_benchmark_name(spark):
    got = spark.range(1).select(X.benchmark_name(F.lit(" my  long name "), F.lit(3), "t")).first()[0]
    assert got == "benchmark-my-long-name-avg3seeds-t"


@pytest.fixture
def event_files(spark, sf_dir, tmp_path):
    """The log as four files with interleaved rows (out of order within the allowed lateness)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = str(tmp_path / "log")
    events.repartition(4, "event_id").write.parquet(folder)
    return folder, events


FOREVER = "60 days"


def test_windows_match_batch(spark, event_files):
    folder, events = event_files
    stream = M.event_stream(spark, folder, "*.parquet", files_per_batch=1)
    got = run_to_table(M.round_metrics(stream, FOREVER))
    assert got.count() == 0  # every window is still open
    whole = M.event_stream(spark, folder, "*.parquet")
    table = run_to_table(M.round_metrics(whole))
    batch = events.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.avg("value").alias("m"))
    last = batch.agg(F.max("d")).first()[0]
    want = {(r.d, r.event_type): pytest.approx(r.m) for r in batch.filter(F.col("d") < last).collect()}
    assert {(r.start.date(), r.experiment): r["mean"] for r in table.collect()} == want


def test_late_rows_are_dropped(spark, tmp_path):
    rows = [(i, f"2024-01-{d:02d} 12:00:00", 1, "view", 1.0, "{}") for i, d in enumerate([1, 20, 25, 2, 28])]
    schema = "event_id long, ts string, user_id long, event_type string, value double, props string"
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "late"))
    stream = M.event_stream(spark, str(tmp_path / "late"), "*.parquet", files_per_batch=1)
    got = run_to_table(M.round_metrics(stream))
    # The watermark of one batch judges the rows of the next but one.
    assert sorted(r.start.day for r in got.collect()) == [1, 20, 25]


def test_restart_goes_on(spark, event_files, tmp_path):
    folder, events = event_files
    target = str(tmp_path / "once")
    stream = M.event_stream(spark, folder, "*.parquet", files_per_batch=2)
    first = run_to_table(M.once_per_round(stream, FOREVER), target).count()
    again = run_to_table(M.once_per_round(stream, FOREVER), target).count()
    want = events.select("user_id", F.to_date("ts")).distinct().count()
    assert first == again == want


def test_keyed_state_matches_windows(spark, event_files):
    folder, events = event_files
    windows = run_and_follow(M.entity_windows(M.event_stream(spark, folder, "*.parquet")))
    got = run_to_table(S.increase_alerts(windows))
    per = events.groupBy(F.col("user_id").alias("entity"), F.to_date("ts").alias("round")).agg(
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    last = per.agg(F.max("round")).first()[0]
    want = H.increase_alerts(per.filter(F.col("round") < last), "norm", ["entity"]).filter("rising")
    assert {(r.entity, r.at.date()) for r in got.collect()} == {(r.entity, r["round"]) for r in want.collect()}


def test_replayed_batches_count_once(spark, event_files, tmp_path):
    folder, events = event_files
    target = str(tmp_path / "partials")
    rows = M.event_stream(spark, folder, "*.parquet", files_per_batch=1).select(
        F.col("event_type").alias("group"), F.array("value").alias("vector"), F.lit(1.0).alias("weight"))
    table = run_partials(rows, M.mean_partials, target)
    assert table.select("batch_id").distinct().count() == 4
    table = run_partials(rows, M.mean_partials, target)
    got = {r.group: r.val for r in M.running_mean(table).collect()}
    want = {r.event_type: pytest.approx(r.m) for r in events.groupBy("event_type").agg(F.avg("value").alias("m")).collect()}
    assert got == want


def write_days(spark, folder, days):
    """One file per event, in the order given: ``(day, user, value)``."""
    schema = "event_id long, ts string, user_id long, event_type string, value double, props string"
    for i, (day, user, value) in enumerate(days):
        row = (i, f"2024-{1 + (day - 1) // 28:02d}-{1 + (day - 1) % 28:02d} 12:00:00", user, "view", value, "{}")
        spark.createDataFrame([row], schema).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1) \
            .write.mode("append").parquet(folder)


def test_end_of_log_closes_the_last_window(spark, event_files):
    folder, events = event_files
    stream = M.event_stream(spark, folder, "*.parquet", files_per_batch=1)
    got = run_to_end(stream, lambda rows: M.round_metrics(rows, FOREVER))
    batch = events.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.avg("value").alias("m"))
    assert {(r.start.date(), r.experiment): r["mean"] for r in got.collect()} == {
        (r.d, r.event_type): pytest.approx(r.m) for r in batch.collect()}


def test_late_rows_are_counted(spark, tmp_path):
    """Of the two rows for day 2 that come after day 25, the first meets an older watermark."""
    folder = str(tmp_path / "late")
    write_days(spark, folder, [(2, 1, 1.0), (20, 1, 1.0), (25, 1, 1.0), (2, 2, 1.0), (2, 3, 1.0), (28, 1, 1.0)])
    stream = M.event_stream(spark, folder, "*.parquet", files_per_batch=1)
    closed = run_to_end(stream, lambda rows: M.quorum(rows, 1))
    got = M.late_rows(closed, run_partials(stream, M.window_rows)).collect()
    assert {r.start.day: (r["rows"], r.late) for r in got} == {2: (1, 2), 20: (1, 0), 25: (1, 0), 28: (1, 0)}


def test_silent_entities_lose_history_and_state(spark, tmp_path):
    folder = str(tmp_path / "days")
    # Entity 1 comes back after 45 days, entity 2 never; entity 3 is seen until the end.
    days = [(1, 1, 1.0), (2, 2, 1.0), (2, 1, 2.0), *[(d, 3, 1.0) for d in (10, 30, 45)], (47, 1, 9.0), (50, 3, 1.0)]
    write_days(spark, folder, days)
    windows = run_and_follow(M.event_stream(spark, folder, "*.parquet"), M.entity_windows)
    rows = run_to_table(S.recent_values(windows)).filter("entity = 1").orderBy("at").collect()
    assert [(r.newest, r.second, r.kept) for r in rows] == [(1.0, None, 1), (2.0, 1.0, 2), (9.0, None, 1)]
    assert [r.current for r in run_to_table(S.increase_alerts(windows)).filter("entity = 1").collect()] == [2.0]
    query = S.recent_values(windows).writeStream.format("noop").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    left = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    assert left == 2  # entity 2 is gone
