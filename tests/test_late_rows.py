"""Watermarked upserts: replays, late rows, bounded state; log files; single model documents."""

import datetime as dt
import json

import pytest

from callmetrics.operators import pairing, status
from callmetrics.sources import files
from callmetrics.streaming import monitors as SM

START = dt.datetime(2026, 1, 1)
SCHEMA = "k string, version long, at timestamp, value string"


def batches():
    """Ten files, an hour apart: each with new rows, replays of the file before, and from the sixth on late rows."""
    out = []
    for hour in range(10):
        rows = [(f"k{i % 40}", hour * 100 + i, START + dt.timedelta(hours=hour, minutes=i % 50), f"v{hour}.{i}") for i in range(100)]
        if hour:
            rows += out[-1][:50]
        if hour > 5:
            rows += [(f"late{i}", 10_000 + i, START + dt.timedelta(minutes=i), "late") for i in range(7)]
        out.append(rows)
    return out


@pytest.fixture()
def stream(spark, tmp_path):
    for number, rows in enumerate(batches()):
        path = tmp_path / "in" / f"{number:03}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text("".join(json.dumps({"k": k, "version": v, "at": at.isoformat(sep=" "), "value": x}) + "\n" for k, v, at, x in rows))
        import os

        os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))

    def read(files_a_batch: int):
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).json(str(tmp_path / "in"))

    return read


def expected(files_a_batch, delay):
    """Last version per key of the rows in time, and the late ones."""
    kept, late, newest = {}, [], None
    whole = batches()
    for first in range(0, len(whole), files_a_batch):
        rows = [r for part in whole[first:first + files_a_batch] for r in part]
        mark = newest - delay if newest else None
        for r in rows:
            if mark is not None and r[2] <= mark:
                late.append(r)
            elif r[0] not in kept or kept[r[0]][1] < r[1]:
                kept[r[0]] = r
        newest = max(r[2] for r in rows)
    return kept, late


@pytest.mark.parametrize("files_a_batch", [1, 2])
def test_upserts_within_a_watermark(spark, stream, tmp_path, files_a_batch):
    kept, late = expected(files_a_batch, dt.timedelta(hours=2))
    table = SM.upsert_within(stream(files_a_batch), ["k"], ["version"], "at", "2 hours", str(tmp_path / "up"))
    assert {r.k: (r.version, r.value) for r in table.collect()} == {k: (r[1], r[3]) for k, r in kept.items()}
    logged = spark.read.parquet(str(tmp_path / "up/log"))
    assert logged.groupBy("batch", "k").count().where("count > 1").count() == 0
    found = SM.late_rows(stream(files_a_batch), "at", "2 hours", str(tmp_path / "late"))
    assert sorted((r.k, r.version) for r in found.collect()) == sorted((r[0], r[1]) for r in late) and late


def test_state_holds_one_delay(spark, stream, tmp_path):
    live = stream(1).withWatermark("at", "2 hours").dropDuplicatesWithinWatermark(["k", "version"])
    running = (
        live.writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in running.recentProgress if p["stateOperators"]]
    running.stop()
    assert len(sizes) >= 10 and max(sizes) <= 500  # of 1,000 distinct rows: those of about four hours


def test_rates_count_every_failure(spark):
    codes = {"parse": "fail_parse", "refusal": "fail_refusal", "empty": "fail_empty"}
    rows = [("m", o) for o in ("pass", "fail_refusal", "fail_refusal", "fail_empty", None)]
    row = status.failure_rates(spark.createDataFrame(rows, "model_id string, outcome string"), codes).first()
    assert (row.n, row.parse, row.refusal, row.empty) == (5, 0.0, 0.4, 0.2)


def test_stage_counts_of_pairs(spark):
    shape = "instance_id string, sample_idx long, outcome string"
    before = spark.createDataFrame([("a", 0, "pass"), ("a", 1, "fail_truncated"), ("b", 0, "fail_wrong"), ("c", 0, "pass")], shape)
    after = spark.createDataFrame([("a", 0, "error_api"), ("a", 1, "pass"), ("b", 0, None), ("d", 0, "pass")], shape)
    got = {r.stage: tuple(r)[1:] for r in pairing.paired_stage_counts(before, after).collect()}
    assert got == {"before": (3, 1, 1, 1, 1, 0), "after": (3, 1, 0, 2, 0, 1)}


def test_log_lines_keep_their_order_over_small_blocks(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(5000)))
    (tmp_path / "b.log").write_text("x\ny\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = files.read_logs(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    mine = sorted((r.line_no, r.value) for r in lines if r["log"].endswith("a.log"))
    assert [v for _, v in mine] == [f"line {i}" for i in range(5000)] and len({n for n, _ in mine}) == 5000


def test_one_model_document(spark, tmp_path):
    (tmp_path / "one").mkdir(), (tmp_path / "two").mkdir(), (tmp_path / "none").mkdir()
    for name in ("one/a.json", "two/a.json", "two/b.json"):
        (tmp_path / name).write_text('{"x": 1}')
    assert files.load_frozen(spark, str(tmp_path / "one")) == {"x": 1}
    with pytest.raises(ValueError, match="several"):
        files.load_frozen(spark, str(tmp_path / "two"))
    with pytest.raises(ValueError, match="none"):
        files.load_frozen(spark, str(tmp_path / "none"))


def test_late_rows_of_an_empty_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    empty = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    assert SM.late_rows(empty, "at", "1 hour", str(tmp_path / "late")).count() == 0
