import datetime as dt

from quizspark.streaming import jobs as st


def _files(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/part{i}")


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part*")


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


USAGE = "ts timestamp, model_id string, cost double"


def test_late_rows_are_dropped_and_windows_closed(spark, tmp_path):
    path = str(tmp_path / "in")
    _files(spark, path, [[(at(5), "a", 1.0), (at(200), "a", 2.0)], [(at(6), "a", 9.0), (at(400), "a", 3.0)]], USAGE)
    out = st.run_to_table(st.usage_windows(_stream(spark, path, USAGE), "60 minutes", "10 minutes"), "append", "w").collect()
    got = {(r["window_start"] - at(0)).total_seconds() / 60: r["cost"] for r in out}
    assert got[180.0] == 2.0 and got[0.0] in (1.0, 10.0) and 360.0 not in got


def test_running_statistics_equal_batch(spark, tmp_path):
    schema = "model_name string, response_type string, is_correct boolean, confidence double"
    rows = [[("a", "x", True, 0.5), ("a", "x", None, 0.7)], [("a", "x", False, 0.9), ("b", "y", True, 1.0)]]
    path = str(tmp_path / "in")
    _files(spark, path, rows, schema)
    out = {r["model_name"]: r for r in st.run_to_table(st.grading_statistics(_stream(spark, path, schema)), "complete", "g").collect()}
    assert (out["a"]["total_graded"], out["a"]["correct_count"], out["a"]["incorrect_count"]) == (3, 1, 2)
    assert abs(out["a"]["avg_confidence"] - 0.7) < 1e-9 and out["b"]["total_graded"] == 1


def test_first_seen_drops_repeats(spark, tmp_path):
    path = str(tmp_path / "in")
    _files(spark, path, [[(at(1), "a", 1.0), (at(2), "b", 1.0)], [(at(3), "a", 2.0), (at(4), "c", 1.0)]], USAGE)
    out = st.run_to_table(st.first_seen(_stream(spark, path, USAGE), ["model_id"]), "append", "f").collect()
    assert sorted(r["model_id"] for r in out) == ["a", "b", "c"]


def test_progress_and_stalled_runs(spark, tmp_path):
    schema = "run_id string, ts timestamp, is_correct boolean"
    path = str(tmp_path / "in")
    _files(spark, path, [[("r1", at(0), True), ("r1", at(1), None)], [("r1", at(2), False), ("r2", at(600), True)], [("r2", at(601), True)]], schema)
    newest = st.run_totals(st.run_to_table(st.run_progress(_stream(spark, path, schema)), "update", "p", ["run_id", "period_start"])).collect()
    assert sorted((r["run_id"], r["completed"], r["successful"], r["failed"]) for r in newest) == [("r1", 3, 1, 1), ("r2", 2, 2, 0)]
    silent = st.run_to_table(st.stalled_runs(_stream(spark, path, schema), "30 minutes"), "append", "s").collect()
    assert [(r["run_id"], r["completed"], r["successful"], r["failed"], r["last_seen"]) for r in silent] == [("r1", 3, 1, 1, at(2))]


def test_progress_state_falls_after_finished_runs(spark, tmp_path):
    schema = "run_id string, ts timestamp, is_correct boolean"
    path, days = str(tmp_path / "in"), 24 * 60
    _files(spark, path, [[(f"r{i}", at(i), True) for i in range(20)], [("r0", at(30), None), ("new", at(2 * days), False)],
                         [("new", at(2 * days + 1), True)], [("new", at(2 * days + 2), True)]], schema)
    query = (st.run_progress(_stream(spark, path, schema)).writeStream.outputMode("update").format("memory").queryName("progress_state")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) >= 20 and kept[-1] == 1
    newest = st.run_to_table(st.run_progress(_stream(spark, path, schema)), "update", "p", ["run_id", "period_start"])
    totals = {r["run_id"]: (r["completed"], r["successful"], r["failed"]) for r in st.run_totals(newest).collect()}
    assert len(totals) == 21 and totals["r0"] == (2, 1, 0) and totals["new"] == (3, 2, 1) and totals["r7"] == (1, 1, 0)


def test_first_seen_returns_a_repeat_after_the_horizon(spark, tmp_path):
    path = str(tmp_path / "in")
    _files(spark, path, [[(at(1), "a", 1.0)], [(at(30), "a", 2.0), (at(500), "b", 1.0)], [(at(510), "c", 1.0)], [(at(520), "a", 3.0)]], USAGE)
    out = st.run_to_table(st.first_seen(_stream(spark, path, USAGE), ["model_id"], horizon="1 hour"), "append", "f").collect()
    assert sorted((r["model_id"], r["cost"]) for r in out) == [("a", 1.0), ("a", 3.0), ("b", 1.0), ("c", 1.0)]


def test_stream_static_prices(spark, tmp_path):
    schema = "model_id string, input_tokens bigint, output_tokens bigint"
    path = str(tmp_path / "in")
    _files(spark, path, [[("a", 1_000_000, 0), ("z", 5, 5)]], schema)
    prices = spark.createDataFrame([("a", 2.0, 3.0)], "model_id string, input_cost double, output_cost double")
    out = {r["model_id"]: r["list_cost"] for r in st.run_to_table(st.enrich_with_prices(_stream(spark, path, schema), prices), "append", "e").collect()}
    assert out == {"a": 2.0, "z": 0.0}
