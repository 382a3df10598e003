import json

import pytest
from pyspark.sql import functions as F

from quizspark.sources import logs, questions as qs, tables as tb

ROW = {"category": "ART", "clue": "Who painted it", "response": "X", "value": "$200"}


@pytest.mark.parametrize("doc,n", [([ROW, ROW], 2), ({"data": [ROW]}, 1), ({"questions": [ROW, ROW, ROW]}, 3), (ROW, 1)])
def test_json_shapes(spark, tmp_path, doc, n):
    path = tmp_path / "q.json"
    path.write_text(json.dumps(doc, indent=1))
    df = qs.require_columns(qs.present_only(qs.read_questions_json(spark, str(path))))
    assert df.count() == n and sorted(df.columns) == ["answer", "category", "question", "value"]
    assert df.first()["question"] == "Who painted it"


def test_csv_quotes_and_missing_columns(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('category,question,answer\nART,"say ""hi""\nthere",X\n')
    df = qs.require_columns(qs.read_questions_csv(spark, str(path), multi_line=True))
    assert df.first()["question"] == 'say "hi"\nthere'
    with pytest.raises(qs.IngestionError):
        qs.require_columns(df.drop("answer"))


def test_snapshot_and_restore(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string")
    counts = {r["table_name"]: r["record_count"] for r in tb.snapshot({"questions": a}, f"{tmp_path}/s", "2024-01-01").collect()}
    back = tb.read_snapshot(spark, f"{tmp_path}/s", {"questions": a.schema})["questions"]
    assert counts == {"questions": 2} and sorted(back.collect()) == sorted(a.collect())
    new = spark.createDataFrame([(2, "z"), (3, "w")], "id int, t string")
    tb.restore({"questions": a}, {"questions": new}, {"questions": ["id"]}, f"{tmp_path}/r")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/r/questions").collect()) == [(1, "x"), (2, "z"), (3, "w")]
    tb.restore({"questions": a}, {"questions": new}, {"questions": ["id"]}, f"{tmp_path}/r2", drop_existing=True)
    assert spark.read.parquet(f"{tmp_path}/r2/questions").count() == 2


def test_checkpoints_newest_first_skip_broken(spark, tmp_path):
    for i, ts in enumerate(["2024-01-01T00:00:00", "2024-03-01T00:00:00"]):
        (tmp_path / f"c{i}.json").write_text(json.dumps({"checkpoint_id": f"c{i}", "benchmark_run_id": 1, "timestamp": ts,
                                                         "progress_data": {"done": "3"}}, indent=1))
    (tmp_path / "broken.json").write_text("{not json")
    got, rejects = logs.scan_checkpoints(spark, str(tmp_path), 1)
    got = got.collect()
    assert [(r["line"], r["file_path"].rsplit("/", 1)[1]) for r in rejects.collect()] == [("{not json", "broken.json")]
    assert [r["checkpoint_id"] for r in got] == ["c1", "c0"] and got[0]["file_path"].endswith("c1.json")


@pytest.mark.parametrize("kind", ["json", "csv"])
def test_usage_round_trip(spark, tmp_path, kind):
    rows = spark.createDataFrame([("2024-01-15 10:00:00.123456", "a", 1, 2, 0.5, "s", {"k": 'v"1"'}), ("2024-01-16 00:00:00", "b", 3, 4, 0.25, None, {})],
                                 "t string, model_id string, input_tokens bigint, output_tokens bigint, cost double, session_id string, metadata map<string,string>")
    rows = rows.select(F.col("t").cast("timestamp").alias("timestamp"), *rows.columns[1:])
    logs.write_usage(rows, f"{tmp_path}/u", kind)
    got, rejects = logs.read_usage(spark, f"{tmp_path}/u", kind)
    got = got.orderBy("model_id").collect()
    assert rejects.collect() == []
    assert got[0]["metadata"] == {"k": 'v"1"'} and got[0]["timestamp"].microsecond == 123456 and got[1]["cost"] == 0.25
    with pytest.raises(ValueError):
        logs.write_usage(rows, f"{tmp_path}/x", "xml")


def test_spoilt_lines_are_returned(spark, tmp_path):
    lines = ['{"checkpoint_id":"a","benchmark_run_id":1}', '{"checkpoint_id":"b","benchmark_run_id":"x"}', "no json", '{"benchmark_run_id":2}', ""]
    (tmp_path / "c.json").write_text("\n".join(lines))
    docs, rejects = logs.scan_checkpoints(spark, str(tmp_path), multi_line=False)
    assert [r["checkpoint_id"] for r in docs.collect()] == ["a"] and sorted(r["line"] for r in rejects.collect()) == sorted(lines[1:4])
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "u.json").write_text('{"model_id":"m","input_tokens":3}\n{"model_id":"m","input_tokens":"many"}\n{"model_id":')
    rows, rejects = logs.read_usage(spark, f"{tmp_path}/u")
    assert [r["input_tokens"] for r in rows.collect()] == [3] and rejects.count() == 2


def test_last_row_of_a_key_wins(spark):
    have = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "id int, t string")
    new = spark.createDataFrame([(1, "n1", 2), (1, "n2", 1), (None, "x", 1), (None, "y", 3), (5, "z", 0)], "id int, t string, seq int")
    by_seq = tb.upsert(have, new, ["id"], "seq").select("id", "t").collect()
    assert sorted(map(tuple, by_seq), key=str) == sorted([(2, "c"), (1, "n1"), (None, "y"), (5, "z")], key=str)
    as_read = tb.upsert(have, new.drop("seq").coalesce(1), ["id"]).collect()
    assert sorted(map(tuple, as_read), key=str) == sorted([(2, "c"), (1, "n2"), (None, "y"), (5, "z")], key=str)


def test_merge_rewrites_touched_partitions_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.createDataFrame([(i, i % 3, "old") for i in range(30)] + [(99, None, "old")], "id int, p int, t string").write.partitionBy("p").parquet(path)
    def files():
        return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([(1, 1, "new"), (1, 1, "newer"), (100, 7, "new"), (99, None, "new")], "id int, p int, t string").coalesce(1)
    tb.merge_partitions(spark, path, new, ["id", "p"], ["p"])
    after = files()
    kept = {f for f in before if f.startswith(("p=0", "p=2"))}
    assert kept and all(after.get(f) == before[f] for f in kept) and not any(f in after for f in before if f not in kept)
    rows = {r["id"]: (r["p"], r["t"]) for r in spark.read.parquet(path).collect()}
    assert len(rows) == 32 and rows[1] == (1, "newer") and rows[100] == (7, "new") and rows[99] == (None, "new") and rows[4] == (1, "old")
    with pytest.raises(ValueError):
        tb.merge_partitions(spark, path, new, ["id"], ["p"])
