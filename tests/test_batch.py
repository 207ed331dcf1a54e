import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tracelake.operators import planning
from tracelake.sources import batch, files

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def requests(spark, n):
    said = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("é「"), F.col("custom_id")).alias("content")))
    return planning.requests(spark.range(n).select(F.concat(F.lit("trace-"), "id").alias("custom_id")), "m", said)


def test_requests_are_written_with_their_job_file(spark, tmp_path):
    at = str(tmp_path / "job")
    info = batch.submit(requests(spark, 100).repartition(5), at, F.expr("cast(substr(custom_id, 7) as int)"), model="m", inline=True)
    assert info == batch.job_info(at) and info["status"] == "prepared" and info["count"] == 100 and info["inline"] is True
    lines = [json.loads(x) for f in info["files"] for x in open(f"{at}/requests/{f}", encoding="utf-8")]
    assert [x["custom_id"] for x in lines] == [f"trace-{k}" for k in range(100)]
    assert lines[3] == {"custom_id": "trace-3", "method": "POST", "url": "/v1/chat/completions", "body": {"model": "m", "messages": [{"role": "user", "content": "é「trace-3"}]}}
    assert sorted(os.listdir(at)) == ["batch_info.json", "requests"]
    again = batch.submit(requests(spark, 3), at)
    assert again["count"] == 3 and sorted(os.listdir(f"{at}/requests")) == sorted(again["files"])
    assert batch.submit(requests(spark, 0), str(tmp_path / "none"))["count"] == 0


def test_a_failed_task_leaves_nothing_behind(spark, tmp_path):
    at = str(tmp_path / "job")
    bad = requests(spark, 50).repartition(4).withColumn("x", F.when(F.col("custom_id") == "trace-17", F.raise_error(F.lit("broken"))).otherwise(1))
    with pytest.raises(Exception, match="broken"):
        batch.submit(bad, at)
    assert batch.job_info(at) == {} and (not os.path.exists(at) or os.listdir(at) == [])


def done(at, name, rows):
    os.makedirs(f"{at}/results", exist_ok=True)
    with open(f"{at}/results/{name}", "w", encoding="utf-8") as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def ok(k, text):
    return {"custom_id": f"trace-{k}", "error": None, "response": {"body": {"choices": [{"message": {"content": text}}]}}}


def test_status_gate_files_and_filter(spark, tmp_path):
    at = str(tmp_path / "job")
    batch.submit(requests(spark, 4), at)
    done(at, "b.jsonl", [ok(0, "é"), "", {"custom_id": "trace-1", "error": {"code": 429}}, "{broken", {"custom_id": "trace-2", "response": {"body": {"choices": []}}}])
    done(at, "a.jsonl", [ok(3, None), "[1]"])
    done(at, "note.txt", ["x"])
    for status in ("prepared", "in_progress", "failed"):
        batch.update_job(at, status=status)
        assert batch.results(spark, at).count() == 0
    os.chmod(f"{at}/results/a.jsonl", 0)
    reader = batch._Results(at)
    assert reader.partitions() == [], "an unfinished job opens no result file"
    os.chmod(f"{at}/results/a.jsonl", 0o644)
    batch.update_job(at, status="completed")
    assert [p.path.rpartition("/")[2] for p in reader.partitions()] == ["a.jsonl", "b.jsonl"]
    got = {(r.custom_id, r.status, r.content) for r in batch.results(spark, at).collect()}
    assert got == {("trace-0", "ok", "é"), ("trace-1", "failed", None), ("trace-3", "ok", None), ("trace-2", "malformed", None), (None, "malformed", None)}
    assert batch.results(spark, at).count() == 6
    one = batch.results(spark, at).where("status = 'failed'")
    assert [(r.custom_id, json.loads(r.error)) for r in one.collect()] == [("trace-1", {"code": 429})]
    assert " Filter " not in one._jdf.queryExecution().executedPlan().toString()
    assert batch.results(spark, at).where("status = 'ok' and custom_id = 'trace-0'").count() == 1
    assert batch.results(spark, at).where("status = 'ok' and status = 'failed'").count() == 0
    assert batch.results(spark, str(tmp_path / "no such job")).count() == 0


def test_long_lines_cross_blocks(tmp_path):
    import io

    data = ("x" * 10 + "\n" + "é" * 7 + "\n\n" + "z").encode()
    assert list(batch._lines(io.BytesIO(data), 3)) == ["x" * 10, "é" * 7, "z"]


def test_array_file_written_by_tasks(spark, tmp_path):
    df = spark.createDataFrame([(k, f"é「{k}」", None) for k in range(500)], "id long, t string, none int").repartition(6)
    at = str(tmp_path / "x" / "all.json")
    files.write_array(df, at)
    got = json.load(open(at, encoding="utf-8"))
    assert sorted(got, key=lambda r: r["id"]) == [{"id": k, "t": f"é「{k}」", "none": None} for k in range(500)]
    assert files.scenarios(spark, at, "id long, t string").count() == 500
    files.write_array(df.where("id = 7"), at)
    assert json.load(open(at, encoding="utf-8")) == [{"id": 7, "t": "é「7」", "none": None}]
    files.write_array(df.limit(0), at)
    assert json.load(open(at, encoding="utf-8")) == []
    assert os.listdir(tmp_path / "x") == ["all.json"]


def test_capped_lines_are_the_first_ones(spark, tmp_path):
    df = spark.createDataFrame([(k, str(k)) for k in range(300)], "id long, t string").repartition(7)
    files.write_lines(df, str(tmp_path / "l"), limit=25, order="id")
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "l")).collect()) == list(range(25))
    with pytest.raises(ValueError):
        files.write_lines(df, str(tmp_path / "m"), limit=25)
