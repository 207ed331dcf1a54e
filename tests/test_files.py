import json
from pathlib import Path

from pyspark.sql import functions as F

from tracelake.sources import files as S


def test_lines_and_objects(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text('{"trace": "a", "x": 1}\nbroken\n\n"text"\n[1]\n{"y": 2}\n{"trace": "b"}\n')
    assert [(r["index"], r.line) for r in S.lines(spark, str(p)).orderBy("index").collect()] == list(enumerate(p.read_text().split("\n")[:-1]))
    assert [r["index"] for r in S.objects(spark, str(p)).orderBy("index").collect()] == [0, 5, 6]
    assert [(r["index"], r.text) for r in S.traces(spark, str(p)).orderBy("index").collect()] == [(0, "a"), (6, "b")]
    assert S.first_lines(spark, str(p), 3).count() == 3 and S.line_count(spark, str(p)) == 7 and S.line_count(spark, str(tmp_path / "no")) == 0
    assert S.whole(spark, str(p)).first().trace == p.read_text()


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(2, "zwei", None), (1, "eins", 1)], "trace_id long, trace string, v int")
    S.write_lines(df, str(tmp_path / "o"))
    S.write_lines(df, str(tmp_path / "o"), mode="append", limit=1, order="trace_id")
    got = [json.loads(x.line) for x in S.lines(spark, str(tmp_path / "o")).collect()]
    assert len(got) == 3 and {"trace_id": 2, "trace": "zwei", "v": None} in got
    S.write_numbered(df, str(tmp_path / "n"))
    assert (tmp_path / "n/trace_0000.task").read_text() == "eins" and (tmp_path / "n/trace_0001.task").read_text() == "zwei"
    (tmp_path / "n/trace_x.task").write_text("")
    (tmp_path / "n/trace_12345.task").write_text("")
    assert S.next_number(spark, str(tmp_path / "n")) == 12346 and S.next_number(spark, str(tmp_path / "none")) == 0
    S.write_array(df, str(tmp_path / "a"))
    assert sorted(r.trace_id for r in S.scenarios(spark, str(tmp_path / "a"), "trace_id long, trace string").collect()) == [1, 2]


def test_batch_results(spark, tmp_path):
    ok = {"custom_id": "trace-1", "error": None, "response": {"body": {"choices": [{"message": {"content": " t "}}]}}}
    (tmp_path / "r.jsonl").write_text(json.dumps(ok) + "\n" + json.dumps({"custom_id": "trace-2", "error": {"code": 1}, "response": None}) + "\n")
    got = {r.custom_id: (r.error, r.content) for r in S.batch_results(spark, str(tmp_path / "r.jsonl")).collect()}
    assert got["trace-1"] == (None, " t ") and got["trace-2"][0] and got["trace-2"][1] is None


def test_rows_of_one_checkpoint_are_written_by_many_tasks(spark, tmp_path):
    """Most orders belong to one folder; they stay where they are read."""
    from tracelake.plans import file_catalogue
    from tracelake.session import shared_dir

    spark.range(4000).select(F.col("id").alias("o_orderkey")).repartition(4).write.parquet(str(tmp_path / "orders.parquet"))
    top = Path(shared_dir(spark).removeprefix("file:")) / "tracelake" / spark.sparkContext.applicationId
    old = set(top.glob("run-*"))
    got = file_catalogue.latest_checkpoint(spark, str(tmp_path)).first()
    assert tuple(got) == ("checkpoint-9990", None, 4)
    (run,) = [d for d in set(top.glob("run-*")) - old if not d.name.endswith("-by")]
    assert len(list((run / "other-99999").glob("*.parquet"))) == 4


def test_array_with_an_element_a_line_is_read_by_many_tasks(spark, tmp_path):
    rows = [(i, f'a\n"{{[,]}}" \\ {i} 」') for i in range(2000)] + [(None, None)]
    S.write_array(spark.createDataFrame(rows, "trace_id long, trace string"), str(tmp_path / "a"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = S.scenarios(spark, str(tmp_path / "a"), "trace_id long, trace string")
        assert got.rdd.getNumPartitions() > 2 and sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_arrays_of_any_layout(spark, tmp_path):
    items = [{"a": 1, "b": [{}, {"c": "x,\n]"}]}, {"a": 2, "b": []}]
    nested = '[{"a":1,"b":[{}\n,{"c":"x,\\n]"}]}\n,{"a":2,"b":[]}\n]\n'  # its lines look like elements
    for n, text in enumerate((json.dumps(items), json.dumps(items, indent=1), nested, f"[{json.dumps(items[0])}\n\n,{json.dumps(items[1])}\n]", "[]", "[]\n")):
        p = tmp_path / f"{n}.json"
        p.write_text(text)
        got = S.scenarios(spark, str(p), "a int, b array<struct<c:string>>").collect()
        assert [(r.a, [x.c for x in r.b]) for r in got] == [(x["a"], [y.get("c") for y in x["b"]]) for x in json.loads(text)], text
