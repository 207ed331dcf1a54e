"""Model calls: pauses, windows, errors in rows, retry rounds, waves, and the verdict store."""

import os
import re
import sys
import threading
import time
import tracemalloc
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tracelake.operators import calls, judge

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors cannot import a test


def counted(folder, answer):
    """answer, leaving one file per call, so that calls in other processes can be counted."""
    at = str(folder)

    def ask(text):
        with open(f"{at}/{uuid.uuid4().hex}", "w") as f:
            f.write(text)
        return answer(text)

    return ask


def asked_for(folder):
    out = {}
    for f in folder.iterdir():
        t = f.read_text()
        out[t] = out.get(t, 0) + 1
    return out


def test_pauses_double_up_to_eight_seconds():
    slept = []

    def never(text):
        raise TimeoutError("late")

    assert calls.call(never, "x", retries=6, sleep=slept.append) == (None, "TimeoutError: late", 7)
    assert slept == [1, 2, 4, 8, 8, 8]
    turns = iter([ValueError("a"), ValueError("b"), "yes"])

    def third(text):
        x = next(turns)
        if isinstance(x, Exception):
            raise x
        return x

    slept.clear()
    assert calls.call(third, "x", sleep=slept.append) == ("yes", None, 3) and slept == [1, 2]
    assert calls.call(never, "x", retries=0, sleep=slept.append)[2] == 1 and slept == [1, 2]


def test_window_is_bounded_and_keeps_the_order():
    lock, now, most = threading.Lock(), [0], [0]

    def do(x):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.03 if x % 5 == 0 else 0.002)
        with lock:
            now[0] -= 1
        return x

    with calls.ThreadPoolExecutor(4) as pool:
        assert list(calls._in_order(pool, 4, iter(range(40)), do)) == list(range(40))
    assert 2 <= most[0] <= 4


def odd_fails(text):
    if text.endswith("1"):
        raise ConnectionError("down")
    return text.upper()


def pause(seconds):
    pass


def test_every_key_is_asked_once_and_failures_stay_in_their_rows(spark, tmp_path):
    rows = [(k, f"text {k}") for k in range(30)] * 3 + [(None, "text n"), (99, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    got = calls.asked(df, "id", "text", counted(tmp_path, odd_fails), window=3, retries=2, sleep=pause)
    for _ in range(2):  # evaluated again, nobody is asked again
        out = {r.id: (r.reply, r.error, r.calls) for r in got.collect()}
    assert out == {k: (None, "ConnectionError: down", 3) if k % 10 == 1 else (f"TEXT {k}", None, 1) for k in range(30)} | {99: (None, None, 0)}
    assert asked_for(tmp_path) == {f"text {k}": 3 if k % 10 == 1 else 1 for k in range(30)}
    assert calls.asked(df.limit(0), "id", "text", odd_fails).count() == 0


def test_retry_rounds_ask_only_for_what_is_still_invalid(spark, tmp_path):
    df = spark.createDataFrame([(k, f"k{k}") for k in range(12)] + [(3, "k3")], "id long, key string")
    request = lambda n: F.concat(F.lit(f"{n}:"), "key")

    def answer(text):
        n, k = text.split(":k")
        if int(k) == 11:
            raise OSError("gone")
        return "good" if int(n) >= int(k) % 5 else "bad"

    got = calls.until_valid(df, "id", request, counted(tmp_path, answer), lambda c: F.col(c) == "good", rounds=3, retries=0, sleep=pause)
    out = {r.id: (r.reply, r.attempt, r.error) for r in got.collect()}
    want = {k: ("good", max(1, k % 5), None) if k % 5 < 4 else (None, 3, "invalid") for k in range(11)} | {11: (None, 3, "OSError: gone")}
    assert out == want
    assert asked_for(tmp_path) == {f"{n}:k{k}": 1 for k in range(12) for n in range(1, want[k][1] + 1)}


def test_rounds_end_when_nothing_is_left(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "id long")
    got = calls.until_valid(df, "id", lambda n: F.col("id").cast("string"), counted(tmp_path, lambda t: t), lambda c: F.col(c) != "", rounds=9)
    assert {(r.id, r.attempt) for r in got.collect()} == {(1, 1), (2, 1)} and len(asked_for(tmp_path)) == 2
    assert calls.until_valid(df.limit(0), "id", lambda n: F.lit("x"), odd_fails, lambda c: F.lit(True)).count() == 0


def test_waves_stop_at_enough_and_cut_by_order(spark, tmp_path):
    df = spark.createDataFrame([(k * 10, str(k)) for k in range(200)], "id long, text string").repartition(7)
    valid = lambda c: F.col(c).cast("int") % 4 == 0
    got, waves = calls.first_valid_of(df, "id", "text", counted(tmp_path, lambda t: t), valid, 20, retries=0)
    assert sorted((r.id, r.reply) for r in got.collect()) == [(k * 10, str(k)) for k in range(0, 80, 4)]
    assert len(asked_for(tmp_path)) == sum(w[1] for w in waves) and sum(w[2] for w in waves) >= 20
    assert sum(w[2] for w in waves[:-1]) < 20, "the last wave was needed"
    assert waves[0][1] == 20 and waves[1][1] == 60
    few, waves = calls.first_valid_of(df, "id", "text", lambda t: t, valid, 500, most=90, retries=0)
    assert few.count() == 50 and sum(w[1] for w in waves) == 200 and max(w[1] for w in waves[1:]) <= 90
    none, waves = calls.first_valid_of(df.limit(0), "id", "text", lambda t: t, valid, 5)
    assert none.count() == 0 and waves == []


def test_judge_keeps_columns_errors_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([("p", "a", 1, 2), ("p", None, 3, 4), (None, None, 5, 6), ("p", "bad", 7, 8)], "prompt string, completion string, known int, fresh int")
    none = spark.createDataFrame([("x", float("nan"))], "cache_key string, judge_score double")

    def ask(text):
        if text.endswith("bad"):
            raise ValueError("no")
        return '{"coherence": 10}'

    out = {r.known: r for r in judge.judged(df, none, counted(tmp_path, ask), retries=1, sleep=pause).collect()}
    assert {k: (r.fresh, r.judge_error, r.cached) for k, r in out.items()} == {1: (2, None, False), 3: (4, None, False), 5: (6, None, False), 7: (8, "ValueError: no", False)}
    assert out[7].judge_score is None and round(out[1].judge_score, 9) == 0.575
    assert sum(asked_for(tmp_path).values()) == 5


def test_verdict_store(spark, tmp_path):
    path = str(tmp_path / "v")
    df = spark.createDataFrame([("p", str(k)) for k in range(60)], "prompt string, completion string")
    assert judge.verdicts(spark, path).count() == 0
    judge.remember(judge.judged(df, judge.verdicts(spark, path), lambda t: "{}"), path)
    judge.remember(judge.judged(df, judge.verdicts(spark, path), lambda t: 1 / 0, retries=0), path)
    assert judge.verdicts(spark, path).count() == 60
    again = judge.judged(df, judge.verdicts(spark, path, df.select(judge.cache_key(F.col("prompt"), F.col("completion")).alias("cache_key"))), lambda t: 1 / 0, retries=0)
    assert {(r.cached, round(r.judge_score, 9)) for r in again.collect()} == {(True, 0.5)}
    # a look-up reads the folders of its keys only
    key = spark.range(1).select(judge.cache_key(F.lit("p"), F.lit("7")).alias("cache_key"))
    some = judge.verdicts(spark, path, key)
    prefix = key.first().cache_key[:2]
    plan = some._jdf.queryExecution().toString()
    assert re.search(rf"PartitionFilters: \[[^]]*\(bucket#\d+ = {prefix}\)", plan)
    assert some.where(F.col("cache_key") == key.first().cache_key).count() == 1
    # repeated and null verdicts go, one file a folder is left
    again = spark.createDataFrame([(r.cache_key, 0.9) for r in judge.verdicts(spark, path).limit(9).collect()] + [("ab" * 8, None)], "cache_key string, judge_score double")
    judge.remember(again.withColumn("cached", F.lit(False)), path)
    assert judge.verdicts(spark, path).count() == 69
    judge.compact(spark, path)
    found = judge.verdicts(spark, path)
    assert found.count() == 60 and {round(r.judge_score, 9) for r in found.collect()} == {0.5}
    folders = [d for d in os.listdir(path) if d.startswith("bucket=")]
    assert all(sum(f.endswith(".parquet") for f in os.listdir(f"{path}/{d}")) == 1 for d in folders)
    # a file that cannot be read is a miss
    one = f"{path}/{sorted(folders)[0]}"
    broken = next(f for f in os.listdir(one) if f.endswith(".parquet"))
    lost = spark.read.parquet(f"{one}/{broken}").count()
    with open(f"{one}/{broken}", "wb") as f:
        f.write(b"not parquet")
    for f in os.listdir(one):
        if f.endswith(".crc"):
            os.remove(f"{one}/{f}")
    spark.catalog.clearCache()
    left = judge.verdicts(spark, path)
    assert left.count() == 60 - lost
    asked = judge.judged(df, left, counted(tmp_path / "v2", lambda t: "{}") if (tmp_path / "v2").mkdir() is None else None)
    assert asked.where("cached").count() == 60 - lost and sum(asked_for(tmp_path / "v2").values()) == lost


def test_texts_of_a_batch_become_strings_piece_by_piece():
    keys, texts = pa.array(range(2000)), pa.array([None if i % 5 == 4 else f"{i}" + "é" * 4000 for i in range(2000)])
    tracemalloc.start()
    seen = [(k.as_py(), t and (t[:4].rstrip("é"), len(t))) for k, t in calls._pairs(keys, texts)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == [(i, None if i % 5 == 4 else (str(i), 4000 + len(str(i)))) for i in range(2000)]
    assert peak < 3 << 20  # 13 MB as strings
