import random

import pytest
from pyspark.sql import functions as F

from test_scanner import F1
from tracelake.functions import lex
from tracelake.functions.ordered import framed, running_sum, sliding, upper_median, with_ordinal
from tracelake.operators import judge, parse, planning, profile, prompts, validate
from tracelake.streaming import rolling


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


def check(spark, text):
    return one(spark, text, validate.validation("t"))


def test_canonical_trace_is_valid(spark):
    v = check(spark, F1)
    assert v.valid and not v.errors and not v.warnings
    assert v.todos_defined == v.todos_satisfied[:1] + v.todos_defined[1:] == [1, 2] and v.tags_defined == ["sys1", "usr1", "weather_result"]
    assert v.tags_referenced == ["usr1", "weather_result"]


def test_block_level_result_tag_is_one_warning(spark):
    v = check(spark, F1.replace('"68" 🏷 weather_result\n}', '"68"\n} 🏷 weather_result'))
    assert v.valid and [tuple(w) for w in v.warnings] == [("result_block_tag", "")]


def test_confidence(spark):
    v = check(spark, F1 + " 𝑝 1.5")
    assert v.valid and [tuple(w) for w in v.warnings] == [("confidence_range", "1.5")]
    v = check(spark, F1 + " 𝑝 1.2.3 𝑝 .")
    assert not v.valid and v.errors == ["Invalid confidence value: 1.2.3", "Invalid confidence value: ."]


def test_order_and_balance(spark):
    v = check(spark, "response「r」 plan { 1 ↦ \"x\" } user「u」 system「s」 { [ 「")
    assert v.errors == ["User message appears before system message", "Plan appears before user message", "Response appears before plan", "Unbalanced braces: 2 open, 1 close", "Unbalanced brackets: 1 open, 0 close", "Unbalanced special quotes: 4 open, 3 close"]
    assert check(spark, None).errors == ["Missing system message", "Missing user message", "Missing plan block", "Missing response"]


def test_two_plans_and_listed_satisfies(spark):
    t = 'plan { 1 ↦ "a" } plan { todo ↦ { 2 ↦ "b" • 3 ↦ 「c」 } } ⊨ [2 • 3] ⊨ 1'
    assert one(spark, t, lex.todos_defined("t")) == [1, 2] and one(spark, t, lex.todos_satisfied("t")) == [1]
    assert one(spark, t, lex.first_plan_todos("t")) == [2, 3] and one(spark, t, lex.all_satisfied("t")) == [1, 2, 3]


@pytest.mark.parametrize("text,want", [("user「 a b 」x", "a b"), ("user「」user「c」", "c"), ("<|im_start|>user\n hi <|im_end|>", "hi"), ("x" * 600, "x" * 500), ("user「" + "y" * 600 + "」", "y" * 500)])
def test_user_request(spark, text, want):
    assert one(spark, text, lex.user_request("t")) == want


def test_lenient_json(spark):
    get = lambda t: one(spark, t, F.try_variant_get(lex.lenient_object("t"), "$.coherence", "int"))
    assert get('{"coherence": 7}') == 7 and get('so:\n```json\n{"coherence": 3}\n```') == 3 and get('x {"coherence": 9, "y": 1} z') == 9 and get("none") is None
    assert one(spark, 'a [1, {"b": 2}] c', lex.lenient_array("t")) == ["1", '{"b":2}'] and one(spark, '{"a": 1}', lex.lenient_array("t")) == []


def rewards(spark, text, strict=True):
    return one(spark, text, parse.reward(parse.parse("t", strict)))


def test_rewards_by_hand(spark):
    r = rewards(spark, 'plan {rationale ↦ "r"} response「ok」')
    assert round(r.total, 9) == 2.6 and r.output_length is None
    full = 'tool {name ↦ get} plan {rationale ↦ "r"} act { call ↦ { tool ↦ get • id ↦ r1 } } result { data ↦ "x" 🏷r1 } response「ok」'
    r = rewards(spark, full)
    assert (r.tools_valid, r.call_result_match, round(r.total, 9)) == (0.5, 0.4, 3.5)
    assert round(rewards(spark, F1).total, 9) == -4.1
    spec = rewards(spark, F1, strict=False)
    assert spec.todos_satisfied == 0.5 and spec.refs_valid == 0.3 and round(spec.total, 9) == 4.3
    assert rewards(spark, "").clean_ending is None
    late = rewards(spark, "response「a」 " + "user「b」 " * 3)
    assert late.clean_ending == -0.5 and late.has_plan == -0.5


def test_prompts(spark):
    rows = [(0, "do", None), (1, "<|im_start|>x", None), (2, None, "a<|im_start|>assistant b <|im_start|>assistant c"), (3, None, "none"), (4, None, "a<|im_start|>assistant" + "b" * 50), (5, None, None)]
    d = prompts.derive(spark.createDataFrame(rows, "i long, prompt string, trace string"), most=40)
    got = {r.i: (r.status, r.out) for r in d.collect()}
    assert got[0] == ("prompt", "<|im_start|>system\ndo\n<|im_end|>\n<|im_start|>assistant\n") and got[1] == ("prompt", "<|im_start|>x")
    assert got[2] == ("split", "a<|im_start|>assistant\n") and got[3][0] == got[5][0] == "skipped_malformed" and got[4] == ("skipped_long", None)
    assert tuple(prompts.counters(prompts.capped(d, "i", 3)).first()) == (3, 3, 0, 0)
    assert tuple(prompts.counters(prompts.capped(d, "i", None)).first()) == (6, 3, 1, 2)


def test_profile_edges(spark):
    rows = spark.createDataFrame([(i, t, 4 * t) for i, t in enumerate([1, 2, 3, 4])], "index long, tokens long, chars long")
    r = profile.totals(rows).first()
    assert (r.median_tokens, r.avg_tokens, r.total_tokens) == (3, 2, 10)
    empty = rows.where("false")
    assert profile.totals(empty).first().n == 0 and [x.n for x in profile.histogram(empty).collect()] == [0] * 7
    ids = profile.tokenized(spark.createDataFrame([("a" * 5,), ("b" * 9,), (None,)], "t string"), "t", lambda ts: [list(map(ord, t)) for t in ts], most=6, least=5).collect()
    assert [r.input_ids for r in ids] == [[98] * 6] and ids[0].labels == ids[0].input_ids and ids[0].attention_mask == [1] * 6


def test_ordered_helpers_equal_plain_python(spark):
    rng = random.Random(3)
    keys = rng.sample(range(100000), 400)
    vals = {k: rng.randint(-5, 9) for k in keys}
    df = spark.createDataFrame(list(vals.items()), "k long, v long").repartition(4)
    up, total = {}, 0
    for k in sorted(keys):
        total += vals[k]
        up[k] = total
    assert {r.k: r.s for r in running_sum(df, "k", F.col("v"), "s", rows=64).collect()} == up
    place = {k: i for i, k in enumerate(sorted(keys))}
    numbered = with_ordinal(df, "k", rows=100)
    assert {r.k: r.ordinal for r in numbered.collect()} == place
    got = framed(numbered, "ordinal", 7, {"m": lambda w: F.max("v").over(w)}, block=16).collect()
    own = [vals[k] for k in sorted(keys)]
    assert len(got) == 400 and all(r.m == max(own[max(0, r.ordinal - 6) : r.ordinal + 1]) for r in got)
    slid = sliding(numbered.withColumnRenamed("k", "lo"), "ordinal", "v", 7, "a", "b", "c").collect()
    assert len(slid) == 400
    for r in slid:
        frame = own[max(0, r.ordinal - 6) : r.ordinal + 1]
        assert (r.a, r.b, round(r.c, 9)) == (min(frame), max(frame), round(sum(frame) / len(frame), 9)) and vals[r.lo] == r.v
    sparse = spark.createDataFrame([(i * 10**15 - 5 * 10**17, 1, "x") for i in range(1000)], "k long, bucket long, value string")
    assert sorted((r.k, r.s, r.bucket, r.value) for r in running_sum(sparse, "k", F.col("bucket"), "s", rows=50).collect()) == [(i * 10**15 - 5 * 10**17, i + 1, 1, "x") for i in range(1000)]
    assert running_sum(df.where("false"), "k", F.col("v"), "s").count() == 0
    assert upper_median(df, "v").first().median == sorted(vals.values())[200]


def test_sparkline(spark):
    log = spark.createDataFrame([(i, float(i % 9) - 4) for i in range(20)], "seq long, score double")
    lo, hi = -4.5, 4.5
    want = "─" * 40 + "".join(rolling.BARS[max(0, min(8, int((i % 9 - 4 - lo) / (hi - lo) * 8)))] for i in range(20))
    assert rolling.sparkline(log).first().line == want


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", i, float((i * 7) % 5 - 2)) for i in range(40)]
    schema = "log string, seq long, score double"
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = rolling.stream_stats(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), size=6)
    q = stream.writeStream.format("memory").queryName("rolled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.seq: (r.valid_rate, r.min_score, r.max_score, r.n_total) for r in spark.table("rolled").collect()}
    # files may arrive in any order; within the log each row counts once
    assert len(got) == 40 and sorted(v[3] for v in got.values()) == list(range(1, 41))
    assert all(0 <= v[0] <= 1 and v[1] <= v[2] for v in got.values())


def test_judge_asks_only_for_what_is_not_cached(spark):
    df = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "b")], "prompt string, completion string")
    cache = df.limit(1).select(judge.cache_key(F.col("prompt"), F.col("completion")).alias("cache_key"), F.lit(0.25).alias("judge_score"))
    got = judge.judged(df, cache, lambda t: '{"coherence": 10, "quality": 0}').collect()
    assert sorted((r.completion, r.cached, round(r.judge_score, 6)) for r in got) == [("a", True, 0.25), ("b", False, 0.5), ("b", False, 0.5)]
    assert tuple(judge.stats(spark.createDataFrame([], "cached boolean")).first()) == (0, 0, 0.0)


def test_planning(spark):
    assert planning.quotas(10) == [(True, False, 6), (True, True, 2), (False, False, 2)] and planning.quotas(0) == []
    p = planning.plan(spark, 500)
    assert p.where("include_error and not has_tools").count() == 0 and p.where("num_steps < 5 or num_steps > 50").count() == 0
    assert p.exceptAll(planning.plan(spark, 500)).count() == 0
    got = planning.match(spark.createDataFrame([("trace-1", None, F1), ("trace-9", "x", None), ("odd", None, "")], "custom_id string, error string, content string"), p.where("idx < 5")).collect()
    assert {(r.custom_id, r.status, r.has_plan) for r in got} == {("trace-1", "valid", True), ("trace-9", "failed", False), ("odd", "invalid", False)}
    body = planning.requests(p, "m", F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content")))).first()
    assert body.custom_id == "trace-0" and body.body.messages[0].content == "hi"


def test_trace_messages(spark):
    row = spark.sql("""select named_struct('domain','d','system_prompt','s','tools',array(named_struct('name','t','description','x','params',array(named_struct('name','p')))),'user_request','u','follow_up_requests',array('more')) as sc""")
    m = row.select(planning.trace_messages(F.col("sc"), F.lit(True), F.lit(7), "sys", "ex").alias("m")).first().m
    assert [x.role for x in m] == ["system", "user", "assistant", "user"] and "- t(p): x" in m[3].content and 'usr2: "more"' in m[3].content and "fail" in m[3].content
