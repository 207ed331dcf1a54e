"""Queries that write traces to the shared folder through the sinks and read them back through the sources, and further
text functions, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracelake.functions import lex
from tracelake.operators import calls, display, judge, parse, planning, profile, rewrite, validate
from tracelake.plans.catalogue import _FACTS, _RENDER, NEXT, WITH, _table, query, render_trace, rendered
from tracelake.plans.traces import PARTS, parts, traces
from tracelake.session import shared_dir
from tracelake.sources import batch, files


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tracelake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _lines(spark, sf_dir) -> str:
    """A folder of JSON lines in the order of trace_id: every seventh line is broken, every seventh an array."""
    k = F.col("trace_id") % 7
    whole = F.to_json(F.struct("trace_id", F.when(k != 5, F.col("trace")).alias("trace")))
    rows = traces(spark, sf_dir).orderBy("trace_id").select(F.when(k == 0, '{"broken').when(k == 3, "[1, 2]").otherwise(whole).alias("value"))
    rows.write.text(at := _folder(spark, "lines"))
    return at


_NUMBERED = f"{NEXT} n AS (SELECT row_number() OVER (ORDER BY trace_id) - 1 AS index, trace_id, trace FROM traces)"


@query(f"{_NUMBERED} SELECT index, trace_id FROM n WHERE trace_id % 7 NOT IN (0, 3)")
def jsonl_objects(spark, sf_dir):
    got = files.objects(spark, _lines(spark, sf_dir))
    return got.select("index", F.try_variant_get("item", "$.trace_id", "long").alias("trace_id"))


@query(f"{_NUMBERED} SELECT index, md5(trace) AS text_md5 FROM n WHERE trace_id % 7 NOT IN (0, 3, 5)")
def jsonl_traces(spark, sf_dir):
    return files.traces(spark, _lines(spark, sf_dir)).select("index", F.md5("text").alias("text_md5"))


@query(f"{_NUMBERED} SELECT index, CASE trace_id % 7 WHEN 0 THEN '{{\"broken' WHEN 3 THEN '[1, 2]' ELSE '{{\"trace_id\":' || trace_id END AS head FROM n WHERE index < 25")
def jsonl_first_lines(spark, sf_dir):
    return files.first_lines(spark, _lines(spark, sf_dir), 25).select("index", F.regexp_extract("line", r'^(\{"broken|\[1, 2\]|\{"trace_id":[0-9]+)', 1).alias("head"))


@query(f"{WITH} SELECT count(*) AS n_lines, 2 * count(*) AS n_appended, least(10, count(*)) AS n_capped, 0 AS n_missing, (SELECT md5(string_agg(md5(trace), ',' ORDER BY trace_id)) FROM (SELECT * FROM traces ORDER BY trace_id LIMIT 10)) AS capped_md5 FROM traces")
def jsonl_counts(spark, sf_dir):
    """Lines after a first write, after the same rows are appended, of a capped write, and of a file that is not there."""
    rows, at, capped = traces(spark, sf_dir), _folder(spark, "rows"), _folder(spark, "capped")
    files.write_lines(rows, at)
    first = files.line_count(spark, at)
    files.write_lines(rows, at, mode="append")
    files.write_lines(rows, capped, limit=10, order="trace_id")
    first_ten = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("trace_id", F.md5("trace").alias("m")))), lambda x: x["m"]), ","))
    counts = (first, files.line_count(spark, at), files.line_count(spark, capped), files.line_count(spark, _folder(spark, "none")))
    one = spark.read.json(capped).agg(first_ten.alias("capped_md5"))
    return one.select(*[F.lit(n).cast("long").alias(c) for n, c in zip(counts, ("n_lines", "n_appended", "n_capped", "n_missing"))], "capped_md5")


@query(f"{WITH} SELECT trace_id, md5(trace) AS trace_md5 FROM traces")
def json_array(spark, sf_dir):
    at = _folder(spark, "array") + ".json"
    files.write_array(traces(spark, sf_dir), at)
    return files.scenarios(spark, at, "trace_id long, trace string").select("trace_id", F.md5("trace").alias("trace_md5"))


@query(f"{_NUMBERED} SELECT index + 1 AS number, md5(trace) AS trace_md5, (SELECT count(*) + 1 FROM n) AS next_number FROM n")
def numbered_files(spark, sf_dir):
    at = _folder(spark, "numbered")
    files.write_numbered(traces(spark, sf_dir), at, start=1)
    number = F.regexp_extract("file", r"trace_(\d+)\.task", 1).cast("long")
    return files.whole(spark, at).select(number.alias("number"), F.md5("trace").alias("trace_md5"), F.lit(files.next_number(spark, at)).cast("long").alias("next_number"))


@query("""SELECT 'checkpoint-' || max(o_orderkey % 1000 * 10) AS latest, CAST(NULL AS VARCHAR) AS latest_of_none, CAST(count(*) FILTER (o_orderkey % 1000 = (SELECT max(o_orderkey % 1000) FROM orders)) AS BIGINT) AS n_rows FROM orders""")
def latest_checkpoint(spark, sf_dir):
    """The orders saved as numbered checkpoints: the last one is found by its number, not by its name, and read back."""
    at = _folder(spark, "run")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 1000 * 10).alias("step"))
    steps = F.when(F.col("step") == rows.agg(F.max("step")).first()[0], F.concat(F.lit("checkpoint-"), "step")).when(F.col("step") % 1000 == 0, F.concat(F.lit("checkpoint-"), F.col("step") / F.lit(1000).cast("int"))).otherwise(F.lit("other-99999"))
    rows.select("o_orderkey", steps.alias("folder")).write.partitionBy("folder").parquet(at + "-by")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.Path(at))
    for f in fs.globStatus(hadoop.Path(at + "-by/folder=*")):
        fs.rename(f.getPath(), hadoop.Path(at, f.getPath().getName().partition("=")[2]))
    last = files.latest_checkpoint(spark, at)
    none = files.latest_checkpoint(spark, f"{at}/none")
    found = spark.read.schema("o_orderkey long").parquet(last).agg(F.count("*").alias("n_rows"))
    return found.select(F.lit(last.rpartition("/")[2]).alias("latest"), F.lit(none).cast("string").alias("latest_of_none"), "n_rows")


@query(f"""{WITH} SELECT 'trace-' || trace_id AS custom_id, CASE WHEN trace_id % 4 = 0 THEN '{{"code":429}}' END AS error, CASE WHEN trace_id % 4 <> 0 AND trace_id % 9 <> 0 THEN md5(trace) END AS content_md5 FROM traces""")
def batch_results(spark, sf_dir):
    k, at = F.col("trace_id"), _folder(spark, "batch")
    said = F.array(F.struct(F.struct(F.lit("assistant").alias("role"), F.col("trace").alias("content")).alias("message")))
    choices = F.filter(said, lambda x: k % 9 != 0)
    rows = traces(spark, sf_dir).select(F.concat(F.lit("trace-"), k.cast("string")).alias("custom_id"), F.when(k % 4 == 0, F.struct(F.lit(429).alias("code"))).alias("error"), F.when(k % 4 != 0, F.struct(F.struct(choices.alias("choices")).alias("body"))).alias("response"))
    files.write_lines(rows, at)
    return files.batch_results(spark, at).select("custom_id", "error", F.md5("content").alias("content_md5"))


_PLAIN_REQUEST = "CASE WHEN regexp_matches(trace, 'user「[^」]+」') THEN substr(trim(regexp_extract(trace, '(?s)user「([^」]+)」', 1), ' ' || chr(10)), 1, 500) ELSE right(trace, 500) END"


@query(f"""{NEXT} j AS (SELECT trace_id, trace, 'Request:' || chr(10) || {_PLAIN_REQUEST} || chr(10) || chr(10) || 'Response:' || chr(10) || left(trace, 4000) AS t FROM traces)
SELECT trace_id, trace IN (SELECT trace FROM traces WHERE trace_id % 3 = 0) AS cached, round((length(t) % 11)::DOUBLE / 10 * {sum(judge.WEIGHTS.values())}::DOUBLE, 6) AS judge_score FROM j""")
def judge_cached(spark, sf_dir):
    """Every third trace is judged and remembered; a second round over all asks for the others only."""
    rows, at = traces(spark, sf_dir).select("trace_id", F.col("trace").alias("prompt"), F.col("trace").alias("completion")), _folder(spark, "verdicts")
    names = list(judge.WEIGHTS)

    def ask(text: str) -> str:
        own = "{" + ", ".join(f'"{n}": {len(text) % 11}' for n in names) + "}"
        return f"So: {own}" if len(text) % 2 else own

    def round_of(some):
        keys = some.select(judge.cache_key(F.col("prompt"), F.col("completion")).alias("cache_key"))
        return judge.judged(some, judge.verdicts(spark, at, keys), ask)

    judge.remember(round_of(rows.where("trace_id % 3 = 0")), at)
    judge.compact(spark, at)
    return round_of(rows).select("trace_id", "cached", F.round("judge_score", 6).alias("judge_score"))


@query(f"{NEXT} j AS (SELECT trace_id, {_PLAIN_REQUEST} AS r, trace FROM traces) SELECT trace_id, md5('Request:' || chr(10) || r || chr(10) || chr(10) || 'Response:' || chr(10) || left(trace, 4000)) AS text_md5 FROM j")
def judge_texts(spark, sf_dir):
    return traces(spark, sf_dir).select("trace_id", F.md5(judge.judge_text(F.col("trace"), F.col("trace"))).alias("text_md5"))


_K = "p_partkey % 4"


@query(f"SELECT p_partkey, CASE {_K} WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 5 END AS coherence, CASE {_K} WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS n_items, p_name AS head, left(p_name, 7) AS cut, p_name AS whole FROM part")
def lenient_replies(spark, sf_dir):
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, '{"coherence": 3, "x": [1]}').when(k == 1, 'Sure:\n```json\n{"coherence": 4}\n```').when(k == 2, 'so {"coherence": 5} it is').otherwise("none")
    listed = F.when(k == 0, '[1, "a"]').when(k == 1, 'here [1, 2, {"a": 3}] you are').when(k == 2, "[broken").otherwise("none")
    stopped = F.concat("p_name", F.lit("<|im_end|>"), "p_brand", F.lit("<|im_end|>"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.try_variant_get(lex.lenient_object(said), "$.coherence", "int").alias("coherence"), F.size(lex.lenient_array(listed)).alias("n_items"), lex.until_stop(stopped).alias("head"), lex.truncate("p_name", 7).alias("cut"), lex.truncate("p_name", None).alias("whole"))


@query("""SELECT p_partkey, 4 AS n_messages, md5('Domain: ' || p_brand || chr(10) || 'System: ' || p_type || chr(10) || 'Request: ' || p_name || chr(10) || 'Steps: ' || p_size || chr(10)
 || CASE WHEN p_size % 2 = 0 THEN 'Tools:' || chr(10) || '- find(a, b): finds' || CASE WHEN p_partkey % 5 = 0 THEN chr(10) || 'Let one tool call fail and recover from it.' ELSE '' END ELSE 'No tools; reasoning steps only.' END
 || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || 'Follow-up requests:' || chr(10) || '  - usr2: "more of ' || p_brand || '"' || chr(10) || '  - usr3: "less"' ELSE '' END) AS ask_md5 FROM part""")
def generation_messages(spark, sf_dir):
    named = lambda *n: F.array(*[F.struct(F.lit(x).alias("name")) for x in n])
    tools = F.array(F.struct(F.lit("find").alias("name"), named("a", "b").alias("params"), F.lit("finds").alias("description")))
    more = F.array(F.concat(F.lit("more of "), "p_brand"), F.lit("less"))
    scenario = F.struct(F.col("p_brand").alias("domain"), F.col("p_type").alias("system_prompt"), F.when(F.col("p_size") % 2 == 0, tools).otherwise(F.filter(tools, lambda t: F.lit(False))).alias("tools"), F.col("p_name").alias("user_request"), F.when(F.col("p_partkey") % 3 == 0, more).otherwise(F.filter(more, lambda t: F.lit(False))).alias("follow_up_requests"))
    chat = planning.trace_messages(scenario, F.col("p_partkey") % 5 == 0, F.col("p_size"), "You write traces.", "example")
    return _table(spark, sf_dir, "part").select("p_partkey", F.size(chat).alias("n_messages"), F.md5(parse.last_content(chat)).alias("ask_md5"))


@query(f"{WITH} SELECT count(*) AS n, CAST(sum(least(length(trace), 2000)) AS BIGINT) AS n_ids, CAST(sum(unicode(trace)) AS BIGINT) AS first_ids, count(*) AS n_same FROM traces WHERE length(trace) > 500")
def tokenized_rows(spark, sf_dir):
    """Code points stand in for token ids; the second call reads what the first one kept."""
    folder = _folder(spark, "tokens")
    codes = lambda texts: [[ord(c) for c in t] for t in texts]
    first = profile.tokenized(traces(spark, sf_dir), "trace", codes, 2000, 500)
    kept = profile.cached_tokenized(traces(spark, sf_dir).where(F.length("trace") > 500), "trace", codes, 2000, folder, "codes")
    again = profile.cached_tokenized(traces(spark, sf_dir).where(F.length("trace") > 500), "trace", lambda texts: [[] for _ in texts], 2000, folder, "codes")
    one = first.agg(F.count("*").alias("n"), F.sum(F.size("input_ids")).alias("n_ids"), F.sum(F.col("input_ids")[0]).alias("first_ids"))
    return one.crossJoin(kept.unionByName(again).agg((F.count("*") / 2).cast("long").alias("n_same")))


# Facts of traces that render_trace builds from parts: each follows from the part.


@query("""WITH p AS (SELECT p_partkey AS k, p_size % 3 = 0 AS t FROM part)
SELECT k AS trace_id, CASE WHEN t THEN 'system|tool|user|plan|act|result|response' ELSE 'system|user|plan|act|response' END AS blocks, '1|2' AS todos, '1|2' AS done, CASE WHEN t THEN 'find_part' ELSE '' END AS tools, CASE WHEN t THEN 'find_part' ELSE '' END AS called,
 CASE WHEN t THEN 'c1' ELSE '' END AS calls, CASE WHEN t THEN 'c1' ELSE '' END AS results, CASE k % 3 WHEN 0 THEN 'th1' WHEN 1 THEN 'th1|usr1' ELSE 'sys1|th1|usr1' END AS refs, true AS valid FROM p""")
def rendered_facts(spark, sf_dir):
    text = lambda c: F.array_join(F.col(f"f.{c}").cast("array<string>"), "|")
    todo = lambda c: F.array_join(F.col(f"f.{c}").cast("array<int>").cast("array<string>"), "|")
    got = render_trace(spark, sf_dir).select("trace_id", parse.parse("trace", strict=False).alias("f"))
    return got.select("trace_id", text("blocks").alias("blocks"), todo("defined_todos").alias("todos"), todo("satisfied_todos").alias("done"), text("defined_tools").alias("tools"), text("called_tools").alias("called"), text("call_ids").alias("calls"), text("result_ids").alias("results"), text("referenced_tags").alias("refs"), "f.valid")


_PARTS = "WITH p AS (SELECT p_partkey AS k, p_size % 3 = 0 AS t FROM part), r AS (SELECT k, t, CASE WHEN t THEN 4.3::DOUBLE ELSE 3.4::DOUBLE END AS total FROM p)"


@query(f"""{_PARTS} SELECT k AS trace_id, 1.0::DOUBLE AS parse_valid, 0.3::DOUBLE AS has_plan, 0.5::DOUBLE AS has_response, 0.2::DOUBLE AS structure_order, 0.3::DOUBLE AS todos_start_at_1, 0.5::DOUBLE AS todos_satisfied, 0.3::DOUBLE AS refs_valid,
 CASE WHEN t THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS tools_valid, CASE WHEN t THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS call_result_match, 0.3::DOUBLE AS clean_ending, total, 'pass' AS class FROM r""")
def rendered_rewards(spark, sf_dir):
    got = parse.with_rewards(render_trace(spark, sf_dir), strict=False)
    names = [c for c in parse.COMPONENTS if c not in ("warnings", "output_length")]
    return got.select("trace_id", *[F.round(f"reward.{c}", 6).alias(c) for c in names], F.round("reward.total", 6).alias("total"), "class")


@query(f"{_PARTS} SELECT count(*) AS n, round(avg(total), 6) AS mean, min(total) AS min, max(total) AS max, 0 AS n_parse_errors, count(*) AS n_pass FROM r")
def rendered_reward_summary(spark, sf_dir):
    return parse.summary(parse.with_rewards(render_trace(spark, sf_dir), strict=False))


@query("""WITH p AS (SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN ['system', 'tool', 'user', 'plan', 'act', 'result', 'response'] ELSE ['system', 'user', 'plan', 'act', 'response'] END AS b FROM part)
SELECT k AS trace_id, i AS pos, b[i + 1] AS type FROM p, unnest(range(0, len(b))) u(i)""")
def rendered_blocks(spark, sf_dir):
    return render_trace(spark, sf_dir).select("trace_id", F.posexplode(display.block_rows("trace")).alias("pos", "x")).select("trace_id", "pos", "x.type")


@query("""SELECT p_partkey AS trace_id, 1 AS acts_before, 1 AS acts_after, false AS lossy FROM part""")
def rendered_merge(spark, sf_dir):
    """A trace with one act between its other blocks has nothing to merge."""
    got = rewrite.process_traces(render_trace(spark, sf_dir), tags=False, style="none")
    return got.select("trace_id", "acts_before", "acts_after", "lossy")


# The same traces with faults: p_partkey % 12 decides, and every expected value follows from the fault.

_CUT = "substr(trace, 1, strpos(trace, 'response「') - 1)"
_FAULTY = {
    1: _CUT,
    2: "replace(trace, ' it is.」 ※ \"th1\" ⊨ 2', ' it is.')",
    3: "replace(trace, 'plan {', 'plan [')",
    4: "replace(trace, '※ \"th1\" ⊨ 2', '※ [\"th1\" • \"ghost\" • gone] ⊨ 2')",
    5: "replace(trace, '        1 ↦', '        3 ↦')",
    6: "trace || ' act { think ↦ 「x」 } act { think ↦ 「y」 } act { think ↦ 「z」 }'",
    7: "trace || ' ??? stray'",
    8: "replace(trace, 'tool ↦ find_part', 'tool ↦ lose_part')",
    9: "replace(trace, '} 🏷 \"c1\"', '} 🏷 \"c9\"')",
    10: "replace(trace, '} 🏷 \"c1\"', '}')",
    11: "replace(trace, 'name ↦ find_part', 'title ↦ find_part')",
}
_FAULT = "CASE trace_id % 12 " + " ".join(f"WHEN {k} THEN {x}" for k, x in _FAULTY.items()) + " ELSE trace END"
_BROKEN = f"""WITH parts AS ({PARTS}), whole AS ({_RENDER.replace('FROM part', 'FROM parts')}), broken AS (SELECT trace_id, trace_id % 12 AS f, size % 3 = 0 AS t, {_FAULT} AS trace FROM (SELECT whole.*, p_size AS size FROM whole JOIN parts ON trace_id = p_partkey))"""


def _faulty(spark, sf_dir):
    return rendered(parts(spark, sf_dir)).selectExpr("trace_id", f"{_FAULT.replace('strpos(trace, ', 'instr(trace, ')} AS trace")


@query(f"""{_BROKEN}, m AS (SELECT *, CASE WHEN t THEN 'tool|' ELSE '' END AS tool, CASE WHEN t THEN 'result|' ELSE '' END AS result FROM broken)
SELECT trace_id, CASE f WHEN 3 THEN rtrim('system|' || tool || 'user', '|') WHEN 1 THEN rtrim('system|' || tool || 'user|plan|act|' || result, '|') ELSE 'system|' || tool || 'user|plan|act|' || result || 'response' || CASE f WHEN 6 THEN '|act|act|act' ELSE '' END END AS blocks,
 CASE f WHEN 3 THEN '' WHEN 5 THEN '2|3' ELSE '1|2' END AS todos, CASE WHEN f = 3 THEN '' WHEN f IN (1, 2) THEN '1' ELSE '1|2' END AS done,
 CASE WHEN NOT t OR f = 11 THEN '' ELSE 'find_part' END AS tools, CASE WHEN NOT t OR f = 3 THEN '' WHEN f = 8 THEN 'lose_part' ELSE 'find_part' END AS called,
 CASE WHEN t AND f <> 3 THEN 'c1' ELSE '' END AS calls, CASE WHEN NOT t OR f IN (3, 10) THEN '' WHEN f = 9 THEN 'c9' ELSE 'c1' END AS results,
 CASE f WHEN 3 THEN 'Expected ''{{'' at position ' || (strpos(trace, 'plan [') + 4) ELSE '' END AS errors,
 CASE WHEN f = 7 THEN 'Skipped unparseable content from ' || (strpos(trace, '???') - 1) || ' to ' || length(trace) WHEN f = 10 AND t THEN 'Result data value should have a 🏷 tag' ELSE '' END AS warnings,
 f <> 3 AS valid, length(trace) AS length FROM m""")
def faulty_facts(spark, sf_dir):
    text = lambda c: F.array_join(F.col(f"f.{c}").cast("array<string>"), "|").alias(c)
    todo = lambda c: F.array_join(F.col(f"f.{c}").cast("array<int>").cast("array<string>"), "|")
    got = _faulty(spark, sf_dir).select("trace_id", parse.parse("trace", strict=False).alias("f"))
    return got.select("trace_id", text("blocks"), todo("defined_todos").alias("todos"), todo("satisfied_todos").alias("done"), text("defined_tools").alias("tools"), text("called_tools").alias("called"), text("call_ids").alias("calls"), text("result_ids").alias("results"), text("errors"), text("warnings"), "f.valid", "f.length")


_d = "::DOUBLE"
_PARTS_OF = {
    "parse_valid": f"CASE f WHEN 3 THEN -3.0{_d} ELSE 1.0{_d} END",
    "has_plan": f"CASE f WHEN 3 THEN -0.5{_d} ELSE 0.3{_d} END",
    "has_response": f"CASE WHEN f IN (1, 3) THEN -1.5{_d} ELSE 0.5{_d} END",
    "structure_order": f"CASE WHEN f IN (1, 3) THEN 0.0{_d} ELSE 0.2{_d} END",
    "todos_start_at_1": f"CASE f WHEN 3 THEN 0.0{_d} WHEN 5 THEN -0.5{_d} ELSE 0.3{_d} END",
    "todos_satisfied": f"CASE WHEN f = 3 THEN 0.0{_d} WHEN f IN (1, 2) THEN -0.05{_d} WHEN f = 5 THEN 0.2{_d} ELSE 0.5{_d} END",
    "refs_valid": f"CASE f WHEN 4 THEN -0.2{_d} ELSE 0.3{_d} END",
    "tools_valid": f"CASE WHEN NOT t OR f = 3 THEN 0.0{_d} WHEN f = 8 THEN -0.5{_d} WHEN f = 11 THEN -1.5{_d} ELSE 0.5{_d} END",
    "call_result_match": f"CASE WHEN NOT t OR f = 3 THEN 0.0{_d} WHEN f = 9 THEN -0.4{_d} WHEN f = 10 THEN -0.1{_d} ELSE 0.4{_d} END",
    "warnings": f"CASE WHEN f = 7 OR (f = 10 AND t) THEN -0.05{_d} ELSE 0.0{_d} END",
    "clean_ending": f"CASE WHEN f IN (1, 3) THEN NULL WHEN f = 6 THEN -0.5{_d} ELSE 0.3{_d} END",
}
_SCORED = f"{_BROKEN}, c AS (SELECT trace_id, {', '.join(f'{x} AS {c}' for c, x in _PARTS_OF.items())} FROM broken), s AS (SELECT *, {' + '.join(f'coalesce({c}, 0)' for c in _PARTS_OF)} AS total FROM c)"


@query(f"{_SCORED} SELECT trace_id, {', '.join(_PARTS_OF)}, round(total, 6) AS total, CASE WHEN total > 1.5 THEN 'pass' WHEN total > 0 THEN 'mid' ELSE 'fail' END AS class FROM s")
def faulty_rewards(spark, sf_dir):
    got = parse.with_rewards(_faulty(spark, sf_dir), strict=False)
    return got.select("trace_id", *[F.round(f"reward.{c}", 6).alias(c) for c in _PARTS_OF], F.round("reward.total", 6).alias("total"), "class")


@query(f"{_SCORED} SELECT count(*) AS n, round(avg(total), 6) AS mean, round(min(total), 6) AS min, round(max(total), 6) AS max, count(*) FILTER (parse_valid < 0) AS n_parse_errors, count(*) FILTER (total > 1.5) AS n_pass FROM s")
def faulty_reward_summary(spark, sf_dir):
    return parse.summary(parse.with_rewards(_faulty(spark, sf_dir), strict=False))


@query(f"""{_SCORED} SELECT s.trace_id, round(total, 6) AS score, CASE WHEN f = 3 THEN 2 + t::INT ELSE 4 + 2 * t::INT + CASE f WHEN 1 THEN 0 WHEN 6 THEN 4 ELSE 1 END END AS n_blocks, CASE f WHEN 3 THEN 1 ELSE 0 END AS n_errors, CASE WHEN f = 7 OR (f = 10 AND t) THEN 1 ELSE 0 END AS n_warnings,
 CASE WHEN t AND f IN (9, 10) THEN 'c1' ELSE '' END AS calls_without_result, CASE WHEN t AND f = 9 THEN 'c9' ELSE '' END AS results_without_call, CASE WHEN f = 3 OR f = 1 THEN 10 ELSE 11 END AS n_rewards, length('You sell parts.') AS system_size FROM s JOIN broken b ON s.trace_id = b.trace_id""")
def trace_detail(spark, sf_dir):
    d = parse.detail(parse.with_rewards(_faulty(spark, sf_dir), strict=False))
    joined = lambda c: F.array_join(f"detail.{c}", "|").alias(c)
    return d.select("trace_id", F.round("detail.score", 6).alias("score"), F.size("detail.blocks").alias("n_blocks"), "detail.n_errors", "detail.n_warnings", joined("calls_without_result"), joined("results_without_call"), F.size("detail.rewards").alias("n_rewards"), F.col("detail.blocks")[0]["size"].alias("system_size"))


_TOKEN = r"""'「[^」]*」|"[^"]*"|//[^\n]*|🏷\s*\S+|※\s*(?:\[[^\]]+\]|\S+)|⊨\s*\d+|𝑝\s*[\d.]+|[↦•]|\b(?:system|tool|user|plan|act|result|response|todo|call|think|data|error|name|params|type|enum|required|description|rationale|id)\b'"""


@query(f"""{NEXT} m AS (SELECT trace_id, regexp_extract_all(trace, {_TOKEN}) AS found, list_transform(string_split_regex(trace, {_TOKEN}), lambda x: length(x)) AS gaps FROM traces),
k AS (SELECT trace_id, found, gaps, list_transform(found, lambda x: length(x)) AS sizes, unnest(range(1, len(found) + 1)) AS k FROM m),
p AS (SELECT trace_id, found[k] AS token, list_sum(gaps[1:k]) + coalesce(list_sum(sizes[1:k - 1]), 0) AS start FROM k)
SELECT trace_id, CASE left(token, 1) WHEN '「' THEN 'special' WHEN '"' THEN 'string' WHEN '/' THEN 'comment' WHEN '🏷' THEN 'tag' WHEN '※' THEN 'reference' WHEN '⊨' THEN 'satisfies' WHEN '𝑝' THEN 'confidence' WHEN '↦' THEN 'operator' WHEN '•' THEN 'operator' ELSE 'keyword' END AS class,
 CAST(start AS INT) AS start, CAST(start + length(token) AS INT) AS end_at, token FROM p""")
def syntax_tokens(spark, sf_dir):
    return display.syntax_rows(traces(spark, sf_dir), "trace_id", "trace").withColumnRenamed("end", "end_at")


# Calls of a model. The stub answers from the text it is asked, so SQL knows every reply.


def _answer(text: str) -> str:
    """The request's trace, whole or (two times of three) with a brace too many; requests of a seventh length fail for good."""
    n, trace = text.split("\n", 1)
    if len(trace) % 7 == 0:
        raise ConnectionError("no answer")
    return trace if (len(trace) + int(n)) % 3 == 0 else trace + "{"


def _request(attempt: int):
    return F.concat(F.lit(f"{attempt}\n"), "trace")


def _at_once(seconds: float) -> None:
    """No pause: the stub's failures do not pass with time."""


@query(f"""{NEXT} {_FACTS}, a AS (SELECT trace_id, t, length(t) % 7 = 0 AS dead, trace_id IN (SELECT trace_id FROM e) AS bad, 3 - length(t) % 3 AS round FROM v)
SELECT trace_id, CASE WHEN dead OR bad THEN 3 ELSE round END AS attempt, CASE WHEN dead THEN 'ConnectionError: no answer' WHEN bad THEN 'invalid' END AS error, CASE WHEN NOT dead AND NOT bad THEN md5(t) END AS reply_md5 FROM a""")
def retry_rounds(spark, sf_dir):
    """Every trace is asked for up to three times; two of three replies have a brace too many."""
    got = calls.until_valid(traces(spark, sf_dir), "trace_id", _request, _answer, lambda c: validate.validation(c)["valid"], rounds=3, retries=1, sleep=_at_once)
    return got.select("trace_id", "attempt", "error", F.md5("reply").alias("reply_md5"))


@query(f"""{NEXT} {_FACTS}, g AS (SELECT trace_id, md5(t) AS reply_md5, row_number() OVER (ORDER BY trace_id) AS k, (SELECT count(*) FROM v) // 4 AS n FROM v WHERE length(t) % 7 <> 0 AND trace_id NOT IN (SELECT trace_id FROM e))
SELECT trace_id, reply_md5 FROM g WHERE k <= n""")
def enough_replies(spark, sf_dir):
    """The first valid replies by trace_id, a quarter as many as there are traces, each asked for once and unbroken."""
    rows = traces(spark, sf_dir).withColumn("text", F.concat(((3 - F.length("trace") % 3) % 3).cast("string"), F.lit("\n"), "trace"))
    got, _ = calls.first_valid_of(rows, "trace_id", "text", _answer, lambda c: validate.validation(c)["valid"], rows.count() // 4, retries=0, sleep=_at_once)
    return got.select("trace_id", F.md5("reply").alias("reply_md5"))


# A batch job from requests to results.


@query(f"""{WITH} SELECT 'trace-' || trace_id AS custom_id, CASE WHEN trace_id % 4 = 0 THEN 'failed' WHEN trace_id % 9 = 0 THEN 'malformed' ELSE 'ok' END AS status, CASE WHEN trace_id % 4 <> 0 AND trace_id % 9 <> 0 THEN md5(trace) END AS content_md5,
 (SELECT count(*) FROM traces) AS n_requests, 0::BIGINT AS n_before, (SELECT count(*) FROM traces WHERE trace_id % 4 = 0) AS n_failed FROM traces""")
def batch_job(spark, sf_dir):
    """Requests for all traces go out as a job, results come back in files; before the job is completed there are none."""
    rows, at = traces(spark, sf_dir), _folder(spark, "job")
    k = F.col("trace_id")
    said = F.array(F.struct(F.lit("user").alias("role"), F.col("trace").alias("content")))
    asks = planning.requests(rows.withColumn("custom_id", F.concat(F.lit("trace-"), k.cast("string"))), "model", said)
    info = batch.submit(asks, at, "custom_id", model="model", inline=True)
    sent = spark.read.schema("custom_id string, body struct<messages:array<struct<content:string>>>").json(f"{at}/requests")
    trace, number = F.col("body.messages")[0]["content"], F.split_part("custom_id", F.lit("-"), F.lit(2)).cast("long")
    choices = F.filter(F.array(F.struct(F.struct(trace.alias("content")).alias("message"))), lambda x: number % 9 != 0)
    back = sent.select("custom_id", F.when(number % 4 == 0, F.struct(F.lit(429).alias("code"))).alias("error"), F.when(number % 4 != 0, F.struct(F.struct(choices.alias("choices")).alias("body"))).alias("response"))
    files.write_lines(back, f"{at}/back")
    _as_results(spark, at)
    before = batch.results(spark, at).count()
    batch.update_job(at, status="completed")
    failed = batch.results(spark, at).where("status = 'failed'").count()
    counts = [F.lit(n).cast("long").alias(c) for n, c in ((info["count"], "n_requests"), (before, "n_before"), (failed, "n_failed"))]
    return batch.results(spark, at).select("custom_id", "status", F.md5("content").alias("content_md5"), *counts)


def _as_results(spark, at: str) -> None:
    """What a service would do: put its files into the job's results."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.Path(at, "results"))
    for f in fs.globStatus(hadoop.Path(at, "back/part-*")):
        fs.rename(f.getPath(), hadoop.Path(at, f"results/{f.getPath().getName().removesuffix('.json')}.jsonl"))
