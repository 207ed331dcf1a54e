"""All queries over the trace tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import lex
from tracelake.operators import display, judge, parse, planning, profile, prompts, render, rewrite, validate
from tracelake.plans import line_sql
from tracelake.plans.traces import ACT_RUNS, PARTS, act_runs, traces
from tracelake.plans.traces import sql as traces_sql
from tracelake.streaming import rolling

WITH = f"WITH traces AS ({traces_sql()})"
NEXT = f"{WITH},"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Validation. The SQL spells every pattern again, in RE2.

_FACTS = r"""
v AS (SELECT trace_id, trace AS t,
    regexp_matches(trace, 'system「[^」]*」') AS has_s, regexp_matches(trace, 'user「[^」]*」') AS has_u, regexp_matches(trace, 'plan\s*\{[^}]*\}') AS has_p, regexp_matches(trace, 'response「[^」]*」') AS has_r,
    strpos(trace, 'system') AS at_s, strpos(trace, 'user「') AS at_u, strpos(trace, 'plan {') AS at_p, strpos(trace, 'response「') AS at_r,
    list_sort(list_distinct(list_concat(regexp_extract_all(trace, '🏷\s*["'']?([^"''\s•}]+)["'']?', 1), regexp_extract_all(trace, 'data\s*↦\s*["「][^"」]*["」]\s*🏷\s*(\S+)', 1)))) AS tags,
    list_sort(list_distinct(list_filter(list_concat(
      list_transform(flatten(list_transform(regexp_extract_all(trace, '※\s*\[\s*([^\]]+)\s*\]', 1), lambda x: string_split(x, '•'))), lambda x: trim(trim(x, ' ' || chr(9) || chr(10) || chr(13)), '"''')),
      regexp_extract_all(trace, '※\s*["'']?([^"''\s•}\[]+)["'']?', 1)), lambda x: x <> ''))) AS refs,
    list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all(trace, 'plan\s*\{([^}]*)\}', 1), lambda p: regexp_extract_all(p, '(\d+)\s*↦\s*["''][^"'']+["'']', 1))), lambda x: CAST(x AS INT)))) AS todos,
    list_sort(list_distinct(list_transform(regexp_extract_all(trace, '⊨\s*(\d+)', 1), lambda x: CAST(x AS INT)))) AS done,
    regexp_extract_all(trace, '𝑝\s*([\d.]+)', 1) AS conf
  FROM traces),
e AS (
  SELECT trace_id, 'Missing system message' AS error FROM v WHERE NOT has_s UNION ALL
  SELECT trace_id, 'Missing user message' FROM v WHERE NOT has_u UNION ALL
  SELECT trace_id, 'Missing plan block' FROM v WHERE NOT has_p UNION ALL
  SELECT trace_id, 'Missing response' FROM v WHERE NOT has_r UNION ALL
  SELECT trace_id, 'User message appears before system message' FROM v WHERE has_s AND has_u AND at_u < at_s UNION ALL
  SELECT trace_id, 'Plan appears before user message' FROM v WHERE has_u AND has_p AND at_p > 0 AND at_p < at_u UNION ALL
  SELECT trace_id, 'Response appears before plan' FROM v WHERE has_p AND has_r AND at_p > 0 AND at_r < at_p UNION ALL
  SELECT trace_id, 'Invalid confidence value: ' || c FROM (SELECT trace_id, unnest(conf) AS c FROM v) WHERE TRY_CAST(c AS DOUBLE) IS NULL UNION ALL
  SELECT trace_id, 'Unbalanced ' || n || ': ' || o || ' open, ' || z || ' close' FROM (
    SELECT trace_id, n, length(t) - length(replace(t, a, '')) AS o, length(t) - length(replace(t, b, '')) AS z FROM v, (VALUES ('braces', '{', '}'), ('brackets', '[', ']'), ('special quotes', '「', '」')) q(n, a, b)) WHERE o <> z)
"""


@query(traces_sql())
def trace_view(spark, sf_dir):
    return traces(spark, sf_dir)


@query(f"{NEXT} {_FACTS} SELECT trace_id, error FROM e")
def validate_errors(spark, sf_dir):
    return validate.error_rows(traces(spark, sf_dir))


@query(f"{NEXT} {_FACTS} SELECT count(*) AS n, count(*) FILTER (NOT bad) AS n_valid, count(*) FILTER (bad) AS n_invalid FROM (SELECT trace_id IN (SELECT trace_id FROM e) AS bad FROM v)")
def validate_summary(spark, sf_dir):
    return validate.summary(traces(spark, sf_dir))


@query(f"""{NEXT} {_FACTS}
SELECT trace_id, 'undefined_reference' AS kind, unnest(list_filter(refs, lambda x: NOT list_contains(tags, x))) AS item FROM v UNION ALL
SELECT trace_id, 'unsatisfied_todo', CAST(unnest(list_filter(todos, lambda x: NOT list_contains(done, x))) AS VARCHAR) FROM v UNION ALL
SELECT trace_id, 'undefined_todo', CAST(unnest(list_filter(done, lambda x: NOT list_contains(todos, x))) AS VARCHAR) FROM v UNION ALL
SELECT trace_id, 'confidence_range', CAST(x AS VARCHAR) FROM (SELECT trace_id, TRY_CAST(unnest(conf) AS DOUBLE) AS x FROM v) WHERE x > 1 UNION ALL
SELECT trace_id, 'result_block_tag', '' FROM v WHERE regexp_matches(t, 'result\\s*\\{{[^}}]*\\}}\\s*🏷')""")
def validate_warnings(spark, sf_dir):
    return validate.warning_rows(traces(spark, sf_dir))


@query(f"{NEXT} {_FACTS} SELECT trace_id, array_to_string(tags, '|') AS tags, array_to_string(todos, '|') AS todos, array_to_string(done, '|') AS satisfied FROM v WHERE trace_id NOT IN (SELECT trace_id FROM e)")
def valid_traces(spark, sf_dir):
    v = F.col("validation")
    text = lambda c: F.array_join(v[c].cast("array<string>"), "|")
    return validate.keep_valid(traces(spark, sf_dir)).select("trace_id", text("tags_defined").alias("tags"), text("todos_defined").alias("todos"), text("todos_satisfied").alias("satisfied"))


@query(f"{NEXT} {_FACTS} SELECT trace_id, unnest(tags) AS tag FROM v")
def tags_defined(spark, sf_dir):
    return traces(spark, sf_dir).select("trace_id", F.explode(lex.tags_defined("trace")).alias("tag"))


@query(f"{NEXT} {_FACTS} SELECT trace_id, unnest(refs) AS tag FROM v")
def tags_referenced(spark, sf_dir):
    return traces(spark, sf_dir).select("trace_id", F.explode(lex.tags_referenced("trace")).alias("tag"))


_TODOS = r"""
d AS (SELECT trace_id, trace, list_sort(list_distinct(list_transform(regexp_extract_all(regexp_extract(trace, '(?s)plan\s*\{.*?todo\s*↦\s*\{([^}]*)\}', 1), '(\d+)\s*↦\s*[「"]', 1), lambda x: CAST(x AS INT)))) AS own,
    list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(trace, '⊨\s*(\d+)', 1), lambda x: CAST(x AS INT)),
      list_transform(list_filter(list_transform(flatten(list_transform(regexp_extract_all(trace, '⊨\s*\[([^\]]+)\]', 1), lambda x: string_split(x, '•'))), lambda x: trim(x)), lambda x: regexp_full_match(x, '\d+')), lambda x: CAST(x AS INT))))) AS done FROM traces),
u AS (SELECT *, list_filter(own, lambda x: NOT list_contains(done, x)) AS open FROM d)
"""


@query(f"{NEXT} {_TODOS} SELECT trace_id, array_to_string(own, '|') AS defined, array_to_string(done, '|') AS satisfied, array_to_string(open, '|') AS unresolved FROM u")
def todo_status(spark, sf_dir):
    own, done = lex.first_plan_todos("trace"), lex.all_satisfied("trace")
    text = lambda a: F.array_join(a.cast("array<string>"), "|")
    return traces(spark, sf_dir).select("trace_id", text(own).alias("defined"), text(done).alias("satisfied"), text(F.array_except(own, done)).alias("unresolved"))


@query(f"{NEXT} {_TODOS} SELECT trace_id, trace FROM u WHERE len(open) = 0")
def purge_unresolved(spark, sf_dir):
    return traces(spark, sf_dir).where(F.size(F.array_except(lex.first_plan_todos("trace"), lex.all_satisfied("trace"))) == 0)


@query(f"""{WITH} SELECT trace_id, contains(trace, 'tool {{') AS has_tools, contains(lower(trace), 'error:') AS has_error,
(length(trace) - length(replace(trace, 'user「', ''))) // 5 > 1 AS multi_turn, CAST(len(string_split_regex(trace, '\\r?\\n')) AS BIGINT) AS n_lines FROM traces""")
def trace_flags(spark, sf_dir):
    return traces(spark, sf_dir).select("trace_id", lex.flags("trace").alias("f")).select("trace_id", "f.*")


@query(f"{WITH} SELECT trace_id FROM traces WHERE contains(lower(trace), 'timed out')")
def trace_search(spark, sf_dir):
    return traces(spark, sf_dir).where(lex.search("trace", "Timed OUT")).select("trace_id")


@query(f"{WITH} SELECT trace_id, CAST((length(trace) - length(replace(trace, 'act {{', ''))) // 5 AS BIGINT) AS n_acts, CASE WHEN length(p) > 60 THEN substr(p, 1, 57) || '...' ELSE p END AS preview FROM (SELECT trace_id, trace, trim(replace(trace, chr(10), ' ')) AS p FROM traces)")
def trace_previews(spark, sf_dir):
    return traces(spark, sf_dir).select("trace_id", lex.count_of("trace", "act {").alias("n_acts"), lex.preview("trace").alias("preview"))


@query(f"""{WITH} SELECT count(*) AS n, count(*) FILTER (contains(trace, 'tool {{')) AS n_tools, count(*) FILTER (contains(lower(trace), 'error:')) AS n_errors, count(*) FILTER ((length(trace) - length(replace(trace, 'user「', ''))) // 5 > 1) AS n_multi_turn FROM traces""")
def trace_characteristics(spark, sf_dir):
    f = traces(spark, sf_dir).select(lex.flags("trace").alias("f")).select("f.*")
    return f.agg(F.count("*").alias("n"), F.count_if("has_tools").alias("n_tools"), F.count_if("has_error").alias("n_errors"), F.count_if("multi_turn").alias("n_multi_turn"))


@query()
def display_blocks(spark, sf_dir):
    rows = traces(spark, sf_dir).select("trace_id", F.posexplode(display.block_rows("trace")).alias("pos", "b"))
    return rows.select("trace_id", "pos", "b.type", "b.text")


# Token profile, over traces and over documents.

_PROFILE = {"traces": "p AS (SELECT trace_id AS index, length(trace) // 4 AS tokens, length(trace) AS chars FROM traces)", "documents": "p AS (SELECT doc_id AS index, length(coalesce(text, '')) // 4 AS tokens, length(coalesce(text, '')) AS chars FROM documents)"}
_TOTALS = """SELECT count(*) AS n, CAST(sum(tokens) AS BIGINT) AS total_tokens, CAST(sum(chars) AS BIGINT) AS total_chars, min(tokens) AS min_tokens, max(tokens) AS max_tokens, CAST(sum(tokens) // count(*) AS BIGINT) AS avg_tokens,
 CAST(sum(tokens) AS BIGINT) * 0.008::DOUBLE / 1000 AS cost_training, CAST(sum(tokens) AS BIGINT) * 0.0003::DOUBLE / 1000 AS cost_inference, list_sort(list(tokens))[count(*) // 2 + 1] AS median_tokens FROM p"""
_HISTOGRAM = """SELECT lo, hi, n, round(n * 100.0::DOUBLE / (SELECT count(*) FROM p), 6) AS pct FROM (SELECT b.lo, b.hi, count(p.tokens) AS n
 FROM (VALUES (0::BIGINT, 100::BIGINT), (100, 500), (500, 1000), (1000, 5000), (5000, 10000), (10000, 50000), (50000, NULL)) b(lo, hi) LEFT JOIN p ON p.tokens >= b.lo AND (b.hi IS NULL OR p.tokens < b.hi) GROUP BY b.lo, b.hi)"""
_TOP = "SELECT index, tokens, chars FROM p ORDER BY tokens DESC, index LIMIT 10"


def _trace_profile(spark, sf_dir):
    return profile.profile(traces(spark, sf_dir), "trace", "trace_id")


def _document_profile(spark, sf_dir):
    return profile.profile(_table(spark, sf_dir, "documents"), "text", "doc_id")


@query(f"{NEXT} {_PROFILE['traces']} {_TOTALS}")
def token_totals(spark, sf_dir):
    return profile.totals(_trace_profile(spark, sf_dir))


@query(f"{NEXT} {_PROFILE['traces']} {_HISTOGRAM}")
def token_histogram(spark, sf_dir):
    return profile.histogram(_trace_profile(spark, sf_dir))


@query(f"{NEXT} {_PROFILE['traces']} {_TOP}")
def token_top10(spark, sf_dir):
    return profile.longest(_trace_profile(spark, sf_dir))


@query(f"WITH {_PROFILE['documents']} {_TOTALS}")
def document_token_totals(spark, sf_dir):
    return profile.totals(_document_profile(spark, sf_dir))


@query(f"WITH {_PROFILE['documents']} {_HISTOGRAM}")
def document_token_histogram(spark, sf_dir):
    return profile.histogram(_document_profile(spark, sf_dir))


@query(f"WITH {_PROFILE['documents']} {_TOP}")
def document_token_top10(spark, sf_dir):
    return profile.longest(_document_profile(spark, sf_dir))


@query(f"""WITH {_PROFILE['documents']} SELECT count(*) AS n, count(*) FILTER (tokens > 1000) AS n_over, max(tokens) AS max_tokens, min(tokens) FILTER (tokens > 1000) AS min_over, max(tokens) FILTER (tokens > 1000) AS max_over,
 CAST(sum(tokens) FILTER (tokens > 1000) // count(*) FILTER (tokens > 1000) AS BIGINT) AS avg_over, count(*) FILTER (least(tokens, 1000) <= 100) AS n_short, list_sort(list(tokens))[count(*) // 2 + 1] AS median_tokens FROM p""")
def truncation_report(spark, sf_dir):
    return profile.truncation(_document_profile(spark, sf_dir), 1000)


# Prompt derivation: some lines have a prompt, some a marked trace, some neither.

_LINES = f"""{NEXT} l AS (SELECT trace_id, CASE trace_id % 5 WHEN 0 THEN 'Do: ' || trace_id WHEN 1 THEN '<|im_start|>user' || chr(10) || trace_id END AS prompt,
  CASE WHEN trace_id % 5 > 2 THEN replace(trace, 'plan {{', '<|im_start|>assistant' || chr(10) || 'plan {{') WHEN trace_id % 5 = 2 THEN trace END AS trace FROM traces),
a AS (SELECT *, strpos(coalesce(trace, ''), '<|im_start|>assistant') AS pos FROM l),
s AS (SELECT *, CASE WHEN prompt IS NOT NULL THEN 'prompt' WHEN pos = 0 THEN 'skipped_malformed' WHEN length(trace) - pos + 1 - 21 > 3000 THEN 'skipped_long' ELSE 'split' END AS status FROM a),
o AS (SELECT trace_id, status, CASE status WHEN 'prompt' THEN CASE WHEN starts_with(prompt, '<|im_start|>') THEN prompt ELSE '<|im_start|>system' || chr(10) || prompt || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) END
  WHEN 'split' THEN substr(trace, 1, pos - 1) || '<|im_start|>assistant' || chr(10) END AS out FROM s)"""


def _derived(spark, sf_dir):
    k = F.col("trace_id") % 5
    marked = F.replace("trace", F.lit("plan {"), F.lit("<|im_start|>assistant\nplan {"))
    prompt = F.when(k == 0, F.concat(F.lit("Do: "), F.col("trace_id").cast("string"))).when(k == 1, F.concat(F.lit("<|im_start|>user\n"), F.col("trace_id").cast("string")))
    rows = traces(spark, sf_dir).select("trace_id", prompt.alias("prompt"), F.when(k > 2, marked).when(k == 2, F.col("trace")).alias("trace"))
    return prompts.derive(rows, most=3000)


@query(f"{_LINES} SELECT * FROM o")
def prompt_status(spark, sf_dir):
    return _derived(spark, sf_dir).select("trace_id", "status", "out")


_COUNTERS = "SELECT count(*) AS total, count(out) AS accepted, count(*) FILTER (status = 'skipped_long') AS skipped_long, count(*) FILTER (status = 'skipped_malformed') AS skipped_malformed FROM"


@query(f"{_LINES} {_COUNTERS} o")
def prompt_counters(spark, sf_dir):
    return prompts.counters(_derived(spark, sf_dir))


@query(f"{_LINES}, c AS (SELECT *, coalesce(count(out) OVER (ORDER BY trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o) {_COUNTERS} c WHERE before < 12")
def prompt_counters_capped(spark, sf_dir):
    return prompts.counters(prompts.capped(_derived(spark, sf_dir), "trace_id", 12))


@query(f"{_LINES} SELECT out AS prompt, 'trace' AS task FROM o WHERE out IS NOT NULL")
def environment_rows(spark, sf_dir):
    return prompts.environment(_derived(spark, sf_dir))


@query(f"{_LINES} SELECT trace_id, trim(list_extract(string_split(list_extract(string_split(coalesce(trace, prompt), '<|im_start|>assistant'), -1), '<|im_end|>'), 1), ' ' || chr(10)) AS segment FROM l")
def assistant_segments(spark, sf_dir):
    return _derived(spark, sf_dir).select("trace_id", lex.assistant_segment(F.coalesce("trace", "prompt")).alias("segment"))


# Parsing and rewards of these traces have no SQL form; rewriting has one by lines.


@query()
def parse_facts(spark, sf_dir):
    facts = traces(spark, sf_dir).select("trace_id", parse.parse("trace").alias("strict"))
    return facts.select("trace_id", "strict.*")


@query()
def reward_components(spark, sf_dir):
    both = traces(spark, sf_dir).select("trace_id", parse.parse("trace").alias("c"), parse.parse("trace", strict=False).alias("s"))
    scored = both.select("trace_id", parse.reward(F.col("c")).alias("c"), parse.reward(F.col("s")).alias("s"))
    return scored.select("trace_id", *[F.round(f"c.{k}", 6).alias(k) for k in parse.COMPONENTS], F.round("c.total", 6).alias("score_compat"), F.round("s.total", 6).alias("score_spec"), parse.score_class(F.col("s.total")).alias("class_spec"))


@query()
def reward_summary(spark, sf_dir):
    return parse.summary(parse.with_rewards(traces(spark, sf_dir), strict=False))


def _rewritten(source: str, *steps: tuple[str, Callable[[str, str], str]]) -> str:
    """CTEs that take source through the steps; each is named and reads the one before."""
    out, last = [source], "traces"
    for name, step in steps:
        out.append(step(last, name))
        last = name
    return "WITH RECURSIVE " + ", ".join(out)


_SOURCES = {"": (traces, f"traces AS ({traces_sql()})"), "act_runs_": (act_runs, f"traces AS (SELECT p_partkey AS trace_id, {ACT_RUNS} AS trace FROM ({PARTS}))")}
_MERGED, _UNTAGGED = ("merged", line_sql.merged), ("untagged", line_sql.untagged)
_ACTS = "CAST((length({0}) - length(replace({0}, 'act {{', ''))) // 5 AS INT)".format


def _rewriters(prefix: str, source: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    """The rewriting queries over one table of traces."""

    def keep(name: str, text: str, run: Callable[[DataFrame], DataFrame]) -> None:
        def f(spark, sf_dir):
            return run(source(spark, sf_dir))

        f.__name__ = prefix + name
        query(text)(f)

    keep(
        "merge_acts",
        f"{_rewritten(sql, _MERGED)} SELECT m.trace_id, m.trace, lossy, {_ACTS('t.trace')} AS acts_before, {_ACTS('m.trace')} AS acts_after FROM merged m JOIN traces t ON m.trace_id = t.trace_id",
        lambda df: rewrite.process_traces(df, tags=False, style="none").select("trace_id", "trace", "lossy", "acts_before", "acts_after"),
    )
    cut = "CAST(length(regexp_replace(m.trace, '[^🏷]', '', 'g')) - length(regexp_replace(u.trace, '[^🏷]', '', 'g')) AS INT)"
    joined = "merged m JOIN untagged u ON m.trace_id = u.trace_id"
    for style, template in (("a", line_sql.template_a), ("b", line_sql.template_b)):
        keep(
            f"template_{style}",
            f"{_rewritten(sql, _MERGED, _UNTAGGED, ('done', template))} SELECT d.trace_id, d.trace, {cut} AS tags_removed FROM {joined} JOIN done d ON m.trace_id = d.trace_id",
            lambda df, style=style: rewrite.process_traces(df, style=style).select("trace_id", "trace", "tags_removed"),
        )
    keep(
        "process_summary",
        f"""{_rewritten(sql, _MERGED, _UNTAGGED, ('done', line_sql.template_a))}, {_TODOS},
x AS (SELECT {_ACTS('u.trace')} - {_ACTS('merged.trace')} AS fewer, {cut.replace('u.trace', 'untagged.trace').replace('m.trace', 'merged.trace')} AS cut, len(own) AS own, len(open) AS open, length(u.trace) AS before, length(done.trace) AS after FROM u JOIN merged USING (trace_id) JOIN untagged USING (trace_id) JOIN done USING (trace_id))
SELECT count(*) AS n, CAST(sum(fewer) AS BIGINT) AS acts_merged, CAST(sum(cut) AS BIGINT) AS tags_removed, CAST(sum(own) AS BIGINT) AS total_todos, CAST(sum(open) AS BIGINT) AS unresolved_todos, count(*) FILTER (open > 0) AS n_with_unresolved,
 CAST(sum(before) AS BIGINT) AS chars_before, CAST(sum(after) AS BIGINT) AS chars_after, round((sum(after) - sum(before)) * 100.0::DOUBLE / sum(before), 6) AS change_pct FROM x""",
        lambda df: rewrite.summary(rewrite.process_traces(df)),
    )


for _prefix, _source in _SOURCES.items():
    _rewriters(_prefix, *_source)


@query(rf"""{NEXT} n AS (SELECT trace_id, trace, list_distinct(regexp_extract_all(trace, '🏷\s*["'']?([a-zA-Z_][a-zA-Z0-9_-]*)["'']?', 1)) AS own,
  list_concat(regexp_extract_all(trace, '※\s*["'']?([a-zA-Z_][a-zA-Z0-9_-]*)["'']?', 1), list_transform(flatten(list_transform(regexp_extract_all(trace, '※\s*\[([^\]]+)\]', 1), lambda x: string_split(x, '•'))), lambda x: trim(trim(x), '"'''))) AS used FROM traces)
SELECT trace_id, list_reduce(list_prepend(trace, list_sort(list_filter(own, lambda x: NOT list_contains(used, x)))), lambda a, t: CASE WHEN regexp_matches(a, '🏷\s*"' || t || '"') THEN regexp_replace(a, '\s*🏷\s*"' || t || '"', '', 'g')
  ELSE regexp_replace(a, '\s*🏷\s*' || t || '([^a-zA-Z0-9_-]|$)', '\1', 'g') END) AS trace FROM n""")
def drop_unused_tags(spark, sf_dir):
    return rewrite.process_traces(traces(spark, sf_dir), merge=False, style="none").select("trace_id", "trace")


# Structured rendering, on typed traces made from parts.

_N = "chr(10)"
_RENDER = """
WITH p AS (SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size, chr(10) AS n FROM part)
SELECT k AS trace_id, 'system「You sell parts.」' || CASE WHEN k % 2 = 0 THEN ' 🏷 sys1' ELSE '' END || n || n
 || CASE WHEN size % 3 = 0 THEN 'tool {' || n || '    name ↦ find_part •' || n || '    params ↦ {' || n || '        brand ↦ {' || n || '            enum ↦ [ ' || brand || ' • any ] •' || n || '            required ↦ false •' || n || '            description ↦ "of the part"' || n || '        } •' || n || '        size ↦ {' || n || '            type ↦ integer' || n || '        }' || n || '    }' || n || '}' || n || n ELSE '' END
 || 'user「' || name || '」🏷 usr1' || n || n
 || 'plan {' || n || '    todo ↦ {' || n || '        1 ↦ "find ' || brand || '" •' || n || '        2 ↦ "answer"' || n || '    } •' || n || '    rationale ↦ "size ' || size || '"' || n || '}' || n || n
 || 'act {' || n || '    think ↦ "' || type || '"' || CASE WHEN k % 4 = 0 THEN ' 𝑝 0.5' ELSE '' END || CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN ' ※ "usr1"' ELSE ' ※ ["usr1" • "sys1"]' END || ' 🏷 th1' || ' ⊨ 1'
 || CASE WHEN size % 3 = 0 THEN ' •' || n || '    call ↦ {' || n || '        tool ↦ find_part •' || n || '        size ↦ "' || size || '" •' || n || '        id ↦ "c1"' || n || '    }' || CASE WHEN k % 2 = 1 THEN ' ⊨ 1' ELSE '' END ELSE '' END || n || '}' || n || n
 || CASE WHEN size % 3 = 0 THEN 'result {' || n || '    data ↦ "' || name || '"' || n || '} 🏷 "c1"' || n || n ELSE '' END
 || 'response「' || name || ' it is.」 ※ "th1" ⊨ 2' AS trace FROM p
"""


@query(_RENDER)
def render_trace(spark, sf_dir):
    return rendered(_table(spark, sf_dir, "part"))


def rendered(parts: DataFrame) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    lit = F.lit
    has = size % 3 == 0

    def struct(**fields):
        return F.struct(*[(lit(v) if isinstance(v, (str, int, float, bool)) else v).alias(n) for n, v in fields.items()])

    texts = lambda *x: F.array(*[lit(v) if isinstance(v, str) else v for v in x])
    none = F.array().cast("array<string>")
    params = F.array(struct(name="brand", type="enum", enum_values=texts(F.col("p_brand"), "any"), required=False, description="of the part"), struct(name="size", type="integer", enum_values=none, required=True, description=""))
    tool = struct(name="find_part", description="finds parts", params=params)
    plan = struct(todos=F.array(struct(number=1, text=F.concat(lit("find "), "p_brand")), struct(number=2, text="answer")), rationale=F.concat(lit("size "), size.cast("string")))
    refs = F.when(k % 3 == 0, none).when(k % 3 == 1, texts("usr1")).otherwise(texts("usr1", "sys1"))
    think = struct(content=F.col("p_type"), confidence=F.when(k % 4 == 0, 0.5).otherwise(-1.0), refs=refs, tag="th1", satisfies=1)
    call = struct(tool="find_part", args=F.array(struct(name="size", value=size.cast("string"))), id="c1", refs=none, satisfies=F.when(k % 2 == 1, 1).otherwise(0))
    act = struct(think=think, calls=F.filter(F.array(call), lambda c: has))
    blank = {"plan": struct(todos=F.array(struct(number=0, text="")), rationale=""), "act": struct(think=struct(content="", confidence=-1.0, refs=none, tag="", satisfies=0), calls=F.filter(F.array(call), lambda c: lit(False))), "result": struct(data="", tag=""), "response": struct(content="", refs=none, satisfies=0)}
    step = lambda kind, value: struct(step_type=kind, **(blank | {kind: value}))
    steps = F.array(step("plan", plan), step("act", act), step("result", struct(data=F.col("p_name"), tag="c1")), step("response", struct(content=F.concat("p_name", lit(" it is.")), refs=texts("th1"), satisfies=2)))
    steps = F.filter(steps, lambda s: (s["step_type"] != "result") | has)
    system = struct(content="You sell parts.", tag=F.when(k % 2 == 0, "sys1").otherwise(""))
    text = render.trace_text(system, F.filter(F.array(tool), lambda t: has), struct(content=F.col("p_name"), tag="usr1"), steps)
    return parts.select(k.alias("trace_id"), text.alias("trace"))


_TOOLS = """CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'tool { name ↦ ' || s_name || ' • description ↦ "' || CASE WHEN s_suppkey % 4 = 1 THEN '' ELSE 'asks ' || s_name END || '" • params ↦ { q ↦ { type ↦ string } • n ↦ { type ↦ ' || CASE WHEN s_suppkey % 2 = 0 THEN 'integer' ELSE 'string' END || ' } } }'
 || CASE WHEN s_suppkey % 4 = 3 THEN chr(10) || 'tool { name ↦ unknown • description ↦ "" }' ELSE '' END END"""


def _supplier_tools():
    k = F.col("s_suppkey")
    params = F.create_map(F.lit("q"), F.lit("string"), F.lit("n"), F.when(k % 2 == 0, "integer").otherwise("number?"))
    first = F.struct(F.col("s_name").alias("name"), F.when(k % 4 != 1, F.concat(F.lit("asks "), "s_name")).alias("description"), params.alias("params"))
    bare = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("map<string,string>").alias("params"))
    return F.when(k % 4 == 0, F.array(first)).otherwise(F.array(first, bare)), k


@query(f"SELECT s_suppkey, {_TOOLS} AS tools FROM supplier")
def tools_text(spark, sf_dir):
    both, k = _supplier_tools()
    own = F.when(k % 4 == 0, F.slice(both, 1, 0)).when(k % 4 == 3, both).otherwise(F.slice(both, 1, 1))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", render.tools_text(own).alias("tools"))


@query(f"""WITH t AS (SELECT s_suppkey, s_name, {_TOOLS} AS tools FROM supplier)
SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'system「You are ' || s_name || '.」🏷 sys1' || CASE WHEN tools = '' THEN '' ELSE chr(10) || chr(10) || tools END || chr(10) || chr(10) || 'user「Order from ' || s_name || '」🏷 usr1' END AS prompt FROM t""")
def scenario_prompts(spark, sf_dir):
    both, k = _supplier_tools()
    own = F.when(k % 4 == 0, F.slice(both, 1, 0)).when(k % 4 == 3, both).otherwise(F.slice(both, 1, 1))
    request = F.when(k % 7 != 0, F.concat(F.lit("Order from "), "s_name")).otherwise("")
    return _table(spark, sf_dir, "supplier").select("s_suppkey", prompts.scenario_prompt(F.concat(F.lit("You are "), F.col("s_name"), F.lit(".")), render.tools_text(own), request).alias("prompt"))


@query("""SELECT s_suppkey, '<|im_start|>system' || chr(10) || 'system「' || CASE WHEN s_suppkey % 3 = 0 THEN 'You are a helpful AI assistant that completes tasks step by step.' ELSE s_name END || '」🏷 sys1' || chr(10)
 || 'tool {' || chr(10) || '    name ↦ ' || s_name || ' •' || chr(10) || '    params ↦ {' || chr(10) || '        q ↦ { type ↦ string }' || chr(10) || '    }' || chr(10) || '}' || chr(10)
 || '<|im_end|>' || chr(10) || chr(10) || '<|im_start|>user' || chr(10) || 'user「Ask ' || s_name || '」🏷 usr1' || chr(10) || '<|im_end|>' || chr(10) || chr(10) || '<|im_start|>assistant' AS prompt FROM supplier""")
def inference_prompts(spark, sf_dir):
    tool = F.struct(F.col("s_name").alias("name"), F.lit("").alias("description"), F.create_map(F.lit("q"), F.lit("string")).alias("params"))
    system = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name"))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", prompts.inference_prompt(F.concat(F.lit("Ask "), "s_name"), system, F.array(tool)).alias("prompt"))


# Planning. Draws are hashes that both engines have.


def _draw(purpose: str, key: str = "idx", seed: int = 0) -> str:
    return f"(CAST('0x' || left(md5('{seed}:{purpose}:' || {key}), 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def _plan_sql(count: int | str) -> str:
    bare = int(count * planning.NO_TOOLS_RATE) if isinstance(count, int) else f"CAST(floor({count} * {planning.NO_TOOLS_RATE}::DOUBLE) AS BIGINT)"
    return f"""r AS (SELECT unnest(range({count})) AS idx),
plan AS (SELECT idx, 'trace-' || idx AS custom_id, idx >= {bare} AS has_tools, {_draw('follow_up')} < 0.3::DOUBLE AS has_follow_ups, idx >= {bare} AND {_draw('error')} < 0.2::DOUBLE AS include_error,
 CAST(floor({_draw('steps')} * 46) AS INT) + 5 AS num_steps, ['coding', 'data_analysis', 'research', 'writing', 'planning', 'math', 'troubleshooting', 'creative', 'education', 'business'][CAST(floor({_draw('domain')} * 10) AS INT) + 1] AS domain FROM r)"""


_DOCUMENTS = "(SELECT count(*) FROM documents)"


@query(f"WITH {_plan_sql(_DOCUMENTS)} SELECT * FROM plan")
def request_plan(spark, sf_dir):
    """A request for each document."""
    return planning.plan(spark, _table(spark, sf_dir, "documents").count())


@query("""WITH c AS (SELECT source AS segment, count(*) AS n FROM documents GROUP BY source), b AS (SELECT segment, n, CAST(floor(n * 0.2::DOUBLE) AS BIGINT) AS bare FROM c),
h AS (SELECT segment, true AS t, n - bare AS k FROM b UNION ALL SELECT segment, false, bare FROM b), m AS (SELECT *, CAST(floor(k * 0.3::DOUBLE) AS BIGINT) AS many FROM h),
q AS (SELECT segment, t, false AS f, k - many AS n FROM m UNION ALL SELECT segment, t, true, many FROM m)
SELECT segment, t AS has_tools, f AS has_follow_ups, b AS batch, least(10, n - b * 10) AS size FROM q, unnest(range((n + 9) // 10)) u(b)""")
def request_batches(spark, sf_dir):
    """As many requests as each source has documents, as batches."""
    return planning.batches_by(_table(spark, sf_dir, "documents").groupBy(F.col("source").alias("segment")).agg(F.count("*").alias("count")), "count")


@query(f"WITH {_plan_sql(_DOCUMENTS)}, w AS (SELECT idx, row_number() OVER (ORDER BY {_draw('shuffle')}, idx) AS k FROM plan) SELECT idx, k - 1 AS place FROM w WHERE k <= {_DOCUMENTS} // 20")
def shuffled_plan(spark, sf_dir):
    """A twentieth of the plan, drawn and in the order drawn."""
    n = _table(spark, sf_dir, "documents").count()
    return planning.drawn(planning.plan(spark, n), "idx", n // 20).select("idx", "place")


_MATCH = f"""{NEXT} {_FACTS}, {_plan_sql('(SELECT count(*) * 9 // 10 FROM traces)')}, q AS (SELECT * FROM plan),
m AS (SELECT t.trace_id AS idx, CASE WHEN t.trace_id % 17 = 0 THEN 'failed' WHEN t.trace_id IN (SELECT trace_id FROM e) THEN 'invalid' ELSE 'valid' END AS status, q.has_tools, q.domain, q.idx IS NOT NULL AS has_plan FROM traces t LEFT JOIN q ON q.idx = t.trace_id)"""


def _matched(spark, sf_dir):
    k = F.col("trace_id")
    got = traces(spark, sf_dir).select(F.concat(F.lit("trace-"), k.cast("string")).alias("custom_id"), F.when(k % 17 == 0, "timeout").alias("error"), F.concat(F.lit("\n"), "trace", F.lit("\n ")).alias("content"))
    return planning.match(got, planning.plan(spark, got.count() * 9 // 10))


@query(f"{_MATCH} SELECT * FROM m")
def response_match(spark, sf_dir):
    return _matched(spark, sf_dir).select("idx", "status", "has_tools", "domain", "has_plan")


@query(f"{_MATCH} SELECT count(*) FILTER (status = 'valid') AS n_valid, count(*) FILTER (status <> 'valid') AS n_failed FROM m")
def batch_outcome(spark, sf_dir):
    return planning.outcome(_matched(spark, sf_dir))


@query(f"{NEXT} {_FACTS} SELECT trace_id % 20 AS idx, min(trace_id // 20) AS attempt FROM v WHERE trace_id NOT IN (SELECT trace_id FROM e) GROUP BY trace_id % 20")
def retry_first_valid(spark, sf_dir):
    tries = traces(spark, sf_dir).select((F.col("trace_id") % 20).alias("idx"), F.floor(F.col("trace_id") / 20).alias("attempt"), F.col("trace").alias("content"))
    return planning.first_valid(tries).select("idx", "attempt")


# Judge, with stub verdicts.

_STUB = {name: i for i, name in enumerate(judge.WEIGHTS)}


def _verdict_sql(name: str) -> str:
    return f"coalesce(CASE WHEN (trace_id + {_STUB[name]}) % 6 > 0 THEN ((trace_id * {_STUB[name] + 3}) % 11)::DOUBLE END, 5.0::DOUBLE) / 10.0::DOUBLE * {judge.WEIGHTS[name]}::DOUBLE"


_JUDGED = f"{NEXT} j AS (SELECT trace_id, trace, left(sha256('p' || trace_id || '|||' || trace), 16) AS cache_key, {' + '.join(_verdict_sql(n) for n in _STUB)} AS judge_score FROM traces)"


def _judged(spark, sf_dir):
    k = F.col("trace_id")
    verdict = {n: F.when((k + i) % 6 > 0, (k * (i + 3)) % 11) for n, i in _STUB.items()}
    key = judge.cache_key(F.concat(F.lit("p"), k.cast("string")), F.col("trace"))
    return traces(spark, sf_dir).select("trace_id", "trace", key.alias("cache_key"), judge.score(verdict).alias("judge_score"))


@query(f"{_JUDGED} SELECT trace_id, cache_key, round(judge_score, 9) AS judge_score FROM j")
def judge_score(spark, sf_dir):
    return _judged(spark, sf_dir).select("trace_id", "cache_key", F.round("judge_score", 9).alias("judge_score"))


@query(f"{_JUDGED} SELECT trace_id, round(CASE WHEN {_draw('judge', 'trace_id')} < 0.4::DOUBLE THEN length(trace) % 7 - 3 + (judge_score * 3 - 1) * 0.5::DOUBLE ELSE length(trace) % 7 - 3 END, 9) AS reward FROM j")
def judge_hybrid(spark, sf_dir):
    stub = (F.length("trace") % 7 - 3).cast("double")
    return _judged(spark, sf_dir).select("trace_id", F.round(judge.hybrid(stub, F.col("judge_score"), F.col("trace_id"), 0.4, 0.5), 9).alias("reward"))


@query(f"{_JUDGED} SELECT count(*) FILTER (trace_id % 3 <> 0) AS calls, count(*) FILTER (trace_id % 3 = 0) AS cache_hits, (count(*) FILTER (trace_id % 3 = 0))::DOUBLE / greatest(1, count(*)) AS cache_rate FROM j")
def judge_cache_stats(spark, sf_dir):
    rows = _judged(spark, sf_dir)
    cache = rows.where("trace_id % 3 = 0").select("cache_key", F.lit(True).alias("cached"))
    return judge.stats(rows.select("cache_key").join(cache, "cache_key", "left").select(F.coalesce("cached", F.lit(False)).alias("cached")))


@query(f"{WITH} SELECT trace_id, coalesce(substr(trim(regexp_extract(trace, '(?s)user「([^」]+)」', 1), ' ' || chr(10)), 1, 500), '') AS request FROM traces WHERE regexp_matches(trace, 'user「[^」]+」')")
def judge_requests(spark, sf_dir):
    return traces(spark, sf_dir).where(lex.has("trace", "user「[^」]+」")).select("trace_id", lex.user_request("trace").alias("request"))


# Rolling log over events.


def _log(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("value") - 20).alias("score"))


_LOG = "WITH g AS (SELECT event_id AS seq, value - 20 AS score FROM events)"
_STATS = f"""{_LOG}, s AS (SELECT seq, score, min(score) OVER w AS min_score, max(score) OVER w AS max_score, avg(score) OVER w AS mean_score, row_number() OVER (ORDER BY seq) AS n_total FROM g WINDOW w AS (ORDER BY seq ROWS 4999 PRECEDING)),
t AS (SELECT *, least(min_score - 0.5::DOUBLE, -3.0::DOUBLE) AS lo, greatest(max_score + 0.5::DOUBLE, 4.0::DOUBLE) AS hi FROM s),
b AS (SELECT *, greatest(0, least(8, CAST(trunc((score - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END * 8) AS INT))) AS level FROM t)"""


@query(f"{_LOG} SELECT seq, round(avg(CASE WHEN score > 0 THEN 1.0::DOUBLE ELSE 0.0 END) OVER (ORDER BY seq ROWS 49 PRECEDING), 9) AS valid_rate FROM g")
def rolling_valid_rate(spark, sf_dir):
    return rolling.valid_rate(_log(spark, sf_dir)).select("seq", F.round("valid_rate", 9).alias("valid_rate"))


@query(f"{_STATS} SELECT seq, min_score, max_score, floor(mean_score * 1000000 + 0.3::DOUBLE) / 1000000 AS mean_score, n_total, lo, hi FROM t")
def rolling_reward_stats(spark, sf_dir):
    return rolling.reward_stats(_log(spark, sf_dir)).select("seq", "min_score", "max_score", (F.floor(F.col("mean_score") * 1000000 + 0.3) / 1000000).alias("mean_score"), "n_total", "lo", "hi")


@query(f"{_STATS} SELECT seq, level FROM b")
def sparkline_bucket(spark, sf_dir):
    s = rolling.reward_stats(_log(spark, sf_dir))
    return s.select("seq", rolling.bar_level(F.col("score"), F.col("lo"), F.col("hi")).alias("level"))


@query(f"""{_STATS}, z AS (SELECT seq, score, (SELECT lo FROM t ORDER BY seq DESC LIMIT 1) AS lo, (SELECT hi FROM t ORDER BY seq DESC LIMIT 1) AS hi FROM t ORDER BY seq DESC LIMIT 60)
SELECT string_agg([' ', '▁', '▂', '▃', '▄', '▅', '▆', '▇', '█'][greatest(0, least(8, CAST(trunc((score - lo) / (hi - lo) * 8) AS INT))) + 1], '' ORDER BY seq) AS line FROM z""")
def sparkline(spark, sf_dir):
    return rolling.sparkline(_log(spark, sf_dir))


@query(f"{_LOG} SELECT seq, score, seq = (SELECT max(seq) FROM g) AS latest FROM g ORDER BY seq DESC LIMIT 10")
def latest_and_recent(spark, sf_dir):
    log = _log(spark, sf_dir)
    last = rolling.latest(log).select(F.col("seq").alias("last"))
    return rolling.recent(log).join(F.broadcast(last), F.col("seq") == F.col("last"), "left").select("seq", "score", F.col("last").isNotNull().alias("latest"))


@query("""SELECT event_id, CASE WHEN contains(l, '[ERROR]') OR contains(l, 'Error') THEN 'error' WHEN contains(l, '[WARN]') OR contains(l, 'Warning') THEN 'warning' WHEN contains(l, '[Judge]') THEN 'judge' WHEN contains(l, '[Reward]') THEN 'reward' WHEN contains(l, '✓') THEN 'ok' WHEN contains(l, '✗') THEN 'failed' ELSE 'other' END AS severity
FROM (SELECT event_id, ['[ERROR] ✓', '[Reward] Warning', '[Judge] [Reward]', '[Reward] ✓', '✓ ✗', '✗', 'plain'][event_id % 7 + 1] || event_type AS l FROM events)""")
def log_severity(spark, sf_dir):
    marks = F.array(*[F.lit(x) for x in ("[ERROR] ✓", "[Reward] Warning", "[Judge] [Reward]", "[Reward] ✓", "✓ ✗", "✗", "plain")])
    line = F.concat(F.element_at(marks, (F.col("event_id") % 7 + 1).cast("int")), "event_type")
    return _table(spark, sf_dir, "events").select("event_id", lex.severity(line).alias("severity"))


@query(f"""{_LOG}, m AS (SELECT seq, score, CAST(CAST(round(score, 2) AS DECIMAL(12, 2)) AS VARCHAR) AS v, CASE WHEN seq % 3 = 0 THEN CAST(CAST(round((seq % 101) / 100.0::DOUBLE, 2) AS DECIMAL(12, 2)) AS VARCHAR) END AS j, avg(score) OVER (ORDER BY seq ROWS 49 PRECEDING) AS mean FROM g)
SELECT seq, '[' || seq || '] ' || CASE WHEN score > 1.5::DOUBLE THEN '✓' WHEN score > 0 THEN '~' ELSE '✗' END || ' verifier=' || v || CASE WHEN j IS NOT NULL AND seq % 101 <> 0 THEN ' | judge=' || j ELSE '' END AS line,
 CASE WHEN seq % 10 = 0 AND seq <> 0 THEN '  Step ' || seq || ': reward_mean=' END AS step, CASE WHEN seq % 10 = 0 AND seq <> 0 THEN round(mean, 6) END AS reward_mean FROM m""")
def plain_log(spark, sf_dir):
    judge_score = F.when(F.col("seq") % 3 == 0, (F.col("seq") % 101) / 100)
    rows = rolling.plain_log(_log(spark, sf_dir).withColumn("judge", judge_score), "seq", "score", "judge")
    return rows.select("seq", "line", F.regexp_extract("step_line", r"^(.*reward_mean=)", 1).alias("step"), F.round("reward_mean", 6).alias("reward_mean"))


@query("""WITH p AS (SELECT event_type, user_id, count(*) AS n, count(*) FILTER (value > 20) AS n_passed FROM events GROUP BY event_type, user_id),
r AS (SELECT *, n_passed / n::DOUBLE AS rate, row_number() OVER (PARTITION BY event_type ORDER BY n_passed / n::DOUBLE, md5(CAST(user_id AS VARCHAR)), user_id) - 1 AS rank, count(*) OVER (PARTITION BY event_type) AS of FROM p)
SELECT event_type, user_id, n, n_passed, rank, CASE WHEN rank < floor(of * 0.2::DOUBLE) THEN 'hard' WHEN rank >= of - floor(of * 0.2::DOUBLE) THEN 'easy' ELSE 'kept' END AS difficulty FROM r""")
def difficulty_filter(spark, sf_dir):
    """Users stand for problems and their events for rollouts, of which those above 20 pass."""
    rolls = _table(spark, sf_dir, "events").select("event_type", "user_id", (F.col("value") > 20).alias("passed"))
    return planning.by_difficulty(rolls, "event_type", "user_id", "passed").select("event_type", "user_id", "n", "n_passed", "rank", "difficulty")
