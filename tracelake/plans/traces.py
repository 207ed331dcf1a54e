"""The table ``traces(trace_id, trace)``, written from ``conversations`` with known faults.

One SQL text serves Spark and DuckDB; only the ordered string aggregate is spelled differently. System turns, numbered
user turns and assistant turns become blocks of the trace language; conv_id decides which fault a trace carries, so that
every check of the validator fires on known rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fault by conv_id % 13; the rest have none.
FAULTS = {0: "no response", 1: "extra brace", 2: "undefined reference", 3: "open todo", 4: "tag on result block", 5: "confidence above 1", 6: "confidence not a number", 7: "tool error", 8: "unused tag"}

_TURNS = """
WITH turns AS (
  SELECT conv_id, turn, role, text,
    sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS u,
    sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER w AS a,
    row_number() OVER w AS k,
    conv_id % 13 AS f
  FROM {conversations} WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
blocks AS (
  SELECT conv_id, k,
    CASE WHEN k = 1 AND role <> 'system' AND conv_id % 3 <> 0 THEN 'system「You help.」🏷 sys1' || chr(10) ELSE '' END
    || CASE WHEN k = 1 AND conv_id % 4 < 2 THEN 'tool {' || chr(10) || '    name ↦ search_' || CAST(conv_id % 5 AS VARCHAR(20)) || ' •' || chr(10) || '    description ↦ "finds things"' || chr(10) || '}' || chr(10) ELSE '' END
    || CASE role
      WHEN 'system' THEN 'system「' || text || '」🏷 sys1' || chr(10)
      WHEN 'user' THEN 'user「' || text || '」🏷 usr' || CAST(u AS VARCHAR(20)) || chr(10)
      ELSE CASE WHEN a = 1 THEN 'plan {' || chr(10) || '    todo ↦ {' || chr(10) || '        1 ↦ "find data" •' || chr(10)
            || CASE WHEN f = 3 THEN '        3 ↦ "never done" •' || chr(10) ELSE '' END
            || '        2 ↦ "answer"' || chr(10) || '    } •' || chr(10) || '    rationale ↦ "asked for"' || chr(10) || '}' || chr(10) ELSE '' END
        || 'act {' || chr(10) || '    think ↦ 「weigh the request」' || CASE WHEN f = 8 THEN ' 🏷 unused_' || CAST(a AS VARCHAR(20)) ELSE '' END
        || ' 𝑝 ' || CASE f WHEN 5 THEN '1.5' WHEN 6 THEN '1.2.3' ELSE '0.9' END || ' ⊨ 1' || chr(10) || '}' || chr(10) || chr(10)
        || 'act {' || chr(10) || '    think ↦ "look it up"' || chr(10) || '}' || chr(10)
        || 'act {' || chr(10) || '    call ↦ { tool ↦ search_' || CAST(conv_id % 5 AS VARCHAR(20)) || ' • id ↦ "call' || CAST(a AS VARCHAR(20)) || '" }' || chr(10) || '}' || chr(10)
        || 'result {' || chr(10) || '    data ↦ "' || CASE WHEN f = 7 THEN 'Error: timed out' ELSE 'some rows' END || '"'
        || CASE WHEN f = 4 THEN chr(10) || '} 🏷 "call' || CAST(a AS VARCHAR(20)) || '"' ELSE ' 🏷 call' || CAST(a AS VARCHAR(20)) || chr(10) || '}' END || chr(10)
        || CASE WHEN f = 1 THEN '{' ELSE '' END
        || CASE WHEN f = 0 THEN '' ELSE 'response「' || text || '」 ※ [usr' || CAST(u AS VARCHAR(20)) || ' • call' || CAST(a AS VARCHAR(20)) || CASE WHEN f = 2 THEN ' • ghost' ELSE '' END || '] ⊨ 2' || chr(10) END
      END AS block
  FROM turns)
SELECT conv_id AS trace_id, {join} AS trace FROM blocks GROUP BY conv_id
"""


def sql(conversations: str = "conversations", engine: str = "duckdb") -> str:
    join = "string_agg(block, '' ORDER BY k)" if engine == "duckdb" else "listagg(block, '') WITHIN GROUP (ORDER BY k)"
    return _TURNS.replace("{conversations}", conversations).replace("{join}", join)


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").where("conv_id is not null and turn is not null and role is not null and text is not null")
    return spark.sql(_spark_sql(), rows=rows)


def _run(i: int) -> str:
    """Piece i of a trace of act_runs: a thought with or without operators, a call, both, two of one, a line, nothing."""
    nl = "chr(10)"
    act = lambda *lines: f" || {nl} || ".join(["'act {'", *(f"'    {x}'" for x in lines), "'}'"])
    call = f"call ↦ {{ tool ↦ find • args ↦ {{ n ↦ {i} }} • id ↦ \"c{i}\" }}"
    kinds = [
        act(f'think ↦ "look {i}"'), act(f"think ↦ 「weigh {i}」 🏷 t{i} ⊨ 1"), act(f'think ↦ "go on" ※ t{i - 1}'), act(f"{call} ⊨ 2"), act(f'think ↦ "both {i}" •', call), act(f'think ↦ "one" •', f"think ↦ 「two」 𝑝 0.{i}"),
        act(f"{call} •", "call ↦ { tool ↦ other }"), act("think ↦ bare"), f"'note {i}'", "''", "''", f"'result {{' || {nl} || '    data ↦ \"r{i}\" 🏷 c{i}' || {nl} || '}}'",
    ]
    pick = f"(p_partkey % {2 * i + 7} + p_size % {i + 3} * {i + 1}) % {len(kinds)}"
    return f"CASE {pick} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(kinds[:-1])) + f" ELSE {kinds[-1]} END"


#: Documents in the shape of parts, for traces that are built from short fields.
PARTS = "SELECT doc_id AS p_partkey, coalesce(source, 'none') AS p_name, coalesce(lang, 'none') AS p_brand, concat('kind ', CAST(doc_id % 7 AS VARCHAR(20))) AS p_type, CAST(n_chars % 50 AS INT) AS p_size FROM documents"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return spark.sql(PARTS.replace("FROM documents", "FROM {docs}"), docs=docs)


#: Per part a trace of eight acts and lines in ever other order, for a second user turn on every fourth.
ACT_RUNS = "'system「s' || chr(10) || 't」🏷 sys1' || chr(10) || " + " || chr(10) || ".join(["'user「' || p_name || '」🏷 usr1' || chr(10) || 'plan {' || chr(10) || '    todo ↦ { 1 ↦ \"a\" • 2 ↦ \"b\" }' || chr(10) || '}'", *map(_run, range(4)), "CASE WHEN p_size % 4 = 0 THEN 'response「so」' || chr(10) || 'user「more' || chr(10) || p_brand || '」' ELSE ' ' END", *map(_run, range(4, 8)), "'response「' || p_type || '」 ※ usr1'"])


def act_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).selectExpr("p_partkey AS trace_id", f"{ACT_RUNS} AS trace")


def _spark_sql() -> str:
    # a parameterised query formats its text once more, so braces of the trace language are written as chr()
    text = sql("@rows@", engine="spark").replace("{", "'||chr(123)||'").replace("}", "'||chr(125)||'")
    return text.replace("@rows@", "{rows}")
