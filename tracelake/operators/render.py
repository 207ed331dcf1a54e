"""Typed traces and tools to text, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOOL = "struct<name:string,description:string,params:array<struct<name:string,type:string,enum_values:array<string>,required:boolean,description:string>>>"
STEP = (
    "struct<step_type:string,plan:struct<todos:array<struct<number:int,text:string>>,rationale:string>,"
    "act:struct<think:struct<content:string,confidence:double,refs:array<string>,tag:string,satisfies:int>,calls:array<struct<tool:string,args:array<struct<name:string,value:string>>,id:string,refs:array<string>,satisfies:int>>>,"
    "result:struct<data:string,tag:string>,response:struct<content:string,refs:array<string>,satisfies:int>>"
)
TRACE = f"system struct<content:string,tag:string>, tools array<{TOOL}>, user struct<content:string,tag:string>, steps array<{STEP}>"
PARAM_TYPES = ["string", "number", "integer", "boolean", "array", "object"]


def _line(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _if(test: Column, *parts) -> Column:
    return F.when(test, _line(*parts)).otherwise("")


def _refs(refs: Column) -> Column:
    quoted = F.transform(refs, lambda r: _line('"', r, '"'))
    return F.when(F.size(refs) > 1, _line(" ※ [", F.array_join(quoted, " • "), "]")).when(F.size(refs) == 1, _line(" ※ ", quoted[0])).otherwise("")


def _tool(t: Column) -> Column:
    def param(p: Column) -> Column:
        parts = F.array_compact(F.array(
            F.when(p["type"] != "enum", _line("            type ↦ ", p["type"])),
            F.when(F.size(p["enum_values"]) > 0, _line("            enum ↦ [ ", F.array_join(p["enum_values"], " • "), " ]")),
            F.when(~p["required"], F.lit("            required ↦ false")),
            F.when(p["description"] != "", _line('            description ↦ "', p["description"], '"')),
        ))
        return _line("        ", p["name"], " ↦ {\n", F.array_join(parts, " •\n"), "\n        }")

    params = _if(F.size(t["params"]) > 0, "    params ↦ {\n", F.array_join(F.transform(t["params"], param), " •\n"), "\n    }\n")
    return _line("tool {\n    name ↦ ", t["name"], " •\n", params, "}\n")


def _step(s: Column) -> Column:
    plan, think, result, response = s["plan"], s["act"]["think"], s["result"], s["response"]
    todos = F.transform(plan["todos"], lambda i: _line("        ", i["number"].cast("string"), ' ↦ "', i["text"], '"'))
    planned = _line("plan {\n    todo ↦ {\n", F.array_join(todos, " •\n"), _if(F.size(todos) > 0, "\n"), '    } •\n    rationale ↦ "', plan["rationale"], '"\n}')
    thought = _line(
        '    think ↦ "', think["content"], '"', _if(think["confidence"] >= 0, " 𝑝 ", think["confidence"].cast("string")), _refs(think["refs"]),
        _if(think["tag"] != "", " 🏷 ", think["tag"]), _if(think["satisfies"] > 0, " ⊨ ", think["satisfies"].cast("string")),
    )

    def call(c: Column) -> Column:
        args = F.array_join(F.transform(c["args"], lambda a: _line("        ", a["name"], ' ↦ "', a["value"], '" •\n')), "")
        return _line("    call ↦ {\n        tool ↦ ", c["tool"], " •\n", args, '        id ↦ "', c["id"], '"\n    }', _if(c["satisfies"] > 0, " ⊨ ", c["satisfies"].cast("string")))

    parts = F.concat(F.when(think["content"] != "", F.array(thought)).otherwise(F.array().cast("array<string>")), F.transform(s["act"]["calls"], call))
    acted = _line("act {\n", F.array_join(parts, " •\n"), "\n}")
    resulted = _line('result {\n    data ↦ "', result["data"], '"\n} 🏷 "', result["tag"], '"')
    said = _line("response「", response["content"], "」", _refs(response["refs"]), _if(response["satisfies"] > 0, " ⊨ ", response["satisfies"].cast("string")))
    body = F.when(s["step_type"] == "plan", planned).when(s["step_type"] == "act", acted).when(s["step_type"] == "result", resulted).when(s["step_type"] == "response", said).otherwise("")
    return F.concat(body, F.when(body != "", "\n").otherwise(""))


def trace_text(system: Column, tools: Column, user: Column, steps: Column) -> Column:
    """A typed trace (TRACE; empty text and sentinels mean absent) as text. Tool descriptions and call references are not
    written; a result's tag stands on the block."""
    head = _line("system「", system["content"], "」", _if(system["tag"] != "", " 🏷 ", system["tag"]), "\n")
    asked = _line("user「", user["content"], "」🏷 ", user["tag"], "\n")
    parts = F.concat(F.array(head), F.transform(tools, _tool), F.array(asked), F.transform(steps, _step))
    return F.regexp_replace(F.array_join(parts, "\n"), r"(?U)^\s+|\s+\z", "")


def tools_text(tools: Column) -> Column:
    """array<struct<name, description, params map<string,string>>> as one line per tool; unknown types become string,
    a missing name unknown, a missing description empty."""

    def one(t: Column) -> Column:
        kind = lambda v: F.when(v.isin(*PARAM_TYPES), v).otherwise("string")
        params = F.transform(F.map_entries(t["params"]), lambda e: _line(e["key"], " ↦ { type ↦ ", kind(e["value"]), " }"))
        listed = F.when(F.size(params) > 0, _line(" • params ↦ { ", F.array_join(params, " • "), " }")).otherwise("")
        return _line("tool { name ↦ ", F.coalesce(t["name"], F.lit("unknown")), ' • description ↦ "', F.coalesce(t["description"], F.lit("")), '"', listed, " }")

    return F.coalesce(F.array_join(F.transform(tools, one), "\n"), F.lit(""))
