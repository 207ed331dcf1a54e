"""Prompts for training from raw lines: wrap, split at the assistant marker, count what was skipped, cap in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.ordered import running_sum, unused

MARK, OPEN = "<|im_start|>assistant", "<|im_start|>"


def derive(df: DataFrame, most: int | None = 50_000, prompt: str = "prompt", trace: str = "trace") -> DataFrame:
    """df with out (the derived prompt or null) and status: prompt, split, skipped_malformed or skipped_long.

    A row with a prompt keeps it, wrapped into a system turn unless it opens with a turn marker; any other is cut at the
    first assistant marker of its trace, is malformed without one, and too long if more than most characters follow.
    """
    p, t = F.col(prompt), F.coalesce(F.col(trace), F.lit(""))
    at = F.instr(t, MARK)
    rest = F.length(t) - (at - 1) - len(MARK)
    long_ = (rest > most) if most else F.lit(False)
    status = F.when(p.isNotNull(), "prompt").when(at == 0, "skipped_malformed").when(long_, "skipped_long").otherwise("split")
    wrapped = F.when(p.startswith(OPEN), p).otherwise(F.concat(F.lit("<|im_start|>system\n"), p, F.lit("\n<|im_end|>\n<|im_start|>assistant\n")))
    cut = F.concat(F.left(t, at - 1), F.lit(MARK + "\n"))
    out = F.when(F.col("status") == "prompt", wrapped).when(F.col("status") == "split", cut)
    return df.withColumn("status", status).withColumn("out", out)


def capped(derived: DataFrame, order: str, most: int | None) -> DataFrame:
    """The lines that are looked at when reading in order stops once most prompts are accepted (None or 0: all)."""
    if not most:
        return derived
    taken = F.col("out").isNotNull().cast("long")
    (upto,) = unused(derived, "upto")
    return running_sum(derived, order, taken, upto).where(F.col(upto) - taken < most).drop(upto)


def counters(seen: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s)
    return seen.agg(F.count("*").alias("total"), F.count_if(F.col("out").isNotNull()).alias("accepted"), is_("skipped_long").alias("skipped_long"), is_("skipped_malformed").alias("skipped_malformed"))


def environment(prompts: DataFrame, task: str = "trace") -> DataFrame:
    return prompts.where("out is not null").select(F.col("out").alias("prompt"), F.lit(task).alias("task"))


def scenario_prompt(system: Column, tools: Column, request: Column) -> Column:
    """Text of a scenario: system, tools (text, may be empty) and user blocks with blank lines between; null unless
    system and request say something."""
    ok = (F.coalesce(system, F.lit("")) != "") & (F.coalesce(request, F.lit("")) != "")
    parts = [F.concat(F.lit("system「"), system, F.lit("」🏷 sys1")), F.nullif(F.coalesce(tools, F.lit("")), F.lit("")), F.concat(F.lit("user「"), request, F.lit("」🏷 usr1"))]
    return F.when(ok, F.concat_ws("\n\n", *parts))


def inference_prompt(user: Column, system: Column | None = None, tools: Column | None = None) -> Column:
    """Chat prompt that ends with the assistant opener; tools: array<struct<name, description, params map<string,string>>>."""
    # fixed text
    default = F.lit("You are a helpful AI assistant that completes tasks step by step.")
    s = F.coalesce(F.nullif(system, F.lit("")), default) if system is not None else default
    line = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    def tool(t: Column) -> Column:
        params = F.transform(F.map_entries(t["params"]), lambda e: line("        ", e["key"], " ↦ { type ↦ ", e["value"], " }"))
        block = F.when(F.size(params) > 0, line("    params ↦ {\n", F.array_join(params, "\n"), "\n    }"))
        about = F.when(F.coalesce(t["description"], F.lit("")) != "", line('    description ↦ "', t["description"], '" •'))
        return F.concat_ws("\n", F.lit("tool {"), line("    name ↦ ", t["name"], " •"), about, block, F.lit("}"))

    own = F.nullif(F.array_join(F.transform(tools, tool), "\n"), F.lit("")) if tools is not None else F.lit(None).cast("string")
    return F.concat_ws("\n", F.lit("<|im_start|>system"), line("system「", s, "」🏷 sys1"), own, F.lit("<|im_end|>\n"), F.lit("<|im_start|>user"), line("user「", user, "」🏷 usr1"), F.lit("<|im_end|>\n"), F.lit("<|im_start|>assistant"))
