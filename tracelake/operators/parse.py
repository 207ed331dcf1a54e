"""Parse facts of traces as one Arrow UDF over batches, and the reward rubric as native arithmetic over the facts.

Well-formed texts are answered for a whole batch at once by the structural index; the scanner reads the others one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.pieces import pieces
from tracelake.operators import index
from tracelake.operators.scanner import scan

FACTS = (
    "blocks array<string>, sizes array<int>, defined_tags array<string>, referenced_tags array<string>, defined_todos array<int>, "
    "satisfied_todos array<double>, defined_tools array<string>, called_tools array<string>, call_ids array<string>, "
    "result_ids array<string>, errors array<string>, warnings array<string>, valid boolean, length long"
)


def facts_of(text: str | None, strict: bool) -> dict:
    f = scan(text or "", strict)
    texts = lambda s: sorted(map(str, s))
    return {
        "blocks": f.blocks, "sizes": f.sizes, "defined_tags": texts(f.defined_tags), "referenced_tags": texts(f.referenced_tags),
        "defined_todos": sorted(x for x in f.defined_todos if abs(x) < 1 << 31), "satisfied_todos": sorted(map(float, f.satisfied_todos)),
        "defined_tools": texts(f.defined_tools), "called_tools": texts(f.called_tools), "call_ids": texts(f.call_ids), "result_ids": texts(f.result_ids),
        "errors": f.errors, "warnings": f.warnings, "valid": not f.errors, "length": len(text or ""),
    }


def facts_of_batch(texts: pa.Array, strict: bool, limit: int = 8 << 20) -> pa.Array:
    """Facts of all texts (a struct array), in order; a null text is empty. limit: bytes of text indexed at once."""
    out = []
    for some in pieces(texts, limit):
        whole, ok = index.facts(some, strict)
        if not ok.all():
            rest = pa.array([facts_of(t, strict) for t in some.filter(pa.array(~ok)).to_pylist()], whole.type)
            place = np.where(ok, np.cumsum(ok) - 1, ok.sum() + np.cumsum(~ok) - 1)
            whole = pa.concat_arrays([whole.filter(pa.array(ok)), rest]).take(pa.array(place))
        out.append(whole)
    return pa.concat_arrays(out) if out else index.facts(texts, strict)[0]


def parse(text: Column | str, strict: bool = True) -> Column:
    """Facts of a trace as a struct (FACTS). Marked non-deterministic so that it is evaluated once; write filters on
    plain columns before it."""

    @F.arrow_udf(FACTS)
    def run(texts: pa.Array) -> pa.Array:
        return facts_of_batch(texts, strict)

    return run.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


COMPONENTS = ["parse_valid", "has_plan", "has_response", "structure_order", "todos_start_at_1", "todos_satisfied", "refs_valid", "tools_valid", "call_result_match", "warnings", "clean_ending", "output_length"]


def reward(p: Column) -> Column:
    """struct of the components (null where one does not apply) and their sum, added in this order, over parse facts."""
    d = lambda x: F.lit(float(x))
    n = lambda a: F.size(a).cast("double")
    plan, response = F.array_position(p["blocks"], "plan"), F.array_position(p["blocks"], "response")
    todos = n(p["defined_todos"])
    undone = F.size(F.array_except(p["defined_todos"].cast("array<double>"), p["satisfied_todos"]))
    orphans = n(F.array_except(F.filter(p["referenced_tags"], lambda t: ~t.rlike(r"^(usr|sys)\d+$")), p["defined_tags"]))
    unknown = n(F.array_except(p["called_tools"], p["defined_tools"]))
    stray, missing = n(F.array_except(p["result_ids"], p["call_ids"])), n(F.array_except(p["call_ids"], p["result_ids"]))
    after = F.size(p["blocks"]) - response
    parts = {
        "parse_valid": F.when(p["valid"], d(1)).otherwise(d(-3)),
        "has_plan": F.when(plan > 0, d(0.3)).otherwise(d(-0.5)),
        "has_response": F.when(response > 0, d(0.5)).otherwise(d(-1.5)),
        "structure_order": F.when((plan == 0) | (response == 0), d(0)).when(plan < response, d(0.2)).otherwise(d(-0.3)),
        "todos_start_at_1": F.when(todos == 0, d(0)).when(F.array_min(p["defined_todos"]) == 1, d(0.3)).otherwise(d(-0.5)),
        "todos_satisfied": F.when(todos == 0, d(0)).when(undone == 0, d(0.5)).otherwise(F.try_divide(n(p["satisfied_todos"]), todos) * 0.5 - 0.3),
        "refs_valid": F.when(orphans == 0, d(0.3)).otherwise(-F.least(orphans * 0.1, d(0.5))),
        "tools_valid": F.when(F.size(p["called_tools"]) == 0, d(0)).when(F.size(p["defined_tools"]) == 0, d(-1.5)).when(unknown == 0, d(0.5)).otherwise(-F.least(unknown * 0.5, d(1.5))),
        "call_result_match": F.when((F.size(p["call_ids"]) == 0) & (F.size(p["result_ids"]) == 0), d(0)).when((stray == 0) & (missing == 0), d(0.4)).otherwise(-(F.least(stray * 0.3, d(0.6)) + F.least(missing * 0.1, d(0.3)))),
        "warnings": -F.least(n(p["warnings"]) * 0.05, d(0.3)),
        "clean_ending": F.when(response > 0, F.when(after == 0, d(0.3)).when(after <= 2, d(0.1)).otherwise(d(-0.5))),
        "output_length": F.when((response > 0) & (p["length"] > 100_000), d(-1)),
    }
    total = F.lit(0.0)
    for c in COMPONENTS:
        total = total + F.coalesce(parts[c], d(0))
    return F.struct(*[parts[c].alias(c) for c in COMPONENTS], total.alias("total"))


def score_class(total: Column) -> Column:
    return F.when(total > 1.5, "pass").when(total > 0, "mid").otherwise("fail")


def with_rewards(df: DataFrame, text: str = "trace", strict: bool = True) -> DataFrame:
    """df with facts, reward and class."""
    parsed = df.withColumn("facts", parse(text, strict))
    return parsed.withColumn("reward", reward(F.col("facts"))).withColumn("class", score_class(F.col("reward.total")))


SHOWN, SHOWN_ERRORS = 15, 5


def detail(rewarded: DataFrame, facts: str = "facts", reward_: str = "reward", shown: int = SHOWN, errors: int = SHOWN_ERRORS) -> DataFrame:
    """rewarded with detail, what a reader is shown of a trace: score, blocks (type, size), the sorted lists cut to their first shown
    items and messages to their first errors ones (with how many there were), calls without result and results without call."""
    f = lambda c: F.col(f"{facts}.{c}")
    lists = ["defined_tags", "referenced_tags", "defined_todos", "satisfied_todos", "defined_tools", "called_tools", "call_ids", "result_ids"]
    cut = [F.slice(f(c), 1, shown).alias(c) for c in lists] + [F.slice(f(c), 1, errors).alias(c) for c in ("errors", "warnings")]
    counts = [F.size(f(c)).alias(f"n_{c}") for c in (*lists, "errors", "warnings")]
    blocks = F.arrays_zip(f("blocks").alias("type"), f("sizes").alias("size"))
    pairs = [F.array_except(f("call_ids"), f("result_ids")).alias("calls_without_result"), F.array_except(f("result_ids"), f("call_ids")).alias("results_without_call")]
    parts = F.map_from_arrays(F.array(*[F.lit(c) for c in COMPONENTS]), F.array(*[F.col(f"{reward_}.{c}") for c in COMPONENTS]))
    return rewarded.withColumn("detail", F.struct(F.col(f"{reward_}.total").alias("score"), F.map_filter(parts, lambda k, v: v.isNotNull()).alias("rewards"), blocks.alias("blocks"), *cut, *counts, *pairs))


def summary(rewarded: DataFrame) -> DataFrame:
    t = F.col("reward.total")
    return rewarded.agg(F.count("*").alias("n"), F.round(F.avg(t), 6).alias("mean"), F.round(F.min(t), 6).alias("min"), F.round(F.max(t), 6).alias("max"), F.count_if(~F.col("facts.valid")).alias("n_parse_errors"), F.count_if(t > 1.5).alias("n_pass"))


def last_content(messages: Column) -> Column:
    """Content of the last message of a chat, the text a rubric sees."""
    return F.try_element_at(messages, F.lit(-1))["content"]
