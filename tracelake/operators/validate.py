"""The pattern-based validator as one projection of native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import lex

BALANCED = [("braces", "{", "}"), ("brackets", "[", "]"), ("special quotes", "「", "」")]


def _when(test: Column, message: Column | str) -> Column:
    return F.when(test, F.lit(message) if isinstance(message, str) else message)


def errors(text: Column) -> Column:
    """Messages in the order of the checks."""
    system, user, plan, response = (lex.has(text, p) for p in (lex.SYSTEM, lex.USER, lex.PLAN, lex.RESPONSE))
    at = {k: lex.find(text, k) for k in ("system", "user「", "plan {", "response「")}
    spelled = at["plan {"] >= 0
    first = [
        _when(~system, "Missing system message"),
        _when(~user, "Missing user message"),
        _when(~plan, "Missing plan block"),
        _when(~response, "Missing response"),
        _when(system & user & (at["user「"] < at["system"]), "User message appears before system message"),
        _when(user & plan & spelled & (at["plan {"] < at["user「"]), "Plan appears before user message"),
        _when(plan & response & spelled & (at["response「"] < at["plan {"]), "Response appears before plan"),
    ]
    numbers = F.transform(F.filter(lex.confidences(text), lambda x: x.try_cast("double").isNull()), lambda x: F.concat(F.lit("Invalid confidence value: "), x))
    last = []
    for name, a, b in BALANCED:
        opened, closed = lex.count_of(text, a), lex.count_of(text, b)
        last.append(_when(opened != closed, F.concat(F.lit(f"Unbalanced {name}: "), opened.cast("string"), F.lit(" open, "), closed.cast("string"), F.lit(" close"))))
    return F.concat(F.array_compact(F.array(*first)), numbers, F.array_compact(F.array(*last)))


def warnings(text: Column) -> Column:
    """(kind, item) pairs: undefined_reference, unsatisfied_todo, undefined_todo, confidence_range, result_block_tag."""
    pair = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("item"))
    defined, satisfied = lex.todos_defined(text), lex.todos_satisfied(text)
    above = F.filter(F.transform(lex.confidences(text), lambda x: x.try_cast("double")), lambda x: x > 1)
    block = F.when(lex.has(text, lex.BLOCK_TAG), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(
        F.transform(F.array_except(lex.tags_referenced(text), lex.tags_defined(text)), pair("undefined_reference")),
        F.transform(F.array_except(defined, satisfied), pair("unsatisfied_todo")),
        F.transform(F.array_except(satisfied, defined), pair("undefined_todo")),
        F.transform(above, pair("confidence_range")),
        F.transform(block, pair("result_block_tag")),
    )


def validation(text: Column | str) -> Column:
    """struct of valid, errors, warnings and the sorted sets of tags and todos. Null text is checked as empty."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    found = errors(t)
    return F.struct((F.size(found) == 0).alias("valid"), found.alias("errors"), warnings(t).alias("warnings"), lex.tags_defined(t).alias("tags_defined"), lex.tags_referenced(t).alias("tags_referenced"), lex.todos_defined(t).alias("todos_defined"), lex.todos_satisfied(t).alias("todos_satisfied"))


def with_validation(df: DataFrame, text: str = "trace", out: str = "validation") -> DataFrame:
    return df.withColumn(out, validation(text))


def keep_valid(df: DataFrame, text: str = "trace") -> DataFrame:
    """Valid rows with the attached sets (tags and todos defined, todos satisfied)."""
    v = F.col("_v")
    kept = df.withColumn("_v", validation(text)).where("_v.valid")
    return kept.withColumn("validation", F.struct(v["tags_defined"].alias("tags_defined"), v["todos_defined"].alias("todos_defined"), v["todos_satisfied"].alias("todos_satisfied"))).drop("_v")


def error_rows(df: DataFrame, text: str = "trace", key: str = "trace_id") -> DataFrame:
    return df.select(key, F.explode(errors(F.coalesce(text, F.lit("")))).alias("error"))


def warning_rows(df: DataFrame, text: str = "trace", key: str = "trace_id") -> DataFrame:
    return df.select(key, F.explode(warnings(F.coalesce(text, F.lit("")))).alias("w")).select(key, "w.kind", "w.item")


def summary(df: DataFrame, text: str = "trace") -> DataFrame:
    bad = F.size(errors(F.coalesce(F.col(text), F.lit("")))) > 0
    return df.select(bad.alias("bad")).agg(F.count("*").alias("n"), F.count_if(~F.col("bad")).alias("n_valid"), F.count_if("bad").alias("n_invalid"))
