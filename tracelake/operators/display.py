"""Blocks and syntax classes of a trace for display (no markup: positions and kinds only)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.pieces import mapped, pieces

# fixed values: block kinds and syntax classes
KINDS = ("system", "tool", "user", "plan", "act", "result", "response")

_SYNTAX = re.compile(
    r"""(?P<special>「[^」]*」)|(?P<string>"[^"]*")|(?P<comment>//[^\n]*)|(?P<tag>🏷\s*\S+)|(?P<reference>※\s*(?:\[[^\]]+\]|\S+))"""
    r"""|(?P<satisfies>⊨\s*\d+)|(?P<confidence>𝑝\s*[\d.]+)|(?P<operator>[↦•])"""
    r"""|(?P<keyword>\b(?:system|tool|user|plan|act|result|response|todo|call|think|data|error|name|params|type|enum|required|description|rationale|id)\b)"""
)


def blocks(trace: str) -> list[tuple[str, str]]:
    """(type, text): lines up to the one on which the braces are balanced; blank ones go; type by prefix or empty."""
    out, lines, depth = [], [], 0
    for line in [*trace.split("\n"), None]:
        if line is not None:
            lines.append(line)
            depth += line.count("{") - line.count("}")
        if line is None or depth == 0:
            text = "\n".join(lines).strip()
            if text:
                out.append((next((k for k in KINDS if text.startswith(k)), ""), text))
            lines = []
    return out


def syntax(text: str) -> list[tuple[str, int, int]]:
    """(class, start, end) of what stands out, left to right, without overlaps."""
    return [(m.lastgroup, *m.span()) for m in _SYNTAX.finditer(text)]


def syntax_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per token: key, class, start, end (exclusive, in characters) and token, by a table function over whole batches.

    Null texts and texts without tokens have no rows; key may be of any type and need not be unique.
    """

    @F.arrow_udtf(returnType=f"key {df.schema[key].dataType.simpleString()}, class string, start int, end int, token string")
    class Tokens:
        def eval(self, rows: pa.RecordBatch):
            i = 0
            for some in pieces(rows.column("text")):
                at, found = [], []
                for i, t in enumerate(some.to_pylist(), i):
                    own = [(*x, t[x[1] : x[2]]) for x in syntax(t or "")]
                    at += [i] * len(own)
                    found += own
                i += 1
                cols = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays([rows.column("key").take(pa.array(at, pa.int64())), *cols], ["key", "class", "start", "end", "token"])

    return Tokens(df.select(F.col(key).alias("key"), F.col(text).alias("text")).asTable()).withColumnRenamed("key", key)


def block_rows(text: Column | str) -> Column:
    """array<struct<type, text>>, to be exploded."""

    @F.arrow_udf("array<struct<type:string,text:string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string())]))
        return mapped(batches, lambda texts: [[{"type": k, "text": b} for k, b in blocks(t)] for t in texts], kind)

    return run(F.col(text) if isinstance(text, str) else text)
