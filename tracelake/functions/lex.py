"""Column expressions over trace text: what a text mentions, counts and positions.

(?U) gives white space, digits and word characters their Unicode meaning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the trace language.
SYSTEM = "system「[^」]*」"
USER = "user「[^」]*」"
RESPONSE = "response「[^」]*」"
PLAN = r"plan\s*\{([^}]*)\}"
TAG = r"""🏷\s*["']?([^"'\s•}]+)["']?"""
DATA_TAG = r"""data\s*↦\s*["「][^"」]*["」]\s*🏷\s*(\S+)"""
REFERENCE = r"""※\s*(?:\[\s*([^\]]+)\s*\]|["']?([^"'\s•}]+)["']?)"""
SATISFIES = r"⊨\s*(\d+)"
SATISFIES_LIST = r"⊨\s*\[([^\]]+)\]"
CONFIDENCE = r"𝑝\s*([\d.]+)"
TODO = r"""(\d+)\s*↦\s*["'][^"']+["']"""
FIRST_TODOS = r"(?s)plan\s*\{.*?todo\s*↦\s*\{([^}]*)\}"
TODO_OPEN = r'(\d+)\s*↦\s*[「"]'
BLOCK_TAG = r"result\s*\{[^}]*\}\s*🏷"

Text = Column | str


def _c(text: Text) -> Column:
    return F.col(text) if isinstance(text, str) else text


def has(text: Text, pattern: str) -> Column:
    return F.regexp_like(_c(text), F.lit("(?U)" + pattern))


def every(text: Text, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(_c(text), F.lit("(?U)" + pattern), F.lit(group))


def strip(text: Text) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def members(lists: Column) -> Column:
    """Items of bodies of bracketed lists: split at the separator, stripped of white space and then of quotes."""
    items = F.flatten(F.transform(lists, lambda x: F.split(x, "•")))
    return F.filter(F.transform(items, lambda x: F.btrim(strip(x), F.lit("\"'"))), lambda x: x != "")


def _set(items: Column) -> Column:
    return F.array_sort(F.array_distinct(items))


def _ints(items: Column) -> Column:
    return _set(F.array_compact(F.transform(items, lambda x: x.try_cast("int"))))


def find(text: Text, what: str) -> Column:
    """First position from 0 in code points, -1 if absent."""
    return F.instr(_c(text), what) - 1


def occurrences(text: Text, what: str) -> Column:
    t = _c(text)
    return (F.length(t) - F.length(F.replace(t, F.lit(what), F.lit("")))) / len(what)


def count_of(text: Text, what: str) -> Column:
    return occurrences(text, what).cast("long")


def tags_defined(text: Text) -> Column:
    return _set(F.concat(every(text, TAG), every(text, DATA_TAG)))


def tags_referenced(text: Text) -> Column:
    lists = F.filter(every(text, REFERENCE, 1), lambda x: x != "")
    single = F.filter(every(text, REFERENCE, 2), lambda x: x != "")
    return _set(F.concat(members(lists), single))


def todos_defined(text: Text) -> Column:
    """Of all plans."""
    return _ints(F.flatten(F.transform(every(text, PLAN), lambda p: F.regexp_extract_all(p, F.lit("(?U)" + TODO), F.lit(1)))))


def todos_satisfied(text: Text) -> Column:
    """Single markers only."""
    return _ints(every(text, SATISFIES))


def first_plan_todos(text: Text) -> Column:
    """Of the first plan with a todo section."""
    return _ints(every(F.regexp_extract(_c(text), "(?U)" + FIRST_TODOS, 1), TODO_OPEN))


def all_satisfied(text: Text) -> Column:
    """Single markers and lists."""
    listed = F.filter(F.flatten(F.transform(every(text, SATISFIES_LIST), lambda x: F.split(x, "•"))), lambda x: F.regexp_like(strip(x), F.lit(r"(?U)^\d+$")))
    return _ints(F.concat(every(text, SATISFIES), F.transform(listed, strip)))


def confidences(text: Text) -> Column:
    return every(text, CONFIDENCE)


def flags(text: Text) -> Column:
    """has_tools, has_error, multi_turn, n_lines."""
    t = _c(text)
    return F.struct(
        t.contains("tool {").alias("has_tools"),
        F.lower(t).contains("error:").alias("has_error"),
        (count_of(t, "user「") > 1).alias("multi_turn"),
        F.size(F.split(t, r"\r?\n", -1)).cast("long").alias("n_lines"),
    )


def search(text: Text, what: str) -> Column:
    """Case-insensitive; an empty search matches all."""
    return F.lower(_c(text)).contains(what.lower())


def user_request(prompt: Text) -> Column:
    """First non-empty user block, else the chat template's user turn (both stripped and cut to 500), else the last 500 characters."""
    p = _c(prompt)
    # fixed patterns of the two forms a request may have
    block, chat = r"(?sU)user「([^」]+)」", r"(?sU)<\|im_start\|>user\s*(.+?)(?:<\|im_end\|>|$)"
    cut = lambda pattern: F.left(strip(F.regexp_extract(p, pattern, 1)), F.lit(500))
    return F.when(F.regexp_like(p, F.lit(block)), cut(block)).when(F.regexp_like(p, F.lit(chat)), cut(chat)).otherwise(F.right(p, F.lit(500)))


def truncate(text: Text, most: int | None = 4000) -> Column:
    """First characters; no limit where most is None or not positive."""
    return F.left(_c(text), F.lit(most)) if most and most > 0 else _c(text)


def lenient_object(text: Text) -> Column:
    """A JSON object as VARIANT: the text itself, a fenced block, or a flat object that names "coherence"; else {}."""
    t = _c(text)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    named = F.regexp_extract(t, r'(?s)\{[^{}]*"coherence"[^{}]*\}', 0)
    return F.coalesce(F.try_parse_json(t), F.try_parse_json(F.nullif(fenced, F.lit(""))), F.try_parse_json(F.nullif(named, F.lit(""))), F.parse_json(F.lit("{}")))


def lenient_array(text: Text) -> Column:
    """The elements of a JSON array, as JSON texts: the text itself, or its outermost bracketed part; else none."""
    t = _c(text)
    part = F.regexp_extract(t, r"(?s)\[.*\]", 0)
    parsed = F.coalesce(F.try_parse_json(t), F.try_parse_json(F.nullif(part, F.lit(""))))
    items = F.try_variant_get(parsed, "$", "array<variant>")
    return F.coalesce(F.transform(items, lambda x: F.to_json(x)), F.array().cast("array<string>"))


def preview(text: Text, most: int = 60) -> Column:
    t = strip(F.replace(_c(text), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most - 3)), F.lit("..."))).otherwise(t)


def assistant_segment(text: Text) -> Column:
    return strip(F.substring_index(F.substring_index(_c(text), "<|im_start|>assistant", -1), "<|im_end|>", 1))


def until_stop(text: Text, stop: str = "<|im_end|>") -> Column:
    return F.substring_index(_c(text), stop, 1)


def severity(line: Text) -> Column:
    """Class of a log line by the first rule that holds."""
    t = _c(line)
    rules = [("error", ["[ERROR]", "Error"]), ("warning", ["[WARN]", "Warning"]), ("judge", ["[Judge]"]), ("reward", ["[Reward]"]), ("ok", ["✓"]), ("failed", ["✗"])]
    out = F.lit("other")
    for name, marks in reversed(rules):
        hit = t.contains(marks[0])
        for m in marks[1:]:
            hit = hit | t.contains(m)
        out = F.when(hit, name).otherwise(out)
    return out
