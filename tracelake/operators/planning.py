"""Generation requests: quotas, batches, reproducible draws, request rows; matching responses; retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.ordered import unused
from tracelake.operators.validate import validation

# Subject areas of generated traces, default rates and bounds.
DOMAINS = ["coding", "data_analysis", "research", "writing", "planning", "math", "troubleshooting", "creative", "education", "business"]
ERROR_RATE, NO_TOOLS_RATE, FOLLOW_UP_RATE, MIN_STEPS, MAX_STEPS, BATCH = 0.2, 0.2, 0.3, 5, 50, 10


def draw(key: Column, purpose: str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on seed, purpose and key only."""
    return F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:{purpose}:"), key.cast("string"))), F.lit(8)), 16, 10).cast("double") / float(1 << 32)


def quotas(count: int, no_tools: float = NO_TOOLS_RATE, follow_up: float = FOLLOW_UP_RATE) -> list[tuple[bool, bool, int]]:
    """(has_tools, has_follow_ups, how many), in generation order; fractions are cut off."""
    bare = int(count * no_tools)
    out = []
    for has_tools, n in ((True, count - bare), (False, bare)):
        many = int(n * follow_up)
        out += [(has_tools, False, n - many), (has_tools, True, many)]
    return [q for q in out if q[2] > 0]


def batches(spark: SparkSession, count: int, **rates: float) -> DataFrame:
    """has_tools, has_follow_ups, batch, size: the quotas cut into batches of at most BATCH."""
    q = spark.createDataFrame(quotas(count, **rates), "has_tools boolean, has_follow_ups boolean, n long")
    cut = q.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BATCH).cast("long"))).alias("batch"))
    return cut.select("has_tools", "has_follow_ups", "batch", F.least(F.lit(BATCH), F.col("n") - F.col("batch") * BATCH).cast("long").alias("size"))


def batches_by(counts: DataFrame, count: str, no_tools: float = NO_TOOLS_RATE, follow_up: float = FOLLOW_UP_RATE) -> DataFrame:
    """``batches`` for every row of counts: its other columns, has_tools, has_follow_ups, batch, size."""
    rest = [F.col(f"`{c}`") for c in counts.columns if c != count]
    share = lambda n, rate: F.floor(n * F.lit(float(rate))).cast("long")
    n = F.col(f"`{count}`").cast("long")
    halves = F.array(F.struct(F.lit(True).alias("has_tools"), (n - share(n, no_tools)).alias("n")), F.struct(F.lit(False).alias("has_tools"), share(n, no_tools).alias("n")))
    some = counts.select(*rest, F.explode(halves).alias("h")).withColumn("many", share(F.col("h.n"), follow_up))
    quota = F.array(F.struct(F.lit(False).alias("f"), (F.col("h.n") - F.col("many")).alias("n")), F.struct(F.lit(True).alias("f"), F.col("many").alias("n")))
    each = some.select(*rest, "h.has_tools", F.explode(quota).alias("q")).where("q.n > 0")
    cut = each.select(*rest, "has_tools", F.col("q.f").alias("has_follow_ups"), F.col("q.n").alias("n"), F.explode(F.sequence(F.lit(0), F.floor((F.col("q.n") - 1) / BATCH).cast("long"))).alias("batch"))
    return cut.select(*rest, "has_tools", "has_follow_ups", "batch", F.least(F.lit(BATCH), F.col("n") - F.col("batch") * BATCH).cast("long").alias("size"))


def shuffled(df: DataFrame, key: str, count: int, seed: int = 0) -> DataFrame:
    return df.orderBy(draw(F.col(key), "shuffle", seed), key).limit(count)


def drawn(df: DataFrame, key: str, count: int, seed: int = 0, buckets: int = 4096) -> DataFrame:
    """The rows that ``shuffled`` keeps, with their place in it, without sorting them in one task.

    Draws are even, so rows are numbered in buckets of draws, and bucket totals are added up. key: unique, not null.
    """
    d, b, before, at = unused(df, "draw", "bucket", "before", "place")
    own = df.withColumn(d, draw(F.col(key), "shuffle", seed)).withColumn(b, F.floor(F.col(d) * buckets).cast("int"))
    totals = own.groupBy(b).agg(F.count("*").alias("n"))
    ahead = totals.select(b, F.coalesce(F.sum("n").over(Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before)).where(F.col(before) < count)
    ranked = own.join(F.broadcast(ahead), b)  # one row per bucket
    place = F.col(before) + F.row_number().over(Window.partitionBy(b).orderBy(d, key)) - 1
    return ranked.withColumn(at, place).where(F.col(at) < count).drop(d, b, before)


def by_difficulty(rollouts: DataFrame, group: str, problem: str, passed: str, easy: float = 0.2, hard: float = 0.2, prefix: int = 2) -> DataFrame:
    """One row per group and problem: n (rollouts), n_passed, rate, rank (from 0, hardest first), difficulty.

    The hardest and the easiest share of each group's problems, by the rate of rollouts that passed (shares are cut off to
    whole numbers), are hard and easy, the others kept. Equal rates go by a hash of the problem, then by the problem. A null in
    passed is a rollout that did not pass; null groups and problems are values like others. Ranks are taken in two
    levels: counts per group, rate and hash prefix are added up, and rows are numbered inside these only, so that a group,
    or a rate that most problems have, is no single task.
    """
    own = rollouts.select(F.col(group).alias("g"), F.col(problem).alias("p"), F.coalesce(F.col(passed), F.lit(False)).alias("ok"))
    rows = own.groupBy("g", "p").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_passed"))
    rows = rows.withColumn("rate", F.col("n_passed") / F.col("n")).withColumn("h", F.coalesce(F.md5(F.col("p").cast("string")), F.lit("~"))).withColumn("b", F.left("h", F.lit(prefix)))
    cells = rows.groupBy("g", "rate", "b").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("g").orderBy("rate", "b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("g").alias("_g"), F.col("rate").alias("_r"), F.col("b").alias("_b"), F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy("g")).alias("of"))
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("g", "rate", "b").orderBy("h", "p")))
    both = ranked.join(cells, F.col("g").eqNullSafe(F.col("_g")) & (F.col("rate") == F.col("_r")) & (F.col("b") == F.col("_b")))
    rank = F.col("before") + F.col("k") - 1
    cut = lambda share: F.floor(F.col("of") * F.lit(float(share)))
    kind = F.when(F.col("rank") < cut(hard), "hard").when(F.col("rank") >= F.col("of") - cut(easy), "easy").otherwise("kept")
    return both.withColumn("rank", rank).select(F.col("g").alias(group), F.col("p").alias(problem), "n", "n_passed", "rate", "rank", kind.alias("difficulty"))


def plan(spark: SparkSession, count: int, seed: int = 0) -> DataFrame:
    """One row per request: idx, custom_id, has_tools, has_follow_ups, include_error, num_steps, domain. The first
    int(count * NO_TOOLS_RATE) rows have no tools; errors need tools."""
    i = F.col("idx")
    steps = F.floor(draw(i, "steps", seed) * (MAX_STEPS - MIN_STEPS + 1)).cast("int") + MIN_STEPS
    domain = F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), F.floor(draw(i, "domain", seed) * len(DOMAINS)).cast("int") + 1)
    rows = spark.range(count).withColumnRenamed("id", "idx").withColumn("has_tools", i >= int(count * NO_TOOLS_RATE))
    return rows.select("idx", F.concat(F.lit("trace-"), i.cast("string")).alias("custom_id"), "has_tools", (draw(i, "follow_up", seed) < FOLLOW_UP_RATE).alias("has_follow_ups"), (F.col("has_tools") & (draw(i, "error", seed) < ERROR_RATE)).alias("include_error"), steps.alias("num_steps"), domain.alias("domain"))


def requests(planned: DataFrame, model: str, messages: Column) -> DataFrame:
    """Rows for a batch file: custom_id, method, url, body struct; messages: array<struct<role, content>>."""
    return planned.select("custom_id", F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), F.struct(F.lit(model).alias("model"), messages.alias("messages")).alias("body"))


def trace_messages(scenario: Column, include_error: Column, steps: Column, system: str, example: str) -> Column:
    """Chat for one scenario (struct with domain, system_prompt, tools, user_request, follow_up_requests)."""
    tools = F.transform(scenario["tools"], lambda t: F.concat(F.lit("- "), t["name"], F.lit("("), F.array_join(F.transform(t["params"], lambda p: p["name"]), ", "), F.lit("): "), t["description"]))
    some = F.size(scenario["tools"]) > 0
    more = F.transform(scenario["follow_up_requests"], lambda r, i: F.concat(F.lit("  - usr"), (i + 2).cast("string"), F.lit(': "'), r, F.lit('"')))
    ask = F.concat_ws(
        "\n",
        F.concat(F.lit("Domain: "), scenario["domain"]),
        F.concat(F.lit("System: "), scenario["system_prompt"]),
        F.concat(F.lit("Request: "), scenario["user_request"]),
        F.concat(F.lit("Steps: "), steps.cast("string")),
        F.when(some, F.concat(F.lit("Tools:\n"), F.array_join(tools, "\n"))).otherwise("No tools; reasoning steps only."),
        F.when(some & include_error, "Let one tool call fail and recover from it."),
        F.when(F.size(more) > 0, F.concat(F.lit("Follow-up requests:\n"), F.array_join(more, "\n"))),
    )
    say = lambda role, content: F.struct(F.lit(role).alias("role"), (F.lit(content) if isinstance(content, str) else content).alias("content"))
    return F.array(say("system", system), say("user", "Example:\n\n" + example), say("assistant", "I will follow this syntax."), say("user", ask))


def match(responses: DataFrame, planned: DataFrame) -> DataFrame:
    """Each response (custom_id, error, content) with its plan row, if any, and status: failed (error), invalid or valid.
    Responses without a plan row stay; has_plan tells them apart."""
    idx = F.split_part("custom_id", F.lit("-"), F.lit(2)).try_cast("long")
    got = responses.withColumn("idx", idx).withColumn("content", F.btrim("content", F.lit(" \t\r\n")))
    wrong = F.coalesce(F.col("error"), F.lit("")) != ""
    status = F.when(wrong, "failed").when(validation("content")["valid"], "valid").otherwise("invalid")
    own = planned.select("idx", "has_tools", "domain", F.lit(True).alias("has_plan"))
    return got.withColumn("status", status).join(own, "idx", "left").withColumn("has_plan", F.coalesce("has_plan", F.lit(False)))


def outcome(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count_if(F.col("status") == "valid").alias("n_valid"), F.count_if(F.col("status") != "valid").alias("n_failed"))


def first_valid(attempts: DataFrame, key: str = "idx", attempt: str = "attempt", text: str = "content") -> DataFrame:
    """Per key the first attempt whose text is valid; keys without one do not appear (they are the failures)."""
    ok = attempts.where(validation(text)["valid"])
    return ok.groupBy(key).agg(F.min(attempt).alias(attempt), F.min_by(text, attempt).alias(text))
