"""Filter interaction audit: what each quality filter removes, in every order the filters can be applied in.

Each document gets one failure flag per filter. Documents are tallied per part and combination of flags, which leaves at
most 32 rows a part, and CUBE over the flags and the part turns the tally into survivors: the grouping set that keeps the
flags of some filters has, in its row where they are all false, the documents that pass all of these filters. One step of
an order leads from the survivors of the filters before it to those of one filter more, so every figure of all 120 orders
is a difference between two of 32 numbers a part.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, small, table

LAST = (1 << 63) - 1
FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
MIN_WORDS = 200
MIN_DISTINCT_PCT = 50
MAX_UPPER_PCT = 3
SYMBOLS = "[#$%&*|]"

COUNTS = ["n", "good", "toxic"]


def text_flags(text: Column) -> dict[str, Column]:
    """The failure conditions that one text decides."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size("words").cast("long"), F.size(F.array_distinct("words")).cast("long")
    return {
        "words": words,
        "A": n < MIN_WORDS,
        "B": 100 * distinct < MIN_DISTINCT_PCT * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MAX_UPPER_PCT * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, part and a boolean per filter, true where the document fails it.

    A: fewer than 200 words; B: fewer than half of the words are distinct; C: over 3 % capital letters A-Z; D: a symbol of
    #$%&*|; E: the text of a smaller doc_id. Null texts are empty, and an empty text fails A only (and E, if it is not the
    first); null parts are the empty string; a null doc_id comes after all others. Rows with the same id are documents of
    their own, and neither is smaller. Texts are told apart by 128 bits. Columns other than doc_id, text and the part are
    not read, and an empty table gives an empty result.

    Texts stay where they are read; flags and hashes are shuffled. First owners of repeated texts come from one
    aggregate (combined before the shuffle) and are joined back to the narrow rows; where one text is very common, adaptive
    execution splits the join.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    flags = text_flags(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", flags.pop("words")).select("doc_id", "part", F.coalesce("doc_id", F.lit(LAST)).alias("k"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), *[c.alias(f) for f, c in flags.items()])
    rows = materialise(rows, "flags")
    first = rows.groupBy("h1", "h2").agg(F.min("k").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    return rows.join(small(materialise(first, "owners")), ["h1", "h2"], "left").select("doc_id", "part", *flags, F.coalesce(F.col("k") > F.col("first"), F.lit(False)).alias("E"))


def survivors(failed: DataFrame) -> DataFrame:
    """Per part and subset of filters (bit i is the i-th filter): n documents that pass the subset, how many of them are good and toxic.

    All 32 subsets of every part, zeros included; the part null stands for the whole table. failed: part, the flags, good, toxic.
    """
    tally = failed.groupBy("part", *FILTERS).agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    cube = tally.cube("part", *FILTERS).agg(*[F.sum(c).alias(c) for c in COUNTS], sum((1 - F.grouping(f).cast("int")) * (1 << i) for i, f in enumerate(FILTERS)).alias("subset"))
    passed = materialise(cube.where(" and ".join(f"not coalesce({f}, false)" for f in FILTERS)).select("part", "subset", *COUNTS), "cube")
    every = passed.where("subset = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("subset"))
    same = every["part"].eqNullSafe(passed["part"]) & (every["subset"] == passed["subset"])
    return every.join(passed, same, "left").select(every["part"], every["subset"], *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])


def orders(spark: SparkSession) -> DataFrame:
    """Every step of every order of the filters: filter_order, step, filter, before (the subset applied already)."""
    rows = [("".join(o), k + 1, f, sum(1 << FILTERS.index(x) for x in o[:k])) for o in permutations(FILTERS) for k, f in enumerate(o)]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int")


def audit(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    failed: as failures() gives it. labels: doc_id, quality, toxic; of repeated rows of an id one that says 1 is enough, a
    null says nothing, and rows without an id label nothing. The part null is the whole table. No documents, no rows.
    """
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    passed = materialise(survivors(failed.select("doc_id", "part", *FILTERS).join(small(materialise(marks, "marks")), "doc_id", "left")), "survivors")
    bits = F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(1 << i).alias("bit")) for i, f in enumerate(FILTERS)])
    start = passed.select("part", F.col("subset").alias("before"), *[F.col(c).alias(f"{c}_before") for c in COUNTS], F.explode(bits).alias("f")).select("*", "f.*").drop("f").where("before & bit = 0")
    after = passed.withColumnRenamed("part", "_part")
    pairs = start.join(after, start["part"].eqNullSafe(after["_part"]) & (F.col("before") + F.col("bit") == F.col("subset"))).withColumn("removed", F.col("n_before") - F.col("n"))
    # of all orders, those that have this subset, in any order, before this filter, and the rest after it
    ways = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS))]), F.bit_count("before") + 1)
    own = Window.partitionBy("part", "filter")
    pairs = pairs.select("part", "filter", "before", F.col("n").alias("kept"), "removed", (F.col("good_before") - F.col("good")).alias("good_lost"), (F.col("toxic_before") - F.col("toxic")).alias("toxic_lost"), F.sum(F.col("removed") * ways).over(own).alias("shapley"), F.max(F.when(F.col("before") == 0, F.col("removed"))).over(own).alias("failing"), F.max(F.when(F.col("before") + F.col("bit") == ALL, F.col("removed"))).over(own).alias("unique_fails"))
    steps = pairs.join(F.broadcast(orders(failed.sparkSession)), ["filter", "before"])
    return steps.select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")).where("part is not null")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  MAP {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text), 'D': regexp_matches(text, '[#$%&*|]'), 'E': min(t.doc_id) OVER (PARTITION BY text) < t.doc_id} AS fails
  FROM t LEFT JOIN m ON t.doc_id = m.doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
r AS (SELECT filter_order, g.*, list_min(list_transform(range(1, 6), lambda i: CASE WHEN fails[substr(filter_order, i, 1)] THEN i ELSE 6 END)) AS hit, len(list_filter(map_values(fails), lambda v: v)) AS n_fails FROM o, g),
s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS x, CAST(coalesce(sum(n) FILTER (hit > step), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (hit = step), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (hit < step AND fails[substr(filter_order, step, 1)]), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (n_fails = 1 AND fails[substr(filter_order, step, 1)]), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (hit = step), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (hit = step), 0) AS BIGINT) AS toxic_lost FROM r, (SELECT unnest(range(1, 6))::INT AS step) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM s
"""
