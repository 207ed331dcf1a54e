"""Chat formatting with cumulative-snapshot collapse.

A logged conversation is often a snapshot: a later log repeats its turns and goes on. Each turn is hashed with its place
(128 bits); the exclusive-or over the first k turns is the rolling hash of that prefix. A conversation whose whole hash
is the hash of a proper prefix of another one goes (anti-join); of equal ones the smallest conv_id stays. What is left
is rendered with role markers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

BEGIN, END = "<|im_start|>", "<|im_end|>"


def render(conversations: DataFrame) -> DataFrame:
    """Per maximal conversation: conv_id, n_turns, text (of each turn BEGIN role, line feed, content, END, line feed).

    Turns are ordered by turn (null last), then role and text, so ties and repeated rows have one order; all turns are
    kept. Null role or text is rendered as empty, yet differs from empty when prefixes are compared. A turn whose
    conv_id is null belongs to no other: it is a conversation of its own, of one turn, and its conv_id stays null, so
    such rows never meet in one place. A conversation becomes one row. Turn numbers are not compared, only their order. An empty table gives no
    rows; columns other than conv_id, turn, role, text are not read.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    loose, turns = turns.where("conv_id is null"), turns.where("conv_id is not null")
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role"), F.col("text"))
    placed = turns.withColumn("pos", F.row_number().over(in_order))
    # a null changes the hash: xxhash64 skips nulls, the flags do not
    parts = [F.col("pos"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    so_far = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    hashed = placed.select("conv_id", "pos", F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))
    prefixes = hashed.select("conv_id", "pos", F.bit_xor("a").over(so_far).alias("a"), F.bit_xor("b").over(so_far).alias("b"), F.lead("pos").over(Window.partitionBy("conv_id").orderBy("pos")).isNull().alias("whole"))
    first = [F.lit(1), *parts[1:]]
    alone = loose.select("conv_id", F.lit(1).alias("pos"), F.xxhash64(*first).alias("a"), F.xxhash64(F.lit(1), *first).alias("b"), F.lit(True).alias("whole"))
    prefixes = materialise(prefixes.unionByName(alone), "prefixes")
    whole = prefixes.where("whole").groupBy("a", "b", "pos").agg(F.min("conv_id").alias("conv_id"))
    proper = prefixes.where("not whole").select("a", "b", "pos").distinct()
    kept = materialise(whole.join(proper, ["a", "b", "pos"], "left_anti").select("a", "b", F.col("conv_id").alias("kept"), F.col("pos").cast("long").alias("n_turns")), "maximal")
    own = turns.join(kept, F.col("conv_id") == F.col("kept")).groupBy("conv_id", "n_turns")
    # structs sort by turn, role, text with nulls first; the flag puts null turns last as above
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "text")))
    one = loose.select("role", "text", F.xxhash64(*first).alias("a"), F.xxhash64(F.lit(1), *first).alias("b")).groupBy("a", "b").agg(F.first(F.struct("role", "text")).alias("t"))
    single = one.join(kept.where("kept is null"), ["a", "b"]).select(F.lit(None).cast("long").alias("conv_id"), "n_turns", F.array(F.struct(F.lit(False).alias("late"), F.lit(None).cast("long").alias("turn"), "t.role", "t.text")).alias("turns"))
    said = own.agg(ordered.alias("turns")).unionByName(single)
    lines = F.transform("turns", lambda t: F.concat(F.lit(BEGIN), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(END + "\n")))
    return said.select("conv_id", "n_turns", F.array_join(lines, "").alias("text"))


def op8_snapshot_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH u AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations),
t AS (SELECT conv_id, alone, role, text, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS pos FROM u),
c AS (SELECT conv_id, min(alone) AS alone, list({'r': role, 't': text} ORDER BY pos) AS l, string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text FROM t GROUP BY conv_id, t.alone),
m AS (SELECT min(conv_id) AS conv_id, l, min(text) AS text FROM c GROUP BY l),
p AS (SELECT DISTINCT l[1:k] AS q FROM m, unnest(range(1, len(l))) u(k))
SELECT m.conv_id, CAST(len(m.l) AS BIGINT) AS n_turns, m.text FROM m WHERE m.l NOT IN (SELECT q FROM p)
"""
