"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source is a flow with a weight. Its documents, shuffled by a hash, queue up; a document copy gets a virtual
finish time, the source's words up to and with it divided by the source's target. All copies are then ranked by finish
time over the whole corpus and cut where the running total of words reaches the budget.

Running sums over a hot source or over the whole corpus would put one key into one task. Both are therefore taken in
two levels: words are summed per (key, bucket) with a fixed number of buckets, a window adds up the few bucket totals,
and a second window runs inside each bucket only. Buckets of the shuffle hash and of the finish time are even by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, row_hash, table

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET_SHARE = 1.5
MAX_EPOCHS = 2
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = BUDGET_SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: source, source_size, target. sizes: (source, size) rows.

    Sources rank by code point, null last, and take the weights in turn. The budget, share of all words, is split by
    weight; no target passes epochs times its source's words, and what is cut off is split again by weight. The water
    level is found in closed form: sources fill up in the order of capacity/weight, so a prefix of that order is full.
    One row per source is all that the windows without a key see.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = total.withColumn("w", w).withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    first_open = F.min(F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct("pos", "level"))).over(everything)
    return (
        ranked.withColumn("level", level)
        .withColumn("pos", F.row_number().over(fill))
        .withColumn("open", first_open)
        .select("source", F.col("source_size"), F.when(F.col("open").isNull() | (F.col("pos") < F.col("open.pos")), F.col("cap")).otherwise(F.col("open.level") * F.col("w")).alias("target"))
    )


def running(df: DataFrame, keys: list[str], bucket: str, order: list[Column], size: str, out: str) -> DataFrame:
    """Add out, the running sum of size with the row itself, by keys in the order of bucket and then order."""
    totals = df.groupBy(*keys, bucket).agg(F.sum(size).alias("_b"))
    ahead = totals.withColumn("_before", F.sum("_b").over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)))
    ahead = ahead.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, bucket])], "_before")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, bucket])]
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    drop = ["_before", "_in", *[f"_k{i}" for i in range(len(keys) + 1)]]
    return df.withColumn("_in", F.sum(size).over(inside)).join(ahead, on).withColumn(out, F.col("_in") + F.coalesce("_before", F.lit(0))).drop(*drop)


def mix(docs: DataFrame, seed: int = 9, **how) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies (0, 1 or 2), row (hash of all its columns).

    Null texts and texts without words have size 0 and are taken 0 times. Null sources are one source, the last.
    Repeated rows and ids are separate documents. Rows come back whole; an empty table gives an empty result. docs
    needs doc_id, text and source; other columns are only read to settle ties. Reruns agree, over other files and in
    another order too: documents rank by a hash of seed, id and text, then by source and a hash of all columns. Rows
    that agree in all of these are equal, and which of them is taken makes no difference.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))).alias("shuffle"), row_hash(docs).alias("row"))
    rows = materialise(rows.withColumn("uid", F.monotonically_increasing_id()), "mix")
    goals = materialise(targets(rows, **how), "targets")
    bucket = F.conv(F.left("shuffle", F.lit(3)), 16, 10).cast("int")  # BUCKETS values
    queued = running(rows.withColumn("bucket", bucket), ["source"], "bucket", [F.col("shuffle"), F.col("row"), F.col("uid")], "size", "upto")
    goal = goals.select(F.col("source").alias("_s"), "source_size", "target")
    flows = queued.join(goal, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "bucket")
    epochs = how.get("epochs", MAX_EPOCHS)
    copies = (
        flows.where("size > 0")
        .withColumn("epoch", F.explode(F.array(*[F.lit(k) for k in range(epochs)])))
        .withColumn("finish", F.try_divide(F.col("upto") + F.col("epoch") * F.col("source_size"), F.col("target")))
        .select("uid", "size", "epoch", "finish", "shuffle", "source", "row")
        .withColumn("slot", F.floor(F.col("finish") * BUCKETS))
    )
    budget = (goals.agg(F.sum("source_size")).first()[0] or 0) * min(how.get("share", BUDGET_SHARE), epochs)
    ranked = running(copies, [], "slot", [F.col("finish"), F.col("shuffle"), F.col("source").asc_nulls_last(), F.col("row"), F.col("uid"), F.col("epoch")], "size", "total")
    taken = ranked.where(F.col("total") <= F.lit(budget)).groupBy("uid").agg(F.count("*").alias("copies"))
    out = flows.join(taken, "uid", "left")
    n = F.coalesce(F.col("copies"), F.lit(0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", (n * F.col("size")).alias("taken"), n.alias("copies"), "row")


def op9_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
             md5(concat('9:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))) AS shuffle, row_number() OVER () AS uid FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, CAST(source_size * 2 AS DOUBLE) AS cap FROM s),
f AS (SELECT *, row_number() OVER o AS pos, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM r WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
p AS (SELECT min(pos) AS opened FROM f WHERE level * w < cap),
t AS (SELECT source, source_size, CASE WHEN opened IS NULL OR pos < opened THEN cap ELSE (SELECT level FROM f g WHERE g.pos = p.opened) * w END AS target FROM f, p),
q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY shuffle, uid ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT uid, size, shuffle, source, (upto + epoch * source_size) / target AS finish, epoch FROM q, (VALUES (0), (1)) e(epoch) WHERE size > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, shuffle, source NULLS LAST, uid, epoch ROWS UNBOUNDED PRECEDING) AS total FROM c),
k AS (SELECT uid, count(*) AS copies FROM g WHERE total <= (SELECT sum(source_size) * 1.5::DOUBLE FROM s) GROUP BY uid)
SELECT doc_id, size, source_size, target, CAST(coalesce(copies, 0) * size AS BIGINT) AS taken FROM q LEFT JOIN k USING (uid)
"""
