"""Around an external judge: cache key and lookup, verdict scoring, counters, blending with the rubric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import lex
from tracelake.functions.ordered import unused
from tracelake.operators.calls import Ask, asked
from tracelake.operators.planning import draw
from tracelake.session import written

# The criteria, their weights, and what a missing one counts.
WEIGHTS = {"coherence": 0.15, "relevance": 0.25, "reasoning": 0.20, "completion": 0.25, "quality": 0.15}
DEFAULT = 5


def cache_key(prompt: Column, completion: Column) -> Column:
    """16 hexadecimal digits; a null text is keyed like an empty one."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.left(F.sha2(F.concat(text(prompt), F.lit("|||"), text(completion)), 256), F.lit(16))


def score(verdict: dict[str, Column]) -> Column:
    """Weighted mean of the criteria over ten; a missing one counts as DEFAULT."""
    total = None
    for name, weight in WEIGHTS.items():
        part = F.coalesce(verdict[name].cast("double"), F.lit(float(DEFAULT))) / 10 * weight
        total = part if total is None else total + part
    return total


def verdict_fields(reply: Column) -> dict[str, Column]:
    """The criteria of a judge's reply text, read leniently."""
    found = lex.lenient_object(reply)
    return {name: F.try_variant_get(found, f"$.{name}", "double") for name in WEIGHTS}


def judge_text(prompt: Column, completion: Column, most: int = 4000) -> Column:
    return F.concat(F.lit("Request:\n"), lex.user_request(prompt), F.lit("\n\nResponse:\n"), lex.truncate(completion, most))


def judged(df: DataFrame, cache: DataFrame, ask: Ask, most: int = 4000, **how) -> DataFrame:
    """df (prompt, completion) with cache_key, judge_score, cached and judge_error; other columns are kept.

    ask is called once for each different key that cache (cache_key, judge_score) does not hold; null scores and scores that
    are no number are misses, of repeated keys the smallest score counts. Replies are written when this is called (see
    ``calls.asked``, which also takes how), so the result can be evaluated any number of times. A call that fails leaves a
    null score and its error; null prompts and completions are judged as empty texts.
    """
    known_score, fresh_score = unused(df, "known", "fresh")
    keyed = df.withColumn("cache_key", cache_key(F.col("prompt"), F.col("completion")))
    known = cache.where("cache_key is not null and judge_score is not null and not isnan(judge_score)").groupBy("cache_key").agg(F.min("judge_score").alias(known_score))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    new = keyed.join(known, "cache_key", "left_anti").select("cache_key", judge_text(empty("prompt"), empty("completion"), most).alias("text"))
    replies = asked(new, "cache_key", "text", ask, **how)
    fresh = replies.select("cache_key", F.when(F.col("reply").isNotNull(), score(verdict_fields(F.col("reply")))).alias(fresh_score), F.col("error").alias("judge_error"))
    out = keyed.join(known, "cache_key", "left").join(fresh, "cache_key", "left")
    return out.withColumn("cached", F.col(known_score).isNotNull()).withColumn("judge_score", F.coalesce(known_score, fresh_score)).drop(known_score, fresh_score)


# Verdicts are kept in folders by the first characters of the key, so that a look-up reads the folders of its keys only.

PREFIX = 2
STORED = "cache_key string, judge_score double, bucket string"


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.left("cache_key", F.lit(PREFIX)))


def remember(judged_rows: DataFrame, path: str) -> None:
    """Append the new verdicts (not cached, with a score; one per key) to the store at path."""
    new = judged_rows.where("not cached and judge_score is not null").groupBy("cache_key").agg(F.min("judge_score").alias("judge_score"))
    _bucketed(new).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def verdicts(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """cache_key, judge_score of the store at path; none if there is no such store.

    Files that cannot be read are skipped, as if their verdicts had never been given. keys (with cache_key): only the
    folders are read that these keys fall into, by a look-up of at most 16**PREFIX prefixes.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], STORED).drop("bucket")
    found = spark.read.schema(STORED).option("ignoreCorruptFiles", "true").parquet(path)
    if keys is not None:
        wanted = [r.bucket for r in _bucketed(keys.where("cache_key is not null")).select("bucket").distinct().collect()]
        found = found.where(F.col("bucket").isin(wanted))
    return found.drop("bucket")


def compact(spark: SparkSession, path: str, buckets: list[str] | None = None) -> None:
    """Rewrite the store, or some of its folders, with one row per key and one file a folder."""
    found = spark.read.schema(STORED).option("ignoreCorruptFiles", "true").parquet(path)
    if buckets is not None:
        found = found.where(F.col("bucket").isin(buckets))
    one = found.where("cache_key is not null and judge_score is not null").groupBy("bucket", "cache_key").agg(F.min("judge_score").alias("judge_score"))
    whole = written(one, "verdicts").repartition("bucket")
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def stats(rows: DataFrame) -> DataFrame:
    """calls, cache_hits, cache_rate over rows with cached."""
    return rows.agg(F.count_if(~F.col("cached")).alias("calls"), F.count_if("cached").alias("cache_hits"), (F.count_if("cached") / F.greatest(F.lit(1), F.count("*"))).alias("cache_rate"))


def hybrid(verifier: Column, judge: Column, key: Column, rate: float, weight: float, seed: int = 0) -> Column:
    """verifier + (3 judge - 1) weight on a drawn share of the rows, else verifier."""
    return F.when((draw(key, "judge", seed) < rate) & judge.isNotNull(), verifier + (judge * 3 - 1) * weight).otherwise(verifier)
