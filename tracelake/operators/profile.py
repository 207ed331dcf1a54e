"""Token profile of a corpus: per-row counts, totals, histogram, longest rows, truncation report."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.ordered import upper_median
from tracelake.functions.pieces import mapped

# Bounds of the histogram, and cost factors.
BOUNDS = [0, 100, 500, 1000, 5000, 10000, 50000]
COST_PER_1K = {"cost_training": 0.008, "cost_inference": 0.0003}


def estimate(text: Column | str) -> Column:
    """Tokens as a quarter of the characters, rounded down; null text has none."""
    return F.floor(F.length(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))) / 4).cast("long")


def counted_by(encode: Callable[[list[str]], list[int]]) -> Callable[[Column], Column]:
    """A token counter around any tokenizer: encode gives the count of each of some texts."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return mapped(batches, encode, pa.int64())

    return run


def profile(df: DataFrame, text: str, index: str, counter: Callable[[Column], Column] = estimate) -> DataFrame:
    return df.select(F.col(index).alias("index"), counter(F.col(text)).alias("tokens"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("chars"))


def totals(rows: DataFrame) -> DataFrame:
    n = F.sum("tokens")
    one = rows.agg(F.count("*").alias("n"), n.alias("total_tokens"), F.sum("chars").alias("total_chars"), F.min("tokens").alias("min_tokens"), F.max("tokens").alias("max_tokens"), F.floor(F.try_divide(n, F.count("*"))).cast("long").alias("avg_tokens"), *[(n * rate / 1000).alias(c) for c, rate in COST_PER_1K.items()])
    return one.join(upper_median(rows, "tokens").withColumnRenamed("median", "median_tokens"), how="left", on=F.lit(True))


def histogram(rows: DataFrame) -> DataFrame:
    """lo, hi (null: open), n, pct per bucket, empty buckets included."""
    lo = F.array_max(F.filter(F.array(*[F.lit(b) for b in BOUNDS]), lambda b: b <= F.col("tokens")))
    counts = rows.groupBy(lo.cast("long").alias("lo")).agg(F.count("*").alias("n"))
    bounds = rows.sparkSession.createDataFrame(list(zip(BOUNDS, [*BOUNDS[1:], None], strict=True)), "lo long, hi long")
    all_ = rows.agg(F.count("*").alias("all"))
    n = F.coalesce("n", F.lit(0))
    return bounds.join(counts, "lo", "left").join(F.broadcast(all_)).select("lo", "hi", n.alias("n"), F.round(F.try_divide(n * 100.0, F.col("all")), 6).alias("pct"))


def longest(rows: DataFrame, k: int = 10) -> DataFrame:
    return rows.orderBy(F.desc("tokens"), "index").limit(k)


def truncation(rows: DataFrame, most: int, least: int = 100) -> DataFrame:
    """Rows over most tokens, extremes and upper median of all, extremes and mean of those over, and rows that are
    least tokens or shorter after truncation (to be dropped)."""
    over = F.col("tokens") > most
    pick = F.when(over, F.col("tokens"))
    one = rows.agg(F.count("*").alias("n"), F.count_if(over).alias("n_over"), F.max("tokens").alias("max_tokens"), F.min(pick).alias("min_over"), F.max(pick).alias("max_over"), F.floor(F.try_divide(F.sum(pick), F.count_if(over))).cast("long").alias("avg_over"), F.count_if(F.least(F.col("tokens"), F.lit(most)) <= least).alias("n_short"))
    return one.join(upper_median(rows, "tokens").withColumnRenamed("median", "median_tokens"), how="left", on=F.lit(True))


def tokenized(df: DataFrame, text: str, encode: Callable[[list[str]], list[list[int]]], most: int, least: int = 100) -> DataFrame:
    """input_ids, attention_mask, labels of at most most tokens; rows of least tokens or fewer go."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return mapped(batches, encode, pa.list_(pa.int32()))

    cut = df.where(F.col(text).isNotNull()).select(F.slice(ids.asNondeterministic()(F.col(text)), 1, most).alias("input_ids"))
    return cut.where(F.size("input_ids") > least).select("input_ids", F.transform("input_ids", lambda x: F.lit(1)).alias("attention_mask"), F.col("input_ids").alias("labels"))


def cached_tokenized(df: DataFrame, text: str, encode: Callable[[list[str]], list[list[int]]], most: int, folder: str, tokenizer: str) -> DataFrame:
    """tokenized(), kept under folder by a key of the texts' content, the tokenizer's name and the length; a second call
    with the same three reads the files."""
    t = F.coalesce(F.col(text), F.lit(""))
    seen = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(t)).alias("x"), F.sum(F.pmod(F.xxhash64(F.lit(1), t), F.lit(1 << 31))).alias("s")).first()
    key = hashlib.md5(f"{seen.n}_{seen.x}_{seen.s}_{tokenizer}_{most}".encode()).hexdigest()[:12]
    path = f"{folder.rstrip('/')}/tokenized_{key}"
    try:
        return df.sparkSession.read.parquet(path)
    except AnalysisException:
        tokenized(df, text, encode, most).write.parquet(path)
        return df.sparkSession.read.parquet(path)
