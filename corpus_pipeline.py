"""From raw documents to token ids: quality, near duplicates, decontamination, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. All stages but the last return the
columns of documents. Stages need doc_id, text and source; any further columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import op2_wavelet, op4_decontaminate, op6_jaccard, op9_mix, op10_quality
from tracelake.llm.common import free, materialise, row_hash, small, table

LAST = (1 << 63) - 1


def _pick(docs: DataFrame, keyed: DataFrame, keys: DataFrame, on: list[str], many: str, order: Column) -> DataFrame:
    """The rows of keyed that keys (on and the flag many) names, one for each key; where a key has many rows, the first by order."""
    found = keyed.join(small(keys), on)
    row, *_ = free(keyed, "row")
    first = found.where(F.col(many)).groupBy(*on).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in keyed.columns if c not in on]), order).alias(row))
    rest = [c for c in keys.columns if c not in [*on, many]]
    again = first.select(*on, f"{row}.*").join(small(keys.where(many)), on) if rest else first.select(*on, f"{row}.*")
    cols = [*[f"`{c}`" for c in docs.columns], *rest]
    return found.where(~F.col(many)).select(*cols).unionByName(again.select(*cols))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network scores below its threshold go."""
    net = op10_quality.train(docs, table(spark, sf_dir, "labels"))
    (out,) = free(docs, "score")
    return op10_quality.score(docs, net, out).where(F.col(out) >= op10_quality.THRESHOLD).drop(out)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays (null last; then by a hash of the text).

    Texts without words are in no group and stay. Of rows with the same id and text in a group the first by a hash of
    all columns stays.
    """
    k1, k2, many = free(docs, "k1", "k2", "many")
    rows = op6_jaccard.classes_of(docs).where("group is not null").select("group", F.coalesce("doc_id", F.lit(LAST)).alias(k1), F.col("key").alias(k2))
    same = rows.groupBy("group", k1, k2).agg((F.count("*") > 1).alias(many))
    kept = same.groupBy("group").agg(F.min(F.struct(k1, k2, many)).alias("k")).select("k.*")
    keyed = docs.select("*", F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias(k1), F.xxhash64(docs["text"]).alias(k2))
    some = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    best = _pick(docs, keyed.where(some), materialise(kept, "kept"), [k1, k2], many, row_hash(docs))
    return best.unionByName(docs.where(~some))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    got = op4_decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return got.where(F.size("spans") == 0).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Equal rows are taken together."""
    k, n, many, i = free(docs, "k", "n", "many", "i")
    copies = op9_mix.mix(docs).groupBy(F.col("row").alias(k)).agg(F.sum("copies").cast("int").alias(n), (F.count("*") > 1).alias(many)).where(F.col(n) > 0)
    one = _pick(docs, docs.select("*", row_hash(docs).alias(k)), materialise(copies, "copies"), [k], many, F.lit(0))
    return one.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(i, n)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token shards' report: doc_id, start, n_tokens, ids_crc32."""
    return op2_wavelet.tokenize(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: The quality network has no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
