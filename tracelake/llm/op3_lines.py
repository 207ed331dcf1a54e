"""Line dedup by overlapping windows of three lines.

Every three consecutive lines of a text are hashed to 128 bits. A window that occurs before, in any text, by
(doc_id, line), is a later occurrence; the lines that later occurrences cover, merged, are taken out of the text.
First occurrences come from one aggregate (combined before the shuffle), later ones from a join back on the hash, which
adaptive execution splits where one window is very common.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

LINES = 3


def dedup(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """Every row of docs: doc_id, text (without the removed lines), n_lines, n_removed.

    Lines end at \\n. A text of fewer lines than a window has none and stays whole, as do windows of blank lines only.
    Null texts stay null (n_lines 0). Occurrences are ordered by doc_id (null last), then by a hash of the text, then by
    line; rows with the same id and text are one document and are treated alike. Other columns are not read.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("k1"), F.xxhash64("text").alias("k2"))
    split = F.split("text", "\n", -1)
    parts = [lambda i, j=j: F.get(F.col("l"), i + j) for j in range(lines)]
    own = F.transform(
        F.sequence(F.lit(0), F.size("l") - lines),
        lambda i: F.struct(F.xxhash64(*[p(i) for p in parts]).alias("a"), F.xxhash64(F.lit(1), *[p(i) for p in parts]).alias("b"), F.concat(*[F.trim(F.translate(p(i), "\t\r", "  ")) for p in parts]).alias("some")),
    )
    windows = keyed.select("k1", "k2", split.alias("l")).where(F.size("l") >= lines).select("k1", "k2", F.posexplode(own).alias("pos", "w"))
    windows = materialise(windows.where("w.some <> ''").select("w.a", "w.b", "k1", "k2", "pos"), "windows")
    first = windows.groupBy("a", "b").agg(F.min(F.struct("k1", "k2", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = windows.join(first, ["a", "b"]).where(F.struct("k1", "k2", "pos") != F.col("first"))
    starts = later.groupBy("k1", "k2").agg(F.collect_set("pos").alias("starts"))
    both = keyed.join(starts, ["k1", "k2"], "left").withColumn("l", split)
    covered = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (lines - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), covered)
    text = F.when(F.col("starts").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("l"), i)), "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("l"))
    removed = F.when(F.col("starts").isNull(), 0).otherwise(F.size("l") - F.size(kept))
    return both.select("doc_id", text.alias("text"), n.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))


def op3_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS uid, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT uid, p, l[p+1] AS x, l[p+2] AS y, l[p+3] AS z FROM d, unnest(range(0, greatest(0, len(l) - 2))) t(p)),
k AS (SELECT uid, p, row_number() OVER (PARTITION BY x, y, z ORDER BY uid, p) AS n FROM w WHERE trim(translate(x, chr(9) || chr(13), '  ')) || trim(translate(y, chr(9) || chr(13), '  ')) || trim(translate(z, chr(9) || chr(13), '  ')) <> ''),
c AS (SELECT DISTINCT uid, p + j AS p FROM k, (VALUES (0), (1), (2)) v(j) WHERE n > 1),
r AS (SELECT uid, count(*) AS n FROM c GROUP BY uid),
t AS (SELECT d.uid, string_agg(l[q+1], chr(10) ORDER BY q) AS text FROM d, unnest(range(0, len(l))) u(q) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.uid = d.uid AND c.p = q) GROUP BY d.uid)
SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END) AS text_sha256
FROM d LEFT JOIN r USING (uid) LEFT JOIN t USING (uid)
"""
