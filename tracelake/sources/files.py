"""JSON lines in and out, whole files, numbered trace files, batch result files."""

from __future__ import annotations

import os
import re
import shutil

from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_RESULT = "custom_id string, error string, response struct<body:struct<choices:array<struct<message:struct<role:string,content:string>>>>>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Every physical line: index (from 0, in file order; files by name) and line.

    Files are read in blocks; a block's number and the row's place in it give the order, and the blocks' sizes are added up
    to give the index.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("line"))
    from pyspark.sql import Window

    w = Window.partitionBy("f", "b").orderBy("m")
    sizes = raw.groupBy("f", "b").agg(F.count("*").alias("n"))
    before = sizes.select("f", "b", F.coalesce(F.sum("n").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return raw.withColumn("i", F.row_number().over(w)).join(before, ["f", "b"]).select((F.col("before") + F.col("i") - 1).alias("index"), "line")


def objects(spark: SparkSession, path: str) -> DataFrame:
    """Lines that hold a JSON object: index, line, item (VARIANT, all keys kept). Others are skipped; their index is missing."""
    got = lines(spark, path).withColumn("item", F.try_parse_json("line"))
    return got.where(F.schema_of_variant("item").startswith("OBJECT"))


def traces(spark: SparkSession, path: str, key: str = "trace") -> DataFrame:
    """index and text of objects that have the key; a value that is no string is read as JSON text."""
    return objects(spark, path).select("index", F.try_variant_get("item", f"$.{key}", "string").alias("text")).where("text is not null")


def first_lines(spark: SparkSession, path: str, limit: int) -> DataFrame:
    return lines(spark, path).where(F.col("index") < limit)


def line_count(spark: SparkSession, path: str) -> int:
    """0 if there is no such file."""
    try:
        return spark.read.text(path).count()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise


def whole(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one row: file (its name) and trace (its text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("trace"))


def scenarios(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A file (or files) with one JSON array.

    With an element a line, as write_array leaves it, tasks share a file's lines; one job looks whether every line is an
    element of its own. In any other layout a file is read by one task.
    """
    got = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    first, element = F.col("line").startswith("["), F.regexp_extract("line", r"(?s)^[\[,](.*)$", 1)
    own = F.coalesce(F.schema_of_variant(F.try_parse_json(element)).startswith("OBJECT"), F.lit(False))
    last, blank = F.col("line") == "]", F.col("line") == ""
    seen = got.agg(F.count_if(~(own | last | blank)).alias("other"), F.count_if(first).alias("first"), F.count_if(last).alias("last"), F.countDistinct("file").alias("files")).first()
    if seen.other or not seen.first == seen.last == seen.files:
        return spark.read.schema(schema).json(path, multiLine=True)
    return got.where(~(last | blank)).select(F.from_json(element, schema).alias("x")).select("x.*")


def batch_results(spark: SparkSession, path: str) -> DataFrame:
    """custom_id, error, content (of the first choice)."""
    got = spark.read.schema(BATCH_RESULT).json(path)
    return got.select("custom_id", "error", F.try_element_at("response.body.choices", F.lit(1))["message"]["content"].alias("content"))


def next_number(spark: SparkSession, folder: str) -> int:
    """One more than the largest N of trace_N.task, 0 without any; other names are ignored."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(folder)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop.Path(at, "trace_*.task"))
    numbers = [int(m[1]) for f in found or [] if (m := re.fullmatch(r"trace_(\d+)\.task", f.getPath().getName()))]
    return max(numbers, default=-1) + 1


def latest_checkpoint(spark: SparkSession, folder: str) -> str | None:
    """Path of the checkpoint-N folder with the largest N."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(folder)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop.Path(at, "checkpoint-*"))
    named = [(int(m[1]), f.getPath().toString()) for f in found or [] if f.isDirectory() and (m := re.fullmatch(r"checkpoint-(\d+)", f.getPath().getName()))]
    return max(named)[1] if named else None


def write_lines(df: DataFrame, path: str, mode: str = "overwrite", limit: int | None = None, order: str | None = None) -> None:
    """JSON lines; nulls are written. limit: only the first rows by order (a bigint key without repeats), however they lie."""
    from tracelake.functions.ordered import unused, with_ordinal

    if limit is not None:
        if order is None:
            raise ValueError("the first rows of what order?")
        (at,) = unused(df, "ordinal")
        df = with_ordinal(df, order, at).where(F.col(at) < limit).drop(at)
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_numbered(df: DataFrame, folder: str, text: str = "trace", order: str = "trace_id", start: int | None = None) -> None:
    """One file trace_NNNN.task per row, numbered in order from start (default: after the last one there).

    folder is a path or URI that executors can write to: a shared directory, or a store that Arrow knows.
    """
    from tracelake.functions.ordered import with_ordinal
    from tracelake.sources.batch import place

    base = next_number(df.sparkSession, folder) if start is None else start

    def put(rows):
        fs, at = place(folder)
        fs.create_dir(at, recursive=True)
        for r in rows:
            with fs.open_output_stream(f"{at}/trace_{base + r.ordinal:04d}.task") as f:
                f.write((r.text or "").encode())

    with_ordinal(df, order).select("ordinal", F.col(text).alias("text")).foreachPartition(put)


def write_array(df: DataFrame, path: str) -> None:
    """All rows as one file with one JSON array, an element a line; path is in a folder that all executors share.

    Tasks write the rows as text first. The lengths of these files say where each belongs in the whole, and tasks copy them
    there, every one its own; the driver sees the lengths only. The file appears under its name when it is complete.
    """
    from tracelake.sources.batch import place

    spark, parts, name = df.sparkSession, f"{path.rstrip('/')}.parts", f"{path.rstrip('/')}.part"
    df.select(F.concat(F.lit(","), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})).alias("value")).write.mode("overwrite").text(parts)
    fs, at = place(parts)
    found = [(f.path, f.size) for f in sorted(fs.get_file_info(FileSelector(at)), key=lambda f: f.path) if f.base_name.startswith("part-") and f.size]
    whole = os.path.abspath(place(name)[1])
    total = sum(n for _, n in found)
    with open(whole, "wb") as out:
        out.truncate(max(total, 1) + len("]\n"))
        out.write(b"[")  # in the place of the comma before the first element
        out.seek(max(total, 1))
        out.write(b"]\n")
    starts, start = [], 0
    for file, n in found:
        starts.append((file, start))
        start += n

    def copy(rows):
        for r in rows:
            with open(r.file, "rb") as own, open(whole, "r+b") as out:
                skip = int(r.start == 0)
                own.seek(skip)
                out.seek(r.start + skip)
                shutil.copyfileobj(own, out, 1 << 20)

    if starts:
        spark.createDataFrame(starts, "file string, start long").repartition(len(starts)).foreachPartition(copy)
    os.replace(whole, os.path.abspath(place(path)[1]))
    fs.delete_dir(at)
