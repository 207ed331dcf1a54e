"""Row numbers, running sums, row frames and medians over a whole table without sending it to one task.

All take a bigint order key. Rows are summed per bucket of the key, the few bucket totals are added up in one window, and
a second window runs inside each bucket only. Buckets are ranges of the key of equal width, as many as it takes for
ROWS rows each if the keys are spread evenly; one small job reads the key's ends and the number of rows.
Columns of the caller may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 1 << 16


def unused(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores added as it takes to clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def running_sum(df: DataFrame, key: str, value: Column, out: str, rows: int = ROWS) -> DataFrame:
    """Add out: the sum of value over all rows up to and with this one, by key (unique; null keys first)."""
    low, high, n = df.agg(F.min(key), F.max(key), F.count("*")).first()
    width = max(1, (high - low + 1) * min(rows, max(1, n // 64)) // n) if n and low is not None else 1
    b, v, inside, t, before = unused(df, "bucket", "value", "inside", "total", "before")
    at = F.coalesce(F.floor((F.col(key) - F.lit(low or 0)) / width).cast("long"), F.lit(-1))
    own = df.withColumns({b: at, v: value.cast("long")})
    totals = own.groupBy(b).agg(F.sum(v).alias(t))
    ahead = totals.select(b, F.coalesce(F.sum(t).over(Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    upto = F.sum(v).over(Window.partitionBy(b).orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn(inside, upto).join(ahead, b).withColumn(out, F.col(before) + F.col(inside)).drop(b, v, inside, before)


def with_ordinal(df: DataFrame, key: str, out: str = "ordinal", rows: int = ROWS) -> DataFrame:
    """Add out: 0, 1, 2, ... by key."""
    return running_sum(df, key, F.lit(1), out, rows).withColumn(out, F.col(out) - 1)


def framed(df: DataFrame, ordinal: str, size: int, columns: dict[str, callable], block: int = 1 << 15) -> DataFrame:
    """Add columns, each a function of a window that spans the row and the size-1 rows before it by ordinal.

    Rows are cut into blocks of ordinals; the last size-1 rows of a block are also given to the next one. A window looks at
    size rows for each row: for long frames see ``sliding``.
    """
    block = max(block, size)
    at, halo = unused(df, "block", "halo")
    own = df.withColumns({at: F.floor(F.col(ordinal) / block), halo: F.lit(False)})
    tail = own.where(F.col(ordinal) % block >= block - (size - 1)).withColumns({at: F.col(at) + 1, halo: F.lit(True)})
    w = Window.partitionBy(at).orderBy(ordinal).rowsBetween(-(size - 1), 0)
    both = own.unionByName(tail)
    return both.select("*", *[f(w).alias(c) for c, f in columns.items()]).where(~F.col(halo)).drop(at, halo)


def sliding(df: DataFrame, ordinal: str, value: str, size: int, least: str, most: str, mean: str) -> DataFrame:
    """Add the minimum, maximum and mean of value (nulls left out) over the row and the size-1 rows before it by ordinal.

    Blocks of size rows: a frame is the end of one block and the beginning of the next, so it takes one running value
    from each, whatever the size.
    """
    at, k, lo, hi, total, n, lo2, hi2, total2, n2 = unused(df, "block", "k", "lo", "hi", "total", "n", "lo2", "hi2", "total2", "n2")
    own = df.withColumn(at, F.floor(F.col(ordinal) / size))
    begin = Window.partitionBy(at).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    end = Window.partitionBy(at).orderBy(F.desc(ordinal)).rowsBetween(Window.unboundedPreceding, 0)
    stats = lambda w, names: [f(value).over(w).alias(c) for f, c in zip((F.min, F.max, F.sum, F.count), names, strict=True)]
    # the part of a block from its second row on completes the frame that ends size-1 rows later
    rest = own.where(F.col(ordinal) % size > 0).select((F.col(ordinal) + size - 1).alias(k), *stats(end, (lo2, hi2, total2, n2)))
    both = own.select("*", *stats(begin, (lo, hi, total, n))).drop(at).join(rest, F.col(ordinal) == F.col(k), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = both.withColumns({least: F.least(lo, lo2), most: F.greatest(hi, hi2), mean: F.try_divide(zero(total) + zero(total2), F.col(n) + zero(n2))})
    return out.drop(k, lo, hi, total, n, lo2, hi2, total2, n2)


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """One row, median: the element n div 2 (from 0) of the sorted non-null values (integers); exact, from counts per value.

    Counts are added up by ranges of values, in two levels like every running sum here, so neither the rows nor the
    different values meet in one task. Two small jobs read the counts' ends and their sum."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c")).first()[0] or 0
    return running_sum(counts, "v", F.col("c"), "upto").where(F.col("upto") > total // 2).agg(F.min("v").alias("median"))
