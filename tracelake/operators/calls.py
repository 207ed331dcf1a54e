"""Calls of an external model: a bounded window of calls in each task, back-off, retry rounds, and waves until enough.

The model is a function of one text that returns a reply or raises; it is sent to the executors, so it opens its
connection there. Whatever was asked is written to the shared folder before anything reads it: evaluating a result again
asks nobody again, and a lost executor repeats the calls of its unfinished tasks only.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.ordered import unused, with_ordinal
from tracelake.functions.pieces import pieces
from tracelake.session import written

RETRIES, LONGEST_PAUSE = 3, 8
REPLY = "reply string, error string, calls int"

Ask = Callable[[str], str]


def call(ask: Ask, text: str, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int]:
    """(reply, error, number of calls). Between calls it waits 1, 2, 4, 8, 8, ... seconds; after the last one the error stays."""
    for k in range(1, retries + 2):
        try:
            return ask(text), None, k
        except Exception as e:  # whatever a backend raises belongs to its row
            error = f"{type(e).__name__}: {e}"
            if k <= retries:
                sleep(min(2 ** (k - 1), LONGEST_PAUSE))
    return None, error, retries + 1


def _in_order(pool: ThreadPoolExecutor, window: int, work: Iterator, do: Callable) -> Iterator:
    """do(x) for all x of work, at most window of them at a time, results in the order of work."""
    flying: deque = deque()
    for x in work:
        if len(flying) == window:
            yield flying.popleft().result()
        flying.append(pool.submit(do, x))
    while flying:
        yield flying.popleft().result()


def asked(rows: DataFrame, key: str, text: str, ask: Ask, window: int = 8, tasks: int | None = None, **how) -> DataFrame:
    """One row per different key: key, reply, error, calls; a written table.

    Of a key's texts the smallest is asked, once. A null text is not asked (reply and error are null, no calls); null keys
    are left out. A call that fails for good has its error in the row and does not stop the others. At most window calls
    are under way in a task and tasks * window in all (tasks: as many as the cluster runs at once, if not given); at most
    window replies are held back to keep the order. how: retries and sleep of ``call``.
    """
    one = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(text).alias("text"))
    one = one.repartition(tasks or rows.sparkSession.sparkContext.defaultParallelism, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = lambda x: (x[0], *((None, None, 0) if x[1] is None else call(ask, x[1], **how)))
        work = (x for b in batches for x in _pairs(b.column("key"), b.column("text")))
        with ThreadPoolExecutor(window) as pool:
            out: list[tuple] = []
            size = 0
            for found in _in_order(pool, window, work, do):
                out.append(found)
                size += len(found[1] or "")
                if len(out) >= 1000 or size > 4 << 20:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    kind = one.schema["key"].dataType.simpleString()
    return written(one.mapInArrow(run, f"key {kind}, {REPLY}"), "asked").withColumnRenamed("key", key)


def _pairs(keys: pa.Array, texts: pa.Array) -> Iterator[tuple]:
    at = 0
    for some in pieces(texts):
        yield from zip(keys.slice(at, len(some)), some.to_pylist(), strict=True)
        at += len(some)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    keys = pa.array([r[0].as_py() for r in rows], rows[0][0].type)
    rest = [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.string()), (2, pa.string()), (3, pa.int32()))]
    return pa.RecordBatch.from_arrays([keys, *rest], ["key", "reply", "error", "calls"])


def until_valid(rows: DataFrame, key: str, request: Callable[[int], Column], ask: Ask, valid: Callable[[str], Column], rounds: int = 3, **how) -> DataFrame:
    """One row per different key: key, reply, attempt, error.

    Each round asks for the keys that have no valid reply yet, at most rounds times. request gives the text of attempt
    1, 2, ..., valid tells from the column of that name whether a reply is valid. Keys without a valid reply have a null
    reply, the number of the last attempt and the last error ("invalid" if the last reply was one). Accepted replies of a round are
    a written table, as is what is left over, so a round reads nothing but the one before.
    """
    pending, done = rows, []
    for attempt in range(1, rounds + 1):
        (text,) = unused(rows, "text")
        got = asked(pending.withColumn(text, request(attempt)), key, text, ask, **how)
        good = F.coalesce(F.col("reply").isNotNull() & valid("reply"), F.lit(False))
        judged = written(got.select(F.col(key).alias("key"), good.alias("good"), F.when(good, F.col("reply")).alias("reply"), F.lit(attempt).alias("attempt"), F.when(~good, F.coalesce("error", F.lit("invalid"))).alias("error")), "attempts")
        left = judged.where("not good")
        last = attempt == rounds or not left.limit(1).count()
        done.append(judged if last else judged.where("good"))
        if last:
            break
        (k,) = unused(rows, "key")
        pending = rows.join(left.select(F.col("key").alias(k)), F.col(key) == F.col(k), "left_semi")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("good").withColumnRenamed("key", key)


def first_valid_of(rows: DataFrame, order: str, text: str, ask: Ask, valid: Callable[[str], Column], wanted: int, most: int | None = None, **how) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """The first wanted valid replies by order (a unique bigint key), and what it took: (wave, asked, valid) per wave.

    Requests go out in waves by order. A wave is as large as the share of valid replies so far says that it must be to
    bring the rest (the first is wanted, later ones at most most and at least one); it ends when there are enough or no more
    requests. So at most the last wave asks for too much. Result: order, reply; a written table.
    """
    (at,) = unused(rows, "ordinal")
    numbered = written(with_ordinal(rows.where(F.col(order).isNotNull()), order, at), "requests")
    total, start, found, waves, parts = numbered.count(), 0, 0, [], []
    while found < wanted and start < total:
        size = wanted if not waves else ceil((wanted - found) * start / max(found, 1))
        stop = min(total, start + max(1, min(size, most or size)))
        got = asked(numbered.where((F.col(at) >= start) & (F.col(at) < stop)), order, text, ask, **how)
        good = written(got.where(F.col("reply").isNotNull() & valid("reply")).select(order, "reply"), "wave")
        n = good.count()
        waves.append((len(waves) + 1, stop - start, n))
        parts.append(good)
        start, found = stop, found + n
    if not parts:
        return numbered.select(order, F.lit(None).cast("string").alias("reply")).where(F.lit(False)), waves
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if found > wanted:
        (k,) = unused(out, "ordinal")
        out = with_ordinal(out, order, k).where(F.col(k) < wanted).drop(k)
    return out, waves
