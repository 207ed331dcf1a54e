"""Near-duplicate vectors with a pivot-permutation index.

Every vector is described by the ordered list of its NEAREST closest pivots (reference vectors). Its entry goes to the
inverted lists of these pivots; two vectors are candidates when they share SHARED pivots or more, which is the same as
standing together in the list of at least one SHARED-subset, so these subsets are the keys of the lists (label first).
Candidates are verified by their cosine in double precision. A pair counts in one list only, that of the first SHARED
pivots the two have in common, so partial link counts add up without ever writing a pair.

Pivots: vectors spread over a bounded sample, the first by a hash, SAMPLE vectors or twice the pivots. Their number grows as
the square root of the different vectors of the largest label, from PIVOTS to MOST_PIVOTS, so that a list of evenly spread
vectors keeps about MEAN entries (see ``pivots_for``). Every vector is indexed. Equal vectors form one entry with a multiplicity. A list longer than PART entries is cut into parts by a hash; each pair of
parts is one unit of work, so no list, however hot, meets in one task and none is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialise, mix64, release, small_batches, table

SAMPLE, PIVOTS, NEAREST, SHARED = 1000, 64, 4, 2
MOST_PIVOTS, MEAN = 2048, 128
COSINE, PART = 0.93, 512


def spread(vectors: np.ndarray, count: int) -> np.ndarray:
    """count pivots out of unit vectors, each the one least similar to those before it: copies of one vector, however
    many are in the sample, give one pivot, so that the order of the pivots is not left to noise."""
    chosen, close = [0], vectors @ vectors[0]
    while len(chosen) < min(count, len(vectors)):
        chosen.append(int(close.argmin()))
        close = np.maximum(close, vectors @ vectors[chosen[-1]])
    return vectors[chosen]


def pivots_for(rows: int, nearest: int, shared: int) -> int:
    """How many pivots p give rows entries of one label, each in C(nearest, shared) of the C(p, shared) lists, a mean list of about MEAN."""
    lists = rows * math.comb(nearest, shared) / MEAN
    return min(MOST_PIVOTS, max(PIVOTS, nearest, math.ceil((lists * math.factorial(shared)) ** (1 / shared)) + shared))


def closest(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The nearest pivots of each row, in blocks of rows so that memory doesn't grow with the pivots; the first of equal ones."""
    out, step, few = np.zeros((len(x), nearest), np.int64), max(1, (1 << 20) // len(pivots)), min(4 * nearest, len(pivots))
    for a in range(0, len(x), step):
        far = -(x[a : a + step] @ pivots.T)
        at = np.sort(np.argpartition(far, few - 1, axis=1)[:, :few], axis=1) if len(pivots) > 4 * PIVOTS else np.tile(np.arange(len(pivots)), (len(far), 1))
        first = np.argsort(np.take_along_axis(far, at, axis=1), axis=1, kind="stable")[:, :nearest]
        out[a : a + step] = np.take_along_axis(at, first, axis=1)
    return out


def usable(v: str) -> F.Column:
    """Neither null nor empty, no null or non-finite component, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(v).isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _entries(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, e) for all rows, e null where nothing can link; and entries (e, label, size, id, v)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("v"))
    good = usable("v") & F.col("label").isNotNull()
    keyed = rows.withColumn("e", F.when(good, F.struct(F.xxhash64("label", "v").alias("a"), F.xxhash64(F.lit(1), "v", "label").alias("b"))))
    entries = keyed.where("e is not null").groupBy("e").agg(F.count("*").alias("size"), F.min("vec_id").alias("id"), F.first("label").alias("label"), F.first("v").alias("v"))
    entries = materialise(entries.withColumn("u", F.monotonically_increasing_id()), "entries")
    return keyed.select("vec_id", "e"), entries


def _describe(entries: DataFrame, pivots: np.ndarray, nearest: int, shared: int) -> DataFrame:
    """Inverted-list entries: cell (hash of label, dimension and SHARED pivots), the entry, its ordered pivots."""
    known = entries.sparkSession.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = known.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lists = batch.column("v")
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            dims = np.diff(off)
            near = np.zeros((n, nearest), np.int64)
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                x = flat[off[own][:, None] + np.arange(d)[None, :]].astype(np.float64)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                q = p[:, :d] if p.shape[1] >= d else np.pad(p, ((0, 0), (0, d - p.shape[1])))
                near[own] = closest(x, q, nearest)
            near.sort(axis=1)
            label = batch.column("lab").to_numpy(zero_copy_only=False).view(np.uint64) + dims.astype(np.uint64)
            u, cells, owner, first = batch.column("u"), [], [], []
            for k, subset in enumerate(combinations(range(nearest), shared)):
                h = label.copy()
                for j in subset:
                    h = mix64(h ^ (near[:, j] + 1).astype(np.uint64))
                cells.append(h.view(np.int64))
            m = len(cells)
            at = pa.array(np.arange(n + 1) * m, pa.int32())
            prefix = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * nearest, pa.int32()), pa.array(near.ravel().astype(np.int16)))
            yield pa.RecordBatch.from_arrays([u, batch.column("size"), lists, prefix, pa.ListArray.from_arrays(at, pa.array(np.stack(cells, axis=1).ravel()))], ["u", "size", "v", "near", "cells"])

    rows = entries.select("u", "size", "v", F.xxhash64("label").alias("lab")).mapInArrow(run, f"u long, size long, v {dict(entries.dtypes)['v']}, near array<short>, cells array<long>")
    return rows.select("u", "size", "v", "near", F.posexplode("cells").alias("k", "cell"))


def _verify(listed: DataFrame, cosine: float, nearest: int, shared: int) -> DataFrame:
    """Per unit of work and entry with links: u, n (links counted here, by multiplicity), root (smallest entry that links reach here)."""
    subsets = list(combinations(range(nearest), shared))

    def links(x: np.ndarray, near: np.ndarray, subset: np.ndarray, side: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray]:
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if both else (np.arange(len(x)),) * 2
        a, b = np.nonzero(x[left] @ x[right].T >= cosine)
        a, b = left[a], right[b]
        if not both:
            a, b = a[a < b], b[a < b]
        # the pair counts here if the first shared pivots of the two are this list's
        eq = (near[a][:, :, None] == near[b][:, None, :]).any(axis=2)
        first = np.argsort(~eq, axis=1, kind="stable")[:, :shared]
        here = (first == subset[a]).all(axis=1)
        return a[here], b[here]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
            if not t.num_rows:
                continue
            key = [t.column(c).to_numpy() for c in ("cell", "pa", "pb")]
            cut = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)]))
            carry = t.slice(int(cut[-1])).combine_chunks()
            yield from groups(t.slice(0, int(cut[-1])), cut)
        if carry is not None and carry.num_rows:
            yield from groups(carry, np.array([0, carry.num_rows]))

    def groups(t: pa.Table, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        t = t.combine_chunks()
        u, size, k, side, pa_, pb = (t.column(c).to_numpy() for c in ("u", "size", "k", "side", "pa", "pb"))
        vs, ns = t.column("v").chunk(0), t.column("near").chunk(0)
        flat, off = vs.values.to_numpy(zero_copy_only=False), vs.offsets.to_numpy()
        near = ns.values.to_numpy(zero_copy_only=False)[ns.offsets.to_numpy()[0] :][: len(u) * nearest].reshape(-1, nearest)
        which = np.array(subsets)
        us, counts, roots = [], [], []
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            d = off[s + 1] - off[s]
            if e - s < 2 or np.any(np.diff(off[s : e + 1]) != d):
                continue
            x = flat[off[s] : off[e]].reshape(e - s, d).astype(np.float64)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            a, b = links(x, near[s:e], which[k[s:e]], side[s:e], pa_[s] != pb[s])
            if not len(a):
                continue
            w = size[s:e]
            n = np.bincount(a, weights=w[b], minlength=e - s) + np.bincount(b, weights=w[a], minlength=e - s)
            root = np.arange(e - s)
            while True:  # the smallest row that links reach
                low = root.copy()
                np.minimum.at(low, a, root[b])
                np.minimum.at(low, b, root[a])
                low = low[low]
                if np.array_equal(low, root):
                    break
                root = low
            own = np.flatnonzero(n)
            us.append(u[s:e][own])
            counts.append(n[own].astype(np.int64))
            roots.append(u[s:e][root[own]])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, counts, roots)], ["u", "n", "root"])

    order = ["cell", "pa", "pb"]
    sorted_ = listed.repartition(*order).sortWithinPartitions(*order)
    return materialise(sorted_.mapInArrow(run, "u long, n long, root long"), "verified")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, pivots: int | None = None, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Rows link when their labels are equal and not null, their vectors have the same length and a cosine of at least
    ``cosine``. Null, empty or zero vectors and vectors with null or non-finite components link with nothing: n_links 0,
    component_id vec_id. Equal vectors link with each other. A null vec_id counts as no id. Repeated rows are separate
    rows. vectors needs vec_id, embedding and label; other columns are not read. An empty table gives no rows.

    Links found are exact, but some may be missed. With pivots=1, nearest=1 and shared=1 each label is one list, cut into
    parts, and nothing is missed; the work then grows as the square of a label's different vectors.
    """
    small_batches(vectors.sparkSession)
    rows, entries = _entries(vectors)
    if pivots is None:
        pivots = pivots_for(entries.groupBy("label").count().agg(F.max("count")).first()[0] or 0, nearest, shared)
    sample = entries.select("v").orderBy(F.xxhash64("e"), "id").limit(max(SAMPLE, 2 * pivots)).collect()
    known = np.zeros((max(len(sample), nearest), max((len(r.v) for r in sample), default=1)))
    for i, r in enumerate(sample):
        v = np.array(r.v, np.float64) / np.abs(r.v).max()
        known[i, : len(v)] = v / np.linalg.norm(v)
    listed = _describe(entries, spread(known, max(pivots, nearest)), nearest, shared)
    long_lists = listed.groupBy("cell").agg(F.count("*").alias("len")).where(F.col("len") > PART).select("cell", F.ceil(F.col("len") / PART).cast("int").alias("parts"))
    listed = listed.join(materialise(long_lists, "long"), "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("u"), F.col("parts")).cast("int")
    dealt = listed.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("u", "size", "v", "near", "k", "cell", F.least("part", "other").alias("pa"), F.greatest("part", "other").alias("pb"), (F.col("part") > F.col("other")).cast("int").alias("side"))
    got = _verify(dealt, cosine, nearest, shared)
    release(vectors.sparkSession)
    group = components(got.select(F.col("u").alias("a"), F.col("root").alias("b")))
    counted = got.groupBy("u").agg(F.sum("n").alias("n"))
    ids = entries.select("e", "u", "size", "id").join(group.withColumnRenamed("node", "u"), "u", "left").withColumn("component", F.coalesce("component", "u"))
    smallest = ids.groupBy("component").agg(F.min("id").alias("component_id"))
    facts = ids.join(smallest, "component").join(counted, "u", "left").select("e", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n"), "component_id")
    out = rows.join(facts, "e", "left")
    component = F.when(F.col("e").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op1_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
