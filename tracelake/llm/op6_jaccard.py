"""Exact n-gram Jaccard self-join by vertical partitioning of a global n-gram order.

Order. A fixed-size counting sketch over all documents (one counter per range of hashes, summed in a tree of bounded
fan-in) gives every n-gram a rough frequency. The global order is (rank of that frequency, hash): rare first. Any order
gives exact results; this one keeps passages that many documents share at its end.

Candidates. Two sets of similarity t share an n-gram among the first n - ceil(t n) + 1 of each, all but the first few of
them even more than one (see ``needed``). These prefixes of the order are dealt by n-gram; an n-gram that the sketch calls
frequent is salted, so that no task gets a hot list. A list's members are first paired with its head (the member that
stands in most lists) only. What is still not connected after these pairs are counted is paired list by list, leaving out lists with the same
members and pairs that are connected already or meet in too few lists. So no list is expanded into all pairs unless its
members really differ, and no link between components is lost. (Joining whole fragments directly, without prefixes, would
write every pair of documents that shares any n-gram.)

Counting. The global order is cut into FRAGMENTS ranges of about the same mass. Each set goes once per head to each
fragment; a task counts the partial overlaps of a head with its members in one fragment, and the counts are summed per
pair. A head with many members is repeated for every HEAD_PART of them.

Equal sets form one class (128-bit digest) before everything else, so copies cost one aggregate. Lists hold the digest's
first 64 bits; classes that agree in these but not in the rest are told apart before they are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, materialise, mix64, release, slices, small, small_batches, spent, table, trim

N, PERCENT = 5, 80
SKETCH_BITS = 22
FRAGMENTS = 4
PART = 1024  # a list with more members than this, by the sketch, is salted
HEAD_PART = 256  # members that meet one copy of their head
FAN_IN = 32
NO_ID = -(1 << 63)
WEIGHT_BITS = 12
MOST = (1 << WEIGHT_BITS) - 1

_C = mix64(np.arange(1, N + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased) and the first word of each text, with the end."""
    texts = texts.take(pa.array(np.arange(len(texts))))  # the string kernels misread slices whose offsets begin above 0
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    flat, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    start, size = offsets[:-1], np.diff(offsets)
    raw = np.concatenate([np.frombuffer(flat.buffers()[2] or b"", np.uint8), np.zeros(8, np.uint8)])
    lanes = np.ndarray(shape=(len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))  # eight bytes from each byte on
    full = size > 0
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(full)])
    start, size = start[full], size[full]
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at, todo = start, np.arange(len(start))
    left = size
    while len(todo):
        h[todo] = mix64((h[todo] ^ (lanes[at] & _MASKS[np.minimum(left, 8)])) + np.uint64(0x632BE59BD9B4E019))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return h, before[ends]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 64-bit n-gram hashes of each text; a text of fewer than N words is one n-gram."""
    h, at = word_hashes(texts)
    with np.errstate(over="ignore"):
        s = np.zeros(max(0, len(h) - N + 1), np.uint64)
        for j in range(N):
            s += _C[j] * h[j : j + len(s)]
        s = mix64(s)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= N:
                own = np.sort(s[a : b - N + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif b > a:
                out.append(mix64(np.array([(_C[: b - a] * h[a:b]).sum() + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def digest(own: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        sums = [mix64(own ^ _C[j]).sum() + np.uint64(len(own)) * _C[j + 1] for j in range(2)]
        a, b = mix64(np.array(sums, np.uint64)).view(np.int64).tolist()
    return a, b


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n + 1 - -(-n * percent // 100)


def _pack(counts: np.ndarray) -> bytes:
    """Counters byte plane by byte plane: the high planes are almost empty."""
    low = np.minimum(counts, (1 << 32) - 1).astype("<u4")
    return zstandard.compress(np.ascontiguousarray(low.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.uint64)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


class Order:
    """The global order: a rank per counter, in standard deviations above the mean and on a log scale, and the cuts of the fragments."""

    def __init__(self, counts: np.ndarray):
        self.unit = max(1.0, float(np.sqrt(counts.mean())))
        above = np.maximum(0.0, (counts - counts.mean()) / self.unit)
        self.ranks = np.minimum(255, np.round(16 * np.log2(1 + above))).astype(np.uint8)
        mass = np.cumsum(np.bincount(self.ranks, weights=counts, minlength=256))
        self.cuts = np.zeros(FRAGMENTS - 1, np.uint64)
        for k in range(1, FRAGMENTS):
            goal = mass[-1] * k / FRAGMENTS
            r = int(np.searchsorted(mass, goal))
            before = mass[r - 1] if r else 0.0
            share = (goal - before) / (mass[r] - before) if mass[r] > before else 0.0
            self.cuts[k - 1] = np.uint64(r << 56 | int(share * ((1 << 56) - 1)))

    def keys(self, own: np.ndarray) -> np.ndarray:
        """The n-grams' places in the order: rank, then 56 bits of the hash."""
        return self.ranks[_bucket(own)].astype(np.uint64) << np.uint64(56) | own >> np.uint64(8)

    def parts(self, keys: np.ndarray) -> np.ndarray:
        """Into how many parts an n-gram's list is salted."""
        length = (np.exp2((keys >> np.uint64(56)).astype(np.float64) / 16) - 1) * self.unit
        return np.maximum(1, (length / PART).astype(np.int64) + 1)


def _profile(docs: DataFrame) -> tuple[DataFrame, Order]:
    """(doc_id, key, n, c1, c2) per row, c1 and c2 the class's digest; and the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, names = np.zeros(1 << SKETCH_BITS, np.uint32), ["doc_id", "key", "n", "c1", "c2", "task", "sketch"]
        for batch in batches:
            for piece in slices(batch, "text"):
                sets = shingle_sets(piece.column("text"))
                for own in sets:
                    np.add.at(total, _bucket(own), np.uint32(1))
                k, both = len(sets), [digest(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("key"), pa.array([len(s) for s in sets], pa.int32()), pa.array([c[0] for c in both], pa.int64()), pa.array([c[1] for c in both], pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        blob = _pack(total)
        trim()
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())], pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([blob], pa.binary())], names)

    both = materialise(docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, n int, c1 long, c2 long, task int, sketch binary"), "profile")

    def add(pdf):
        total = np.zeros(1 << SKETCH_BITS, np.uint64)
        for blob in pdf["sketch"]:
            total += _unpack(blob)
        return pdf.iloc[:1][["task"]].assign(task=pdf["task"].iloc[0] // FAN_IN, sketch=_pack(total))

    tree = both.where("sketch is not null").select("task", "sketch")
    while True:
        rows = tree.limit(2).collect()
        if len(rows) < 2:
            break
        tree = materialise(tree.groupBy((F.col("task") / FAN_IN).cast("int")).applyInPandas(add, "task int, sketch binary"), "sketch")
    return both.where("sketch is null").select("doc_id", "key", "n", "c1", "c2"), Order(_unpack(bytes(rows[0].sketch)) if rows else np.zeros(1 << SKETCH_BITS, np.uint64))


def _postings(docs: DataFrame, shared, percent: int) -> DataFrame:
    """Prefix postings: n-gram h (its place in the order), part s (-1 unless salted), class c, size n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = shared.value, set()
        for batch in batches:
            for piece in slices(batch, "text"):
                rows = []
                for own in shingle_sets(piece.column("text")):
                    if not len(own) or (c := digest(own)) in seen:  # a copy met before in this task
                        continue
                    seen.add(c)
                    if len(seen) > 50_000:
                        seen.clear()
                    keys, k = order.keys(own), prefix_size(len(own), percent)
                    first = np.partition(keys, k - 1)[:k] if k < len(own) else keys
                    parts = order.parts(first)
                    salt = np.where(parts > 1, (c[0] & 0x7FFFFFFF) % parts, -1)
                    rows.append((c[0], len(own), first.view(np.int64), salt.astype(np.int32)))
                if rows:
                    c, n, h, s = zip(*rows, strict=True)
                    at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in h])]), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int32()), pa.ListArray.from_arrays(at, pa.array(np.concatenate(h))), pa.ListArray.from_arrays(at, pa.array(np.concatenate(s)))], ["c", "n", "h", "s"])
        trim()

    lists = docs.select("text").mapInArrow(run, "c long, n int, h array<long>, s array<int>")
    return lists.select("c", "n", F.explode(F.arrays_zip("h", "s")).alias("x")).select("x.h", "x.s", "c", "n")


def _lists(postings: DataFrame) -> DataFrame:
    """Members of lists with two classes or more, and of parts of salted lists: h, s, c, n, one row each. A list is
    streamed, so a long one takes no memory."""

    def batch_of(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["h", "s", "c", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None  # the last row and whether it begins its list
        for batch in batches:
            if not batch.num_rows:
                continue
            h, s, c, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if carry:
                h, s, c, n = (np.concatenate([np.array([v], x.dtype), x]) for v, x in zip(carry, (h, s, c, n), strict=False))
            begins = np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])])
            new = begins | np.concatenate([[True], c[1:] != c[:-1]])
            h, s, c, n, begins = (x[new] for x in (h, s, c, n, begins))
            if carry:
                begins[0] = carry[4]
            keep = ~begins | (s >= 0)
            keep[:-1] |= ~begins[1:]
            carry = tuple(x[-1] for x in (h, s, c, n, begins))
            keep[-1] = False
            if keep.any():
                yield batch_of([x[keep] for x in (h, s, c, n)])
        if carry and (not carry[4] or carry[1] >= 0):
            yield batch_of([[x] for x in carry[:4]])

    dealt = postings.repartition("h", "s").sortWithinPartitions("h", "s", "c")
    return materialise(dealt.mapInArrow(run, "h long, s int, c long, n int"), "lists")


def needed(na: Column, nb: Column, percent: int) -> Column:
    """How many n-grams the prefixes of two sets of these sizes share at least, if the sets reach the similarity.

    They have m = ceil(t (na + nb) / (1 + t)) in common at least, so na - m or fewer of the first set's are its own; the
    k-th common one stands at k + na - m or before, inside the prefix for all k up to its size less na - m.
    """
    up = lambda x, d: F.floor((x + (d - 1)) / d)
    m = up((na + nb) * percent, 100 + percent)
    room = lambda n: (n + 1 - up(n * percent, 100)) - (n - m)
    return F.least(room(na), room(nb))


def _close(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _with_heads(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb, hub) of a list's head and another member, if both stand in enough lists to reach the similarity.

    The head is the class that stands in most lists: of a text and its changed copies mostly the text itself. The heads
    of a salted list's parts are paired with the first of them as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = head = None
        for batch in batches:
            h, s, *own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(h):
                continue
            begins = np.concatenate([[(h[0], s[0]) != last], (h[1:] != h[:-1]) | (s[1:] != s[:-1])])
            start = np.maximum.accumulate(np.where(begins, np.arange(len(h)), -1))
            heads = [np.where(start < 0, head[k] if head else 0, x[np.maximum(start, 0)]) for k, x in enumerate(own)]
            last, head = (h[-1], s[-1]), [x[-1] for x in heads]
            yield pa.RecordBatch.from_arrays([pa.array(x[~begins]) for x in (*own, *heads)], ["c", "n", "k", "hc", "hn", "hk"])

    # a class stands in as many lists as its prefix has n-grams, so it makes no task larger than its text does
    counted = lists.repartition("c").withColumn("k", F.count("*").over(Window.partitionBy("c")).cast("int"))
    dealt = counted.select("h", "s", "c", "n", "k").repartition("h", "s").sortWithinPartitions("h", "s", F.desc("k"), "c")
    own = dealt.mapInArrow(run, "c long, n int, k int, hc long, hn int, hk int")
    salted = lists.where("s >= 0")
    ks = lists.join(salted.select("c").distinct(), "c").groupBy("c").agg(F.count("*").cast("int").alias("k"))
    tops = salted.join(ks, "c").groupBy("h", "s").agg(F.min(F.struct(-F.col("k"), "c", "n")).alias("t"))
    first = tops.groupBy("h").agg(F.min("t").alias("f"))
    between = tops.join(first, "h").where("t.c <> f.c").select("t.c", "t.n", (-F.col("t.col1")).alias("k"), F.col("f.c").alias("hc"), F.col("f.n").alias("hn"), (-F.col("f.col1")).alias("hk"))
    met = own.unionByName(between).where(_close("n", "hn", percent) & (F.least("k", "hk") >= needed(F.col("n"), F.col("hn"), percent)))
    low = F.col("c") < F.col("hc")
    pairs = met.select(F.least("c", "hc").alias("a"), F.greatest("c", "hc").alias("b"), F.when(low, F.col("n")).otherwise(F.col("hn")).alias("na"), F.when(low, F.col("hn")).otherwise(F.col("n")).alias("nb"), F.when(low, "b").otherwise("a").alias("hub"))
    return materialise(pairs.groupBy("a", "b", "na", "nb").agg(F.min("hub").alias("hub")), "pairs")


def _band(n: Column) -> Column:
    """Sizes in bands of a twentieth, small sizes one by one."""
    return F.when(n <= 20, n).otherwise(20 + F.floor(F.log(n / 20) * 20)).cast("int")


def _least_needed(n: Column, lo: Column, hi: Column, percent: int) -> Column:
    """A lower bound of needed(n, x) for all x from lo to hi; exact if lo = hi.

    With m as in needed, a set's room is 1 - ceil(t n) + m. Bounding the terms one by one is exact for a single size;
    for a band, 1 - ceil(t x) > -t x leaves an expression that falls as x grows.
    """
    up = lambda x, d: F.floor((x + (d - 1)) / d)
    mine = 1 - up(n * percent, 100) + up((n + lo) * percent, 100 + percent)
    each = 1 - up(hi * percent, 100) + up((n + lo) * percent, 100 + percent)
    t, u = percent / 100, percent / (100 + percent)
    line = F.floor(n * u - hi * (t - u) - 1e-6) + 1
    return F.least(mine, F.greatest(each, line))


def _across(lists: DataFrame, group: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb, hub), not among those tried, of classes in different components that share enough of their lists.

    Lists are numbered from the shortest to the longest. A pair is written in its first common list, so both of its
    classes must have the needed weight in that list and longer ones. A long list therefore only pairs members that have
    little else to share; the texts of a template with one word of their own share too little and are not paired at all.
    Within a list members meet by bands of sizes, and only those that have the weight for the band they meet.
    """
    placed = lists.select("h", "c", "n").join(group.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    placed = materialise(placed, "placed")
    # lists with the same members are one list of weight m; x, y and z tell sets of members apart
    opened = placed.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.bit_xor(F.xxhash64("c")).alias("x"), F.sum(F.pmod("c", F.lit(1 << 30))).alias("y"), F.count("*").alias("z")).where("lo <> hi")
    once = opened.groupBy("x", "y", "z").agg(F.min("h").alias("h"), F.count("*").alias("m")).orderBy("z", "h")
    # the weight rides in the last bits of the list's number; the largest one stands for itself and more
    once = materialise(once.select("h", (F.shiftleft(F.monotonically_increasing_id(), WEIGHT_BITS) + F.least("m", F.lit(MOST))).alias("l")), "open")
    worth = lambda l: F.when(l.bitwiseAND(MOST) == MOST, 1 << 40).otherwise(l.bitwiseAND(MOST))
    by_class = Window.partitionBy("c")
    later = by_class.orderBy(F.desc("l")).rowsBetween(Window.unboundedPreceding, 0)
    members = materialise(placed.join(once, "h").drop("h").withColumn("k", F.sum(worth(F.col("l"))).over(later)).withColumn("own", _band(F.col("n"))), "members")
    bands = members.groupBy("l", "own").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("k").alias("top"))
    bands = bands.groupBy("l").agg(F.collect_list(F.struct("own", "lo", "hi", "top")).alias("bands"))
    meets = lambda x: (x.hi * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= x.lo * percent) & (F.least("k", x.top) >= _least_needed(F.col("n"), x.lo, x.hi, percent))
    able = members.join(bands, "l").select("*", F.explode(F.filter("bands", meets).getField("own")).alias("other")).drop("bands")
    able = materialise(able, "able")
    # all open lists of a class that is still there ride along, so that a pair is written in its first common list only
    needs = able.select("c").distinct()
    own = members.join(needs, "c", "left_semi").groupBy("c").agg(F.collect_list("l").alias("ls"))
    rest = materialise(able.join(own, "c"), "rest")
    side = lambda x: rest.select("l", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.col("own").alias(f"o{x}"), F.col("other").alias(f"w{x}"), F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("k").alias(f"k{x}"), F.col("ls").alias(f"ls{x}"), F.col("component").alias(f"g{x}"))
    common = F.array_intersect("lsa", "lsb")
    weight = F.aggregate(common, F.lit(0).cast("long"), lambda w, x: w + worth(x))
    need = needed(F.col("na"), F.col("nb"), percent)
    likely = ((F.col("p") < F.col("q")) | (F.col("a") < F.col("b"))) & (F.col("ga") != F.col("gb")) & _close("na", "nb", percent) & (F.least("ka", "kb") >= need)
    lower, upper = side("a").where("oa <= wa"), side("b").where("ob >= wb")
    met = lower.join(upper, ["l", "p", "q"]).where(likely & (F.col("l") == F.array_min(common)) & (weight >= need))
    turned = F.col("a") > F.col("b")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(turned, F.col("na")).otherwise(F.col("nb")).alias("nb"), F.lit("a").alias("hub"))
    cross = materialise(met.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    spent(placed, once, members, able, rest)
    release(lists.sparkSession)
    return cross


def _count(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shared, percent: int) -> DataFrame:
    """Those of pairs (a, b, na, nb, hub) that reach the similarity: a, b, by the classes' numbers. The set of a meets
    those of its pairs, or the set of b where hub says so."""
    turned = F.col("hub") == "b"
    pairs = pairs.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"))
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HEAD_PART).cast("int").alias("parts"))
    place = lambda p, head: F.struct(F.col("a").alias("g"), p.alias("p"), F.lit(head).alias("head"))
    # neither a head of many parts nor a member of many heads has all its places in one row
    runs = pairs.groupBy("b").agg(F.ceil(F.count("*") / 64).cast("int").alias("runs"))
    members = pairs.join(parts, "a").join(runs, "b").select(F.col("b").alias("c"), (-1 - F.pmod(F.xxhash64("a"), F.col("runs"))).cast("int").alias("run"), place(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), False).alias("at"))
    heads = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p")).select(F.col("a").alias("c"), F.floor(F.col("p") / 64).cast("int").alias("run"), place(F.col("p"), True).alias("at"))
    wanted = members.unionByName(heads).groupBy("c", "run").agg(F.collect_list("at").alias("at"))
    reps = materialise(wanted.join(classes, wanted["c"] == classes["c1"]).select("rep", "key", "c1", "c2", "cid", "at"), "wanted")
    texts = docs.withColumn("rep", F.coalesce("doc_id", F.lit(NO_ID))).join(small(reps, F.size("at")), ["rep", "key"]).select("c1", "c2", "cid", "at", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            for piece in slices(batch, "text"):
                out = []
                for c1, c2, cid, at, own in zip(*[piece.column(k).to_pylist() for k in range(4)], shingle_sets(piece.column("text")), strict=True):
                    if len(own) and digest(own) == (c1, c2):
                        keys = np.sort(order.keys(own))
                        for f, part in enumerate(np.split(keys, np.searchsorted(keys, order.cuts))):
                            if len(part):
                                out += [(x["g"], x["p"], f, 0 if x["head"] else 1, cid, len(own), part.tobytes()) for x in at]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["g", "p", "f", "side", "cid", "n", "seg"])
        trim()

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heads, last = None, [], None  # one head, unless two classes share the first half of their digests
        for batch in batches:
            out = []
            for g, p, f, side, cid, n, seg in zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True):
                if (g, p, f) != group:
                    group, heads, last = (g, p, f), [], None
                if (side, cid) == last:  # repeated rows
                    continue
                last, own = (side, cid), np.frombuffer(seg, np.uint64)
                if side == 0:
                    heads.append((cid, n, own))
                    continue
                for a, na, theirs in heads:
                    common = len(np.intersect1d(theirs, own, assume_unique=True))
                    if common:
                        out.append((a, cid, na, n, common))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["a", "b", "na", "nb", "common"])

    where = ["g", "p", "f"]
    segments = texts.mapInArrow(cut, "g long, p int, f int, side int, cid long, n int, seg binary").repartition(*where).sortWithinPartitions(*where, "side", "cid")
    partial = segments.mapInArrow(overlap, "a long, b long, na int, nb int, common int")
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    links = materialise(summed.where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b"), "links")
    spent(reps)
    release(docs.sparkSession)
    return links


def classes_of(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, key (hash of the text), n_shingles, component_id (smallest doc_id linked to it, itself included), group (a number for the component, null for texts without words).

    Rows are told apart by id and text, so neither a repeated id nor a repeated text gathers in one place.

    Texts that are null or without words have n_shingles 0 and component_id doc_id. A null doc_id counts as no id: such
    a row gets the smallest id of its group, null if there is none. Repeated rows are kept and form one class. An empty
    table gives no rows. docs needs doc_id and text; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").alias("text"))
    rows, order = _profile(docs)
    found = rows.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("id"), F.max(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("rep"), "key")).alias("r"))
    again = F.row_number().over(Window.partitionBy("c1").orderBy("c2")) > 1  # another set with the same first half
    classes = materialise(found.select("c1", "c2", F.when(again, F.xxhash64("c1", "c2")).otherwise(F.col("c1")).alias("cid"), "id", "r.rep", "r.key"), "classes")
    shared = spark.sparkContext.broadcast(order)  # fixed size
    lists = _lists(_postings(docs, shared, percent))
    release(spark)
    tried = _with_heads(lists, percent)
    links = _count(tried, classes, docs, shared, percent)
    group = components(links)
    cross = _across(lists, group, tried, percent)
    more = _count(cross, classes, docs, shared, percent)
    if more.limit(1).count():
        group = components(links.union(more))
    spent(lists, tried, links, cross, more)
    release(spark)
    named = classes.select("c1", "c2", "cid", "id").join(group.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    ids = named.select("c1", "c2", "component").join(smallest, "component").select("c1", "c2", "component_id", F.col("component").alias("group"))
    out = rows.join(ids, ["c1", "c2"], "left")
    return out.select("doc_id", "key", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("c1").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "group")


def op6_vertical_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes_of(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS g FROM d),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 80 * (len(sa.g) + len(sb.g) - n)),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM s JOIN c ON c.a = s.doc_id
"""
