"""Quality score by a byte-level convolutional network in numpy.

A text's UTF-8 bytes pass through FILTERS learned filters of TAPS bytes with a rectifier. Activations are averaged over
overlapping chunks that cover the whole text (CHUNK bytes every HOP bytes); a small dense layer looks at each chunk, the
chunks' outputs are max-pooled over the text, and a logistic unit turns them into one probability.

The network is trained on the driver from a bounded sample of labelled rows: at most TRAIN_ROWS rows, the first by a
hash of doc_id, of the rows whose crc32(doc_id) mod 5 is not 0. A text of more than TRAIN_LONGEST bytes is not in the
sample, so that the sample fits the driver. Texts are learned from and scored whole, every byte. Label, language, source and id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, trim

TAPS, FILTERS, HIDDEN = 4, 24, 32
HOP, CHUNK = 32, 64
TRAIN_ROWS, TRAIN_LONGEST, EPOCHS, STEPS, BATCH = 4000, 200_000, 8, 320, 50
FOLDS, THRESHOLD = 5, 0.3
BLOCK = 1 << 14  # bytes convolved at a time, so that activations stay in cache


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded with spaces to whole hops, two at least and with TAPS spaces at the end, and the
    texts' first hops. TAPS spaces lead, so that a filter at a text's first byte sees the same wherever the text lies."""
    sizes = np.array([max(2, -(-(len(t) + TAPS) // HOP)) for t in texts], dtype=np.int64)
    starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    out = np.full(TAPS + int(starts[-1]) * HOP, 32, dtype=np.uint8)
    for t, s in zip(texts, starts.tolist(), strict=False):
        out[TAPS + s * HOP : TAPS + s * HOP + len(t)] = np.frombuffer(t, np.uint8)
    return out, starts


class ByteNet:
    def __init__(self, seed: int = 10):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "taps": (r.standard_normal((TAPS, 256, FILTERS)) * 0.5).astype(f), "bias": np.zeros(FILTERS, f),
            "w1": (r.standard_normal((2 * FILTERS, HIDDEN)) / np.sqrt(FILTERS)).astype(f), "b1": np.zeros(HIDDEN, f),
            "w2": (r.standard_normal(HIDDEN) / np.sqrt(HIDDEN)).astype(f), "b2": np.zeros(1, f),
        }

    def conv(self, raw: np.ndarray) -> np.ndarray:
        """Mean activation of each filter in each hop. The filter at byte i sees bytes i-TAPS+1 to i."""
        n = len(raw) - TAPS
        taps, bias = self.p["taps"], self.p["bias"]
        out = np.empty((n // HOP, FILTERS), taps.dtype)
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK)
            z = taps[0].take(raw[a + 1 : b + 1], axis=0)
            for k in range(1, TAPS):
                z += taps[k].take(raw[a + 1 + k : b + 1 + k], axis=0)
            z += bias
            np.maximum(z, 0, out=z)
            out[a // HOP : b // HOP] = z.reshape(-1, HOP, FILTERS).mean(axis=1)
        return out

    def chunks(self, hops: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of the dense layer per chunk (mean activations and their squares), the chunks' first hops, and where each text's chunks begin."""
        first = np.delete(np.arange(len(hops)), starts[1:] - 1)  # the last hop of a text begins no chunk
        m = (hops[first] + hops[first + 1]) * hops.dtype.type(0.5)
        return np.concatenate([m, m * m], axis=1), first, starts[:-1] - np.arange(len(starts) - 1)

    def forward(self, raw: np.ndarray, starts: np.ndarray):
        x, first, begin = self.chunks(self.conv(raw), starts)
        h = x @ self.p["w1"] + self.p["b1"]
        np.maximum(h, 0, out=h)
        top = np.maximum.reduceat(h, begin, axis=0)
        return 1 / (1 + np.exp(-np.clip(top @ self.p["w2"] + self.p["b2"][0], -30, 30))), (x, first, begin, h, top)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.forward(*pack(texts))[0] if texts else np.zeros(0)

    def gradients(self, raw: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, (x, first, begin, h, top) = self.forward(raw, starts)
        d = ((p - y) / len(y)).astype(top.dtype)
        g = {"w2": top.T @ d, "b2": d.sum(keepdims=True)}
        # only the winning chunk of each text and hidden unit learns
        ends = np.append(begin[1:], len(h))
        win = np.stack([a + h[a:b].argmax(axis=0) for a, b in zip(begin, ends, strict=True)])
        dh = d[:, None] * self.p["w2"][None, :] * (top > 0)
        at, back = np.unique(win, return_inverse=True)
        dz = np.zeros((len(at), HIDDEN), top.dtype)
        np.add.at(dz, (back.reshape(win.shape), np.arange(HIDDEN)[None, :]), dh)
        g["w1"], g["b1"] = x[at].T @ dz, dz.sum(axis=0)
        dx = dz @ self.p["w1"].T
        m = x[at, :FILTERS]
        dm = (dx[:, :FILTERS] + 2 * m * dx[:, FILTERS:]) / CHUNK
        place = TAPS + (first[at] * HOP)[:, None] + np.arange(CHUNK)[None, :]
        seen = [raw[place - (TAPS - 1) + k] for k in range(TAPS)]
        z = sum(self.p["taps"][k][seen[k]] for k in range(TAPS)) + self.p["bias"]
        da = (z > 0) * dm[:, None, :]
        g["bias"], da = da.sum(axis=(0, 1)), da.reshape(-1, FILTERS)
        g["taps"] = np.zeros_like(self.p["taps"])
        for k in range(TAPS):
            order = np.argsort(seen[k].ravel(), kind="stable")
            b = seen[k].ravel()[order]
            cut = np.flatnonzero(np.diff(b, prepend=-1))
            g["taps"][k][b[cut]] = np.add.reduceat(da[order], cut, axis=0)
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int | None = None, batch: int = BATCH, rate: float = 0.015, seed: int = 10) -> ByteNet:
        """EPOCHS passes over the sample, or as many as make STEPS steps of a batch each."""
        epochs = epochs or max(EPOCHS, -(-STEPS * batch // len(texts)))
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t, steps = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for a in range(0, len(texts), batch):
                own = order[a : a + batch]
                raw, starts = pack([texts[i] for i in own])
                t += 1
                for k, g in self.gradients(raw, starts, labels[own]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    step = rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-7)
                    self.p[k] = (self.p[k] - step).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ByteNet:
    """Fit on the bounded sample described above; without labelled rows the net says what it was born with.

    The sample of ids is cut first (a top-k), then broadcast to fetch the texts: rows ids are a fixed bound.
    """
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y is not null")
    ids = good.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    short = texts.where(F.octet_length("text") <= TRAIN_LONGEST)
    got = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    net = ByteNet()
    return net.fit([r.text.encode("utf-8", "replace") for r in got], np.array([r.y for r in got], np.float32)) if got else net


def score(docs: DataFrame, net: ByteNet, out: str = "_score") -> DataFrame:
    """docs with every column kept and the score added as ``out``, which must be no column of docs (see common.free).
    Null text counts as empty; repeated rows are kept; no shuffle."""
    if out in docs.columns:
        raise ValueError(f"docs has a column {out}")
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(net.p)
    names = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # Python is not given names with dots
    schema = docs.select("*", F.lit(0.0).cast("double").alias("p")).schema
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ByteNet.__new__(ByteNet)
        own.p = shared.value
        for batch in batches:
            got, held, size = [], [], 0
            for t in batch.column(at):
                held.append((t.as_py() or "").encode("utf-8", "replace"))
                size += len(held[-1])
                if size > 1 << 21:
                    got.append(own.score(held))
                    held, size = [], 0
            got.append(own.score(held))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got), pa.float64())], schema.names)
        trim()

    return docs.mapInArrow(run, schema).toDF(*names, out)


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, net)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
