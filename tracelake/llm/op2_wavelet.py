"""Token ids stored as one wavelet matrix per shard.

A shard holds the token ids of whole documents in order. Its ids are renumbered densely, their bits are stored as
planes, most significant first; each plane orders the ids by the bits of the planes before it (zeros first, stable).
Planes carry a rank directory and are compressed in chunks of CHUNK bytes, so a shard is one self-contained byte string
from which a single token (access), a token's count before a position (rank) and its n-th place (select) can be read by
unpacking the chunks they touch, one or two of a plane.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches, table, trim

TOKENIZER, END_ID = "word_bpe_49k.json", 2
SHARD_TOKENS = 1 << 20
BLOCK = 512  # bits for each entry of a rank directory
CHUNK = 1 << 14  # bytes of a plane that are compressed together
MAGIC = b"WVM2"
SHARDS = "part int, seq int, n_docs long, n_tokens long, payload binary"

_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


class Plane:
    """A packed bit-plane whose chunks are unpacked when they are first read."""

    def __init__(self, chunks: list[bytes]):
        self.packed, self.open, self.z = chunks, {}, zstandard.ZstdDecompressor()

    def __getitem__(self, at: slice | int) -> np.ndarray | int:
        if not isinstance(at, slice):
            return self._chunk(at // CHUNK)[at % CHUNK]
        own = [self._chunk(k)[max(0, at.start - k * CHUNK) : max(0, at.stop - k * CHUNK)] for k in range(at.start // CHUNK, min(len(self.packed), -(-at.stop // CHUNK)))]
        return own[0] if len(own) == 1 else np.concatenate([np.zeros(0, np.uint8), *own])

    def _chunk(self, k: int) -> np.ndarray:
        if k not in self.open:
            self.open[k] = np.frombuffer(self.z.decompress(self.packed[k]), np.uint8)
        return self.open[k]

    def whole(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(self.z.decompress(c), np.uint8) for c in self.packed]])


class WaveletShard:
    """Token ids of a shard's documents: doc_ids (None allowed), lengths, and the wavelet matrix."""

    def __init__(self, doc_ids: list, lengths: np.ndarray, alphabet: np.ndarray, planes: list[Plane] | list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.doc_ids, self.lengths, self.alphabet, self.planes, self.zeros, self.ranks = doc_ids, lengths, alphabet, planes, zeros, ranks
        self.n = int(lengths.sum())

    @classmethod
    def build(cls, ids: np.ndarray, doc_ids: list, lengths: np.ndarray) -> WaveletShard:
        if len(ids) and int(ids.max()) < 1 << 16:
            alphabet = np.flatnonzero(np.bincount(ids, minlength=1))
            code = np.zeros(int(alphabet[-1]) + 1, dtype=np.uint16)
            code[alphabet] = np.arange(len(alphabet))
            v = code[ids]
        else:
            alphabet, v = np.unique(ids, return_inverse=True)
            v = v.astype(np.uint32)
        planes, zeros, ranks = [], [], []
        for shift in range(max(1, int(len(alphabet) - 1).bit_length()) - 1, -1, -1):
            one = (v & v.dtype.type(1 << shift)) != 0
            plane = np.packbits(one)
            z = len(v) - int(np.count_nonzero(one))
            nxt = np.empty_like(v)
            np.compress(one, v, out=nxt[z:])
            np.logical_not(one, out=one)
            np.compress(one, v, out=nxt[:z])
            v = nxt
            planes.append(plane)
            zeros.append(z)
            ranks.append(cls._directory(plane))
        return cls(doc_ids, lengths, alphabet.astype(np.uint32), planes, zeros, ranks)

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        step = BLOCK // 8
        padded = np.zeros(-(-len(plane) // step) * step, dtype=np.uint8)
        padded[: len(plane)] = plane
        ones = _POP[padded].reshape(-1, step).sum(axis=1, dtype=np.uint32)
        return np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])

    def to_bytes(self, level: int = 1) -> bytes:
        z = zstandard.ZstdCompressor(level=level)
        known = np.array([d is not None for d in self.doc_ids], dtype=np.uint8)
        ids = np.array([0 if d is None else d for d in self.doc_ids], dtype="<i8")
        parts = [known.tobytes(), np.diff(ids, prepend=0).astype("<i8").tobytes(), self.lengths.astype("<u4").tobytes(), self.alphabet.astype("<u4").tobytes()]
        parts += [rank.astype("<u4").tobytes() for rank in self.ranks]
        for plane in self.planes:
            parts += [plane[a : a + CHUNK].tobytes() for a in range(0, len(plane), CHUNK)]
        packed = [z.compress(p) for p in parts]
        head = json.dumps({"docs": len(self.doc_ids), "tokens": self.n, "zeros": self.zeros, "parts": [len(p) for p in packed]}).encode()
        return MAGIC + struct.pack("<I", len(head)) + head + b"".join(packed)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletShard:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack_from("<I", data, 4)
        head, at, z, parts = json.loads(data[8 : 8 + size]), 8 + size, zstandard.ZstdDecompressor(), []
        for n in head["parts"]:
            parts.append(data[at : at + n])
            at += n
        levels = len(head["zeros"])
        known, ids, lengths, alphabet, *ranks = [z.decompress(p) for p in parts[: 4 + levels]]
        known, ids, chunks = np.frombuffer(known, np.uint8), np.cumsum(np.frombuffer(ids, "<i8")), parts[4 + levels :]
        each = len(chunks) // levels
        planes = [Plane(chunks[k * each : (k + 1) * each]) for k in range(levels)]
        return cls([int(i) if k else None for i, k in zip(ids, known, strict=True)], np.frombuffer(lengths, "<u4").astype(np.int64), np.frombuffer(alphabet, "<u4"), planes, head["zeros"], [np.frombuffer(r, "<u4") for r in ranks])

    def decode(self) -> np.ndarray:
        """All ids in order, of a shard read from bytes: the planes' partitions undone from the last to the first."""
        wide = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        v = np.zeros(self.n, dtype=wide)
        for level, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            one = np.unpackbits(plane.whole(), count=self.n).view(bool)
            w = np.empty_like(v)
            v[z:] |= wide(1 << level)
            w[one] = v[z:]
            w[~one] = v[:z]
            v = w
        return self.alphabet[v] if self.n else np.zeros(0, np.uint32)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, plane = i // BLOCK, self.planes[level]
        at = block * BLOCK // 8
        n = int(self.ranks[level][block]) + int(_POP[plane[at : i // 8]].sum())
        return n + (int(_POP[plane[i // 8] >> (8 - i % 8)]) if i % 8 else 0)

    def _place(self, level: int, k: int, bit: int) -> int:
        """Position of the k-th (from 0) bit of the given value in a plane."""
        rank = self.ranks[level]
        counts = rank if bit else np.arange(len(rank), dtype=np.int64) * BLOCK - rank
        block = int(np.searchsorted(counts, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(counts[block])])

    def access(self, i: int) -> int:
        code = 0
        for level, z in enumerate(self.zeros):
            bit = (int(self.planes[level][i // 8]) >> (7 - i % 8)) & 1
            ones = self._ones(level, i)
            i, code = (z + ones if bit else i - ones), code << 1 | bit
        return int(self.alphabet[code])

    def _range(self, token: int, i: int) -> tuple[int, int, int] | None:
        code = int(np.searchsorted(self.alphabet, token))
        if code >= len(self.alphabet) or self.alphabet[code] != token:
            return None
        lo, hi = 0, i
        for level, z in enumerate(self.zeros):
            bit, a, b = code >> (len(self.zeros) - 1 - level) & 1, self._ones(level, lo), self._ones(level, hi)
            lo, hi = (z + a, z + b) if bit else (lo - a, hi - b)
        return lo, hi, code

    def count(self, token: int, i: int | None = None) -> int:
        """How often token stands among the first i ids (all by default)."""
        got = self._range(token, self.n if i is None else i)
        return got[1] - got[0] if got else 0

    def occurrences(self, token: int) -> list[int]:
        """All positions of token, ascending."""
        got, out = self._range(token, self.n), []
        for k in range(*(got[:2] if got else (0, 0))):
            for level in range(len(self.zeros) - 1, -1, -1):
                bit, z = got[2] >> (len(self.zeros) - 1 - level) & 1, self.zeros[level]
                k = self._place(level, k - z if bit else k, bit)
            out.append(k)
        return out


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Letters of Latin-1, and marks without the apostrophe: a tokenizer with the steps SPLITS splits letters and then marks into just these two.
_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha() and (c.isascii() or c >= "À"))
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
# fixed values: the steps before the model for which that holds, and for which no token crosses white space
SPLITS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}


class WordEncoder:
    """Encodes a batch of texts, each different chunk between spaces and line feeds once.

    Where the tokenizer's steps are those in SPLITS it drops white space and no token crosses it, so a text's ids are its
    chunks' ids in order; the different words of letters go to the model directly, any other chunk through the whole
    tokenizer. Any other tokenizer gets whole texts. Ids are 16-bit, or 32-bit where the vocabulary needs them. Nothing
    is kept from one batch to the next.
    """

    def __init__(self, path: str):
        self.t = _tokenizer(path)
        self.kind = np.dtype("<u2" if self.t.get_vocab_size() <= 1 << 16 else "<u4")
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE writes these bytes as themselves
        others = iter(range(256, 512))
        self.bytes = {i: chr(i) if i in keep else chr(next(others)) for i in range(256)}
        steps = json.loads(self.t.to_str())
        words = [x["content"] for x in steps["added_tokens"]]
        self.direct = all(steps[k] == v for k, v in SPLITS.items()) and not any(re.search(r"\s", w) for w in words)

    def _lists(self, ids: Iterable[list[int]]) -> pa.ListArray:
        return pa.array(ids, pa.list_(pa.from_numpy_dtype(self.kind)))

    def _whole(self, texts: pa.Array) -> pa.ListArray:
        return self._lists([e.ids for e in self.t.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)])

    def _model(self, words: pa.Array) -> pa.ListArray:
        raw = (w if w.isascii() else w.encode().decode("latin-1").translate(self.bytes) for w in words.to_pylist())
        return self._lists([[x.id for x in self.t.model.tokenize(w)] for w in raw])

    def _chunks(self, chunks: pa.Array) -> pa.ListArray:
        """The ids of each of these different chunks: of letters and then of marks, or of the chunk as a whole."""
        plain = pc.match_substring_regex(chunks, f"^[{_LETTERS}]+[{re.escape(_MARKS)}]*$")
        known, rest = chunks.filter(plain), chunks.filter(pc.invert(plain))
        word = pc.dictionary_encode(pc.utf8_lower(pc.utf8_rtrim(known, characters=_MARKS)))
        mark = pc.dictionary_encode(pc.utf8_ltrim(known, characters=_LETTERS))
        pieces = [self._model(word.dictionary), self._whole(mark.dictionary), self._whole(rest), self._lists([[]])]
        at = np.cumsum([0, *map(len, pieces)])
        pairs, plain = np.full((len(chunks), 2), at[3]), plain.to_numpy(zero_copy_only=False)
        pairs[plain, 0], pairs[plain, 1] = word.indices.to_numpy(), at[1] + mark.indices.to_numpy()
        pairs[~plain, 0] = at[2] + np.arange(len(rest))
        got = pa.concat_arrays(pieces).take(pa.array(pairs.ravel()))
        return pa.ListArray.from_arrays(pa.array(got.offsets.to_numpy()[::2]), got.values)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts (null: empty) in order, and how many each text has."""
        if not len(texts):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        texts = pc.fill_null(texts, "")
        if not self.direct:
            got = self._whole(texts)
            return got.values.to_numpy(), np.diff(got.offsets.to_numpy().astype(np.int64))
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        each = pc.dictionary_encode(chunks.values)
        got = self._chunks(each.dictionary).take(each.indices)
        return got.values.to_numpy(), np.diff(got.offsets.to_numpy()[chunks.offsets.to_numpy()].astype(np.int64))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_shards(docs: DataFrame, path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode docs (doc_id, text; null text counts as empty) in ascending doc_id order, null ids first, into shards.

    Rows that share an id are all kept, ordered by a hash of their text. Rows: part, seq, n_docs, n_tokens, payload;
    (part, seq) is the order. Documents are dealt by range of (id, hash), so no id makes a task larger than its share.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seq, held = encoder(path), TaskContext.get().partitionId(), 0, 0
        names, lengths, ids = [], [], []

        def flush():
            nonlocal seq, held
            n = np.concatenate(lengths)
            blob = WaveletShard.build(np.concatenate(ids), list(chain.from_iterable(names)), n).to_bytes()
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([blob], pa.binary())], ["part", "seq", "n_docs", "n_tokens", "payload"])
            names.clear(), lengths.clear(), ids.clear()
            seq, held = seq + 1, 0
            return out

        for batch in batches:
            got, n = enc.encode(batch.column(1))
            ends = np.cumsum(n := n + 1)  # each document's end id follows it
            flat = np.full(len(got) + len(n), end_id, dtype=enc.kind)
            inner = np.ones(len(flat), dtype=bool)
            inner[ends - 1] = False
            flat[inner] = got
            doc_ids, a, base = batch.column(0).to_pylist(), 0, 0
            while a < len(n):  # a shard ends with the document that fills it
                b = min(int(np.searchsorted(ends, base + shard_tokens - held)) + 1, len(n))
                names.append(doc_ids[a:b])
                lengths.append(n[a:b])
                ids.append(flat[base : ends[b - 1]])
                held += int(ends[b - 1]) - base
                a, base = b, int(ends[b - 1])
                if held >= shard_tokens:
                    yield flush()
        if names:
            yield flush()
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return materialise(ordered.mapInArrow(pack, SHARDS), "shards", codec="uncompressed")


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, decoded from the shards: doc_id, start, n_tokens, ids_crc32, part, seq, place (in its shard)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = WaveletShard.from_bytes(payload.as_py())
                raw = memoryview(s.decode().astype("<u4").tobytes())
                ends = np.cumsum(s.lengths)
                starts = ends - s.lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array(s.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(s.lengths, pa.int64()), pa.array(crc, pa.int64())], ["part", "seq", "place", "doc_id", "inner", "n_tokens", "ids_crc32"])

    # words of the parts before (one row per part, as many as the writer had tasks), then of the part's shards before
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("seq"))), F.lit(0))
    first = shards.select("part", "seq", inside.alias("inside")).join(parts, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("ahead"))
    docs = shards.select("part", "seq", "payload").mapInArrow(unpack, "part int, seq int, place long, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return docs.join(first, ["part", "seq"]).select("doc_id", (F.col("ahead") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "part", "seq", "place")


def tokenize(docs: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Write docs as wavelet shards and report each document as read back from them. An empty table gives no rows."""
    import public_tokenizers

    small_batches(docs.sparkSession)
    return read_shards(write_shards(docs, path or public_tokenizers.path(TOKENIZER), **how))


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")
