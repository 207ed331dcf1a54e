import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracelake.llm import op2_wavelet as W

PATH = public_tokenizers.path(W.TOKENIZER)
TEXTS = ["", "Of the inanin. Thonst", "É ê ß Éçeau, don't I'll 'S x..", "á İstanbul ΣΑΣ straße ﬁ", "12 34a b5.,", "x\ty z q\n\nw", "<|endoftext|> a<|startoftext|>b", "word,word. (a) *** &&& \U0001f600\U0001f600", " lead and trail ", "'s 't d's"]


def encoded(e, texts):
    ids, n = e.encode(pa.array(texts, pa.string()))
    assert ids.dtype == e.kind and len(n) == len(texts) and n.sum() == len(ids)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if texts else []


def test_chunked_encoding_equals_the_tokenizer():
    t, e = Tokenizer.from_file(PATH), W.WordEncoder(PATH)
    assert e.direct
    for x in [*TEXTS, " ".join(TEXTS), "\n".join(TEXTS) * 3]:
        assert encoded(e, [x]) == [t.encode(x, add_special_tokens=False).ids], x


def test_batches_of_texts_equal_the_tokenizer():
    t, e = Tokenizer.from_file(PATH), W.WordEncoder(PATH)
    own = "".join(chr(i) for i in range(0x250))
    texts = [None, *TEXTS, None, "", *[a + b for a in TEXTS for b in own[::7]], *own, *[f"Ab{c}" for c in own], *[f"{c}Ö{c}" for c in own], " ".join(own)]
    assert encoded(e, texts) == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert encoded(e, []) == [] and encoded(e, ["", None]) == [[], []]
    e.direct = False
    assert encoded(e, TEXTS + [None]) == [t.encode(x, add_special_tokens=False).ids for x in TEXTS] + [[]]


@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40), max_size=5))
def test_any_texts_equal_the_tokenizer(texts):
    e = W.encoder(PATH)
    assert encoded(e, texts) == [e.t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("size,most", [(0, 5), (1, 1), (7, 3), (3000, 2), (5000, 49408), (2000, 200000)])
def test_matrix_round_trip_and_queries(size, most):
    rng = np.random.default_rng(size)
    ids = rng.integers(0, most, size).astype(np.uint32 if most > 65536 else np.uint16)
    lengths = np.array([size // 2, 0, size - size // 2])
    s = W.WaveletShard.from_bytes(W.WaveletShard.build(ids, [5, None, -3], lengths).to_bytes())
    assert s.decode().tolist() == ids.tolist() and s.doc_ids == [5, None, -3] and s.lengths.tolist() == lengths.tolist()
    for i in range(0, size, max(1, size // 50)):
        assert s.access(i) == ids[i]
        assert s.count(int(ids[i]), i) == int((ids[:i] == ids[i]).sum())
        assert s.occurrences(int(ids[i])) == np.flatnonzero(ids == ids[i]).tolist()
    assert s.count(most + 7) == 0 and s.occurrences(most + 7) == []


def test_documents_come_back(spark):
    rows = [(i % 7 if i % 5 else None, TEXTS[i % len(TEXTS)] if i % 11 else None, "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    got = W.tokenize(docs, shard_tokens=40).orderBy("start").collect()
    t, at = Tokenizer.from_file(PATH), 0
    left = sorted(((-1 if i is None else i), (ids := t.encode(x or "", add_special_tokens=False).ids + [2], zlib.crc32(np.array(ids, "<u4").tobytes()))[1], len(ids)) for i, x, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32, r.n_tokens) for r in got) == left
    assert [(-1 if r.doc_id is None else r.doc_id) for r in got] == [x[0] for x in left]
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_empty_table(spark):
    assert W.tokenize(spark.createDataFrame([], "doc_id long, text string")).count() == 0
