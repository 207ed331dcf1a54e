import zlib

import numpy as np

from tracelake.llm import op10_quality as Q


def test_scores_do_not_depend_on_company_and_cover_the_whole_text():
    net = Q.ByteNet(3)
    texts = [b"", b"a", b"x" * 27, b"y" * 28, b"z" * 29, "é".encode() * 500, b"some words " * 9000]
    alone = np.array([net.score([t])[0] for t in texts])
    assert np.allclose(net.score(texts), alone, atol=1e-6) and np.allclose(net.score(texts[::-1])[::-1], alone, atol=1e-6)
    assert net.score([b"a" * 100_000])[0] != net.score([b"a" * 99_000 + b"#$%^&*(@!" * 100 + b"a" * 100])[0]


def test_gradients_are_right():
    net = Q.ByteNet(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    raw, starts = Q.pack([b"hello there world, a text of some length" * 3, b"!!!! #### $$$$", b"plain"])
    y = np.array([1, 0, 1], np.float32)
    loss = lambda: float(-(y * np.log(p := net.forward(raw, starts)[0]) + (1 - y) * np.log(1 - p)).mean())
    g = net.gradients(raw, starts, y)
    r = np.random.default_rng(0)
    for k in net.p:
        for _ in range(6):
            at = tuple(r.integers(0, n) for n in net.p[k].shape) if k != "taps" else (r.integers(0, Q.TAPS), ord(r.choice(list("elo!# "))), r.integers(0, Q.FILTERS))
            old = net.p[k][at]
            net.p[k][at] = old + 1e-6
            up = loss()
            net.p[k][at] = old - 1e-6
            down = loss()
            net.p[k][at] = old
            assert abs((up - down) / 2e-6 - g[k][at]) < 1e-5, (k, at)


def junk(i, r):
    return " ".join(r.choice(["###", "!!", "***", "$$"]) + r.choice(["a", "b", "the"]) for _ in range(40)) if i % 4 == 0 else " ".join(r.choice(["the", "of", "and", "some", "word", "text"]) for _ in range(40))


def test_learns_from_training_folds_only(spark):
    r = np.random.default_rng(2)
    rows = [(i, junk(i, r), "x", 0.5) for i in range(500)]
    docs = spark.createDataFrame([*rows, (None, None, "x", 0.1), (7, "", "y", 0.2), (7, rows[7][1], "x", 0.1)], "doc_id long, text string, lang string, score double").repartition(3)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    labels = [(i, int(i % 4 != 0) if fold(i) else int(i % 4 == 0)) for i in range(500)]  # lies in the held-out fold
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int")
    got = Q.score(docs, Q.train(docs, lab)).collect()
    assert len(got) == 503 and set(got[0].asDict()) == {"doc_id", "text", "lang", "score", "_score"}
    by = {x.doc_id: x for x in got if x.doc_id is not None and x.text}
    right = [(by[i]._score >= 0.3) == (i % 4 != 0) for i in range(500) if fold(i) == 0]
    assert sum(right) > 0.97 * len(right)
    assert all(0 <= x._score <= 1 for x in got)
    flags = {x.doc_id: x.h for x in docs.select("doc_id", Q.held_out(docs.doc_id).alias("h")).collect()}
    assert all(flags[i] == (fold(i) == 0) for i in range(500)) and flags[None] is False


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.score(docs, Q.train(docs, lab)).count() == 0
