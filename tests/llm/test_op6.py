import random
import re

import numpy as np
import pyarrow as pa

from tracelake.llm import op6_jaccard as J


def grams(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                up[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if find(k) == find(i) and rows[k][0] is not None]
        out.append((str(d), len(sets[i]), str(min(ids) if sets[i] and ids else d)))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 5, "h") for r in rows], "doc_id long, text string, n int, c string").repartition(5)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.classes_of(df).collect())


def corpus(seed, groups, size):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)] + ["É", "Straße"]
    passage = [r.choice(vocab) for _ in range(60)]
    rows, i = [], 0
    for _ in range(groups):
        base = [r.choice(vocab) for _ in range(r.choice([3, 4, 5, 8, 30, 150, 400]))]
        if r.random() < 0.5:
            base += passage
        for _ in range(r.choice([1, 1, 2, size])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                k = r.randrange(len(t))
                t[k : k + r.choice([0, 1])] = [r.choice(vocab)] * r.choice([0, 1])
            rows.append((i if r.random() < 0.97 else None, r.choice([" ", "\n", "  "]).join(t) + r.choice(["", " "])))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n\t "), (0, rows[0][1]), (0, rows[0][1]), (0, "other words than before here"), (i + 3, "A B"), (i + 4, "a  b")]
    return rows


def test_equals_brute_force(spark):
    for seed, groups, size in ((1, 60, 6), (2, 12, 40)):
        rows = corpus(seed, groups, size)
        assert run(spark, rows) == brute(rows)


def test_salted_lists_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "PART", 2)
    rows = corpus(3, 14, 30)
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_words_are_hashed_like_their_bytes():
    texts = pa.array(["a bb  ccc\n" + "x" * 7 + " " + "x" * 8 + " " + "x" * 9 + " " + "y" * 100, None, "", "bb a", "É" * 5])
    h, at = J.word_hashes(texts)
    assert at.tolist() == [0, 7, 7, 7, 9, 10] and h[0] == h[8] and h[1] == h[7] and len(set(h.tolist())) == 8
    h2, at2 = J.word_hashes(texts.slice(3))
    assert at2.tolist() == [0, 2, 3] and np.array_equal(h2, h[7:])


def test_cut_batches_give_the_same_sets():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["Ab", "c", "É", "word", "\n"]) + str(rng.randint(0, 50)) for _ in range(rng.randint(0, 300))) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    whole = [x.tolist() for x in J.shingle_sets(batch.column("text"))]
    assert whole == [J.shingle_sets(pa.array([t]))[0].tolist() for t in texts]
    cut = list(J.slices(batch, "text", 20_000))
    assert len(cut) > 3 and [x.tolist() for p in cut for x in J.shingle_sets(p.column("text"))] == whole


def test_template_rows_are_not_paired(spark, monkeypatch):
    written = {}

    def noted(df, name):
        out = write(df, name)
        written[name] = out.count()
        return out

    write = J.materialise
    monkeypatch.setattr(J, "materialise", noted)
    rows = [(i, f"all rights reserved by the owner of this page {i}") for i in range(300)]
    assert run(spark, rows) == sorted((str(i), 6, str(i)) for i in range(300))
    assert written["members"] >= 300 and written["able"] == written["rest"] == 0
    # some of them with so much in common that they link, across sizes
    rows += [(1000 + i, " ".join(f"v{k}" for k in range(30 + i)) + f" {i}") for i in range(8)] + [(2000 + i, f"{i} all rights reserved by the owner of this old page of {i % 3} and no other kind of thing") for i in range(30)]
    assert run(spark, rows) == brute(rows)


def test_band_bound_never_exceeds_what_is_needed(spark):
    r = random.Random(4)
    cases = []
    for _ in range(4000):
        p, n = r.choice([50, 80, 90]), r.randint(1, 900)
        lo = r.randint(max(1, -(-n * p // 100)), n * 100 // p)
        hi = lo + r.choice([0, r.randint(0, lo // 15)])
        x = min(r.randint(lo, hi), n * 100 // p)
        cases.append((p, n, lo, hi, x))
    df = spark.createDataFrame(cases, "p int, n int, lo int, hi int, x int")
    for p in (50, 80, 90):
        bad = df.where(f"p = {p}").where(J._least_needed(J.F.col("n"), J.F.col("lo"), J.F.col("hi"), p) > J.needed(J.F.col("n"), J.F.col("x"), p))
        assert bad.count() == 0


def test_members_of_many_heads_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "HEAD_PART", 2)
    rows = corpus(5, 20, 25)
    assert run(spark, rows) == brute(rows)
