import random
import re

from tracelake.llm import op4_decontaminate as D


def ws(t):
    return re.findall(D.PATTERN, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, size=10):
    out = []
    for i, t in docs:
        w, hit, ids = ws(t), set(), set()
        for j, x in items:
            q = ws(x)
            n = min(size, len(q))
            for s in range(len(q) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == q[s : s + n]:
                        hit |= set(range(p, p + n))
                        ids.add(j)
        out.append((str(i), len(w), sorted(hit), sorted(str(j) for j in ids if j is not None)))
    return sorted(out)


def run(spark, docs, items):
    d = spark.createDataFrame([(*x, 1, "w") for x in docs], "doc_id long, text string, pos int, word string").repartition(3)
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, df int")
    return sorted((str(r.doc_id), r.n_words, list(r.spans), list(r.items)) for r in D.contaminated(d, b).collect())


def test_equals_brute_force(spark):
    rng = random.Random(4)
    vocab = ["the", "of", "É", "x1", "Zz", "q", "\U0001f600", "longer"]
    say = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 9, 10, 11, 25]))) for i in range(12)] + [(3, say(12)), (None, say(10)), (77, ""), (78, None), (79, "--"), (80, "the the the the the the the the the the the the")]
    docs = []
    for i in range(60):
        parts = [say(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(items)[1] or ""
            parts += [t[: rng.randint(0, len(t))] if rng.random() < 0.4 else t.upper(), say(rng.randint(0, 5))]
        docs.append((i % 50 if i % 13 else None, " ".join(parts)))
    docs += [(1, None), (2, ""), (2, ""), (9, "the " * 40)]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [("1", 2, [], [])]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha " + "z " * 50 + "beta gamma"), (None, "gamma beta alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    assert sorted((r.k1, r.item_id, r.pos) for r in D.proximity(docs, items, within=6).collect()) == [(-1, "7", 0), (1, "7", 0)]


def test_plan_has_no_python(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = D.contaminated(d, spark.createDataFrame([(1, "a b")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_near_matches_equal_brute_force_per_window(spark):
    rng = random.Random(44)
    vocab = [f"w{i}" for i in range(40)] + ["the", "of"] * 8
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 9, 14, 30]))) for i in range(14)] + [(None, say(12)), (70, "gone1 gone2 gone3 " + say(9)), (71, "gone1 the"), (72, "")]
    docs = [(i if i % 9 else None, say(rng.choice([0, 5, 30, 80]))) for i in range(50)]
    for i in range(20):
        w = ws(rng.choice(items)[1])
        rng.shuffle(w)
        docs.append((i, " ".join([say(4), *w, say(4)])))
    docs += [(3, docs[3][1]), (8, None), (9, "the " * 90)]
    df = {}
    for _, t in docs:
        for x in ws(t):
            df[x] = df.get(x, 0) + 1
    want = set()
    for j, t in items:
        q = ws(t)
        for s in range(max(1, len(q) - 9)):
            own = set(q[s : s + 10])
            need, seen = min(4, len(own)), sorted((w for w in own if w in df), key=lambda w: (df[w], w))
            if not own or len(seen) < need:
                continue
            for n, (_, d) in enumerate(docs):
                w = ws(d)
                want |= {(n, j, p, need) for p in range(len(w)) if w[p] in seen[:need] and set(seen[:need]) <= set(w[p : p + 20])}
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    texts = {(str(i), t): n for n, (i, t) in reversed(list(enumerate(docs)))}
    keys = {(r.k1, r.k2): texts[str(r.doc_id), r.text] for r in D._keyed(d).collect()}
    got = [(keys[r.k1, r.k2], None if r.item_id is None else int(r.item_id), r.pos, r.n_terms) for r in D.proximity(d, b).collect()]
    want = {(texts[str(docs[n][0]), docs[n][1]], *x) for n, *x in want}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    rows = sorted((str(r.doc_id), r.n_words, list(r.spans), list(r["items"]), r.near, list(r.near_items)) for r in D.phrase_and_proximity(d, b).collect())
    near = sorted((str(i), any(x[0] == texts[str(i), t] for x in want), sorted({str(x[1]) for x in want if x[0] == texts[str(i), t] and x[1] is not None}), len(ws(t))) for i, t in docs)
    assert [x[:4] for x in rows] == brute(docs, items)
    assert sorted((x[0], x[4], x[5], x[1]) for x in rows) == near
    assert all(set(x[3]) <= set(x[5]) for x in rows)


def test_near_copy_of_an_item_whose_rarest_words_lie_far_apart(spark):
    q = ["rare1", *[f"a{i}" for i in range(20)], "rare2", *[f"b{i}" for i in range(20)], "rare3", *[f"c{i}" for i in range(14)], "rare4"]
    near = [("x" if i % 9 == 4 else w) for i, w in enumerate(q)]
    changed = [w for i, w in enumerate(q) if i % 9 == 4] * 5
    docs = [(1, " ".join(q)), (2, " ".join(near)), (3, " ".join(w for w in q if "rare" not in w)), (4, " ".join(changed))]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(q))], "item_id long, text string")
    assert {r.k1 for r in D.proximity(docs, items).collect()} == {1, 2, 3}
    assert sorted((r.doc_id, r.near_items, len(r.spans) > 0) for r in D.phrase_and_proximity(docs, items).collect()) == [(1, ["7"], True), (2, ["7"], False), (3, ["7"], True), (4, [], False)]
