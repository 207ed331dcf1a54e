import random

from tracelake.llm import op9_mix as M


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, t = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > epochs * sizes[s] + 1e-9}
        if not full:
            t |= {s: left * w[s] / total for s in open_}
            break
        t |= {s: epochs * sizes[s] for s in full}
        left -= sum(epochs * sizes[s] for s in full)
        open_ -= full
    return t


def test_targets_and_taken(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) if i % 17 else None, rng.choice(["a", "a", "a", "b", "é", "z", None, "q"])) for i in range(600)]
    rows += [(5, "dup dup", "a"), (5, "dup dup", "a"), (None, "one", "rare")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, target int").repartition(4)
    got = M.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    goal = brute_targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]} and abs(own[0].target - goal[s]) < 1e-6
        assert abs(sum(r.taken for r in own) - goal[s]) <= 2 * max(r.size for r in own)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    key = lambda rs: sorted(map(str, ((r.doc_id, r.size, r.taken) for r in rs)))
    assert key(got) == key(M.mix(docs.repartition(7)).collect())


def test_edges(spark):
    assert M.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    r = M.mix(spark.createDataFrame([(1, None, None), (2, "", "x")], "doc_id long, text string, source string")).collect()
    assert [(x.size, x.taken, x.source_size) for x in r] == [(0, 0, 0)] * 2


def test_ties_between_sources_go_by_content(spark):
    rng = random.Random(4)
    for k in range(3):
        rows = [(i, "w " * rng.choice([3, 3, 5]), rng.choice(["a", "d", "g"])) for i in range(300)] + [(1, "w w w ", "a"), (1, "w w w ", "d")]
        got = []
        for parts in (1, 3, 8):
            rng.shuffle(rows)
            docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
            got.append(sorted(map(str, M.mix(docs).select("doc_id", "source", "size", "taken").collect())))
        assert got[0] == got[1] == got[2]
