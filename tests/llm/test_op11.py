import re
from itertools import permutations

from tracelake.llm import op11_audit as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def flags(rows):
    """[(doc_id, part, flags)] of (doc_id, text, lang) rows, each by the definition."""
    out = []
    for i, text, lang in rows:
        t = text or ""
        w = WORD.findall(t)
        smaller = any((j is not None and (i is None or j < i)) and (u or "") == t for j, u, _ in rows)
        out.append((i, lang or "", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), smaller)))
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    docs = flags(rows)
    for part in {p for _, p, _ in docs}:
        own, shapley, found = [d for d in docs if d[1] == part], dict.fromkeys(A.FILTERS, 0), {}
        for order in permutations(A.FILTERS):
            left = own
            for k, f in enumerate(order):
                x = A.FILTERS.index(f)
                gone = [d for d in left if d[2][x]]
                left = [d for d in left if not d[2][x]]
                shapley[f] += len(gone)
                found["".join(order), k + 1] = (f, len(left), len(gone), sum(d[2][x] for d in own) - len(gone), sum(d[2][x] and sum(d[2]) == 1 for d in own), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone))
        out |= {(part, *k): (*v[1:], shapley[v[0]]) for k, v in found.items()}
    return out


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, lang string, n int, A boolean").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = A.audit(A.failures(docs), marks).collect()
    key = lambda r: (r.part, r.filter_order, r.step)
    val = lambda r: (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
    assert len({key(r) for r in got}) == len(got)
    return {key(r): val(r) for r in got if r.part is not None}, {key(r)[1:]: val(r) for r in got if r.part is None}


def cases():
    long = " ".join(f"w{i}" for i in range(210))
    rows = [(1, long, "en"), (2, long, "en"), (3, long, "de"), (4, "a " * 300, "en"), (5, "ABC " * 60, None), (6, "short # text", "en"), (7, None, "en"), (8, "", "de"), (None, long, "en"), (None, None, None), (9, long + " É x 50%", "fr")]
    rows += [(10, "x\x0by\x1cz " * 150, "fr"), (11, long.upper(), "fr"), (11, long.upper(), "fr"), (12, "w " * 100_000 + "|", "en"), (13, " \t\n", "en"), (13, "A" + "b" * 32, "en"), (14, "A" + "b" * 33, "en")]
    return rows, [(1, 1, 0), (2, 1, 0), (3, 0, 1), (4, 0, 1), (4, 1, None), (5, None, None), (11, 0, 1), (None, 1, 1), (99, 1, 1)]


def test_equals_brute_force(spark):
    rows, labels = cases()
    got, whole = run(spark, rows, labels)
    assert got == brute(rows, labels)
    assert whole == {k[1:]: v for k, v in brute([(i, t, "") for i, t, _ in rows], labels).items()}


def test_flags_of_single_texts(spark):
    rows, _ = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = sorted(((r.doc_id, r.part, tuple(r[f] for f in A.FILTERS)) for r in A.failures(docs).collect()), key=str)
    assert got == sorted(flags(rows), key=str)


def test_no_documents_no_labels(spark):
    assert run(spark, [], [(1, 1, 1)]) == ({}, {})
    got, _ = run(spark, [(1, "a", "en")], [])
    assert len(got) == 600 and got["en", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_the_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr("tracelake.llm.common.BROADCAST_ROWS", 0)
    rows, labels = cases()
    assert run(spark, rows, labels)[0] == brute(rows, labels)
