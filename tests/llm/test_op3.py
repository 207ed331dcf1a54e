import random

from tracelake.llm import op3_lines as L


def brute(rows):
    """rows with distinct (doc_id, text)"""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        l = (t or "").split("\n") if t is not None else []
        gone = set()
        for i in range(len(l) - 2):
            w = tuple(l[i : i + 3])
            if "".join(w).strip(" \t\r"):
                if w in seen:
                    gone |= {i, i + 1, i + 2}
                seen.add(w)
        out.append((str(d), None if t is None else "\n".join(x for i, x in enumerate(l) if i not in gone), len(l), len(gone)))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, pos int, n int").repartition(3)
    return sorted(((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in L.dedup(df).collect()), key=str)


def test_equals_brute_force(spark):
    r = random.Random(3)
    rows = [(i, "\n".join(r.choice(["a", "b", "é", "", " ", "long line of words"]) for _ in range(r.randint(1, 14)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "a\n" * 500), (103, "\n\n\n\n"), (None, "a\nb\na\nb\nx"), (104, "a\nb"), (105, "x\na\nb\na")]
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_are_one_document(spark):
    got = run(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd")])
    assert got == [("1", "a\nb\nc", 3, 0), ("1", "a\nb\nc", 3, 0), ("2", "d", 4, 3)]
    assert run(spark, []) == []
