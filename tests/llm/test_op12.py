import random
import re

from tracelake.llm import op12_licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, phrases=L.PHRASES, notices=L.NOTICES):
    """base places, and of each notice every matching block as a set of starts"""
    w = words_of(text)
    base = sorted((i, t.label) for t in phrases for i in range(len(w)) if w[i : i + len(t.text.split())] == t.text.split())
    found = set()
    for t in notices:
        own = t.text.split()
        if t.share >= 1:
            found |= {(t.label, i, i + len(own), 1.0) for i in range(len(w)) if w[i : i + len(own)] == own}
            continue
        length = L.ceil(len(own) * (1 + L.SLACK))
        hits = [(i, len(set(own) & set(w[i : i + length])) / len(set(own))) for i in range(max(1, len(w) - length + 1))]
        hits = [h for h in hits if h[1] >= t.share - 1e-9]
        while hits:
            run = [hits.pop(0)]
            while hits and hits[0][0] < run[-1][0] + length:
                run.append(hits.pop(0))
            i, share = max(run, key=lambda h: (h[1], -h[0]))
            found.add((t.label, i, min(len(w), i + length), round(share, 9)))
    return len(w), base, found


def run(spark, rows, **how):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words int, base string").repartition(3)
    return sorted(((r.doc_id, r.n_words, [(b.start, b.label) for b in r.base], {(b.label, b.start, b.end, round(b.share, 9)) for b in r.blocks}) for r in L.scan(docs, **how).collect()), key=str)


def texts():
    r = random.Random(4)
    notices = [t.text for t in (*L.PHRASES, *L.NOTICES)]
    out = [None, "", "  \n", "Licensed under CC BY-NC 4.0.", "GNU General Public\nLicense; MIT License, apache LICENSE", "cc by cc by cc", "É MITlicense cc.by", "gnu gnu general public license license", "mit " * 3000 + "license", notices[-4]]
    filler = "and the of a foo bär 12 without any file".split()
    for _ in range(60):
        w = []
        for _ in range(r.randint(1, 4)):
            w += r.choices(filler, k=r.randint(0, 30))
            t = r.choice(notices).split()
            for _ in range(r.choice([0, 0, 1, 3, 8])):
                k = r.randrange(len(t))
                t[k : k + 1] = r.choice([[], ["zzz"], [t[k], "x"]])
                t = t or ["x"]
            w += t
        text = r.choice([" ", ", ", "\n"]).join(w)
        out.append(r.choice([text, text.upper() if text.isascii() else text, text.title()]))
    out.append(" ".join(notices) * 40)
    return out


def test_equals_brute_force(spark):
    rows = [(i if i else None, t) for i, t in enumerate(texts())] + [(3, "mit license"), (3, "mit license")]
    want = sorted(((i, *brute(t)) for i, t in rows), key=str)
    got = run(spark, rows)
    assert got == want
    assert sum(len(x[3]) for x in want) > 60 and any(b[3] < 1 for x in want for b in x[3])


def test_other_templates(spark):
    how = {"phrases": (L.Template("p", "a b a", 1),), "notices": (L.Template("n", "a b c d e f", 0.5), L.Template("q", "x", 0.9))}
    r = random.Random(6)
    rows = [(i, " ".join(r.choices("abcdefxyz", k=r.randint(0, 40)))) for i in range(80)]
    assert run(spark, rows, **how) == sorted(((i, *brute(t, **how)) for i, t in rows), key=str)


def test_no_rows(spark):
    assert run(spark, []) == []


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in L.op12_license_scan(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for d in rows:
        n, base, found = brute(d.text)
        r = got[d.doc_id]
        own = sorted({b for _, b in base})
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), base[0][0] if base else None, base[-1][0] if base else None)
        assert r.base_labels == ",".join(own) and r.labels == ",".join(sorted({*own, *(f[0] for f in found)}))
        assert abs(r.score - max([1.0] * bool(base) + [f[3] for f in found] + [0.0])) < 1e-9
