import random
import re
import zlib

from tracelake.llm import op13_variants as V


def near(a, b):
    """Whether a and b differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, cut=199):
    n = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if cut and h % cut == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            n[w] = n.get(w, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    form, count = {}, {}
    for w in n:
        found = sorted((-n[v], v) for v in n if near(w, v))
        count[w] = len(found)
        form[w] = found[0][1] if found and -found[0][0] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], count[w], n[form[w]] if form[w] else None)
    return out


def run(spark, rows, shard=V.SHARD, **how):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string").repartition(3)
    got = V.variants(docs, shard=shard, **how).collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def corpus(seed, letters="abé", lengths=(5, 8), words=400):
    r = random.Random(seed)
    own = ["".join(r.choice(letters) for _ in range(r.randint(*lengths))) for _ in range(words)]
    return [(i, " ".join(w for w in r.choices(own, weights=[1 / (k + 1) for k in range(words)], k=300))) for i in range(60)]


HOSTILE = [
    (None, "Straße ÄRGER ärger Ärgernis " * 6), (1, None), (2, ""), (3, "a" * 300 + " " + "a" * 301 + " " + "a" * 299 + "b"), (3, "×÷×÷×÷ x" * 9), (7, "ABCDEF abcdef abcdeg " * 40),
    (11, "linkaa " * 6 + "linkab " * 31 + "linkbb " * 160), (8, ("y" * 300 + " " + "y" * 301 + " ") * 7), (9, "abcdegg " * 200), (9, "abcdegg " * 200), (10, "short abcdé 1abcdef2abcdef " * 9),
]


def test_equals_brute_force(spark):
    rows = corpus(1) + HOSTILE
    want = brute(rows)
    assert any(v[1] != v[0] and v[0] for v in want.values()), "a chain of forms"
    assert run(spark, rows) == want


def test_blocks_cut_into_many_automata(spark):
    rows = corpus(2, letters="ab", lengths=(6, 9), words=300) + HOSTILE
    assert run(spark, rows, shard=7) == brute(rows)


def test_letters_left_out(spark):
    rows = corpus(3, letters="abcdefgh", words=120)
    assert run(spark, rows, cut=3) == brute(rows, cut=3)
    assert run(spark, rows, cut=0) == brute(rows, cut=0)


def test_no_words(spark):
    assert run(spark, []) == {} == run(spark, [(1, None), (2, "too few")])


def test_automaton_is_minimal_and_numbers_words():
    words = sorted({a + b for a in ("star", "st", "", "sta", "bar") for b in ("", "ting", "ted", "s")})
    a = V.Automaton(words)

    def walk(word):
        return a._finish(a.root, 0, word, 0)

    assert [walk(w) for w in words] == list(range(len(words)))
    assert walk("start") is None and walk("bart") is None
    tails = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:k] for k in range(len(w) + 1))}
    assert len(a.edges) == len(tails)
    assert V.Automaton([]).root == 0


def test_each_near_word_once():
    r = random.Random(5)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 7))) for _ in range(150)})
    a = V.Automaton(words)
    for w in words:
        for exact in range(len(w) + 1):
            got = [i for i in a.near(w, exact) if i is not None]
            assert sorted(got) == [i for i, v in enumerate(words) if v[:exact] == w[:exact] and len(v) >= exact and near(w, v)], (w, exact)


def test_very_long_words_take_little_time():
    words = sorted(["a" * 50_000, "a" * 50_001, "ab" * 25_000])
    a = V.Automaton(words)
    assert [[words[i] for i in a.near(w, len(w) // 2) if i is not None] for w in words] == [["a" * 50_001], ["a" * 50_000], []]
