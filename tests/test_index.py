"""The structural index against the scanner: wherever the index answers, both agree in every fact."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.operators import index, parse
from tests.test_scanner import F1

CHUNKS = ["system", "tool", "user", "plan", "act", "result", "response", "「", "」", "{", "}", "[", "]", "•", "↦", "🏷", "※", "⊨", "𝑝", '"', "\\", "'", " ", "\n", "todo", "call", "id", "data", "name", "1", "2", "0.9", "1.50", "007", "3eggs", "true", "null", "é", "²", "x y", "\x00", " "]


def same(texts, strict, least=0):
    got, ok = index.facts(pa.array(texts, pa.string()), strict)
    assert ok.sum() >= least
    for i, g in enumerate(got.to_pylist()):
        if ok[i]:
            want = parse.facts_of(texts[i], strict)
            assert g == want, (texts[i], {k: (g[k], want[k]) for k in want if g[k] != want[k]})
    want = [parse.facts_of(t, strict) for t in texts]
    assert parse.facts_of_batch(pa.array(texts, pa.string()), strict, limit=5000).to_pylist() == want
    return ok


class Writer:
    """Random well-formed traces; operators stand next to their values if tight."""

    def __init__(self, seed, tight):
        self.r, self.gap = random.Random(seed), "" if tight else " "
        self.tight = tight

    def text(self):
        r = self.r
        return "".join(r.choices(["a", "word", " ", "'", "é", "🏷", "{", "•", "\n", "⊨ 1", "plan {", "\x07", "日本"], k=r.randint(0, 6)))

    def string(self):
        t = self.text()
        kind = self.r.randint(0, 2)
        if kind == 0:
            return '"' + t.replace("\\", "\\\\") + self.r.choice(["", '\\"', "\\\\", "\\n", "「", "」"]) + '"'
        return "「" + t + self.r.choice(["", '"', "「in」", "\\", '\\"']) + "」"

    def atom(self):
        return self.r.choice([self.string(), self.string(), "word", "tr-ue", "true", "null", "0", "12", "0.5", "1.25", "w.1", "é1"])

    def number(self):
        return self.r.choice(["1", "2", "3", "10", "0.9", "0.75"])

    def ops(self):
        r, out = self.r, ""
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            kind = r.choice("🏷※⊨𝑝")
            if kind == "※":
                value = r.choice(["usr1", "ref" if self.tight else self.string(), "[ a • usr1 •\n b ]", "[]", '["x" • 「y」 • 3]'])
            elif kind == "🏷":
                value = r.choice(["t1", "call_1", "plan", "7"] + ([] if self.tight else [self.string()]))
            elif kind == "⊨":
                value = r.choice([self.number()] + ([] if self.tight else ["[1 • 2]", "[ 3 • x ]"]))
            else:
                value = self.number()
            out += r.choice(["", " ", "\n"]) + kind + self.gap + value
        return out

    def value(self, depth=0):
        k = self.r.random()
        if depth < 3 and k < 0.15:
            return self.object(depth + 1)
        if depth < 3 and k < 0.3:
            items = [self.value(depth + 1) + ("" if self.tight else self.ops()) for _ in range(self.r.randint(0, 3))]
            return "[" + " • ".join(items) + self.r.choice(["", " •"] if items else [""]) + "]"
        return self.atom()

    def object(self, depth=0, keys=()):
        r = self.r
        names = [*keys, *r.sample(["a", '"b c"', "id", "tool", "data", "「k」", "1", "name", "zz", '"q\'\\"q"'], r.randint(0, 3))]
        names = list(dict.fromkeys(names))
        r.shuffle(names)
        return "{" + r.choice(["", "\n  "]) + " •\n ".join(f"{k} ↦ {self.member(k, depth)}{self.ops()}" for k in names) + r.choice(["", " •"] if names else [""]) + "}"

    def member(self, key, depth):
        r = self.r
        if key == "todo":
            return "{" + " • ".join(f"{i} ↦ {self.string()}" for i in r.sample(range(1, 9), r.randint(0, 3))) + "}"
        if key == "call":
            call = lambda: self.object(2, r.sample(["tool", "id"], r.randint(0, 2)))
            return r.choice([call(), "[" + " • ".join(call() for _ in range(r.randint(0, 2))) + "]", self.atom()])
        if key == "name":
            return r.choice(["get", '"find it"', self.string()])
        return self.value(depth)

    def trace(self):
        r, out = self.r, []
        for _ in range(r.randint(0, 7)):
            kind = r.choice(["system", "tool", "user", "plan", "act", "act", "result", "response"])
            body = self.string() if kind in ("system", "user", "response") else self.object(0, {"tool": ["name"], "plan": ["todo"], "act": ["call"], "result": ["data"]}[kind] if r.random() < 0.8 else ())
            out.append(kind + r.choice(["", " "]) + body + self.ops())
        return r.choice(["\n", " ", "\n\n"]).join(out)


@pytest.mark.parametrize("strict", [False, True])
def test_well_formed_traces_need_no_scanner(strict):
    w = Writer(7, strict)
    texts = [w.trace() for _ in range(1500)] + ["", " \n"]
    ok = same(texts, strict)
    assert ok.mean() > 0.8


@pytest.mark.parametrize("strict", [False, True])
def test_broken_traces(strict):
    r = random.Random(8)
    w = Writer(9, strict)
    texts = []
    for _ in range(2500):
        t = w.trace()
        for _ in range(r.randint(1, 3)):
            at = r.randint(0, len(t))
            t = t[:at] + r.choice(["", *CHUNKS]) + t[at + r.randint(0, 2) :]
        texts.append(t)
    same(texts, strict)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(CHUNKS), max_size=14).map("".join), min_size=1, max_size=6), st.booleans())
def test_any_text(texts, strict):
    same(texts, strict)


def test_canonical_trace_nulls_and_neighbours():
    texts = [F1, F1 + "\\", '\\"', F1, "「", F1, '"', F1 + "」", F1]
    assert list(same(texts, False)) == [True, False, False, True, False, True, False, False, True]
    got, ok = index.facts(pa.array([None, F1], pa.string()), False)
    assert ok.all() and got[0].as_py() == parse.facts_of(None, False)
    assert index.facts(pa.array([], pa.string()), True)[0].to_pylist() == []
    assert parse.facts_of_batch(pa.array(["x", F1, None], pa.string()).slice(1), False).to_pylist() == [parse.facts_of(F1, False), parse.facts_of("", False)]


def test_deep_nesting_and_long_texts():
    deep = "act { a ↦ " + "[" * 3000 + "]" * 3000 + " }"
    wide = "act { a ↦ [" + " • ".join(map(str, range(50_000))) + "] }"
    long = "user「" + 'x" ' * 200_000 + "」"
    assert list(same([deep, wide, long], False)) == [False, True, True]
