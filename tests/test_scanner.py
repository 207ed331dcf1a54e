import random

import pytest

from tracelake.operators.parse import facts_of
from tracelake.operators.scanner import scan

F1 = """system「You are a helpful assistant.」🏷 sys1

tool {
    name ↦ get_weather •
    description ↦ "Fetches weather"
}

user「What is the weather?」🏷 usr1

plan {
    todo ↦ {
        1 ↦ "Fetch it." •
        2 ↦ "Say it." ※ usr1
    } •
    rationale ↦ "asked"
}

act {
    call ↦ {
        tool ↦ get_weather •
        id ↦ weather_result
    } ⊨ 1
}

result {
    data ↦ "68" 🏷 weather_result
}

response「It is 68.」※ [weather_result • usr1] ⊨ 2"""


def test_strict_scan_stops_at_a_spaced_satisfies():
    f = scan(F1)
    assert f.blocks == ["system", "tool", "user", "plan"] and len(f.warnings) == 4
    assert f.errors == [f"Expected number at position {F1.index('⊨ 1') + 1}"]
    assert f.warnings[-2:] == ["Invalid todo ID: value", "Invalid todo ID: postfixes"]
    assert f.defined_tools == {"get_weather"} and not f.defined_tags


def test_lenient_scan_reads_it_all():
    f = scan(F1, strict=False)
    assert not f.errors and not f.warnings and f.blocks[-1] == "response"
    assert f.defined_todos == {1, 2} == f.satisfied_todos
    assert f.defined_tags == {"sys1", "usr1", "weather_result"} and f.referenced_tags == {"usr1", "weather_result"}
    assert f.call_ids == f.result_ids == {"weather_result"}


def test_values():
    f = scan('tool { name ↦ "a\\"b" • x ↦ [1 • 2.5 • true • null • w] } result { data ↦ 「a「b」c」🏷t }')
    assert f.defined_tools == {'a"b'} and f.result_ids == {"t"} and not f.errors
    assert scan('act { call ↦ { tool ↦ t • id ↦ i } • call ↦ { tool ↦ u • id ↦ j } }⊨3').called_tools == {"u"}


@pytest.mark.parametrize("text,error", [("act { value ↦ 3eggs }", "could not convert"), ("plan [", "Expected '{'"), ("plan { a", "Expected '↦'"), ("act { think ↦ x 🏷 thinky • call ↦ y }", "no progress"), ("plan { a ↦ [1 } }", "no progress"), ("plan { a ↦ 1", "Unclosed object"), ("tool { name ↦ [a] }", "unhashable")])
def test_bad_text_gives_errors(text, error):
    assert any(error in e for e in scan(text).errors), scan(text).errors


def test_every_text_ends_without_raising():
    rng = random.Random(0)
    parts = ["plan", "act", "result", "response", "user", "tool", " ", "{", "}", "[", "]", "「", "」", '"', "↦", "•", "🏷", "※", "⊨", "𝑝", "1", ".", "e", "a", "\\", "\n", "call", "id", "data", "todo"]
    for _ in range(20000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        for strict in (True, False):
            facts_of(t, strict)
    assert scan("[" * 5).errors == [] and any("RecursionError" in e or "Expected" in e for e in scan("plan { a ↦ " + "[" * 100000).errors)


def test_keyword_inside_a_word_during_recovery():
    f = scan("fact plan { }")
    assert f.errors == ["Expected '{' at position 5"]
    assert f.warnings == ["Skipped unparseable content from 0 to 1"]
