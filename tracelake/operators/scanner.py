"""Scanner of the trace language (plain Python, no Spark).

``scan(text)`` returns the facts of one trace. With strict=True it keeps the known quirks of the established scoring:
operators read their value without skipping white space, tag sets stay empty, a plan's todo wrapper yields two "Invalid
todo ID" warnings, and only act-level satisfies count. With strict=False it reads what the language means. Either way
each pass of a container must consume something, so scanning always ends, and no text raises.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

KEYWORDS = ("system", "tool", "user", "plan", "act", "result", "response")
TEXTUAL = frozenset({"system", "user", "response"})

_CORNER = re.compile("[「」]")
_SPACE = re.compile(r"[ \t\n\r]*")
_WORD = re.compile(r'[^ \t\n\r{}\[\]•↦🏷※⊨𝑝「」"]*')
_NUMBER = re.compile(r"\d*(?:\.\d*(?:[eE][+-]?\d*)?|[eE][+-]?\d*(?:\.\d*)?)?")
_STOP = re.compile("[•}\\]]|\\Z")
_QUOTED = re.compile(r'[^"\\]+|\\(?s:.)|\\\Z')
_BLOCK = re.compile("(?:" + "|".join(KEYWORDS) + ")")
_OPERATORS = {"🏷": "tag", "※": "ref", "⊨": "satisfies", "𝑝": "confidence"}
_NATURAL = re.compile(r"\s*[+-]?\d+(?:_\d+)*\s*\Z")


class Halt(Exception):
    """Ends the scan; what was read before stays."""


@dataclass
class Facts:
    blocks: list[str] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    defined_tags: set = field(default_factory=set)
    referenced_tags: set = field(default_factory=set)
    defined_todos: set = field(default_factory=set)
    satisfied_todos: set = field(default_factory=set)
    defined_tools: set = field(default_factory=set)
    called_tools: set = field(default_factory=set)
    call_ids: set = field(default_factory=set)
    result_ids: set = field(default_factory=set)
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


class Entry:
    """A value with the operators that follow it."""

    __slots__ = ("ops", "value")

    def __init__(self, value, ops):
        self.value, self.ops = value, ops

    def __repr__(self) -> str:
        return repr({"value": self.value, "postfixes": self.ops})


class _Scan:
    def __init__(self, text: str, strict: bool):
        self.text, self.strict, self.at, self.end, self.facts = text, strict, 0, len(text), Facts()

    # reading

    def space(self) -> None:
        self.at = _SPACE.match(self.text, self.at).end()

    def next(self) -> str:
        return self.text[self.at : self.at + 1]

    def word(self) -> str:
        m = _WORD.match(self.text, self.at)
        self.at = m.end()
        return m[0]

    def number(self):
        m = _NUMBER.match(self.text, self.at)
        if not m[0]:
            raise Halt(f"Expected number at position {self.at}")
        self.at = m.end()
        try:
            return float(m[0]) if "." in m[0] or "e" in m[0].lower() else int(m[0])
        except ValueError as e:
            raise Halt(str(e)) from None

    def corner(self) -> str:
        """「…」, nested; unclosed is accepted."""
        start, depth = self.at + 1, 1
        for m in _CORNER.finditer(self.text, start):
            depth += 1 if m[0] == "「" else -1
            if not depth:
                self.at = m.end()
                return self.text[start : m.start()]
        self.at = self.end
        return self.text[start:]

    def quoted(self) -> str:
        """"…" with backslash escapes; unclosed is accepted."""
        at, out = self.at + 1, []
        while at < self.end and self.text[at] != '"':
            m = _QUOTED.match(self.text, at)
            out.append(m[0][1:] if m[0][0] == "\\" and len(m[0]) > 1 else m[0])
            at = m.end()
        self.at = min(self.end, at + 1)
        return "".join(out)

    def string(self) -> str:
        self.space()
        c = self.next()
        return self.corner() if c == "「" else self.quoted() if c == '"' else self.word()

    def value(self):
        self.space()
        c = self.next()
        if c == "{":
            return self.object()
        if c == "[":
            return self.array()
        if c in ("「", '"') and c:
            return self.string()
        if c.isdigit():
            return self.number()
        w = self.word()
        return {"true": True, "false": False, "null": None}.get(w, w)

    def _members(self, opened: str, closed: str, name: str, member) -> None:
        self.space()
        if self.next() != opened:
            raise Halt(f"Expected '{opened}' at position {self.at}")
        self.at += 1
        while True:
            begun = self.at
            self.space()
            c = self.next()
            if c == closed:
                self.at += 1
                return
            if not c:
                self.facts.errors.append(f"Unclosed {name} at position {self.at}")
                return
            if member():
                self.space()
                if self.next() == "•":
                    self.at += 1
                elif self.next() != closed:
                    self.at = _STOP.search(self.text, self.at).start()
            if self.at == begun:
                raise Halt(f"no progress at {self.at}")

    def object(self) -> dict:
        out: dict[str, Entry] = {}

        def member() -> bool:
            key = self.string()
            self.space()
            if self.next() != "↦":
                self.facts.errors.append(f"Expected '↦' after key '{key}' at position {self.at}")
                self.at = _STOP.search(self.text, self.at).start()
                return False
            self.at += 1
            value = self.value()
            out[key] = Entry(value, self.operators())
            return True

        self._members("{", "}", "object", member)
        return out

    def array(self) -> list:
        out: list = []

        def member() -> bool:
            value = self.value()
            if not self.strict:
                value = Entry(value, ops) if (ops := self.operators()) else value
            out.append(value)
            return True

        self._members("[", "]", "array", member)
        return out

    def operators(self) -> list[tuple]:
        out = []
        while True:
            self.space()
            kind = _OPERATORS.get(self.next())
            if not kind:
                return out
            self.at += 1
            if kind == "ref" or not self.strict:
                self.space()
            if kind == "ref" or (kind == "satisfies" and not self.strict and self.next() == "["):
                value = self.array() if self.next() == "[" else self.string() if not self.strict else self.word()
            elif kind == "tag":
                value = self.word() if self.strict else self.string()
            else:
                value = self.number()
            out.append((kind, value))

    # blocks

    def keyword(self, at: int) -> str | None:
        m = _BLOCK.match(self.text, at)
        return m[0] if m and not self.text[m.end() : m.end() + 1].isalnum() else None

    def run(self) -> Facts:
        f = self.facts
        try:
            while True:
                self.space()
                if self.at >= self.end:
                    break
                kind = self.keyword(self.at)
                if kind:
                    self.at += len(kind)
                    self.block(kind)
                    continue
                start = self.at
                self.at = next((m.start() for m in _BLOCK.finditer(self.text, start) if self.keyword(m.start())), self.end)
                f.warnings.append(f"Skipped unparseable content from {start} to {self.at}")
        except Halt as e:
            f.errors.append(str(e))
        except (RecursionError, TypeError, ValueError) as e:
            f.errors.append(f"{type(e).__name__}: {e}")
        return f

    def block(self, kind: str) -> None:
        self.space()
        content = self.string() if kind in TEXTUAL else self.object()
        ops = self.operators()
        if kind == "tool":
            name = content["name"].value if "name" in content else None
            if name:
                self.facts.defined_tools.add(name)
        elif kind == "plan":
            self.plan(content)
        elif kind == "act":
            self.act(content, ops)
        elif kind == "result":
            self.result(content, ops)
        if not self.strict:
            self.marks(content, ops, kind)
        self.facts.blocks.append(kind)
        self.facts.sizes.append(len(str(content)))

    def plan(self, content: dict) -> None:
        if "todo" not in content:
            return
        keys = ["value", "postfixes"] if self.strict else list(content["todo"].value) if isinstance(content["todo"].value, dict) else []
        for key in keys:
            if _NATURAL.match(key):
                self.facts.defined_todos.add(int(key))
            else:
                self.facts.warnings.append(f"Invalid todo ID: {key}")

    def act(self, content: dict, ops: list) -> None:
        f = self.facts
        for kind, value in ops:
            if kind == "satisfies" and self.strict:
                f.satisfied_todos.add(value)
        call = content["call"].value if "call" in content else None
        calls = [call] if self.strict or not isinstance(call, list) else [c.value if isinstance(c, Entry) else c for c in call]
        for c in calls:
            if not isinstance(c, dict):
                continue
            for key, into in (("tool", f.called_tools), ("id", f.call_ids)):
                value = c[key].value if key in c else None
                if isinstance(value, str) and value:
                    into.add(value)

    def result(self, content: dict, ops: list) -> None:
        f = self.facts
        tagged = [v for k, v in (content["data"].ops if "data" in content else []) if k == "tag"]
        if "data" in content and not tagged and (self.strict or not any(k == "tag" for k, _ in ops)):
            f.warnings.append("Result data value should have a 🏷 tag")
        f.result_ids.update(tagged)
        f.result_ids.update(v for k, v in ops if k == "tag")

    def marks(self, value, ops: list, kind: str) -> None:
        """All tags, references and satisfied todos, wherever they stand (not strict). A call's id is a tag too."""
        f = self.facts
        plain = lambda v: v.value if isinstance(v, Entry) else v
        for k, v in ops:
            many = [plain(x) for x in v] if isinstance(v, list) else [v]
            if k == "tag":
                f.defined_tags.add(v)
            elif k == "ref":
                f.referenced_tags.update(str(x) for x in many)
            elif k == "satisfies":
                f.satisfied_todos.update(int(x) for x in many if isinstance(x, (int, float)))
        if isinstance(value, dict):
            if kind == "act" and "id" in value and isinstance(value["id"].value, str):
                f.defined_tags.add(value["id"].value)
            for e in value.values():
                self.marks(e.value, e.ops, kind)
        elif isinstance(value, list):
            for e in value:
                self.marks(plain(e), e.ops if isinstance(e, Entry) else [], kind)


def scan(text: str, strict: bool = True) -> Facts:
    return _Scan(text or "", strict).run()
