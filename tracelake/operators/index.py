"""Structural index over a batch of traces: parse facts by array operations on all texts at once.

The batch is one array of code points. Delimiters are found by a table look-up, string literals by following each text's
chain of opening marks (doubling the distance with each step), and what lies between becomes tokens. Depth is a running
sum over brackets, and a sort by depth puts every token next to the bracket that encloses it and every operator next to
the value it follows. The grammar is then a condition on each token and its predecessor, and facts are selections of tokens.

Only texts that meet the grammar without any error are answered here, and for these the facts equal the scanner's. All
others (errors, skipped text, odd numbers, duplicate keys, deep nesting) are named in the result and left to the scanner.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tracelake.operators.scanner import KEYWORDS, TEXTUAL

WORD, STR, OBJ, OBJ_END, ARR, ARR_END, SEP, ARROW, TAG, REF, SAT, CONF, CORNER, CORNER_END, QUOTE, ESCAPE, SPACE = range(17)
NONE, TOP = 254, 255  # no token before; no bracket around
_MARKS = {"{": OBJ, "}": OBJ_END, "[": ARR, "]": ARR_END, "•": SEP, "↦": ARROW, "🏷": TAG, "※": REF, "⊨": SAT, "𝑝": CONF, "「": CORNER, "」": CORNER_END, '"': QUOTE, "\\": ESCAPE} | dict.fromkeys(" \t\n\r", SPACE)
DEEPEST = 50
FAR = np.int64(1) << 60

# What Python's notation of nested values adds to them: it measures the size of a block.
_ENTRY = len("{'value': ") + len(", 'postfixes': [") + len("]}")
_OP_NAMES = {TAG: "tag", REF: "ref", SAT: "satisfies", CONF: "confidence"}
_KEYS = ["name", "todo", "call", "tool", "id", "data"]


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: delimiter class, whether it counts as a digit, characters of its notation inside a string."""
    kind = np.zeros(0x110000, np.uint8)
    for c, k in _MARKS.items():
        kind[ord(c)] = k
    every = [chr(i) for i in range(0x110000)]
    return kind, np.fromiter((c.isdigit() for c in every), bool, len(every)), np.fromiter((len(repr(c)) - 2 for c in every), np.uint8, len(every))


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x, dtype=np.int64)])


def _before(x: np.ndarray, first: np.ndarray, none) -> np.ndarray:
    """x of the token before; none where a text begins."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first] = none
    return out


class Index:
    """Tokens of a batch (kind, start, end, text, parent) and which texts are well-formed."""

    def __init__(self, texts: pa.Array, strict: bool):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        self.n, self.strict = len(texts), strict
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + self.n + 1]
        raw = texts.buffers()[2].slice(at[0], at[-1] - at[0]).to_pybytes() if self.n and at[-1] > at[0] else b""
        self.points = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
        self.lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = _sums(self.lengths)
        self.ok = np.ones(self.n, bool)
        self._tokens(*self._strings())
        self._nest()
        self._grammar()

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def _strings(self) -> tuple[np.ndarray, np.ndarray]:
        """Where string literals start and end (inclusive). Sets kinds, and dropped: the escape marks in strings."""
        kinds = self.kinds = _tables()[0][self.points]
        n = len(kinds)
        quotes, corners = np.flatnonzero(kinds == QUOTE), np.flatnonzero((kinds == CORNER) | (kinds == CORNER_END))
        slashes = np.flatnonzero(kinds == ESCAPE)
        fresh = np.ones(len(slashes), bool)  # whether a run of backslashes begins there
        fresh[1:] = (slashes[1:] != slashes[:-1] + 1) | (self.text_of(slashes[1:]) != self.text_of(slashes[:-1]))
        place = np.arange(len(slashes))
        place -= np.maximum.accumulate(np.where(fresh, place, 0))
        prior = np.searchsorted(slashes, quotes) - 1
        run = np.where((prior >= 0) & (slashes[np.maximum(prior, 0)] == quotes - 1) & (self.starts[self.text_of(quotes)] < quotes), place[np.maximum(prior, 0)] + 1, 0) if len(slashes) else np.zeros(len(quotes), np.int64)
        ending = np.append(quotes[run % 2 == 0], FAR)
        quotes_end = ending[np.searchsorted(ending, quotes, "right")]
        opens = kinds[corners] == CORNER
        level = np.cumsum(np.where(opens, 1, -1))
        low, span = level.min(initial=0) - 1, n + 1
        shut = np.sort((level[~opens] - low) * span + corners[~opens])
        want = level[opens] - 1 - low
        found = np.append(shut, FAR)[np.searchsorted(shut, want * span + corners[opens])]
        corners_end = np.where(found // span == want, found % span, FAR)
        start = np.concatenate([quotes, corners[opens]])
        order = np.argsort(start)
        start, end = start[order], np.concatenate([quotes_end, corners_end])[order]
        text = self.text_of(start)
        m = len(start)
        then = np.searchsorted(start, end, "right")
        then = np.append(np.where((then < m) & (text[np.minimum(then, m - 1)] == text), then, m) if m else then, m)
        real = np.zeros(m + 1, bool)
        real[:m] = np.concatenate([[True], text[1:] != text[:-1]])[:m]
        for _ in range(m.bit_length()):
            real[then[real]] = True
            then = then[then]
        real = real[:m]
        closed = end < self.starts[text + 1]
        self.ok[text[real & ~closed]] = False
        start, end = start[real & closed], end[real & closed]
        if len(start):
            by = np.searchsorted(start, slashes, "right") - 1
            self.dropped = slashes[(place % 2 == 0) & (by >= 0) & (kinds[start[by]] == QUOTE) & (slashes < end[by])]
        else:
            self.dropped = slashes[:0]
        return start, end

    def _tokens(self, start: np.ndarray, end: np.ndarray) -> None:
        n = len(self.points)
        inside = np.zeros(n + 1, np.int8)
        inside[start] += 1
        inside[end + 1] -= 1
        outside = np.cumsum(inside[:n], dtype=np.int8) == 0
        self.ok[self.text_of(np.flatnonzero(outside & (self.kinds == CORNER_END)))] = False
        first = np.zeros(n + 1, bool)
        first[self.starts] = True
        word = np.append(outside & ((self.kinds == WORD) | (self.kinds == ESCAPE)), False)
        begins = np.flatnonzero(word[:n] & (first[:n] | ~np.concatenate([[False], word[:n]])[:n]))
        ends = np.flatnonzero(word[:n] & (first[1:] | ~word[1:])) + 1
        marks = np.flatnonzero(outside & (self.kinds >= OBJ) & (self.kinds <= CONF))
        at = np.concatenate([begins, start, marks])
        order = np.argsort(at)
        self.start = at[order]
        self.end = np.concatenate([ends, end + 1, marks + 1])[order]
        self.kind = np.concatenate([np.full(len(begins), WORD), np.full(len(start), STR), self.kinds[marks]]).astype(np.uint8)[order]
        self.text = self.text_of(self.start)
        self._only(self.ok[self.text])

    def _only(self, keep: np.ndarray) -> None:
        self.start, self.end, self.kind, self.text = self.start[keep], self.end[keep], self.kind[keep], self.text[keep]
        self.first = np.ones(len(self.text), bool)
        self.first[1:] = self.text[1:] != self.text[:-1]

    def _nest(self) -> None:
        """parent: the bracket around a token (of a closing bracket the one it closes), -1 at the top."""
        delta = lambda: np.isin(self.kind, (OBJ, ARR)).astype(np.int64) - np.isin(self.kind, (OBJ_END, ARR_END))
        if len(self.kind):
            d = delta()
            after = np.cumsum(d)
            heads = np.flatnonzero(self.first)
            base = (after - d)[heads]
            last = np.append(heads[1:], len(d)) - 1
            bad = (after[last] != base) | (np.minimum.reduceat(after, heads) < base) | (np.maximum.reduceat(after, heads) > base + DEEPEST)
            self.ok[self.text[heads[bad]]] = False
            self._only(self.ok[self.text])
        d = delta()
        m = len(d)
        self.level = np.cumsum(d) - d
        opens = np.flatnonzero(d == 1)
        self.by_level = np.argsort(self.level * (2 * m + 2) + 2 * np.arange(m))
        key = np.concatenate([self.level * (2 * m + 2) + 2 * np.arange(m), (self.level[opens] + 1) * (2 * m + 2) + 2 * opens + 1])
        who = np.concatenate([np.full(m, -1), opens])
        order = np.argsort(key)
        last = np.maximum.accumulate(np.where(who[order] >= 0, np.arange(len(order)), -1)) if len(order) else order
        self.parent = np.full(m, -1)
        token = order < m
        self.parent[order[token]] = np.where(last[token] >= 0, who[order[np.maximum(last[token], 0)]], -1)
        self.close = np.full(m, -1)
        shut = np.flatnonzero(d == -1)
        self.close[self.parent[shut]] = shut

    def _fail(self, bad: np.ndarray) -> None:
        self.ok[self.text[bad]] = False

    def _grammar(self) -> None:
        kind, first = self.kind, self.first
        m = len(kind)
        self.around = around = np.where(self.parent >= 0, kind[self.parent], TOP) if m else np.empty(0, np.uint8)
        last = _before(kind, first, NONE)
        atom, opens, shuts = kind <= STR, (kind == OBJ) | (kind == ARR), (kind == OBJ_END) | (kind == ARR_END)
        op, last_op = (kind >= TAG) & (kind <= CONF), (last >= TAG) & (last <= CONF)
        top = around == TOP
        self.key = key = atom & (around == OBJ) & ((last == OBJ) | (last == SEP))
        self.value = value = (atom | opens) & (around == OBJ) & (last == ARROW)
        self.element = element = (atom | opens) & (around == ARR) & ((last == ARR) | (last == SEP))
        self.operand = operand = (atom | (kind == ARR)) & last_op
        self.block = block = (kind == WORD) & top & ~operand
        self.content = content = top & ~operand & ((kind == STR) | (kind == OBJ)) & _before(block, first, False)
        end = atom & (value | element | operand | content) | shuts
        last_end = _before(end, first, False)
        good = (atom | opens) & (key | value | element | operand | block | content)
        good |= (kind == ARROW) & _before(key, first, False)
        good |= op & last_end & ~((around == ARR) & self.strict)
        good |= (kind == SEP) & last_end & ~top
        good |= (kind == OBJ_END) & (around == OBJ) & ((last == OBJ) | (last == SEP) | last_end)
        good |= (kind == ARR_END) & (around == ARR) & ((last == ARR) | (last == SEP) | last_end)
        good &= ~op | np.append(operand[1:] & ~first[1:], False)[:m]
        self._fail(~good)
        # a block's keyword, what follows it, and what may stand before it
        at = np.flatnonzero(block)
        code = pc.fill_null(pc.index_in(self.strings(at), value_set=pa.array(KEYWORDS)), -1).to_numpy()
        follows = np.append(content[1:], False)[at] & ~np.append(first[1:], True)[at]
        takes = np.where(np.append(kind[1:], NONE)[at] == STR, 1, 0) == np.isin(code, [i for i, k in enumerate(KEYWORDS) if k in TEXTUAL])
        self._fail(at[(code < 0) | ~follows | ~takes | ~(first[at] | last_end[at])])
        self.blocks, self.block_code = at, code
        self.in_block = np.cumsum(block) - 1
        # operands, by operator and mode
        words = kind == WORD
        near = self.start == _before(self.end, first, -1)
        self._fail(operand & np.isin(last, (SAT, CONF)) & ~(words | ((last == SAT) & (kind == ARR) & (not self.strict))))
        self._fail(operand & (last == TAG) & (kind == ARR))
        if self.strict:
            self._fail(operand & np.isin(last, (TAG, REF)) & (kind == STR))
            self._fail(operand & (last != REF) & ~near)
        listed = (self.parent >= 0) & operand[self.parent] if m else operand
        self.listed = element & listed
        self._fail(listed & (op | opens))
        # numbers: words that begin like one where a value or a number is due
        digit = _tables()[1][self.points[self.start]] if m else words
        self.number = words & ((value | element) & digit | operand & np.isin(last, (SAT, CONF)))
        self._fail(self._odd(np.flatnonzero(self.number)))
        self.literal = np.zeros(m, bool)
        at = np.flatnonzero(words & (value | element) & ~digit & (self.end - self.start <= 5))
        self.literal[at] = pc.is_in(self.strings(at), value_set=pa.array(["true", "false", "null"])).to_numpy(zero_copy_only=False)
        self._fail(self.literal & listed)
        self.string = atom & ~self.number & ~self.literal
        # keys
        at = np.flatnonzero(key)
        names = self.strings(at)
        code = names.dictionary_encode().indices.to_numpy()
        pair = self.parent[at] * (code.max(initial=0) + 1) + code
        _, one, times = np.unique(pair, return_index=True, return_counts=True)
        self._fail(at[one[times > 1]])
        self.key_code = np.full(m, -1)
        self.key_code[at] = pc.fill_null(pc.index_in(names, value_set=pa.array(_KEYS)), -1).to_numpy()
        # the value an operator belongs to: the last one before it on its level; and whether it is the first one there
        heads = (value | element | content)[self.by_level]
        last_head = np.maximum.accumulate(np.where(heads, np.arange(m), -1)) if m else np.empty(0, np.int64)
        self.target = np.full(m, -1)
        self.target[self.by_level] = np.where(last_head >= 0, self.by_level[np.maximum(last_head, 0)], -1) if m else last_head
        of = np.where(shuts, self.parent, np.arange(m))
        self.op, self.opening = op, op & ~_before(operand[of] if m else operand, first, False)

    def _odd(self, at: np.ndarray) -> np.ndarray:
        """Of number tokens those that are not written as Python would write them (or have over 15 digits)."""
        size = self.end[at] - self.start[at]
        bad = size > 16
        use = at[~bad]
        size = size[~bad]
        grid = np.arange(16)[None, :]
        c = np.where(grid < size[:, None], self.points[np.minimum(self.start[use][:, None] + grid, len(self.points) - 1)], 0) if len(use) else np.zeros((0, 16))
        dot = c == ord(".")
        digits = (c >= ord("0")) & (c <= ord("9"))
        whole = np.where(dot.any(1), dot.argmax(1), size)  # digits before the point
        rest = size - whole - 1
        last = np.take_along_axis(c, size[:, None] - 1, 1)[:, 0] if len(use) else size
        fine = ((digits | dot).sum(1) == size) & (dot.sum(1) <= 1) & (whole > 0) & (digits.sum(1) <= 15) & ((c[:, 0] != ord("0")) | (whole == 1))
        fine &= (rest != 0) & ((rest <= 1) | (last != ord("0")))
        small = (c[:, 0] == ord("0")) & (whole == 1) & (rest > 1) & (c[:, 2] == ord("0")) & (c[:, 3] == ord("0"))
        return np.concatenate([at[bad], use[~fine | small]])

    # texts of tokens

    def _inner(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        quoted = self.kind[at] == STR
        return self.start[at] + quoted, self.end[at] - quoted

    def strings(self, at: np.ndarray) -> pa.Array:
        """Contents of atoms, unescaped."""
        lo, hi = self._inner(at)
        size = hi - lo
        ends = np.cumsum(size)
        flat = np.repeat(lo - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        points = self.points[flat]
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        if len(self.dropped):
            spot = np.minimum(np.searchsorted(self.dropped, flat), len(self.dropped) - 1)
            gone = self.dropped[spot] == flat
            width[gone] = 0
            points = points[~gone]
        data = points.tobytes().decode("utf-32-le").encode()
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(_sums(width)[np.concatenate([[0], ends]).astype(np.int64)]), pa.py_buffer(data)])

    def _measured(self, at: np.ndarray, noted: bool) -> np.ndarray:
        """Characters of atoms' contents, or of their notation as Python strings."""
        lo, hi = self._inner(at)
        count = lambda places: np.searchsorted(places, hi) - np.searchsorted(places, lo)
        own = hi - lo - count(self.dropped)
        if not noted:
            return own
        longer, extra = self._longer
        single, double = count(self._single), count(self._double)
        return own + 2 + extra[np.searchsorted(longer, hi)] - extra[np.searchsorted(longer, lo)] + np.where(double > 0, single, 0)

    def sizes(self) -> np.ndarray:
        """Per block: characters of its text, or of the notation of its object."""
        cost = _tables()[2][self.points]
        longer = np.setdiff1d(np.flatnonzero(cost > 1), self.dropped, assume_unique=True)
        self._longer = longer, _sums(cost[longer] - 1)
        self._single, self._double = np.flatnonzero(self.points == ord("'")), np.flatnonzero(self.points == ord('"'))
        m = len(self.kind)
        body = np.minimum(self.blocks + 1, max(m - 1, 0))
        textual = self.kind[body] == STR
        out = np.zeros(len(self.blocks), np.int64)
        out[textual] = self._measured(body[textual], False)
        inside = self.in_block >= 0
        mine = body[np.maximum(self.in_block, 0)] if len(body) else np.zeros(m, np.int64)
        inside &= (np.arange(m) >= mine) & (np.arange(m) <= self.close[mine]) if m else inside
        cost = np.ones(m, np.int64)  # brackets
        then = np.append(self.kind[1:], NONE)
        cost[self.kind == SEP] = np.where(np.isin(then[self.kind == SEP], (OBJ_END, ARR_END)), 0, 2)
        cost[self.kind == ARROW] = len(": ") + _ENTRY
        for k, name in _OP_NAMES.items():
            cost[self.kind == k] = len(f"('{name}', )")
        cost[self.op & ~self.opening] += len(", ")
        cost[self.op & self.opening & self.element[self.target]] += _ENTRY
        atoms = np.flatnonzero((self.kind <= STR) & inside)
        plain = self.number[atoms] | self.literal[atoms]
        cost[atoms[plain]] = (self.end - self.start)[atoms[plain]]
        cost[atoms[~plain]] = self._measured(atoms[~plain], True)
        return out + np.bincount(self.in_block[inside], cost[inside], len(out)).astype(np.int64)[: len(out)]


def _list(text: np.ndarray, values: pa.Array, n: int, distinct: bool = True) -> pa.Array:
    """values by text (ascending if not distinct) as n lists; distinct: sorted and without repeats."""
    if distinct:
        rows = pa.table({"t": text, "v": values}).group_by(["t", "v"]).aggregate([]).sort_by([("t", "ascending"), ("v", "ascending")]).combine_chunks()
        text, values = rows["t"].to_numpy(), pa.concat_arrays(rows["v"].chunks) if rows["v"].num_chunks else values
    kind = pa.string() if pa.types.is_large_string(values.type) else values.type
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32()), values.cast(kind))


def facts(texts: pa.Array, strict: bool) -> tuple[pa.StructArray, np.ndarray]:
    """Facts of all texts, and which texts they hold for; the rest of the rows mean nothing."""
    x = Index(texts, strict)
    n, m = x.n, len(x.kind)
    body = x.blocks + 1
    code = np.full(m, -1)
    code[:] = x.block_code[np.maximum(x.in_block, 0)] if len(x.blocks) else -1
    kind_of = {k: i for i, k in enumerate(KEYWORDS)}
    content_of = np.where(x.in_block >= 0, body[np.maximum(x.in_block, 0)], -1) if len(body) else np.full(m, -1)

    def keys(name: str, kind: str | None = None, top: bool = True) -> np.ndarray:
        """Tokens of a key, in blocks of a kind, as members of the block itself."""
        at = np.flatnonzero((x.key_code == _KEYS.index(name)) & x.ok[x.text])
        at = at if kind is None else at[code[at] == kind_of[kind]]
        return at[x.parent[at] == content_of[at]] if top else at

    def named(at: np.ndarray) -> np.ndarray:
        """The values of keys, those that are strings with content."""
        v = at + 2
        v = v[x.string[v]]
        lo, hi = x._inner(v)
        return v[hi > lo]

    def listed(at: np.ndarray) -> pa.Array:
        return _list(x.text[at], x.strings(at), n)

    names = keys("name", "tool")
    x._fail(names[~x.string[names + 2]] if len(names) else names)
    tools = named(keys("name", "tool"))
    marks = np.flatnonzero(x.op & x.ok[x.text])
    tags, refs, sats = (marks[x.kind[marks] == k] for k in (TAG, REF, SAT))

    todo = keys("todo", "plan")
    warned = [todo, todo] if strict else []
    todos = np.empty(0, np.int64)
    if not strict and m:
        lists = np.zeros(m + 1, bool)
        lists[todo + 2] = x.kind[todo + 2] == OBJ
        todos = np.flatnonzero(x.key & lists[x.parent])
        odd = ~pc.match_substring_regex(x.strings(todos), r"^[0-9]{1,9}$").to_numpy(zero_copy_only=False)
        x._fail(todos[odd])
        todos = todos[~odd]
    called = np.zeros(m + 1, bool)
    calls = keys("call", "act") + 2
    called[calls[x.kind[calls] == OBJ]] = True
    if not strict and m:
        many = np.zeros(m + 1, bool)
        many[calls[x.kind[calls] == ARR]] = True
        called[np.flatnonzero(x.element & (x.kind == OBJ) & many[x.parent])] = True
    own = lambda name: named(k[called[x.parent[k]]] if len(k := keys(name, "act", False)) else k)

    data = keys("data", "result")
    tagged = np.zeros(m + 1, bool)
    tagged[x.target[tags]] = True
    outer = tags[(x.parent[tags] < 0) & (code[tags] == kind_of["result"])]
    inner = tags[np.isin(x.target[tags], data + 2)]
    bare = data[~tagged[data + 2]]
    warned.append(bare if strict else bare[~tagged[content_of[bare]]])

    numbers = lambda at: pc.cast(x.strings(at), pa.float64())
    if strict:
        done = sats[(x.parent[sats] < 0) & (code[sats] == kind_of["act"])] + 1
        none = np.empty(0, np.int64)
        defined, referenced = none, none
    else:
        items = np.flatnonzero(x.listed & x.ok[x.text])
        by = x.kind[x.parent[items] - 1]
        single = lambda at: at[x.kind[at + 1] != ARR] + 1
        done = np.sort(np.concatenate([single(sats), items[(by == SAT) & x.number[items]]]))
        referenced = np.sort(np.concatenate([single(refs), items[by == REF]]))
        ids = keys("id", "act", False) + 2
        defined = np.sort(np.concatenate([tags + 1, ids[x.string[ids]]]))
    fine = lambda at: at[x.ok[x.text[at]]]
    done = fine(done)
    satisfied = numbers(done)
    if not strict:
        satisfied = pc.trunc(satisfied)
    said = np.concatenate([np.full(len(todo), "Invalid todo ID: value"), np.full(len(todo), "Invalid todo ID: postfixes")][: 2 * strict] + [np.full(len(warned[-1]), "Result data value should have a 🏷 tag")])
    where = np.concatenate(warned)
    order = np.argsort(where, kind="stable")
    ids = lambda at: x.text[at]
    blocks = x.blocks
    fields = {
        "blocks": _list(ids(blocks), pa.array(KEYWORDS).take(pa.array(np.maximum(x.block_code, 0))), n, False),
        "sizes": _list(ids(blocks), pa.array(x.sizes().astype(np.int32)), n, False),
        "defined_tags": listed(fine(defined)), "referenced_tags": listed(fine(referenced)),
        "defined_todos": _list(ids(todos), pc.cast(x.strings(todos), pa.int32()), n),
        "satisfied_todos": _list(ids(done), satisfied, n),
        "defined_tools": listed(tools), "called_tools": listed(own("tool")), "call_ids": listed(own("id")), "result_ids": listed(np.sort(np.concatenate([inner, outer])) + 1),
        "errors": pa.ListArray.from_arrays(pa.array(np.zeros(n + 1), pa.int32()), pa.array([], pa.string())),
        "warnings": _list(ids(where[order]), pa.array(said[order].tolist(), pa.string()), n, False),
        "valid": pa.array(np.ones(n, bool)), "length": pa.array(x.lengths),
    }
    return pa.StructArray.from_arrays(list(fields.values()), list(fields)), x.ok
