"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs, digits, schemes, colons and
identifier cues. From each anchor a deterministic local parser expands to the left and right and validates. The base
kinds (email, ip, card, phone) keep exactly the leftmost, non-overlapping matches of their patterns: a match can only
begin where its parser starts, so parsing from the anchors in order equals a scan of the whole text.

Added kinds: login (a URL that carries user and password), account (every IBAN with correct check digits anywhere after
a cue, of its country's length or as long as it is written, or 6 to 17 digits or a social security number right after a cue), ip6 (with :: or in full;
checked by the standard library), secret (a value with a digit that is assigned to a key, token or password, follows
"bearer", or begins as the keys of well-known services do; a private key in PEM form).
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("login", "account", "ip6", "secret")
CUES = ("account", "acct", "iban", "ssn", "passport", "social security")
KEY_CUES = ("token", "secret", "apikey", "api_key", "api-key", "api key", "access_key", "access key", "private_key", "auth", "bearer", "credential")
PASSWORD_CUES = ("password", "passwd", "passphrase", "pwd")
# fixed values: how keys of well-known services begin, and what follows
PREFIXES = {
    "AKIA": r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "ASIA": r"ASIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "AIza": r"AIza[0-9A-Za-z_-]{35}",
    "ghp_": r"ghp_[0-9A-Za-z]{36,}",
    "gho_": r"gho_[0-9A-Za-z]{36,}",
    "ghs_": r"ghs_[0-9A-Za-z]{36,}",
    "github_pat_": r"github_pat_[0-9A-Za-z_]{22,}",
    "glpat-": r"glpat-[0-9A-Za-z_-]{20,}",
    "sk-": r"sk-(?=[A-Za-z_-]*[0-9])[0-9A-Za-z_-]{20,}",
    "sk_live_": r"sk_live_[0-9A-Za-z]{16,}",
    "xoxb-": r"xoxb-[0-9A-Za-z-]{10,}",
    "xoxp-": r"xoxp-[0-9A-Za-z-]{10,}",
    "eyJ": r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    "-----BEGIN ": r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----[^-]*(?:-----END \1PRIVATE KEY-----)?",
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+(:[0-9]+)?")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_ASSIGNED = r"[\"']?[ \t]*(?::=|=>|=|:)[ \t]*[\"'`]?"
_KEY = re.compile(_ASSIGNED + r"((?=[A-Za-z_./+~-]*[0-9])[0-9A-Za-z_./+~-]{15,}[0-9A-Za-z_]={0,2})")
_BEARER = re.compile(r"[ \t]+((?=[A-Za-z_./+~-]*[0-9])[0-9A-Za-z_./+~-]{15,}[0-9A-Za-z_]={0,2})")
_PASSWORD = re.compile(_ASSIGNED + r"((?=[A-Za-z]*[^A-Za-z\s\"'`<>,;])[^\s\"'`<>,;]{5,}[^\s\"'`<>,;.)\]])")
_SERVICE = {k: re.compile(v) for k, v in PREFIXES.items()}
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_ACCOUNT = re.compile(r"(?:[ \t]*(?:no|nr|number|num|id)\b\.?)?[ \t]*[:#=]?[ \t]*([0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{6,17})(?![0-9A-Za-z-])", re.I)
_LENGTHS = dict(x.split(":") for x in "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FK:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MN:20 MR:27 MT:31 MU:30 NI:28 NL:18 NO:15 OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20 YE:30".split())
_IP6 = re.compile(r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){5}(?:(?::[0-9A-Fa-f]{1,4}){2}|:[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9A-Za-z]|:[0-9A-Fa-f:])")
_HEX = frozenset("0123456789abcdefABCDEF:")
_DIGITS = frozenset("0123456789")
_CAPITAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def luhn(digits: str) -> bool:
    odd = digits[::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def iban_ok(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def ibans(text: str, at: int) -> Iterator[tuple[int, int]]:
    """The IBANs from a position on. A candidate may run on into what follows it, so it is tried at its country's length,
    then whole; one of an unknown country at every end of a run of letters and digits, the longest first."""
    while m := _IBAN.search(text, at):
        ends = [k for k in range(m.start(), m.end()) if text[k] != " "]
        size = int(_LENGTHS.get(m[0][:2], 0))
        tries = [size, len(ends)] if size else range(len(ends), 14, -1)
        for n in tries:
            b = ends[n - 1] + 1 if n <= len(ends) else 0
            if b and (b == len(text) or text[b] not in _CAPITAL) and iban_ok(text[m.start() : b]):
                yield m.start(), b
                at = b
                break
        else:
            at = m.start() + 1


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("d", 1))
    for word, kind in (("@", "@"), ("+", "+"), ("://", "s"), ("::", ":"), (":", "6")):
        a.add_word(word, (kind, len(word)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.title(), cue.capitalize()}:
            a.add_word(form, ("c", len(form)))
    for cues, kind in ((KEY_CUES, "k"), (PASSWORD_CUES, "p")):
        for cue in cues:
            for form in {cue, cue.upper(), cue.title(), cue.capitalize()}:
                a.add_word(form, (kind, len(form)))
    for word in PREFIXES:
        a.add_word(word, ("x", len(word)))
    a.make_automaton()
    return a


_AUTOMATON = None


def spans(text: str) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of a text by kind and start; offsets count code points, end exclusive."""
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = _automaton()
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE, *ADDED)}
    mail = ip = card = phone = acct = six = run = secret = 0  # where the next match of a kind may begin
    numbers = None  # the IBANs after the first cue
    last_digit = -2
    for end, (kind, size) in _AUTOMATON.iter(text):
        at = end - size + 1
        if kind == "d":
            if at >= card:
                if m := _CARD.match(text, at):
                    card = m.end()
                    n = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(n) <= 19 and luhn(n):
                        found["card"].append(m.span())
            if at >= ip and (last_digit != at - 1 or at == ip):  # only a run's first digit can begin an address
                if m := _IP.match(text, at):
                    ip = m.end()
                    if all(int(p) <= 255 if len(p) < 10 else int(p.lstrip("0") or "0") <= 255 if len(p.lstrip("0")) < 10 else False for p in m[0].split(".")):
                        found["ip"].append(m.span())
            last_digit = at
        elif kind == "@":
            s = at
            while s > mail and text[s - 1] in _LOCAL:
                s -= 1
            if s < at and (m := _DOMAIN.match(text, at + 1)):
                mail = m.end()
                found["email"].append((s, mail))
        elif kind == "+":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif kind == "s":
            if m := _LOGIN.match(text, end + 1):
                s = at
                while s and text[s - 1] in _SCHEME:
                    s -= 1
                while s < at and not text[s].isalpha():  # a scheme begins with a letter
                    s += 1
                if s < at:
                    found["login"].append((s, m.end()))
        elif kind == ":" and at >= run:  # the run of hexadecimal digits and colons is looked at once
            a, b = at, end + 1
            while a and text[a - 1] in _HEX:
                a -= 1
            while b < len(text) and text[b] in _HEX:
                b += 1
            run = b
            if b - a > 4 and not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum()) and (not found["ip6"] or found["ip6"][-1][1] <= a):
                try:
                    ipaddress.IPv6Address(text[a:b])
                    found["ip6"].append((a, b))
                except ValueError:
                    pass
        elif kind == "6":
            a = at
            while a and text[a - 1] in _HEX and text[a - 1] != ":" and at - a < 5:
                a -= 1
            if six <= a < at and not (a and text[a - 1].isalnum()) and not (a > 1 and text[a - 1] == ":" and text[a - 2] in _HEX) and (m := _IP6.match(text, a)):
                try:
                    ipaddress.IPv6Address(m[0])
                    found["ip6"].append(m.span())
                    six = m.end()
                except ValueError:
                    pass
        elif kind in "kpx" and at >= secret:
            if kind == "x":
                m = None if at and (text[at - 1].isalnum() or text[at - 1] in "_-") else _SERVICE[text[at : end + 1]].match(text, at)
                own = m.span() if m else None
            else:
                m = (_PASSWORD if kind == "p" else _KEY).match(text, end + 1)
                if not m and kind == "k" and text[at : end + 1].lower() == "bearer":
                    m = _BEARER.match(text, end + 1)
                own = m.span(1) if m else None
            if own:
                found["secret"].append(own)
                secret = own[1]
        elif kind == "c" and end >= acct and not (at and text[at - 1].isalnum()):
            if numbers is None:
                numbers = list(ibans(text, end + 1))
            if m := _ACCOUNT.match(text, end + 1):
                found["account"].append(m.span(1))
                acct = m.end()
    if numbers:
        after = dict(numbers)
        starts = sorted(after)
        inside = lambda a: (k := bisect.bisect_right(starts, a)) > 0 and after[starts[k - 1]] > a
        found["account"] = numbers + [x for x in found["account"] if not inside(x[0])]
    return [(k, *s) for k in (*BASE, *ADDED) for s in sorted(found[k])]


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


FIELDS = [("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_secret", pa.int64()), ("n_spans", pa.int64()), ("masked", pa.string())]


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", mask: bool = False) -> DataFrame:
    """Per row: key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_spans (of all kinds) and, if asked for, masked (the text with each
    span replaced by its kind in angle brackets; of overlapping spans the first, longest). Null text counts as empty;
    repeated rows and ids are kept; other columns are not read. No shuffle.
    """
    small_batches(docs.sparkSession)
    fields = FIELDS if mask else FIELDS[:-1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                t = value.as_py() or ""
                got = spans(t)
                base = [x for x in got if x[0] in BASE]
                kinds = [x[0] for x in base]
                row = [*(kinds.count(k) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(got), sum(x[0] == "secret" for x in got), len(got)]
                if mask:
                    out, at = [], 0
                    for k, a, b in sorted(got, key=lambda x: (x[1], -x[2])):
                        if a >= at:
                            out += [t[at:a], f"<{k}>"]
                            at = b
                    row.append("".join([*out, t[at:]]))
                rows.append(row)
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True))], [key, *(n for n, _ in fields)])

    kinds = {pa.int64(): "long", pa.string(): "string"}
    source = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text"))
    return source.mapInArrow(scan, f"{key} long, " + ", ".join(f"{n} {kinds[t]}" for n, t in fields))


def op5_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
