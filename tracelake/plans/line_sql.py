"""SQL of the rewriters: a second implementation of merging, tag dropping and both templates, by lines and islands.

Each function gives CTEs that read a CTE of (trace_id, trace) and end in one of the given name. They use a recursion over
lines and are meant for DuckDB.
"""

from __future__ import annotations

from tracelake.operators.rewrite import BOS, END_TURN, EOS, EOT, OPENERS, ROLE, TURN

NL = "chr(10)"
_SPACE = r"'^\s+|\s+$', '', 'g'"
_NAMES = {o: o[:-1].strip() for o in OPENERS}


def _count(text: str, mark: str) -> str:
    return f"((length({text}) - length(replace({text}, '{mark}', ''))) // {len(mark)})"


def pieces(source: str, name: str, openers=tuple(OPENERS)) -> str:
    """{name}(trace_id, j, b, text, first): blocks and single lines; b: the block's keyword, null for a line."""
    kind = " ".join(f"WHEN starts_with(s, '{o}') THEN '{_NAMES[o]}'" for o in openers)
    corner = ", ".join(f"'{n}'" for o, n in _NAMES.items() if o.endswith("「"))
    delta = lambda b: f"CASE WHEN {b} IN ({corner}) THEN l.corner ELSE l.brace END"
    return rf"""
{name}_s AS (SELECT trace_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM (SELECT trace_id, string_split(trace, {NL}) AS x FROM {source})),
{name}_l AS (SELECT trace_id, i, line, CASE {kind} END AS opener, {_count('line', '「')} - {_count('line', '」')} AS corner, {_count('line', '{')} - {_count('line', '}')} AS brace FROM (SELECT *, regexp_replace(line, '^\s+', '') AS s FROM {name}_s)),
{name}_a AS (SELECT trace_id, i, line, opener AS b, CASE WHEN opener IS NULL THEN 0 ELSE {delta('opener')} END AS d, 1 AS head FROM {name}_l l WHERE i = 1
  UNION ALL SELECT l.trace_id, l.i, l.line, CASE WHEN a.d > 0 THEN a.b ELSE l.opener END, CASE WHEN a.d > 0 THEN a.d + {delta('a.b')} WHEN l.opener IS NULL THEN 0 ELSE {delta('l.opener')} END, CASE WHEN a.d > 0 THEN 0 ELSE 1 END
  FROM {name}_a a JOIN {name}_l l ON l.trace_id = a.trace_id AND l.i = a.i + 1),
{name} AS (SELECT trace_id, j, any_value(b) AS b, string_agg(line, {NL} ORDER BY i) AS text FROM (SELECT *, sum(head) OVER (PARTITION BY trace_id ORDER BY i) AS j FROM {name}_a) GROUP BY trace_id, j)"""


def merged(source: str, name: str) -> str:
    """{name}(trace_id, trace, lossy): runs of think-only acts, and a call-only act behind them, as one act."""
    quoted, bracket = r"""'(?s)think\s*↦\s*"([^"]*)"(.*?)\s*\}'""", r"'(?s)think\s*↦\s*「([^」]*)」(.*?)\s*\}'"
    call = r"'(?s)call\s*↦\s*(\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\})(.*?)\s*\}'"
    part = lambda k: f"regexp_replace(CASE WHEN regexp_matches(text, {quoted}) THEN regexp_extract(text, {quoted}, {k}) WHEN regexp_matches(text, {bracket}) THEN regexp_extract(text, {bracket}, {k}) END, {_SPACE})"
    spaced = lambda x: f"CASE WHEN {x} = '' THEN '' ELSE ' ' || {x} END"
    return rf"""{pieces(source, f'{name}_p', ('act {',))},
{name}_k AS (SELECT *, CASE WHEN b IS NULL THEN CASE WHEN regexp_matches(text, '\S') THEN 'line' ELSE 'blank' END WHEN contains(text, 'think ↦') AND NOT contains(text, 'call ↦') THEN 'think'
  WHEN contains(text, 'call ↦') AND NOT contains(text, 'think ↦') THEN 'call' ELSE 'other' END AS kind FROM {name}_p),
{name}_n AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY trace_id ORDER BY j) = 'think' AND kind IN ('think', 'call'), false) AS joins FROM {name}_k WHERE kind <> 'blank'),
{name}_r AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY trace_id ORDER BY j) AS run FROM {name}_n),
{name}_i AS (SELECT *, ops <> '' AND regexp_matches(ops, '[⊨🏷※𝑝]') AS has FROM (SELECT trace_id, run, j, {part(1)} AS x, {part(2)} AS ops FROM {name}_r WHERE kind = 'think') WHERE x IS NOT NULL),
{name}_o AS (SELECT *, count(*) OVER w AS n, coalesce(sum(has::INT) OVER (PARTITION BY trace_id, run ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g, sum(has::INT) OVER w AS gs FROM {name}_i WINDOW w AS (PARTITION BY trace_id, run)),
{name}_g AS (SELECT trace_id, run, n, least(g, greatest(gs - 1, 0)) AS g, string_agg(x, ' ' ORDER BY j) AS x, CASE WHEN n = 1 THEN any_value(ops) ELSE coalesce(any_value(ops) FILTER (has), '') END AS ops FROM {name}_o GROUP BY trace_id, run, n, least(g, greatest(gs - 1, 0))),
{name}_b AS (SELECT trace_id, run, n, CASE WHEN count(*) = 1 THEN any_value(item) ELSE '[' || {NL} || '        ' || string_agg(item, ' •' || {NL} || '        ' ORDER BY g) || {NL} || '    ]' END AS body FROM (SELECT *, '「' || x || '」' || {spaced('ops')} AS item FROM {name}_g) GROUP BY trace_id, run, n),
{name}_c AS (SELECT trace_id, run, min(j) AS lo, max(j) AS hi, arg_min(text, j) AS head, arg_min(kind, j) AS kind, count(*) FILTER (kind = 'think') AS thinks, bool_or({_count('text', 'think ↦')} > 1) FILTER (kind = 'think') AS twice,
  any_value(text) FILTER (joins AND kind = 'call') AS call FROM {name}_r GROUP BY trace_id, run),
{name}_d AS (SELECT c.*, coalesce(b.n, 0) AS found, b.body, coalesce(regexp_matches(call, {call}), false) AS called FROM {name}_c c LEFT JOIN {name}_b b ON c.trace_id = b.trace_id AND c.run = b.run),
{name}_t AS (SELECT trace_id, lo AS j, CASE WHEN kind = 'think' AND (found > 1 OR called) THEN 'act {{' || {NL} || '    think ↦ ' || coalesce(body, '[' || {NL} || '        ' || {NL} || '    ]') || CASE WHEN called THEN ' •' || {NL} || '    call ↦ ' || regexp_extract(call, {call}, 1) || {spaced(f'regexp_replace(regexp_extract(call, {call}, 2), {_SPACE})')} ELSE '' END || {NL} || '}}' ELSE head END AS text,
  kind = 'think' AND CASE WHEN found > 1 OR called THEN found < thinks OR twice OR (call IS NOT NULL AND (NOT called OR {_count('call', 'call ↦')} > 1)) ELSE thinks > 1 OR call IS NOT NULL END AS lost FROM {name}_d
  UNION ALL SELECT trace_id, j, text, false FROM {name}_k k WHERE kind = 'blank' AND NOT EXISTS (SELECT 1 FROM {name}_d d WHERE d.trace_id = k.trace_id AND d.lo < k.j AND k.j < d.hi)),
{name} AS (SELECT trace_id, string_agg(text, {NL} ORDER BY j) AS trace, bool_or(lost) AS lossy FROM {name}_t GROUP BY trace_id)"""


def untagged(source: str, name: str) -> str:
    """{name}(trace_id, trace): without tags that nothing refers to."""
    return rf"""
{name}_n AS (SELECT trace_id, trace, list_distinct(regexp_extract_all(trace, '🏷\s*["'']?([a-zA-Z_][a-zA-Z0-9_-]*)["'']?', 1)) AS own,
  list_concat(regexp_extract_all(trace, '※\s*["'']?([a-zA-Z_][a-zA-Z0-9_-]*)["'']?', 1), list_transform(flatten(list_transform(regexp_extract_all(trace, '※\s*\[([^\]]+)\]', 1), lambda x: string_split(x, '•'))), lambda x: trim(trim(x), '"'''))) AS used FROM {source}),
{name} AS (SELECT trace_id, list_reduce(list_prepend(trace, list_sort(list_filter(own, lambda x: NOT list_contains(used, x)))), lambda a, t: CASE WHEN regexp_matches(a, '🏷\s*"' || t || '"') THEN regexp_replace(a, '\s*🏷\s*"' || t || '"', '', 'g')
  ELSE regexp_replace(a, '\s*🏷\s*' || t || '([^a-zA-Z0-9_-]|$)', '\1', 'g') END) AS trace FROM {name}_n)"""


def template_a(source: str, name: str) -> str:
    """{name}(trace_id, trace): system turn, then user and assistant turns in pairs."""
    user_before = "coalesce(sum(CASE WHEN b = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY j), 0)"
    turn = lambda role, body: f"'{TURN}{role}' || {NL} || {body} || {NL} || '{END_TURN}' || {NL}"
    return rf"""{pieces(source, f'{name}_p')},
{name}_u AS (SELECT *, {user_before} AS seg FROM {name}_p),
{name}_v AS (SELECT *, coalesce(bool_or(b IN ('plan', 'act', 'result', 'response')) OVER (PARTITION BY trace_id, seg ORDER BY j), false) AS opened, coalesce(bool_or(b IN ('system', 'tool')) OVER (PARTITION BY trace_id ORDER BY j), false) AS begun FROM {name}_u),
{name}_w AS (SELECT *, CASE WHEN b IN ('system', 'tool') THEN 'system' WHEN b = 'user' THEN 'user' WHEN b IS NOT NULL OR opened THEN 'assistant' WHEN begun AND regexp_matches(text, '\S') THEN 'system' END AS part, CASE WHEN b IS NULL AND NOT regexp_matches(text, '\S') THEN '' ELSE text END AS said FROM {name}_v),
{name}_x AS (SELECT trace_id, part, CASE WHEN part = 'system' THEN 0 ELSE seg END AS seg, string_agg(said, {NL} ORDER BY j) AS said FROM {name}_w WHERE part IS NOT NULL GROUP BY ALL),
{name}_y AS (SELECT *, row_number() OVER (PARTITION BY trace_id, part ORDER BY seg) AS k, count(*) FILTER (part = 'user') OVER (PARTITION BY trace_id) AS users FROM {name}_x),
{name} AS (SELECT t.trace_id, coalesce(string_agg(CASE part WHEN 'system' THEN {turn('system', 'said')} WHEN 'user' THEN {turn('user', 'said')} ELSE {turn('assistant', 'said')} END, {NL} ORDER BY CASE part WHEN 'system' THEN 0 WHEN 'user' THEN 2 * k ELSE 2 * k + 1 END) FILTER (part <> 'assistant' OR k <= users), '') AS trace
  FROM (SELECT DISTINCT trace_id FROM {name}_p) t LEFT JOIN {name}_y y ON t.trace_id = y.trace_id GROUP BY t.trace_id)"""


def template_b(source: str, name: str) -> str:
    """{name}(trace_id, trace): a marker around each block but tools."""
    role = " ".join(f"WHEN '{n}' THEN '{ROLE[OPENERS[o]]}'" for o, n in _NAMES.items() if n != "tool")
    return rf"""{pieces(source, f'{name}_p')},
{name}_x AS (SELECT trace_id, j, CASE WHEN b IS NULL OR b = 'tool' THEN text ELSE CASE b {role} END || {NL} || text || {NL} || '{EOT}' END AS text FROM {name}_p WHERE b IS NOT NULL OR regexp_matches(text, '\S')),
{name} AS (SELECT t.trace_id, '{BOS}' || {NL} || coalesce(string_agg(text, {NL} ORDER BY j) || {NL}, '') || '{EOS}' AS trace FROM (SELECT DISTINCT trace_id FROM {name}_p) t LEFT JOIN {name}_x x ON t.trace_id = x.trace_id GROUP BY t.trace_id)"""
