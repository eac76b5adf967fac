"""DuckDB SQL for the rows of the registered corpus queries."""

from __future__ import annotations

_WHITE = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EXACT = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def line_dedup(source: str = "documents", ids: str = "doc_id") -> str:
    """CTEs up to ``cut(doc_id, n_lines, n_dropped, kept)``."""
    return f"""
lined AS (
  SELECT {ids} AS rid, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT {ids}, string_split(coalesce(text, ''), chr(10)) AS ls FROM {source})
),
keyed AS (SELECT rid, pos, line, translate(trim(line, {_WHITE}), '{_UP}', '{_LOW}') AS key FROM lined),
often AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
cut AS (
  SELECT rid, count(*) AS n_lines, count(o.key) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.key IS NULL), '') AS kept
  FROM keyed LEFT JOIN often o USING (key) GROUP BY rid
)"""


LINES = f"""
WITH {line_dedup()}
SELECT rid AS doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM cut
"""


def leaks(source: str = "documents") -> str:
    """CTEs up to ``hit(doc_id, n_words, n_hit, items)``."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{word}') AS ws FROM {source}
),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{word}') AS ws FROM benchmark
),
win AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS w, array_to_string(ws[s : s + least(10, len(ws)) - 1], ' ') AS k
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS s FROM iw WHERE len(ws) > 0)
),
widths AS (SELECT DISTINCT w FROM win),
dwin AS (
  SELECT doc_id, w, s, array_to_string(ws[s : s + w - 1], ' ') AS k
  FROM (SELECT doc_id, ws, w, unnest(generate_series(1, len(ws) - w + 1)) AS s FROM dw, widths WHERE len(ws) >= w)
),
met AS (SELECT doc_id, s, d.w, item_id FROM dwin d JOIN win USING (w, k)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + w - 1)) AS p FROM met) GROUP BY 1),
its AS (SELECT doc_id, list_sort(list(DISTINCT coalesce(item_id::VARCHAR, ''))) AS items FROM met GROUP BY 1),
hit AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(items, []) AS items
  FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
)"""


LEAKS = f"""
WITH {leaks()}
SELECT doc_id, n_words, n_hit, len(items) AS n_items, sha256(array_to_string(items, ',')) AS items_sha256,
       n_hit > 0 AS contaminated
FROM hit
"""

_KINDS = (
    ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    ("hex", r"[0-9a-f]{24,}", 0, 24, True),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, False),
    ("pat", r"ghp_[A-Za-z0-9]{36}", 0, 0, False),
)


def _spans(kind: str, regex: str, group: int, least: int, order: int) -> str:
    return f"""
  SELECT doc_id, {order} AS o, '{kind}' AS kind, s, s + len(m) AS e FROM (
    SELECT doc_id, m, t, sum(len(gap) + coalesce(len(before), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM (
      SELECT doc_id, i, gaps[i] AS gap, ms[i] AS m, ts[i] AS t, CASE WHEN i > 1 THEN ms[i - 1] END AS before FROM (
        SELECT doc_id, ms, unnest(generate_series(1, len(ms))) AS i,
               string_split_regex(text, '{regex}') AS gaps, regexp_extract_all(text, '{regex}', {group}) AS ts
        FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{regex}') AS ms FROM documents)
        WHERE len(ms) > 0
      )
    )
  ) WHERE len(t) >= {least}"""


SECRETS = f"""
WITH spans AS ({" UNION ALL ".join(_spans(k, r, g, n, o) for o, (k, r, g, n, _) in enumerate(_KINDS))}),
told AS (SELECT doc_id, kind, s, o, kind || ':' || s::BIGINT || ':' || e::BIGINT AS x FROM spans),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, string_agg(x, ',' ORDER BY s, o) FILTER (o < 3) AS base,
         string_agg(x, ',' ORDER BY s, o) AS spans
  FROM told GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN per USING (doc_id)
"""

#: CRC-32 of ``k`` byte by byte, with its table made from the polynomial; ids are ASCII.
_CRC_TABLE = """
SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS tab
FROM (SELECT unnest(range(256)) AS n)"""
_CRC = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, len(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""


def _turn(state: str, cost: str, edit: str, turn: str | None = None) -> str:
    """The best of a state (cost, audit, output) after one more edit."""
    out = f"{state}.o" if turn is None else f"CASE WHEN {state}.o = '' THEN {turn} ELSE {state}.o || chr(10) || {turn} END"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'o': {out}}}"


def _cheapest(*states: str) -> str:
    return f"list_sort([{', '.join(states)}])[1]"


_NEVER = 1_000_000_000
_KEPT = "role || ':' || text"
_ROW = "CASE WHEN fault IN (1, 2) THEN {never} WHEN fault = 3 THEN {cost} + 3 ELSE {cost} END".replace("{never}", str(_NEVER))
_INI = "CASE WHEN ini = '{ini}' THEN 0 ELSE {never} END".replace("{never}", str(_NEVER))


def _keep(state: str, ini: str) -> str:
    return _turn(state, f"{_ROW.format(cost=0)} + {_INI.format(ini=ini)}", "K", _KEPT)


def _rerole(state: str, role: str) -> str:
    return _turn(state, _ROW.format(cost=3), "R", f"'{role}:' || text")


def _insert(state: str, role: str) -> str:
    return _turn(state, "3", "I", f"'{role}:'")


def _state(cost: int, audit: str = "''", out: str = "''") -> str:
    return f"{{'c': {cost}::BIGINT, 'a': {audit}::VARCHAR, 'o': {out}::VARCHAR}}"


REPAIR = f"""
WITH RECURSIVE crc AS MATERIALIZED ({_CRC_TABLE}),
read AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
),
kinds AS (SELECT read.*, {_CRC} % 20 AS kind FROM read, crc),
spoilt AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0
),
marked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth,
         rtrim(text, {_WHITE}) AS bare, left(role, 1) AS ini
  FROM spoilt
),
faulty AS (
  SELECT conv_id, turn, pos, role, text, ini, lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
         CASE WHEN bare = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
  FROM marked
),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
),
steps AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, {_state(0)} AS st, {_state(_NEVER)} AS ss,
         {_state(3, "'I'", "'user:'")} AS su, {_state(6, "'II'", "'user:'||chr(10)||'assistant:'")} AS sa
  FROM conversations
  UNION ALL
  SELECT conv_id, pos, st, ss, su, {_cheapest("sa", _insert("su", "assistant"))} AS sa FROM (
    SELECT conv_id, pos, st, ss,
           {_cheapest("su", _insert("st", "user"), _insert("ss", "user"), _insert("sa", "user"))} AS su, sa
    FROM (
      SELECT s.conv_id, f.pos, {_turn("st", "4", "D")} AS st,
             {_cheapest(_turn("ss", "4", "D"), _keep("st", "s"))} AS ss,
             {_cheapest(_turn("su", "4", "D"), *(_keep(x, "u") for x in ("st", "ss", "sa")), *(_rerole(x, "user") for x in ("st", "ss", "sa")))} AS su,
             {_cheapest(_turn("sa", "4", "D"), _keep("su", "a"), _rerole("su", "assistant"))} AS sa
      FROM steps s JOIN faulty f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.pos = s.pos + 1
    )
  )
),
ended AS (SELECT conv_id, pos, {_cheapest("st", "sa")} AS best FROM steps)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(best.o) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
WHERE e.pos = coalesce(c.n, 0)
"""

ARCHIVE = """
WITH paid AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM paid)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR page_id IS NOT DISTINCT FROM least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM firsts
"""

ORACLES = {
    "op2_exact_dedup": EXACT,
    "op7_decontamination": LEAKS,
    "op9_line_dedup": LINES,
    "op10_secret_scan": SECRETS,
    "op12_conversation_repair": REPAIR,
    "op13_warc": ARCHIVE,
}
