"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

from verdant.llm import decontaminate as D
from verdant.llm.quality import COMMON_WORDS

_LISTS = ", ".join(f"('{lang}', {k}, '{w}')" for lang, words in sorted(COMMON_WORDS.items()) for k, w in enumerate(words))

OP10 = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(3) r(j) GROUP BY 1),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
base AS (SELECT d.doc_id, lang, text, ws, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, array_to_string(ws, '') AS dense FROM base),
chars AS (SELECT doc_id, unnest([length(regexp_replace(dense, '[^a-z]', '', 'g')), length(regexp_replace(dense, '[^A-Z]', '', 'g')), length(regexp_replace(dense, '[^0-9]', '', 'g')), n_symbols,
  length(regexp_replace(dense, '[^\x00-\x7F]|[a-zA-Z0-9#*$%&|<>]', '', 'g')), length(regexp_replace(dense, '[\x00-\x7F]', '', 'g')), greatest(n_words - 1, 0)]) AS n, unnest(range(7)) AS k FROM failed),
common(lang, k, w) AS (VALUES {_LISTS}),
hits AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, lang, lower(unnest(ws)) AS w FROM failed) JOIN common USING (lang, w) GROUP BY 1, 2),
own AS (SELECT doc_id, c.k, coalesce(h.n, 0) AS n FROM failed JOIN common c USING (lang) LEFT JOIN hits h USING (doc_id, k)),
words AS (SELECT * FROM own UNION ALL SELECT doc_id, 16, any_value(n_words) - sum(own.n) FROM own JOIN failed USING (doc_id) GROUP BY 1),
shares AS (SELECT kind, doc_id, lang, k, n / sum(n) OVER (PARTITION BY kind, doc_id) AS p, n_words >= 100 AND word_chars >= 200 AND NOT base_failed AS fit
  FROM (SELECT 'c' AS kind, doc_id, k, n FROM chars UNION ALL SELECT 'w', doc_id, k, n FROM words) JOIN failed USING (doc_id)),
refs AS (SELECT kind, lang, k, avg(p) AS q FROM shares WHERE fit GROUP BY 1, 2, 3),
distance AS (SELECT kind, doc_id, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS x FROM shares JOIN refs USING (kind, lang, k) GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (word_chars >= 200 AND coalesce(c.x, 0) > 0.25) AND NOT (n_words >= 100 AND coalesce(w.x, 0) > 0.3) AS kept
FROM failed LEFT JOIN (SELECT * FROM distance WHERE kind = 'c') c USING (doc_id) LEFT JOIN (SELECT * FROM distance WHERE kind = 'w') w USING (doc_id)"""

OP2 = """
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, conv_id || '-' || turn AS call_id, CASE WHEN role = 'user' AND turn > 1 THEN conv_id || '-' || (turn - 2) WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS after FROM conversations),
c AS (SELECT * FROM m WHERE role IN ('user', 'system')),
l(conv_id, turn, level) AS (SELECT conv_id, turn, 0::BIGINT FROM c WHERE after IS NULL OR after NOT IN (SELECT call_id FROM c) UNION ALL SELECT c.conv_id, c.turn, l.level + 1 FROM l JOIN c ON c.conv_id = l.conv_id AND c.after = l.conv_id || '-' || l.turn)
SELECT c.conv_id, c.turn, c.call_id, l.level, CASE c.role WHEN 'user' THEN 'message' ELSE 'configure' END AS name, length(c.text) > 0 AS valid, CASE WHEN length(c.text) > 0 THEN '' ELSE '$.text: length out of bounds' END AS errors, r.turn AS result_turn,
 '{"after":' || coalesce(to_json(c.after)::VARCHAR, 'null') || ',"arguments":{"text":' || to_json(c.text)::VARCHAR || '},"id":' || to_json(c.call_id)::VARCHAR || ',"name":"' || CASE c.role WHEN 'user' THEN 'message' ELSE 'configure' END || '","result":' || coalesce(to_json(r.text)::VARCHAR, 'null') || '}' AS json
FROM c JOIN l USING (conv_id, turn) LEFT JOIN m r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 AND r.role = 'assistant'"""

STATED = """
WITH RECURSIVE c AS (SELECT conv_id, turn, role, text, length(text) AS n, 'c-' || conv_id || '-' || turn AS call_id,
  CASE WHEN turn > 0 THEN 'c-' || conv_id || '-' || (turn - CASE role WHEN 'user' THEN 2 ELSE 1 END) END AS after FROM conversations WHERE role IN ('user', 'system')),
l(call_id, level) AS (SELECT call_id, 0::BIGINT FROM c WHERE after IS NULL OR after NOT IN (SELECT call_id FROM c) UNION ALL SELECT c.call_id, l.level + 1 FROM l JOIN c ON c.after = l.call_id),
e AS (SELECT *, array_to_string(list_filter([CASE WHEN n < 1 OR n > 60 THEN '$.n: out of bounds' END, CASE WHEN role <> 'user' THEN '$.of: not the value allowed' END], lambda x: x IS NOT NULL), '; ') AS errors FROM c)
SELECT conv_id, turn, call_id, level, 'count' AS name, errors = '' AS valid, errors, CASE WHEN n % 3 > 0 THEN turn + 1 END AS result_turn,
 '{"after":' || coalesce('"' || after || '"', 'null') || ',"arguments":{"n":' || n || ',"of":"' || role || '"},"id":"' || call_id || '","name":"count","result":' ||
 CASE WHEN n % 3 > 0 THEN '"{\\"characters\\":' || n || ',\\"words\\":' || len(string_split(text, ' ')) || '}"' ELSE 'null' END || '}' AS json
FROM e JOIN l USING (call_id)"""

_FUNCTION_WORDS = "|".join(sorted({w for words in D.FUNCTION_WORDS.values() for w in words}))


def _tokens(table: str, key: str, merged: int) -> str:
    """Tokens of a reading with their slots' values; this engine looks behind and ahead of nothing, so some steps are done twice or undone."""
    name = rf"((?:[\p{{Ll}}\p{{Nd}},;{D.NUMBER}]|[\p{{Nd}}{D.NUMBER}]\s)\s)(\p{{Lu}}\p{{Ll}}+)"
    run = rf"({D.NAME}[{D.TOKEN}]*)\s({D.NAME})"
    steps = [(r"(\d)[.,](\d)", rf"\1{D.POINT}\2"), (r"(\d)[.,](\d)", rf"\1{D.POINT}\2"), (rf"(\d[\d{D.POINT}]*)", rf" {D.NUMBER}\1 ")]
    if merged:
        asked = (rf"(^|[^{D.TOKEN}])((?i:{D.ASKING}))\s+({D.UNIT_LIKE})([^{D.TOKEN}]|$)", rf"\1\2 {D.NUMBER}{D.UNIT}\3\4")
        steps += [asked, asked, (rf"{D.NUMBER}{D.UNIT}((?i:{_FUNCTION_WORDS}))([^{D.TOKEN}]|$)", r"\1\2")]
        steps += [(rf"({D.NUMBER}[\d{D.POINT}]*)\s+({D.UNIT_LIKE})([^{D.TOKEN}]|$)", rf"\1{D.UNIT}\2\3"), (rf"({D.NUMBER}[\d{D.POINT}]*)\s+([%$€£])", rf"\1{D.UNIT}\2"), (rf"{D.UNIT}((?i:{_FUNCTION_WORDS}))([^{D.TOKEN}]|$)", r" \1\2")]
        steps += [(rf"(^|[^{D.TOKEN}])(\p{{Lu}}\p{{Ll}})", rf"\1{D.NAME}\2"), (run, rf"\1{D.JOIN}\2"), (run, rf"\1{D.JOIN}\2")]
    else:
        steps += [(name, rf"\1{D.NAME}\2"), (name, rf"\1{D.NAME}\2")]
    text = "text"
    for pattern, by in steps:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    value = f"CASE WHEN x[1] = '{D.NAME}' THEN '{D.NAME}' || replace(replace(x, '{D.NAME}', ''), '{D.JOIN}', ' ') ELSE x END"
    return f"SELECT {key}, {merged} AS r, list_transform(list_filter(string_split_regex(lower({text}), '[^{D.TOKEN}]+'), lambda x: x <> ''), lambda x: {value}) AS ts FROM {table}"


_SLOT = f"'[{D.NUMBER}{D.NAME}]'"


def _read(table: str, key: str) -> str:
    """Both readings. ks are the tokens without values."""
    return f"SELECT {key}, r, ts, list_transform(ts, lambda x: CASE WHEN regexp_matches(x[1], {_SLOT}) THEN x[1] ELSE x END) AS ks FROM ({_tokens(table, key, 0)} UNION ALL {_tokens(table, key, 1)})"


def _values(z: str) -> str:
    """Pairs of slots as pairs of values: numbers and names, then units where both sides have one."""
    part = lambda n: f"[split_part(x[1], '{D.UNIT}', {n}), split_part(x[2], '{D.UNIT}', {n})]"
    units = f"list_transform(list_filter({z}, lambda x: contains(x[1], '{D.UNIT}') AND contains(x[2], '{D.UNIT}')), lambda x: list_transform({part(2)}, lambda u: '{D.UNIT}' || u))"
    return f"list_concat(list_transform({z}, lambda x: {part(1)}), {units})"


# Every window of 13 tokens (or of a shorter item's length) is judged by itself; stretches of good ones are joined.
OP3 = f"""
WITH d AS ({_read("documents", "doc_id")}), b AS (SELECT *, least(13, len(ts)) AS need FROM ({_read("benchmark", "item_id")}) WHERE len(ts) > 0),
bw AS (SELECT item_id, r, need, i, array_to_string(ks[i:i + need - 1], ' ') AS w, ts[i:i + need - 1] AS a FROM (SELECT *, unnest(range(1, len(ks) - need + 2)) AS i FROM b)),
dw AS (SELECT doc_id, r, need, i, array_to_string(ks[i:i + need - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(ks) - need + 2)) AS i FROM d, (SELECT DISTINCT need FROM b))),
p AS (SELECT doc_id, item_id, r, need, dw.i, dw.i - bw.i AS shift, a FROM dw JOIN bw USING (r, need, w)),
s AS (SELECT doc_id, item_id, r, need, i, shift, list_filter(list_zip(a, ts[i:i + need - 1]), lambda x: regexp_matches(x[1][1], {_SLOT})) AS z FROM p JOIN d USING (doc_id, r)),
v AS (SELECT *, {_values('z')} AS vs FROM s),
good AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, r, shift ORDER BY i) AS g FROM v
 WHERE len(list_filter(vs, lambda x: x[1] <> x[2])) = 0 OR (2 * len(list_filter(z, lambda x: NOT starts_with(x[1], '{D.NUMBER}{D.UNIT}'))) <= need AND len(list_distinct(vs)) = len(list_distinct(list_transform(vs, lambda x: x[1]))))),
runs AS (SELECT doc_id, item_id, r, shift, min(i) AS first, count(*) + any_value(need) - 1 AS run FROM good GROUP BY doc_id, item_id, r, shift, g),
whole AS (SELECT doc_id, item_id, run, list_filter(list_zip(b.ts[first - shift:first - shift + run - 1], d.ts[first:first + run - 1]), lambda x: regexp_matches(x[1][1], {_SLOT})) AS z FROM runs JOIN b USING (item_id, r) JOIN d USING (doc_id, r))
SELECT doc_id, item_id, run::INT AS run_tokens, len(z)::INT AS n_slots, len(list_filter({_values('z')}, lambda x: x[1] <> x[2])) = 0 AS verbatim FROM whole
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY run_tokens DESC, n_slots DESC, verbatim DESC) = 1"""

OP9 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS x FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS last, list_transform(range(8), lambda j: ('0x' || substr(x, 5 * j + 1, 5))::INT) AS v FROM h)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v[1 + i // 4] >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
 CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM m"""

def _op13(clusters: int = 40, rounds: int = 5) -> str:
    """Rounds written out; a centroid without vectors is carried over."""
    distance = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    near = "SELECT v.rid, min({{'d': " + distance + ", 'k': c.k}}) AS b FROM v, c{0} c GROUP BY 1"
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS k, q FROM v QUALIFY k < {clusters})"""]  # fmt: skip
    for n in range(rounds):
        steps.append(f"""a{n} AS MATERIALIZED ({near.format(n)}),
s{n} AS (SELECT k, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT b.k AS k, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM a{n} JOIN v USING (rid)) GROUP BY 1, 2),
c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{n} c LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS q FROM s{n} GROUP BY 1) m USING (k))""")
    return "WITH " + ", ".join(steps) + f""",
last AS MATERIALIZED ({near.format(rounds)})
SELECT vec_id, b.k::INTEGER AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.k))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM last JOIN v USING (rid) JOIN c{rounds} c ON c.k = b.k
"""


ORACLE_SQL = {"op2_tool_calls": OP2, "stated_tool_calls": STATED, "op3_decontaminate": OP3, "op9_warc": OP9, "op10_quality_rules": OP10, "op13_centroids": _op13()}
