"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from medialoom.llm.quality import RULES, STOP_WORDS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 19), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_transform({_WORDS}, lambda x: translate(x, '{_UPPER}', '{_LOWER}')) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)
"""


def _rule_sql() -> str:
    values = {
        "n_words": "n", "repeat_ratio": "rep / n1", "mean_word_chars": "chars / n1", "symbol_ratio": "sym / n1", "n_stop_words": "stops",
        "dup_line_ratio": "(lines - own) / greatest(lines, 1)::DOUBLE", "capital_ratio": "caps / greatest(chars, 1)::DOUBLE",
    }
    broken = []
    for r in RULES:
        tests = ([f"{values[r.metric]} < {float(r.low)}::DOUBLE"] if r.low is not None else []) + ([f"{values[r.metric]} > {float(r.high)}::DOUBLE"] if r.high is not None else [])
        broken.append(f"CASE WHEN {' OR '.join(tests)} THEN '{r.name}' END")
    return f"array_to_string(list_filter([{', '.join(broken)}], lambda x: x IS NOT NULL), ',')"


QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 2), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT p) AS rep FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, greatest(len(w), 1)::DOUBLE AS n1, CAST(length(array_to_string(w, '')) AS BIGINT) AS chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS sym,
  CAST(coalesce(rep, 0) AS BIGINT) AS rep, CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS caps, len(l) AS lines, len(list_distinct(l)) AS own,
  len(list_intersect(list_distinct(list_transform(w, lambda x: lower(x))), {list(dict.fromkeys(STOP_WORDS))!r})) AS stops
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d) LEFT JOIN rep USING (doc_id)),
j AS (SELECT *, n < 50 OR 100 * rep > 50 * n AS base_failed, {_rule_sql()} AS broken FROM m)
SELECT doc_id, n AS n_words, chars AS word_chars, sym AS n_symbols, CAST(lines - own AS BIGINT) AS n_dup_lines, rep AS n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, broken FROM j
"""

TOPK = """
WITH v AS (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.i, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.i <> c.i
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _crc_table() -> list[int]:
    """The CRC-32 of each byte, before it is inverted."""
    out = list(range(256))
    for _ in range(8):
        out = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in out]
    return out


def _crc(hex_text: str) -> str:
    """CRC-32 of the bytes whose upper-case hex digits are given."""
    byte = f"CAST(strpos('0123456789ABCDEF', substr({hex_text}, 2 * i + 1, 1)) * 16 + strpos('0123456789ABCDEF', substr({hex_text}, 2 * i + 2, 1)) - 17 AS UBIGINT)"
    listed = f"list_prepend(4294967295::UBIGINT, list_transform(range(CAST(length({hex_text}) // 2 AS BIGINT)), lambda i: {byte}))"
    return f"xor(list_reduce({listed}, lambda c, b: xor(c >> 8, CAST({_crc_table()}[CAST(xor(c & 255, b) AS INTEGER) + 1] AS UBIGINT))), 4294967295::UBIGINT)"


CONVERSATION_REPAIR = f"""
WITH RECURSIVE o AS (SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
k AS (SELECT o.*, {_crc("hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')))")} % 20 AS kind FROM o),
d AS (SELECT id, conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS p, left(role, 1) AS c FROM d),
f AS (SELECT *, lag(c) OVER w AS c0, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (c0 IS NOT NULL AND c0 || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
-- the least of 'cost audit' on the way to each state (a: nothing, s, u, v: after an assistant), insertions not yet counted at 0
go AS (
  SELECT conv_id, 0::BIGINT AS p, '00000000' AS a, '99999999' AS s, '00000002I' AS u, '00000004II' AS v FROM n
  UNION ALL
  SELECT conv_id, p, a, s, least(u, plus(v, 2, 'I'), plus(a, 2, 'I'), plus(s, 2, 'I')), least(v, plus(u, 2, 'I'), plus(plus(a, 2, 'I'), 2, 'I'), plus(plus(s, 2, 'I'), 2, 'I')) FROM (
    SELECT f.conv_id, f.p, plus(a, 3, 'D') AS a,
      least(plus(s, 3, 'D'), CASE WHEN ok AND c = 's' THEN plus(a, tr, 'K') ELSE '99999999' END) AS s,
      least(plus(u, 3, 'D'), CASE WHEN ok AND c = 'u' THEN least(plus(a, tr, 'K'), plus(s, tr, 'K'), plus(v, tr, 'K')) WHEN ok THEN least(plus(a, 2 + tr, 'R'), plus(s, 2 + tr, 'R'), plus(v, 2 + tr, 'R')) ELSE '99999999' END) AS u,
      least(plus(v, 3, 'D'), CASE WHEN ok AND c = 'a' THEN plus(u, tr, 'K') WHEN ok THEN plus(u, 2 + tr, 'R') ELSE '99999999' END) AS v
    FROM go JOIN (SELECT *, fault IN (0, 3) AS ok, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS tr FROM f) f ON f.conv_id IS NOT DISTINCT FROM go.conv_id AND f.p = go.p + 1)),
e AS (SELECT n.*, CAST(left(least(a, v), 8) AS BIGINT) AS cost, substr(least(a, v), 9) AS audit FROM n JOIN go ON go.conv_id IS NOT DISTINCT FROM n.conv_id AND go.p = n.n),
l AS (SELECT conv_id, j, substr(audit, CAST(j AS INTEGER), 1) AS x FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM e)),
m AS (SELECT *, count(*) FILTER (x <> 'I') OVER w AS p, count(*) FILTER (x <> 'D') OVER w AS q FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
t AS (SELECT m.conv_id, j, q, x, f.role, f.c, CASE WHEN x = 'I' THEN '' ELSE f.text END AS text FROM m LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.p = m.p AND x <> 'I' WHERE x <> 'D'),
z AS (SELECT conv_id, max(CASE WHEN q = 1 AND x = 'K' AND c = 's' THEN 1 ELSE 0 END) AS h FROM t GROUP BY conv_id),
y AS (SELECT t.conv_id, string_agg((CASE WHEN x = 'K' THEN role WHEN (q - h) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY j) AS out FROM t JOIN z ON z.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY t.conv_id)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(out, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM o) i LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM i.conv_id
"""


def _inlined(sql: str) -> str:
    """plus(x, cost, letter) written out: the cost added to the first eight digits of x, the letter at its end."""
    while "plus(" in sql:
        at = sql.rindex("plus(")
        depth, cuts, i = 0, [], at + 4
        while True:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if (sql[i] == "," and depth == 1) or depth == 0:
                cuts.append(i)
            if depth == 0:
                break
            i += 1
        x, cost, letter = (sql[a + 1 : b].strip() for a, b in zip([at + 4, *cuts], cuts))
        sql = f"{sql[:at]}(lpad(CAST(least(99999999, CAST(left({x}, 8) AS BIGINT) + {cost}) AS VARCHAR), 8, '0') || substr({x}, 9) || {letter}){sql[i + 1 :]}"
    return sql


CONVERSATION_REPAIR = _inlined(CONVERSATION_REPAIR)

_FEATURES = """SELECT {key}, {hex} AS x, count(*) AS n FROM (
  SELECT {key}, w, k, unnest(range(1, len(w) - k + 1)) AS i FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w, unnest(range(3)) AS k FROM {table})
) GROUP BY ALL"""


def _features(table: str, key: str) -> str:
    return _FEATURES.format(table=table, key=key, upper=_UPPER, lower=_LOWER, hex="hex(encode(array_to_string(list_slice(w, i, i + k), ' ')))")


IMPORTANCE_RESAMPLING = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, text FROM documents),
df AS MATERIALIZED ({_features("docs", "id")}),
bf AS MATERIALIZED ({_features("benchmark", "item_id")}),
x AS MATERIALIZED (SELECT x, {_crc("x")} % 10000 AS b FROM (SELECT x FROM df UNION SELECT x FROM bf)),
raw AS (SELECT b, sum(n) AS s FROM df JOIN x USING (x) GROUP BY b),
target AS (SELECT b, sum(n) AS t FROM bf JOIN x USING (x) GROUP BY b),
al AS (SELECT (SELECT coalesce(sum(s), 0) FROM raw) AS s_all, (SELECT coalesce(sum(t), 0) FROM target) AS t_all),
g AS (SELECT b, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM raw LEFT JOIN target USING (b), al),
w AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM df JOIN x USING (x) JOIN g USING (b) GROUP BY id),
c AS (SELECT docs.id, doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || left(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) AS h FROM docs LEFT JOIN w USING (id)),
sc AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score, n_features >= 57 AS fit FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS FIRST, n_features, id) AS r, count(*) OVER (PARTITION BY fit) AS fits FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND r <= 5 * fits // 100 THEN CAST(r AS BIGINT) END AS rank FROM o
"""
