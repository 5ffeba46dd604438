"""DuckDB SQL for the queries of this subpackage that SQL can express, by plainer ways than the operators take.

Signatures, trees, merges of ranks and dependent rounding have none; those queries are tested against brute force.
"""

from __future__ import annotations

import re

from .pii import BASE
from .quality import ACCURACY, DEVIATIONS, EVENTS, MAX_REPEAT_PERCENT, MIN_WORDS, RATES, SHRINK, TWO_SIDED
from .urls import DEFAULT_VERDICT, FIXED, GENERAL, HOSTS, TOKEN, Rule

WORD = r"[^\x20\x09-\x0D]+"
UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _re2(rule: Rule) -> str:
    """The rule's pattern without look-arounds: a bare word is a run of token characters of its own."""
    body = rule.name.removeprefix("@@")
    return rf"(?i)(?:^|[^A-Za-z0-9]){body}(?:[^A-Za-z0-9]|$)" if rule.level != HOSTS and re.fullmatch(TOKEN, body) else rule.pattern


def url_sql() -> str:
    """Every rule runs on every URL."""
    values = ", ".join(f"({_quoted(r.name)}, '{r.verdict}', {r.level}, {_quoted(_re2(r))})" for r in (*FIXED, *GENERAL))
    return rf"""WITH rules(name, verdict, level, pattern) AS (VALUES {values}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM u),
p AS (SELECT page_id, translate(host, {UPPER}, lower({UPPER})) AS host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM h)
SELECT p.page_id, host, path, CASE WHEN level = {HOSTS} THEN name END AS rule, coalesce(verdict, '{DEFAULT_VERDICT}') AS verdict
FROM p LEFT JOIN rules ON regexp_matches(host || path, pattern)
QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY level DESC, length(name) DESC, name DESC) = 1"""


NEAREST = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM e q, e c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id)::INT AS rank, vec_id, round(score, 6) AS score FROM s QUALIFY rank <= 5"""


#: The fixed patterns as the contract has them.
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii_sql() -> str:
    digits = "regexp_replace(x.hit, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({digits})[i]::INT WHEN reverse({digits})[i]::INT >= 5 THEN 2 * reverse({digits})[i]::INT - 9 ELSE 2 * reverse({digits})[i]::INT END)) % 10 = 0"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(x.hit, '.'), lambda p: length(ltrim(p, '0')) > 3 OR ('0' || right(p, 3))::INT > 255)) = 0",
        "card": f"CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN {luhn} ELSE false END",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
    }
    hits = ", ".join(f"regexp_extract_all(t, '{p}') AS h_{k}, string_split_regex(t, '{p}') AS g_{k}" for k, p in PII.items())
    length = "coalesce(list_sum(list_transform({}, lambda s: length(s))), 0)::BIGINT"
    spans = ", ".join(
        f"list_filter(list_transform(range(1, len(h_{k}) + 1), lambda i: {{'kind': '{k}', 'start': {length.format(f'g_{k}[1:i]')} + {length.format(f'h_{k}[1:i - 1]')}, 'hit': h_{k}[i]}}), lambda x: {valid[k]}) AS s_{k}" for k in BASE
    )
    told = "list_concat(" * (len(BASE) - 1) + f"s_{BASE[0]}" + "".join(f", s_{k})" for k in BASE[1:])
    return rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), h AS (SELECT doc_id, {hits} FROM t), s AS (SELECT doc_id, {spans} FROM h)
SELECT doc_id, {', '.join(f'len(s_{k}) AS n_{k}' for k in BASE)}, sha256(array_to_string(list_transform({told}, lambda x: x.kind || ':' || x.start || ':' || (x.start + length(x.hit))), ',')) AS base_sha256 FROM s"""


#: Every window of every document meets every other by its words.
REPEATS = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS pos, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h FROM d WHERE len(w) >= 50),
m AS (SELECT doc_id, pos FROM s QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS p FROM m),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT x.doc_id, count(c.p) AS gone, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE c.p IS NULL) AS kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p GROUP BY x.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def line_sql(least_words: int, least_chars: int) -> str:
    """Every line with every line that shares a variant, as text."""
    return rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
c AS (SELECT *, trim(regexp_replace(lower(raw), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS line, row_number() OVER (ORDER BY doc_id, no) AS spot FROM l),
d AS (SELECT line, min(spot) AS spot, len(string_split(line, ' ')) >= {least_words} AS by_words FROM c WHERE line <> '' GROUP BY line),
u AS (SELECT spot, line, by_words, CASE WHEN by_words THEN string_split(line, ' ') ELSE string_split(line, '') END AS u FROM d WHERE by_words OR length(line) >= {least_chars}),
v AS (SELECT spot, by_words, unnest(range(1, len(u) + 1)) AS pos, unnest(list_transform(range(1, len(u) + 1), lambda i: CASE WHEN by_words THEN array_to_string(list_concat(u[1:i - 1], u[i + 1:]), ' ') ELSE array_to_string(list_concat(u[1:i - 1], u[i + 1:]), '') END)) AS variant FROM u),
near AS (SELECT spot FROM v QUALIFY min(spot) OVER (PARTITION BY by_words, pos, variant) < spot
UNION SELECT greatest(v.spot, u.spot) FROM v JOIN u ON u.line = v.variant AND u.by_words = v.by_words AND u.spot <> v.spot),
told AS (SELECT c.doc_id, c.no, c.raw, c.line <> '' AND (c.spot <> d.spot OR near.spot IS NOT NULL) AS gone FROM c LEFT JOIN d ON d.line = c.line LEFT JOIN near ON near.spot = d.spot),
k AS (SELECT doc_id, bool_or(gone) AS cut, coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (WHERE NOT coalesce(gone, false)), '') AS text FROM told GROUP BY doc_id),
t AS (SELECT doc_id, CASE WHEN k.cut THEN k.text ELSE documents.text END AS text, coalesce(k.cut, false) AS cut FROM documents LEFT JOIN k USING (doc_id))
SELECT doc_id, length(text) AS n_chars_kept, sha256(text) AS text_sha256 FROM t WHERE NOT cut OR regexp_matches(text, '[^\x20\x09-\x0D]')"""


#: Every pair of documents that share a shingle is counted out; links are followed to their ends.
GROUPS = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, lower({UPPER})), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m, any_value(a.n + b.n) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT u, v FROM p WHERE 100 * m >= 80 * (n - m) UNION SELECT v, u FROM p WHERE 100 * m >= 80 * (n - m)),
r AS (SELECT u AS a, v AS b FROM l UNION SELECT r.a, l.v FROM r JOIN l ON l.u = r.b),
c AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, least(doc_id, coalesce(low, doc_id)) = doc_id AS kept FROM s LEFT JOIN c USING (doc_id)"""


#: Sources that stay under their ceiling share what the others leave; so often as there are sources.
TARGETS = rf"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
r AS (SELECT 0 AS i, source, source_size, weight, false AS capped FROM s
UNION ALL SELECT i + 1, source, source_size, weight, capped OR weight * (sum(source_size) OVER () - 3 * coalesce(sum(source_size) FILTER (WHERE capped) OVER (), 0)) > 3 * source_size * (sum(weight) FILTER (WHERE NOT capped) OVER ()) FROM r WHERE i <= (SELECT count(*) FROM s)),
f AS (SELECT * FROM r WHERE i = (SELECT max(i) FROM r)),
t AS (SELECT source, source_size, CASE WHEN capped THEN 3 * source_size ELSE weight * (sum(source_size) OVER () - 3 * coalesce(sum(source_size) FILTER (WHERE capped) OVER (), 0)) / sum(weight) FILTER (WHERE NOT capped) OVER () END AS target FROM f)
SELECT doc_id, size, source_size::BIGINT AS source_size, round(target, 3) AS target FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source"""


def quality_sql() -> str:
    """Limits from sorted lists in place of sketches: the same as long as no group outgrows the sketch's exact part."""
    per = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END"
    parts = {"symbol_rate": ("n_symbols", "word_chars"), "dup_line_rate": ("n_dup_lines", "n_lines"), "repeat_rate": ("n_repeat_words", "n_words"), "shout_rate": ("n_shouting", "word_chars"), "stutter_rate": ("n_stutter", "n_words"), "word_length": ("word_chars", "n_words")}
    at = lambda k, q: f"list_sort(list({k}))[greatest(ceil({q} * count(*)), 1)::INT]"
    read = ", ".join(f"{at(k, r['tail'])} AS {k}_0, {at(k, 0.5)} AS {k}_1, {at(k, 1 - r['tail'])} AS {k}_2" for k, r in RATES.items())
    shrunk = lambda n, own, rest: f"(({n} * {own} + {SHRINK} * {rest}) / ({n} + {SHRINK}))"
    value = lambda k, i: shrunk("g.n", f"g.{k}_{i}", shrunk("l.n", f"l.{k}_{i}", f"a.{k}_{i}"))
    limits = ", ".join(f"{value(k, 2)} + {r['fence']} * ({value(k, 2)} - {value(k, 1)}) AS hi_{k}" for k, r in RATES.items())
    low = f"{value(TWO_SIDED, 0)} - {RATES[TWO_SIDED]['fence']} * ({value(TWO_SIDED, 1)} - {value(TWO_SIDED, 0)}) AS lo_{TWO_SIDED}"
    odd = []
    for k in RATES:
        size = f"greatest({parts[k][1]}, 1)::DOUBLE"
        if k == TWO_SIDED:
            odd.append(f"{k} > hi_{k} + {DEVIATIONS} * hi_{k} / (2 * sqrt({size})) OR {k} < lo_{k} - {DEVIATIONS} * greatest(lo_{k}, 1.0) / (2 * sqrt({size}))")
        else:
            odd.append(f"{k} > hi_{k} + {DEVIATIONS} * sqrt(hi_{k} / {size}) + {EVENTS} / {size}")
    failed = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"
    return rf"""WITH t AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
x AS (SELECT id, unnest(range(1, len(w) - 6)) AS pos, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM t WHERE len(w) >= 8),
y AS (SELECT id, pos FROM x QUALIFY count(*) OVER (PARTITION BY id, g) > 1),
z AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(pos, pos + 8)) AS p FROM y) GROUP BY id),
o AS (SELECT id, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines FROM t),
c AS (SELECT id, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, CASE WHEN len(w) > 0 THEN length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) ELSE 0 END AS n_symbols,
len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(z.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_shouting,
len(list_filter(w, lambda s, i: i > 1 AND s = w[i - 1])) AS n_stutter FROM t JOIN o USING (id) LEFT JOIN z USING (id)),
v AS (SELECT *, {', '.join(f'{per(*p)} AS {k}' for k, p in parts.items())} FROM c),
g AS (SELECT lang, source, count(*) AS n, {read} FROM v WHERE n_words > 0 GROUP BY lang, source),
l AS (SELECT lang, count(*) AS n, {read} FROM v WHERE n_words > 0 GROUP BY lang),
a AS (SELECT {read} FROM v WHERE n_words > 0),
m AS (SELECT g.lang AS m_lang, g.source AS m_source, {limits}, {low} FROM g JOIN l ON l.lang IS NOT DISTINCT FROM g.lang CROSS JOIN a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT {failed} AND NOT coalesce({' OR '.join(odd)}, false) AS kept
FROM v LEFT JOIN m ON m_lang IS NOT DISTINCT FROM lang AND m_source IS NOT DISTINCT FROM source"""


#: CRC-32 by its bits: a byte comes in, eight shifts follow.
CRC = "xor(list_reduce(flatten(list_transform(string_split({0}::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, 4294967295::BIGINT), 4294967295::BIGINT)"

#: Every prefix of every conversation is a row; each node adds to all that are above it.
TRIE = rf"""WITH RECURSIVE t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, {CRC.format('conv_id')} % 4 AS h FROM t),
m AS (SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = base AND pos < h UNION ALL SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, sha256(role) || sha256(text) AS turn, len(regexp_extract_all(text, '{WORD}')) AS words FROM m),
p AS (SELECT conv_id, 0::BIGINT AS depth, '' AS key, NULL::VARCHAR AS above, 0::BIGINT AS words FROM c UNION ALL SELECT p.conv_id, o.depth, sha256(key || turn), key, o.words FROM p JOIN o ON o.conv_id = p.conv_id AND o.depth = p.depth + 1),
l AS (SELECT conv_id, max(depth) AS len FROM p GROUP BY conv_id),
n AS (SELECT key, any_value(depth) AS depth, any_value(above) AS above, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len = depth), '')) AS ends_sha256 FROM p JOIN l USING (conv_id) GROUP BY key),
k AS (SELECT above AS key, count(*) AS n_children FROM n WHERE above IS NOT NULL GROUP BY above),
s AS (SELECT p.key, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n_convs - 1) * n.words) AS saved FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN k ON k.key = n.key GROUP BY p.key)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n u ON u.key = n.above LEFT JOIN k ON k.key = n.key JOIN s ON s.key = n.key"""
