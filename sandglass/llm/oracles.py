"""DuckDB SQL for the operators that SQL can express. Written from the contracts, apart from the Spark code."""

from __future__ import annotations

from .quality import PHRASES

WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

QUALITY = (
    r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, text, """
    + WORDS.format("text")
    + r""" AS words FROM d),
windows AS (
  SELECT row, i, array_to_string(words[i:i + 7], ' ') AS run
  FROM (SELECT row, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT row, run FROM windows GROUP BY row, run HAVING count(*) > 1),
hit AS (SELECT row, count(DISTINCT j) AS n FROM (
  SELECT row, unnest(range(i, i + 8)) AS j FROM windows JOIN twice USING (row, run)) GROUP BY row),
lines AS (
  SELECT row, line, pos, len(own) AS n_own, own FROM (
    SELECT row, line, pos, """
    + WORDS.format("line")
    + r""" AS own FROM (
      SELECT row, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d))),
dup AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM lines WHERE n_own > 0 GROUP BY row),
shaped AS (
  SELECT *, count(*) OVER (PARTITION BY row, line) AS times, regexp_replace(line, '^[ \t-\r|<>»•·]+', '') AS rest,
    list_filter(own, lambda x: NOT regexp_full_match(x, '[|<>»•·]+')) AS plain FROM lines),
closing AS (
  SELECT *, n_own > 0 AND contains('.!?…:;"'')]»”’。！？', right(own[-1], 1)) AS closed FROM shaped),
menus AS (
  SELECT *, 2 * count(*) FILTER (closed) OVER (PARTITION BY row) >= count(*) FILTER (n_own > 0) OVER (PARTITION BY row) AS closes, length(rest) - length(translate(rest, '|•·', '')) + CASE WHEN contains(line, '«') THEN 0
    ELSE len(list_filter(regexp_extract_all(rest, '[^\x20\x09-\x0D]+'), lambda x: regexp_full_match(x, '[<>»]+'))) END AS apart FROM closing),
judged AS (
  SELECT row, CASE
    WHEN n_own > 0 AND apart > 0 AND len(plain) <= 2 * (apart + 1) THEN 'navigation'
    WHEN n_own >= 4 AND length(line) - length(translate(line, '#*$%&|<>', '')) >= n_own THEN 'punctuation'
    WHEN n_own >= 4 AND 2 * len(list_filter(own, lambda x: x LIKE '%!!' OR x LIKE '%??')) >= n_own THEN 'punctuation'
    WHEN closes AND n_own >= 10 AND NOT closed THEN 'punctuation'
    WHEN n_own BETWEEN 2 AND 12 AND times >= 4 THEN 'boilerplate'
    WHEN n_own BETWEEN 1 AND 12 AND regexp_matches(lower(line), '\b("""
    + "|".join(p.replace("'", "''") for p in PHRASES)
    + r""")([^a-z0-9_]|$)') THEN 'boilerplate'
    END AS rule,
    coalesce(list_sum(list_transform(own, lambda x: length(x))), 0) AS chars
  FROM menus),
lost AS (
  SELECT row, count(rule) AS n, coalesce(sum(chars) FILTER (rule IS NOT NULL), 0)::BIGINT AS chars, count(*) FILTER (rule = 'punctuation') AS punctuation_lines,
    count(*) FILTER (rule = 'navigation') AS navigation_lines, count(*) FILTER (rule = 'boilerplate') AS boilerplate_lines FROM judged GROUP BY row),
base AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(hit.n, 0)::BIGINT AS n_repeat_words, lost.n::BIGINT AS lines_removed, lost.chars AS chars_removed,
    punctuation_lines, navigation_lines, boilerplate_lines
  FROM w LEFT JOIN dup USING (row) LEFT JOIN hit USING (row) LEFT JOIN lost USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND chars_removed <= 0.5 * word_chars AS kept,
  lines_removed, chars_removed, punctuation_lines, navigation_lines, boilerplate_lines
FROM base
"""
)

MIX = (
    r"""
WITH d AS (SELECT doc_id, source, text, len("""
    + WORDS.format("text")
    + r""")::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
o AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS w, 2 * n AS cap, sum(n) OVER () AS total FROM s),
r AS (
  SELECT *, row_number() OVER k AS pos,
    coalesce(sum(cap) OVER (k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
    sum(w) OVER (k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM o WINDOW k AS (ORDER BY cap / w, source ASC NULLS LAST)),
e AS (SELECT *, (3 * total - 2 * spent)::BIGINT AS rest FROM r),
f AS (SELECT min(pos) AS pos FROM e WHERE cap * 2 * w_left > w * rest),
t AS (
  SELECT e.source, e.n, CASE WHEN f.pos IS NULL OR e.pos < f.pos THEN e.cap::DOUBLE
    ELSE (e.w * x.rest)::DOUBLE / (x.w_left * 2)::DOUBLE END AS target
  FROM e CROSS JOIN f LEFT JOIN e AS x ON x.pos = f.pos),
q AS (
  SELECT d.*, t.n AS source_size, t.target, CASE WHEN t.n > 0 THEN t.target / t.n::DOUBLE ELSE 0.0 END AS rate,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 8))::BIGINT AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN draw < floor((rate - floor(rate)) * 4294967296.0) THEN 1 ELSE 0 END))::BIGINT AS taken,
  (floor(rate) + CASE WHEN draw < floor((rate - floor(rate)) * 4294967296.0) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM q
"""
)

EXACT = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g USING (text)
"""

#: Every repeated run of every length, grown line by line; not the windows and ranks of the Spark code.
LINES = (
    r"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS row, doc_id, text FROM documents),
l AS (
  SELECT row, pos, line, len("""
    + WORDS.format("line")
    + r""") AS words
  FROM (SELECT row, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d)),
runs AS (
  SELECT row, pos, 1::BIGINT AS len, md5(line) AS run FROM l QUALIFY count(*) OVER (PARTITION BY line) > 1
  UNION ALL
  SELECT * FROM (SELECT r.row, r.pos, r.len + 1 AS len, md5(r.run || md5(l.line)) AS run FROM runs r JOIN l ON l.row = r.row AND l.pos = r.pos + r.len)
  QUALIFY count(*) OVER (PARTITION BY run) > 1),
counted AS (SELECT r.* FROM runs r JOIN l USING (row, pos) WHERE (r.len >= 2 AND l.words > 0) OR (r.len = 1 AND l.words >= 50)),
placed AS (
  SELECT *, first_value(row) OVER w AS first_row, first_value(pos) OVER w AS first_pos FROM counted
  WINDOW w AS (PARTITION BY len, run ORDER BY row, pos)),
gone AS (
  SELECT DISTINCT row, spot FROM (SELECT *, unnest(range(pos, pos + len)) AS spot FROM placed WHERE row <> first_row OR pos <> first_pos)
  WHERE row <> first_row OR spot >= first_pos + len),
parts AS (SELECT row, min(spot) AS a, max(spot) AS b FROM (
  SELECT row, spot, spot - row_number() OVER (PARTITION BY row ORDER BY spot) AS part FROM gone) GROUP BY row, part),
shown AS (SELECT row, sum(b - a + 1) AS n, string_agg(a || '-' || b, ',' ORDER BY a) AS removed FROM parts GROUP BY row)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed
FROM d LEFT JOIN shown USING (row)
"""
)

#: kind, pattern, group that counts, least length: the contract's three, then the operator's own.
_KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}", 0, 1),
)


def _secrets() -> str:
    parts = []
    for turn, (kind, pattern, group, least) in enumerate(_KINDS):
        parts.append(
            f"""SELECT row, '{kind}' AS kind, {turn} AS turn, hits, shown, gaps FROM (
  SELECT row, regexp_extract_all(text, '{pattern}', 0) AS hits,
    list_transform(regexp_extract_all(text, '{pattern}', {group}), lambda x: length(x) >= {least}) AS shown,
    regexp_split_to_array(text, '{pattern}') AS gaps FROM d) WHERE len(hits) > 0"""
        )
    return (
        "WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),\nfound AS ("
        + "\nUNION ALL ".join(parts)
        + """),
each AS (SELECT row, kind, turn, hits, shown, gaps, unnest(range(1, len(hits) + 1)) AS i FROM found),
placed AS (
  SELECT row, kind, turn, shown[i] AS good, length(hits[i]) AS n,
    coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS a
  FROM each),
spans AS (SELECT row, kind, turn, a::BIGINT AS a, (a + n)::BIGINT AS b, kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT AS s FROM placed WHERE good),
told AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(s, ',' ORDER BY a, turn) FILTER (turn < 3) AS base, string_agg(s, ',' ORDER BY a, turn) AS spans
  FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (row)"""
    )


NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, id, score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n USING (anchor_id)
WHERE NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3"""

CHATS = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, len(regexp_extract_all(text, '[\[<]\\*(/?INST\]|ROLE:[0-9A-F]*\]|/ROLE\]|</?SYS>>|/?s>)')) AS marks,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 14 + 2 * octet_length(role::BLOB) END AS template FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + template + marks)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id"""


ORACLES = {
    "op1_quality_rules": QUALITY,
    "op4_mix_sources": MIX,
    "op7_exact_dedup": EXACT,
    "op9_line_dedup": LINES,
    "op10_secret_scan": _secrets(),
    "op12_hard_negatives": NEGATIVES,
    "op13_chat_format": CHATS,
}
