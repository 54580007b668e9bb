"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

from wattline.llm import mixing, quality

WORD = r"[^\x20\x09-\x0D]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = f"""
WITH x AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM x WHERE len(ws) >= 13)),
f AS (SELECT k, min(doc_id) AS d FROM p GROUP BY k),
c AS (SELECT DISTINCT doc_id, i + j AS pos FROM p JOIN f USING (k), range(13) r(j) WHERE f.d < doc_id),
u AS (SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM x),
kept AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.pos) AS t, count(*) AS n FROM u ANTI JOIN c ON u.doc_id = c.doc_id AND u.pos = c.pos GROUP BY 1)
SELECT x.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM x LEFT JOIN kept USING (doc_id)
"""

OP2 = """
WITH x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM x WHERE n >= 100)),
f AS (SELECT k, min((doc_id, i)) AS first FROM p GROUP BY k),
g AS (SELECT doc_id, i FROM p JOIN f USING (k) WHERE (doc_id, i) > first),
r AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g),
q AS (SELECT *, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM r),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM q GROUP BY 1, 2),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM s),
parts AS (SELECT gaps.doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head, max(b) AS tail, sum(b - a) AS n_removed, count(*) AS n_spans FROM gaps JOIN x USING (doc_id) GROUP BY 1)
SELECT x.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256 FROM x LEFT JOIN parts USING (doc_id)
"""

OP4 = f"""
WITH RECURSIVE x AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, array_to_string(ws[i:i + 2], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM x WHERE len(ws) >= 3) UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM x WHERE len(ws) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
sized AS (SELECT s.doc_id, k, n FROM s JOIN n USING (doc_id)),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c FROM sized a JOIN sized b ON a.k = b.k AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
link AS (SELECT x, y FROM common WHERE 100 * c >= 85 * (nx + ny - c)),
both_ways AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(node, low) AS (SELECT x, x FROM both_ways UNION SELECT b.y, r.low FROM reach r JOIN both_ways b ON b.x = r.node),
lowest AS (SELECT node, min(low) AS component FROM reach GROUP BY 1)
SELECT x.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, x.doc_id) AS component_id, coalesce(component, x.doc_id) = x.doc_id AS kept FROM x LEFT JOIN n USING (doc_id) LEFT JOIN lowest ON node = x.doc_id
"""


def op7() -> str:
    how = mixing.PRODUCTION
    weights, share, cap = list(how["weight_cycle"]), how["share"], how["max_repeat"]
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY 1),
w AS (SELECT source, s, {weights}[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} AS INT) + 1] AS w FROM s),
o AS (SELECT *, {cap}.0 * s / w AS level, {share} * sum(s) OVER () - sum({cap} * s) OVER (ORDER BY {cap}.0 * s / w, source NULLS LAST) AS rest, sum(w) OVER () - sum(w) OVER (ORDER BY {cap}.0 * s / w, source NULLS LAST) AS open FROM w),
z AS (SELECT *, coalesce(lag(rest) OVER (ORDER BY level, source NULLS LAST), {share} * sum(s) OVER ()) AS rest_before, coalesce(lag(open) OVER (ORDER BY level, source NULLS LAST), sum(w) OVER ()) AS open_before FROM o),
cut AS (SELECT first(rest_before ORDER BY level, source NULLS LAST) AS rest, first(open_before ORDER BY level, source NULLS LAST) AS open, first(level ORDER BY level, source NULLS LAST) AS level FROM z WHERE rest_before * w / open_before <= {cap} * s AND s > 0),
t AS (SELECT z.source, z.s, CASE WHEN z.level < cut.level OR z.s = 0 THEN CAST({cap} * z.s AS DOUBLE) ELSE CAST(cut.rest * z.w / cut.open AS DOUBLE) END AS target FROM z, cut),
r AS (SELECT *, CAST(round_even(target, 0) AS BIGINT) AS routed FROM t),
k AS (SELECT *, CASE WHEN s > 0 THEN routed // s ELSE 0 END AS whole FROM r),
m AS (SELECT d.doc_id, d.size, k.s, k.target, k.whole, k.routed - k.whole * k.s AS extra, sum(size) OVER (PARTITION BY d.source ORDER BY substr(md5('{how["seed"]}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 16), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS run FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source),
c AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN extra > 0 AND 2 * run - size <= 2 * extra THEN 1 ELSE 0 END END AS copies FROM m)
SELECT doc_id, size, s AS source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM c
"""


def op9() -> str:
    x = quality.Limits()
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
tri AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(3) r(j) GROUP BY 1),
ln AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{WORD}')),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM ln GROUP BY 1),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(t, '[^a-z]', '', 'g')) AS low, length(regexp_replace(t, '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]', '', 'g')) AS letters
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
b AS (SELECT *, n_words < {x.min_words} OR 100 * n_repeat_words > {x.max_repeat_percent} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > {x.max_symbols_per_100_words} * n_words OR word_chars < {x.min_mean_word} * n_words OR word_chars > {x.max_mean_word} * n_words
    OR (n_dup_lines >= {x.min_dup_lines} AND 100 * n_dup_lines > {x.max_dup_line_percent} * n_lines) OR 100 * up > {x.max_upper_percent} * (up + low) OR 100 * letters < {x.min_letter_percent} * word_chars) AS kept
FROM b
"""
