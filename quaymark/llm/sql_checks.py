"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from . import decontamination, license_scans, quality_rules
from .common import LOWER, UPPER

#: As URL_RULES in queries.py.
OP10 = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
s AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
f AS (SELECT *, host = 'org' OR ends_with(host, '.org') AS org, host = 'com' OR ends_with(host, '.com') AS com,
             host = 'example.org' OR ends_with(host, '.example.org') AS ex FROM s),
v AS (SELECT page_id, host, path,
             CASE WHEN ex AND starts_with(path, '/es/') THEN 'example.org/es/'
                  WHEN ex AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                  WHEN org AND starts_with(path, '/') THEN 'org/'
                  WHEN com AND starts_with(path, '/fr/') THEN 'com/fr/'
                  WHEN com AND starts_with(path, '/de/') THEN 'com/de/' END AS rule FROM f)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM v
"""


def _op5() -> str:
    q = quality_rules
    k = q.WINDOW_WORDS
    integer = lambda sql: sql.replace(" div ", " // ")
    each = " UNION ALL ".join(f"SELECT rid, lang, source, '{name}' AS metric, {integer(sql)} AS value, {least} AS least FROM c WHERE NOT base_failed" for name, sql, least in q.METRICS)

    def fences(by: str) -> str:
        cols, over = (f"{by}, ", f"{by}, metric") if by else ("", "metric")
        return f"""SELECT {cols}metric, max(total) AS n,
            min(v) FILTER (WHERE upto >= ceil(total * 0.75)) + {q.FENCE} * greatest(min(v) FILTER (WHERE upto >= ceil(total * 0.75)) - min(v) FILTER (WHERE upto >= ceil(total * 0.5)), max(least)) AS fence
        FROM (SELECT {cols}metric, least, CASE WHEN bucket = 0 THEN 0.0 ELSE pow({q.GAMMA}, bucket) END AS v,
                     sum(n) OVER (PARTITION BY {over} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {over}) AS total
              FROM (SELECT {cols}metric, bucket, max(least) AS least, count(*) AS n FROM b GROUP BY {cols}metric, bucket)) GROUP BY {cols}metric"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT rid, unnest(range(1, len(ws) - {k - 2})) AS i, ws FROM w WHERE len(ws) > {k}),
g AS (SELECT rid, i, list_slice(ws, i, i + {k - 1}) AS x FROM win),
often AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS n FROM g) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM often, range(0, {k}) AS r(j) GROUP BY rid),
c0 AS (SELECT w.rid, doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
              length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
              coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper
       FROM w LEFT JOIN rep USING (rid)),
c AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c0),
m AS ({each}),
b AS (SELECT *, CASE WHEN value <= 0 THEN 0 ELSE CAST(ceil(ln(CAST(value AS DOUBLE)) / ln(CAST({q.GAMMA} AS DOUBLE))) AS INT) END AS bucket FROM m),
own AS ({fences("lang, source")}),
lng AS ({fences("lang")}),
al AS ({fences("")}),
f AS (SELECT own.lang, own.source, own.metric,
             CASE WHEN own.n >= {q.MIN_GROUP} THEN own.fence WHEN lng.n >= {q.MIN_GROUP} THEN lng.fence ELSE al.fence END AS fence
      FROM own LEFT JOIN lng ON own.metric = lng.metric AND own.lang IS NOT DISTINCT FROM lng.lang LEFT JOIN al ON own.metric = al.metric),
bad AS (SELECT DISTINCT rid FROM m JOIN f ON m.metric = f.metric AND m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source WHERE m.value > f.fence)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.rid IS NULL AS kept
FROM c LEFT JOIN bad USING (rid)
"""


OP5 = _op5()


def _op6() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    rows = license_scans.built_in()
    known = ", ".join(f"({text(a)}, {text(b)})" for a, b in rows)

    def lines(column: str) -> str:
        out = f"regexp_replace(lower({column}), '(^|\\n)[^\\pL\\pN\\n]*(copyright[ :]*(\\(c\\)|©|[0-9])|\\(c\\)|©|all rights reserved)[^\\n]*', '\\1', 'g')"
        out = f"regexp_replace({out}, '[^\\pL\\pN\\n]+', ' ', 'g')"
        for seen, meant in license_scans.SPELLINGS:
            out = f"replace({out}, '{seen}', '{meant}')"
        return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"

    return f"""
WITH k AS (SELECT sha256(array_to_string(l, ' ')) AS digest, min(license) AS license
           FROM (SELECT license, {lines("t")} AS l FROM (VALUES {known}) AS v(license, t)) WHERE len(l) > 0 GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, {lines("coalesce(text, '')")} AS l FROM documents),
w AS (SELECT rid, doc_id, l, len(l) AS n_lines, CASE WHEN len(l) > 0 THEN sha256(array_to_string(l, ' ')) END AS text_sha256 FROM d),
h AS (SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT rid, sha256(unnest(l)) AS digest FROM w) JOIN k USING (digest) GROUP BY rid)
SELECT doc_id, n_lines, text_sha256, k.license, coalesce(h.notices, '') AS notices
FROM w LEFT JOIN k ON k.digest = text_sha256 LEFT JOIN h USING (rid)
"""


OP6 = _op6()

_WORDS = "list_filter(string_split_regex(translate(coalesce({t}, ''), '" + UPPER + "', '" + LOWER + "'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_K = decontamination.WINDOW_WORDS
OP7 = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(t="text")} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, list_slice(ws, s, s + {_K} - 1) AS x FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - {_K - 1}, 1) + 1)) AS s FROM i WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format(t="text")} AS ws FROM documents),
sizes AS (SELECT DISTINCT len(x) AS n FROM win),
p AS (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, sizes WHERE len(ws) >= n),
hit AS (SELECT rid, s, n, item FROM (SELECT rid, s, n, list_slice(ws, s, s + n - 1) AS x FROM p) JOIN win USING (x)),
c AS (SELECT rid, count(DISTINCT w) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS w FROM hit) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""

_TOKENS = "list_filter(string_split_regex(translate(coalesce({t}, ''), '" + UPPER + "', '" + LOWER + "'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_TOKENS.format(t="text")} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(ws, s, s + 3), ' ')) AS x
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS s FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (x) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""


#: 2,000 phrases of each language by the score of their worst cut.
OP11 = f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS rid, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
c AS (SELECT lang, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase, k, count(*) AS n FROM i, range(1, 6) AS r(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
f AS (SELECT * FROM c WHERE n >= 100),
total AS (SELECT lang, sum(n) AS n FROM c WHERE k = 1 GROUP BY lang),
cut AS (SELECT f.lang, f.phrase, f.n AS a, cuts.k AS cut, l.n AS l, r.n AS r, total.n AS n,
               (1000::HUGEINT * f.n * total.n) // (l.n::HUGEINT * r.n) AS score
        FROM f JOIN range(1, 5) AS cuts(k) ON cuts.k < f.k
        JOIN f AS l ON l.lang = f.lang AND l.phrase = array_to_string(list_slice(string_split(f.phrase, ' '), 1, cuts.k), ' ')
        JOIN f AS r ON r.lang = f.lang AND r.phrase = array_to_string(list_slice(string_split(f.phrase, ' '), cuts.k + 1, f.k), ' ')
        JOIN total ON total.lang = f.lang WHERE f.k > 1),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
gone AS (SELECT DISTINCT s.lang, s.phrase FROM f AS s JOIN f AS b ON s.lang = b.lang AND b.k > s.k AND s.k > 1 AND 100 * b.n >= 100 * s.n AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')),
kept AS (SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.lang = best.lang AND gone.phrase = best.phrase))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""

OP13 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_TOKENS.format(t="text")} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(ws, s, s + 3), ' ')) AS x
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS s FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (x) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""

#: CRC-32 is computed byte by byte and bit by bit.
OP12 = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS bytes FROM t),
h AS (SELECT conv_id, base, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
             lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295) % 4 AS h FROM c),
r AS (SELECT h.conv_id, t.pos, t.role, t.text FROM h JOIN t ON t.conv_id = h.base AND t.pos <= h.h
      UNION ALL SELECT h.conv_id, t.pos, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id AND t.pos > h.h),
s AS (SELECT h.conv_id, coalesce(list({'role': r.role, 'text': r.text} ORDER BY r.pos) FILTER (WHERE r.pos IS NOT NULL), []) AS turns FROM h LEFT JOIN r ON r.conv_id = h.conv_id GROUP BY h.conv_id),
n AS (SELECT list_slice(turns, 1, d) AS p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(turns) = d), '')) AS ends_sha256
      FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM s) GROUP BY 1, 2),
k AS (SELECT list_slice(p, 1, depth - 1) AS p, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children,
             CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(list_filter(string_split_regex(n.p[depth].text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) END AS saved FROM n LEFT JOIN k ON k.p = n.p),
u AS (SELECT list_slice(p, 1, d) AS p, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT p, saved, n_children, unnest(range(0, depth + 1)) AS d FROM m) GROUP BY 1)
SELECT m.conv_id, m.depth::BIGINT AS depth, parent.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children, u.n_leaves::BIGINT AS n_leaves,
       u.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN u ON u.p = m.p LEFT JOIN m AS parent ON m.depth > 0 AND parent.p = list_slice(m.p, 1, m.depth - 1)
"""
