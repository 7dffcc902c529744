"""SQL equivalents of the native queries, from the same parameters."""

from __future__ import annotations

from quarrylens.llm import quality, urllists

_HOST = f"nullif(rtrim(lower(regexp_extract(url, '{urllists.HOST}', 1)), '.'), '')"

URL_LISTS = f"""
WITH p AS (SELECT page_id, url, {_HOST} AS host, DATE '2024-01-01' + CAST((page_id * 101 + 17) % 400 AS INTEGER) AS fetched, regexp_replace(url, '#.*$', '') AS plain FROM pages),
s AS (SELECT *, string_split(host, '.') AS l FROM p),
e AS (SELECT CASE page_id % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'host' ELSE 'domain' END AS kind,
  CASE page_id % 3 WHEN 0 THEN plain WHEN 1 THEN host ELSE CASE WHEN len(l) >= 2 THEN l[len(l) - 1] || '.' || l[len(l)] END END AS pattern,
  DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS day, (page_id * 13) % 7 < 4 AS added FROM s),
d AS (SELECT kind, pattern, day, bool_and(added) AS added FROM e WHERE pattern IS NOT NULL GROUP BY kind, pattern, day),
v AS (SELECT kind, pattern, added, day AS began, lead(day) OVER (PARTITION BY kind, pattern ORDER BY day) AS ended FROM d),
n AS (SELECT page_id, fetched, l, unnest(range(1, len(l))) AS i FROM s WHERE len(l) >= 2),
k AS (SELECT page_id, fetched, 'url' AS kind, plain AS pattern FROM s UNION ALL SELECT page_id, fetched, 'host', host FROM s
  UNION ALL SELECT page_id, fetched, 'domain', array_to_string(l[i:len(l)], '.') FROM n),
m AS (SELECT k.page_id AS page_id, k.kind AS kind FROM k JOIN v ON k.kind = v.kind AND k.pattern = v.pattern AND v.added AND k.fetched >= v.began AND (v.ended IS NULL OR k.fetched < v.ended)),
a AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM m GROUP BY page_id)
SELECT s.page_id AS page_id, s.host AS host, s.fetched AS fetched, coalesce(a.n, 0) AS n_active, coalesce(a.kinds, '') AS kinds, a.n IS NOT NULL AS blocked FROM s LEFT JOIN a ON s.page_id = a.page_id
"""


def _js(a: str, b: str) -> str:
    half = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0.0 END"
    return f"sqrt(greatest(sum({half(a, b)} + {half(b, a)}) / 2, 0.0))"


_WORDS = ", ".join(f"('{lang}', {i}, '{w}')" for lang, ws in quality.COMMON.items() for i, w in enumerate(ws))
_ONLY = lambda chars: f"length(regexp_replace(t, '[^{chars}]+', '', 'g'))"

QUALITY = rf"""
WITH x AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, list_filter(string_split_regex(t, '{quality.SPACE}'), lambda s: s <> '') AS ws FROM x),
g AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 5], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT g.doc_id AS doc_id, g.i AS i, unnest([0, 1, 2, 3, 4]) AS j FROM g JOIN r ON g.doc_id = r.doc_id AND g.g = r.g) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM x) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (SELECT w.doc_id AS doc_id, lang, t, ws, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, {_ONLY("#*$%&|<>")} AS n_symbols, coalesce(ln.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  length(t) AS n_chars, {_ONLY(chr(92) + "p{Lu}")} AS up, {_ONLY("0-9")} AS dg, {_ONLY(".,;:!?''" + chr(34) + "()" + chr(92) + "-")} AS pu,
  length(regexp_replace(t, '[\p{{L}}\x20\x09-\x0D#*$%&|<>0-9.,;:!?''"()\-]+', '', 'g')) AS ot FROM w LEFT JOIN ln ON w.doc_id = ln.doc_id LEFT JOIN c ON w.doc_id = c.doc_id),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed, n_chars - up - dg - pu - n_symbols - ot - (n_chars - word_chars) AS lo FROM b),
h AS (SELECT doc_id, lang, base_failed, unnest([0, 1, 2, 3, 4, 5, 6]) AS bin, unnest([n_chars - word_chars, lo, up, dg, pu, n_symbols, ot]) AS n FROM f),
words(lang, bin, word) AS (VALUES {_WORDS}),
tw AS (SELECT u.doc_id AS doc_id, words.bin AS bin, count(*) AS n FROM (SELECT doc_id, lang, unnest(ws) AS word FROM w) u JOIN words ON u.lang = words.lang AND u.word = words.word GROUP BY 1, 2),
tr AS (SELECT f.doc_id AS doc_id, 99 AS bin, f.n_words - coalesce(sum(tw.n), 0) AS n FROM f LEFT JOIN tw ON f.doc_id = tw.doc_id GROUP BY f.doc_id, f.n_words),
q AS (SELECT f.doc_id AS doc_id, f.lang AS lang, f.base_failed AS base_failed, a.bin AS bin, a.n AS n FROM f JOIN (SELECT doc_id, bin, n FROM tw UNION ALL SELECT doc_id, bin, n FROM tr) a ON f.doc_id = a.doc_id WHERE f.lang IN ('en', 'fr', 'de', 'es')),
hs AS (SELECT lang, bin, CAST(sum(n) AS DOUBLE) AS n FROM h WHERE lang IN ('en', 'fr', 'de', 'es') AND NOT base_failed GROUP BY lang, bin),
hr AS (SELECT lang, bin, n / sum(n) OVER (PARTITION BY lang) AS q FROM hs),
qs AS (SELECT lang, bin, CAST(sum(n) AS DOUBLE) AS n FROM q WHERE NOT base_failed GROUP BY lang, bin),
qr AS (SELECT lang, bin, n / sum(n) OVER (PARTITION BY lang) AS q FROM qs),
hd AS (SELECT h.doc_id AS doc_id, {_js("(h.n / greatest(1.0, f.n_chars))", "hr.q")} AS d FROM h JOIN f ON h.doc_id = f.doc_id JOIN hr ON h.lang = hr.lang AND h.bin = hr.bin GROUP BY h.doc_id),
qd AS (SELECT f.doc_id AS doc_id, {_js("(coalesce(q.n, 0) / greatest(1.0, f.n_words))", "qr.q")} AS d FROM f JOIN qr ON f.lang = qr.lang LEFT JOIN q ON q.doc_id = f.doc_id AND q.bin = qr.bin GROUP BY f.doc_id)
SELECT f.doc_id AS doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT ((n_words >= {quality.MIN_WORDS_FOR_CLASSES} AND coalesce(hd.d, 0.0) > {quality.MAX_CLASS_DISTANCE}) OR (n_words >= {quality.MIN_WORDS_FOR_WORDS} AND coalesce(qd.d, 0.0) > {quality.MAX_WORD_DISTANCE})) AS kept
FROM f LEFT JOIN hd ON f.doc_id = hd.doc_id LEFT JOIN qd ON f.doc_id = qd.doc_id
"""

EXACT = r"""
WITH x AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM x GROUP BY t)
SELECT x.doc_id AS doc_id, g.keep_id AS keep_id, g.group_size AS group_size, x.doc_id = g.keep_id AS kept, sha256(x.t) AS text_sha256 FROM x JOIN g ON x.t = g.t
"""


def _centroids(k: int, rounds: int, dim: int) -> str:
    assigned = lambda r: (
        f"d{r} AS (SELECT x.n AS n, c.k AS k, CAST(sum((x.x - c.x) * (x.x - c.x)) AS BIGINT) AS d FROM x JOIN c{r} c ON x.i = c.i GROUP BY x.n, c.k),\n"
        f"a{r} AS MATERIALIZED (SELECT n, k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, k) = 1)"
    )
    # A quotient rounded down, whatever the sign of the sum.
    moved = lambda r: f"c{r + 1} AS MATERIALIZED (SELECT c.k AS k, c.i AS i, coalesce(CAST((m.s - ((m.s % m.m) + m.m) % m.m) // m.m AS BIGINT), c.x) AS x FROM c{r} c LEFT JOIN (SELECT a.k AS k, x.i AS i, CAST(sum(x.x) AS BIGINT) AS s, count(*) AS m FROM a{r} a JOIN x ON a.n = x.n GROUP BY 1, 2) m ON c.k = m.k AND c.i = m.i)"
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS n, embedding AS e FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
x AS MATERIALIZED (SELECT n, unnest(range({dim})) AS i, unnest(list_transform(e, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT))) AS x FROM v),
f AS (SELECT n, row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS k FROM v QUALIFY k < {k}),
c0 AS MATERIALIZED (SELECT f.k AS k, x.i AS i, x.x AS x FROM f JOIN x ON f.n = x.n),
{", ".join(f"{assigned(r)}, {moved(r)}" for r in range(rounds))}, {assigned(rounds)},
s AS (SELECT k, sum(d) AS s FROM a{rounds} GROUP BY k),
h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY k)
SELECT v.vec_id AS vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, CAST(s.s AS BIGINT) AS cluster_inertia, CAST((SELECT sum(d) FROM a{rounds}) AS BIGINT) AS inertia, h.h AS centroid_sha256
FROM a{rounds} a JOIN v ON a.n = v.n JOIN s ON a.k = s.k JOIN h ON a.k = h.k
"""


CENTROIDS = _centroids(40, 5, 64)
