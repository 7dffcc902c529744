"""The extraction of indicators in DuckDB's SQL: positions by sums of lengths, one scan after the other over whole tokens."""

from __future__ import annotations

from quarrylens.functions import indicators as i

_Q = lambda x: "'" + x.replace("'", "''") + "'"
_REFANGED = "t"
for _old, _new in i.REFANG:
    _REFANGED = f"regexp_replace({_REFANGED}, {_Q('(?i)' + ''.join(chr(92) + c if c in '[](){}.' else c for c in _old))}, {_Q(_new)}, 'g')"

_V6 = r"^((([a-fA-F0-9]{1,4}:){7}[a-fA-F0-9]{1,4})|((([a-fA-F0-9]{1,4}:)*[a-fA-F0-9]{1,4})?::(([a-fA-F0-9]{1,4}:)*[a-fA-F0-9]{1,4})?))$"
_IS_V6 = lambda x: f"(regexp_matches({x}, '{_V6}') AND (NOT contains({x}, '::') OR len(list_filter(string_split({x}, ':'), lambda g: g <> '')) <= 7))"
_DOMAIN = i.DOMAIN.removeprefix(r"\b").removesuffix(r"\b")
_HOST_TYPE = lambda h: f"CASE WHEN regexp_matches({h}, {_Q(i.STRICT_IPV4)}) THEN 'ipv4' WHEN {_IS_V6(h)} THEN 'ipv6' WHEN regexp_matches({h}, {_Q('^(?:' + _DOMAIN + ')$')}) THEN 'domain' END"


def _matches(n: int, kind: str, pattern: str, flags: str) -> str:
    kept = "rtrim(h[j], '.,;:)')" if kind == "url" else "h[j]"
    begin = "list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:j - 1], lambda x: length(x))), 0)"
    keep = f" WHERE {_IS_V6('hit')}" if kind == "ipv6" else ""
    return (
        f"SELECT id, k, {n} AS scan, '{kind}' AS kind, hit, b, b + length(hit) AS e FROM (SELECT id, k, {kept} AS hit, CAST({begin} AS BIGINT) AS b FROM "
        f"(SELECT id, k, h, g, unnest(range(1, len(h) + 1)) AS j FROM (SELECT id, k, regexp_extract_all(w, {_Q(flags + pattern)}, 0) AS h, string_split_regex(w, {_Q(flags + pattern)}) AS g FROM w) WHERE len(h) > 0)){keep}"
    )


_STEPS = ",\n".join(
    f"r{n} AS MATERIALIZED (SELECT * FROM m WHERE scan = 0)"
    if n == 0
    else f"r{n} AS MATERIALIZED (SELECT * FROM r{n - 1} UNION ALL SELECT a.* FROM m a WHERE a.scan = {n} AND NOT EXISTS (SELECT 1 FROM r{n - 1} x WHERE x.id = a.id AND x.k = a.k AND x.b < a.e AND x.e > a.b))"
    for n in range(len(i.SCANS))
)


#: Word boundaries are ASCII's in DuckDB: other letters and digits are made underscores, all other characters spaces.
def found(texts: str) -> str:
    """WITH ... a(id, type, value): the indicators of ``texts``, a query that gives (id, t)."""
    return f"""
WITH x AS ({texts}),
y AS (SELECT id, CASE WHEN regexp_matches(t, {_Q(i.DEFANGED)}) THEN {_REFANGED} ELSE t END AS t FROM x WHERE t IS NOT NULL),
z AS (SELECT id, regexp_replace(regexp_replace(t, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', ' ', 'g'), '[^\\x00-\\x7F]', '_', 'g') AS t FROM y),
w AS MATERIALIZED (SELECT * FROM (SELECT id, unnest(range(len(l))) AS k, unnest(l) AS w FROM (SELECT id, string_split_regex(t, {_Q(i.BREAKS)}) AS l FROM z)) WHERE regexp_matches(w, {_Q(i.LIKELY)})),
m AS MATERIALIZED ({" UNION ALL ".join(_matches(n, kind, pattern, flags) for n, (kind, pattern, flags, _) in enumerate(i.SCANS))}),
{_STEPS},
o AS (SELECT id, kind AS type, CASE WHEN kind IN ({", ".join(map(_Q, i.LOWER_CASED))}) THEN lower(hit) WHEN kind = 'cve' THEN upper(hit) ELSE hit END AS value, CASE kind WHEN 'url' THEN lower(regexp_extract(hit, {_Q(i.HOST)}, 1)) WHEN 'email' THEN split_part(hit, '@', 2) END AS h FROM r{len(i.SCANS) - 1}),
a AS (SELECT DISTINCT id, type, value FROM (SELECT id, type, value FROM o UNION ALL SELECT id, {_HOST_TYPE('h')}, lower(h) FROM o WHERE h IS NOT NULL) WHERE type IS NOT NULL)
""".replace("\\\\x", "\\x").replace("\\\\p", "\\p")


def type_counts(texts: str) -> str:
    return found(texts) + "SELECT type, count(*) AS n, count(DISTINCT id) AS n_texts, count(DISTINCT value) AS n_values FROM a GROUP BY type"


TYPE_COUNTS = type_counts("SELECT 'p' || page_id AS id, url AS t FROM pages UNION ALL SELECT 'h' || page_id, html FROM pages UNION ALL SELECT 'd' || doc_id, text FROM documents")
