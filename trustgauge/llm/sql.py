"""DuckDB SQL for personal data, centroid clusters and collocations."""

from __future__ import annotations

from . import ball_clusters, collocations, personal_data

#: The kinds' patterns without possessive quantifiers and look-behind.
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
_LUHN = """list_sum(list_transform(range(1, length(digits) + 1), lambda i:
    reverse(digits)[i]::INT * (2 - i % 2) - CASE WHEN reverse(digits)[i]::INT * (2 - i % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0"""
_MOD97 = """list_reduce(list_transform(string_split(substr(bare, 5) || left(bare, 4), ''), lambda c: CASE WHEN ascii(c) < 65 THEN ascii(c) - 48 ELSE ascii(c) - 55 END::BIGINT),
    lambda a, x: (a * (CASE WHEN x < 10 THEN 10 ELSE 100 END) + x) % 97, 0::BIGINT) = 1"""
_CONFIRMED = {
    "email": "true",
    "ip": "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0",
    "card": f"length(digits) BETWEEN 16 AND 19 AND {_LUHN}",
    "phone": "length(digits) BETWEEN 8 AND 15",
    "iban": f"length(bare) BETWEEN 15 AND 34 AND NOT regexp_matches(before, '[A-Za-z0-9]$') AND NOT regexp_matches(behind, '^[A-Za-z0-9]') AND {_MOD97}",
    "short_card": f"length(digits) BETWEEN 13 AND 15 AND {_LUHN}",
    "national_id": "NOT regexp_matches(before, '[0-9-]$') AND NOT regexp_matches(behind, '^[0-9-]') AND NOT regexp_matches(v, '^(?:000|666|9)|-00-|-0000$')",
}


def op11() -> str:
    parts = []
    for ord_, (kind, (_, own, good, bad)) in enumerate(personal_data.KINDS.items()):
        pattern = _PATTERNS[kind if kind in _PATTERNS else "card"]
        parts.append(rf"""
SELECT r, {ord_} AS ord, '{kind}' AS kind, s, e, least(1.0, greatest(0.0, round({own} + {personal_data.NEAR} *
         (regexp_matches(lower(before), '{good}') OR regexp_matches(lower(behind), '{good}'))::INT - {personal_data.NEAR} * regexp_matches(lower(before), '{bad}')::INT, 2))) AS score
FROM (SELECT *, regexp_replace(v, '[^0-9]+', '', 'g') AS digits, regexp_replace(v, '[^A-Z0-9]+', '', 'g') AS bare FROM (
  SELECT r, sum(length(piece) + length(v)) OVER w - length(v) AS s, sum(length(piece) + length(v)) OVER w AS e, v,
         right(piece, {personal_data.BEFORE}) AS before, left(lead(piece) OVER w, {personal_data.AFTER}) AS behind
  FROM (SELECT r, unnest(string_split_regex(t, '{pattern}')) AS piece, unnest(list_append(regexp_extract_all(t, '{pattern}'), '')) AS v,
               unnest(range(len(regexp_extract_all(t, '{pattern}')) + 1)) AS i FROM d)
  WINDOW w AS (PARTITION BY r ORDER BY i)))
WHERE v <> '' AND CASE WHEN v <> '' THEN {_CONFIRMED[kind]} END""")
    base = ", ".join(f"'{k}'" for k in personal_data.BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k in personal_data.BASE)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS MATERIALIZED (SELECT *, concat_ws(':', kind, s::BIGINT, e::BIGINT) AS span FROM ({" UNION ALL ".join(parts)}) WHERE kind IN ({base}) OR score >= {personal_data.STRONG})
SELECT doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY ord, s) FILTER (kind IN ({base})), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY ord, s), '') AS spans, count(*) FILTER (score >= {personal_data.STRONG})::BIGINT AS n_strong
FROM d LEFT JOIN f USING (r) GROUP BY r, doc_id"""


def op12() -> str:
    b = ball_clusters
    ctes = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({b.SCALE} * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = {b.DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs({b.SCALE} * x::DOUBLE) < {b.MOST})) = {b.DIM})""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INT AS cluster, x AS z FROM (SELECT sha256('{b.SEED}:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {b.K}))",
    ]
    for k in range(b.ROUNDS + 1):
        ctes.append(
            f"""a{k} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': d, 'c': cluster}}) AS near
  FROM (SELECT r, vec_id, x, cluster, list_sum(list_transform(list_zip(x, z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{k}) GROUP BY r)"""
        )
        if k < b.ROUNDS:
            ctes.append(
                f"""c{k + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.z, o.z) AS z FROM c{k} o LEFT JOIN (
  SELECT c AS cluster, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS z FROM (
    SELECT near.c AS c, i, sum(y) AS s, count(*) AS n FROM (SELECT near, unnest(x) AS y, unnest(range({b.DIM})) AS i FROM a{k}) GROUP BY ALL) GROUP BY c) m USING (cluster))"""
            )
    last = b.ROUNDS
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, cluster, near.d AS distance, (sum(near.d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(near.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(z, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} ON near.c = cluster"""


def op13() -> str:
    c = collocations
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
t AS MATERIALIZED (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, {c.MOST_WORDS + 1})) AS k))),
f AS MATERIALIZED (SELECT lang, g, count(*)::BIGINT AS f FROM g GROUP BY ALL),
a AS MATERIALIZED (SELECT lang, g, f AS a FROM f WHERE len(g) > 1 AND f >= {c.LEAST}),
s AS (SELECT c.lang, c.g, c.a, c.k, (1000 * c.a::HUGEINT * t.n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score, l.f AS l, r.f AS r, t.n
  FROM (SELECT *, g[1:k] AS front, g[k + 1:] AS rest FROM (SELECT *, unnest(range(1, len(g))) AS k FROM a)) c
  JOIN f l ON c.lang = l.lang AND c.front = l.g JOIN f r ON c.lang = r.lang AND c.rest = r.g JOIN t ON c.lang = t.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
covered AS (SELECT lang, sub AS g, max(a) AS longer FROM (
  SELECT lang, a, g[i:i + k - 1] AS sub FROM (SELECT *, unnest(range(1, len(g) - k + 2)) AS i FROM (SELECT *, unnest(range(2, len(g))) AS k FROM a))) GROUP BY ALL),
o AS (SELECT b.*, array_to_string(g, ' ') AS phrase FROM b LEFT JOIN covered USING (lang, g) WHERE longer IS NULL OR 100 * longer < {c.COVERED_PERCENT} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM o QUALIFY rank <= {c.TOP}"""
