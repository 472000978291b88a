"""DuckDB SQL for the queries that SQL can express over whole tables."""

OP5 = r"""
WITH d AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source
), w AS (
    SELECT source, source_size, CASE (no - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s
), e AS (
    SELECT *, 3.0::DOUBLE * source_size AS lim, 3.0::DOUBLE * source_size / weight AS edge, (SELECT sum(source_size) FROM s)::DOUBLE AS total FROM w
), l AS (
    SELECT *, (total - coalesce(sum(lim) OVER (ORDER BY edge, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
        / sum(weight) OVER (ORDER BY edge, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM e
), o AS (
    SELECT min(edge) AS edge, arg_min(level, edge) AS level FROM l WHERE edge > level
), t AS (
    SELECT source, source_size, least(lim, CASE WHEN o.level IS NULL OR l.edge < o.edge THEN lim ELSE weight * o.level END) AS target FROM l, o
), b AS (
    SELECT source, source_size, target, greatest(1, least(8192, CAST(floor(target / 4096) AS BIGINT))) AS block FROM t WHERE source_size > 0 AND target > 0
), n AS (
    SELECT *, (source_size + block - 1) // block AS per_epoch FROM b
), c AS (
    SELECT *, greatest(1, CAST(round(target / source_size * per_epoch) AS BIGINT)) AS slots FROM n
), h AS (
    SELECT *, CAST(sum(slots) OVER (ORDER BY source NULLS LAST) AS BIGINT) AS hi, CAST(sum(slots) OVER () AS BIGINT) AS every FROM c
), r AS (
    SELECT source, source_size, block, per_epoch, CAST(floor((hi - slots)::DOUBLE / every * 2147483648.0::DOUBLE) AS BIGINT) AS lo_edge,
        CAST(floor(hi::DOUBLE / every * 2147483648.0::DOUBLE) AS BIGINT) AS hi_edge FROM h
), x AS (
    SELECT (i + 1) % 2147483648 * 1327217885 % 2147483648 AS point FROM range((SELECT coalesce(max(every), 0) FROM h)) q(i)
), k AS (
    SELECT source, any_value(source_size) AS source_size, any_value(block) AS block, any_value(per_epoch) AS per_epoch, count(*) AS dealt
    FROM r JOIN x ON x.point >= r.lo_edge AND x.point < r.hi_edge GROUP BY source
), g AS (
    SELECT source, dealt // per_epoch AS whole, least(source_size, dealt % per_epoch * block) AS rest FROM k
), p AS (
    SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size), size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at FROM d
)
SELECT p.doc_id, p.source, p.size, t.source_size, t.target,
    CAST(CASE WHEN p.size = 0 OR g.whole IS NULL THEN 0 WHEN g.whole >= 3 THEN 3 * p.size
        ELSE g.whole * p.size + greatest(0, least(p.begin_at + p.size, g.rest) - p.begin_at) END AS BIGINT) AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN g ON p.source IS NOT DISTINCT FROM g.source
"""

OP1 = r"""
WITH RECURSIVE p AS (
    SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html
    FROM pages
), r AS (
    SELECT page_id, host, path, html,
        CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
            WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
            WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
            WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
    FROM p
), v AS (
    SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM r
), link AS (
    SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s<>]*)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM p
), edge AS (
    SELECT src, dst, count(*) AS n FROM link WHERE dst <> '' AND src <> '' AND src <> dst GROUP BY src, dst
), ways AS (
    SELECT 't' AS kind, src AS host, dst AS dest, n FROM edge UNION ALL SELECT 'd', dst, src, n FROM edge
), w AS (
    SELECT kind, host, dest, n::DOUBLE / sum(n) OVER (PARTITION BY kind, host) AS w FROM ways
), shares AS (
    SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS t FROM v WHERE host <> '' AND ruled IS NOT NULL GROUP BY host
), raw AS (
    SELECT 't' AS kind, host, t AS seed FROM shares WHERE t > 0 UNION ALL SELECT 'd', host, 1 - t FROM shares WHERE t < 1
), seed AS (
    SELECT kind, host, seed / sum(seed) OVER (PARTITION BY kind) AS seed FROM raw
), moved AS (
    SELECT 0 AS step, kind, host, seed AS score FROM seed
    UNION ALL SELECT step + 1, w.kind, dest, sum(score * w * 0.85::DOUBLE) FROM moved JOIN w ON moved.kind = w.kind AND moved.host = w.host WHERE step < 150 GROUP BY step, w.kind, dest
), k AS (
    SELECT kind, host, sum(score) / sum(sum(score)) OVER (PARTITION BY kind) AS score FROM moved GROUP BY kind, host
), h AS (
    SELECT host FROM k GROUP BY host
    HAVING round(coalesce(sum(score) FILTER (WHERE kind = 'd'), 0) - coalesce(sum(score) FILTER (WHERE kind = 't'), 0), 8) > 0
)
SELECT page_id, v.host, path, rule, coalesce(ruled, CASE WHEN h.host IS NOT NULL THEN 'block' END, 'allow') AS verdict FROM v LEFT JOIN h ON v.host = h.host
"""

OP4 = (
    """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
m AS (SELECT sha, max(page_id) AS best FROM p GROUP BY sha)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, """
    + " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(p.sha, {1 + 5 * g}, 5) AS BIGINT) >> {shift}) & 31 AS BIGINT) + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0))
    + """ AS payload_digest,
    CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM p JOIN m ON p.sha = m.sha
"""
)

def _lloyd(rounds: int = 6) -> str:
    """One round after the other, each part compared with all entries."""
    near = "{a} AS MATERIALIZED (SELECT r, p, min(d * 16 + e) % 16 AS e, min(d) AS d FROM (SELECT v.r, v.p, c.e, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN {c} c ON v.i = c.i GROUP BY v.r, v.p, c.e) GROUP BY r, p)"
    mean = "{b} AS MATERIALIZED (SELECT c.e, c.i, coalesce(m.x, c.x) AS x FROM {c} c LEFT JOIN (SELECT a.e, v.i, CAST((sum(v.x) - (sum(v.x) % count(*) + count(*)) % count(*)) / count(*) AS BIGINT) AS x FROM v JOIN {a} a ON v.r = a.r AND v.p = a.p GROUP BY a.e, v.i) m ON c.e = m.e AND c.i = m.i)"
    steps = ",\n".join(f"{near.format(a=f'a{n}', c=f'c{n}')},\n{mean.format(a=f'a{n}', b=f'c{n + 1}', c=f'c{n}')}" for n in range(rounds))
    return f"""
WITH k AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, [CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x
    FROM embeddings WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
), v AS MATERIALIZED (SELECT r, i, i // (len(x) // 8) AS p, x[i + 1] AS x FROM k, range((SELECT max(len(x)) FROM k)) q(i)),
c0 AS MATERIALIZED (SELECT r - 1 AS e, i, x FROM v WHERE r <= 16),
{steps},
{near.format(a="a", c=f"c{rounds}")},
o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i // (SELECT count(DISTINCT i) // 8 FROM c0), e, i)) FROM c{rounds}) AS codebooks_sha256
FROM k JOIN o ON k.r = o.r
"""


ORACLE: dict[str, str] = {"op1_url_trust": OP1, "op4_warc_dictionary": OP4, "op5_source_mixing": OP5, "op11_hamerly_codes": _lloyd()}
