"""DuckDB SQL for the corpus operators that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op3_kdtree_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 10
"""

ORACLES["op5_warc_dictionary"] = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, upper(sha1(body)) AS x FROM p),
d AS (
  SELECT page_id, n, x,
    list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((
        CAST('0x' || substr(x, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31) AS BIGINT), 1)), 'string_agg', '') AS digest
  FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS lowest FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN lowest IS NOT NULL AND page_id IS DISTINCT FROM lowest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM lowest THEN lowest END AS refers_to
FROM f
"""

#: KNOWN is a column of known verdicts, of which pages have none.
URLS = r"""
WITH RECURSIVE u AS (
  SELECT page_id, KNOWN AS known, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
w AS (
  SELECT page_id, known, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM w),
p AS (
  SELECT *, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled,
    list_transform(string_split(path, '/')[2:], lambda s:
      CASE WHEN regexp_matches(s, '^[0-9]+(\.[A-Za-z0-9]+)?$') THEN regexp_replace(s, '^[0-9]+', '{n}')
           WHEN regexp_matches(s, '^[0-9A-Fa-f-]{12,}$') THEN '{x}' ELSE s END) AS segs FROM r),
labelled AS (SELECT *, coalesce(ruled, CASE WHEN known IN ('allow', 'block') THEN known END) AS label FROM p),
s AS (SELECT host, segs, count(*)::DOUBLE AS n, count(label)::DOUBLE AS l, (count(*) FILTER (WHERE label = 'block'))::DOUBLE AS b FROM labelled GROUP BY ALL),
t AS (
  SELECT host, segs, n, l, b, 0 AS i, host AS node, (bn + (nn - ln) * 0.5::DOUBLE * 0.2::DOUBLE + 0.2::DOUBLE * 4) / (ln + (nn - ln) * 0.5::DOUBLE + 4) AS e, nn, bn, kinds, false AS ends
  FROM (SELECT *, sum(n) OVER h AS nn, sum(l) OVER h AS ln, sum(b) OVER h AS bn, count(*) OVER h AS kinds FROM s WINDOW h AS (PARTITION BY host))
  UNION ALL
  SELECT host, segs, n, l, b, i + 1, below, CASE WHEN ways = 1 THEN e ELSE (mb + (mn - ml) * 0.5::DOUBLE * 0.2::DOUBLE + e * 4) / (ml + (mn - ml) * 0.5::DOUBLE + 4) END,
         sum(CASE WHEN c IS NULL THEN 0 ELSE n END) OVER (PARTITION BY below), sum(CASE WHEN c IS NULL THEN 0 ELSE b END) OVER (PARTITION BY below), count(c) OVER (PARTITION BY below), c IS NULL
  FROM (SELECT *, node || '/' || m AS below, sum(n) OVER (PARTITION BY node, m) AS mn, sum(l) OVER (PARTITION BY node, m) AS ml, sum(b) OVER (PARTITION BY node, m) AS mb
  FROM (SELECT * EXCLUDE (m), CASE WHEN gl > 0 OR c IS NULL OR greatest(h0, h1, h2) < 0 THEN m WHEN h0 = greatest(h0, h1, h2) THEN '~=' WHEN h1 = greatest(h0, h1, h2) THEN '~+' ELSE '~-' END AS m
  FROM (SELECT *, HOLDS0 AS h0, HOLDS1 AS h1, HOLDS2 AS h2
  FROM (SELECT *, OVERLAP0 AS o0, OVERLAP1 AS o1, OVERLAP2 AS o2
  FROM (SELECT *, row_number() OVER (PARTITION BY node, g, x) AS nth, sum(n) OVER (PARTITION BY node, g, x) AS u, sum(n) OVER (PARTITION BY node, g) AS own, POOL0, POOL1, POOL2
  FROM (SELECT *, coalesce(segs[i + 2], '/') AS x, CASE WHEN side = '~=' OR (side IS NOT NULL AND (gb * sl - sb * gl) ** 2 <= 4 * gl * sb * (sl - sb)) THEN side ELSE g END AS m
  FROM (SELECT *, sum(l) OVER (PARTITION BY node, side) AS sl, sum(b) OVER (PARTITION BY node, side) AS sb
  FROM (SELECT *, CASE WHEN gl = 0 THEN NULL WHEN (gb * pl - pb * gl) ** 2 <= 4 * gl * pb * (pl - pb) THEN '~=' WHEN gb * pl > pb * gl THEN '~+' ELSE '~-' END AS side
  FROM (SELECT *, sum(l) OVER (PARTITION BY node, g) AS gl, sum(b) OVER (PARTITION BY node, g) AS gb
  FROM (SELECT *, CASE WHEN c IS NULL THEN '$' WHEN k >= 8 AND kn < 4 * k AND c <> '' THEN '*' ELSE '=' || c END AS g
  FROM (SELECT *, count(DISTINCT c) OVER (PARTITION BY node) AS k, count(DISTINCT coalesce(c, '/')) OVER (PARTITION BY node) AS ways, sum(CASE WHEN c IS NULL THEN 0 ELSE n END) OVER (PARTITION BY node) AS kn, sum(l) OVER (PARTITION BY node) AS pl, sum(b) OVER (PARTITION BY node) AS pb
  FROM (SELECT *, segs[i + 1] AS c FROM t WHERE NOT ends AND bn > 0 AND bn < nn AND kinds > 1))))))))))))),
x AS (SELECT host, segs FROM t WHERE (ends OR bn = 0 OR bn >= nn OR kinds <= 1) AND e >= 0.5)
SELECT page_id, labelled.host, path, rule, coalesce(ruled, CASE WHEN x.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM labelled LEFT JOIN x ON labelled.host = x.host AND labelled.segs = x.segs
"""
for _i, _side in enumerate(("~=", "~+", "~-")):
    URLS = URLS.replace(f"POOL{_i}", f"sum(CASE WHEN m = '{_side}' AND c IS NOT NULL THEN n ELSE 0 END) OVER (PARTITION BY node, x) AS p{_i}, sum(CASE WHEN m = '{_side}' AND c IS NOT NULL THEN n ELSE 0 END) OVER (PARTITION BY node) AS s{_i}")
    URLS = URLS.replace(f"OVERLAP{_i}", f"sum(CASE WHEN nth = 1 THEN least(u * s{_i}, p{_i} * own) ELSE 0 END) OVER (PARTITION BY node, g)")
    URLS = URLS.replace(f"HOLDS{_i}", f"CASE WHEN own >= 10 AND s{_i} >= 10 AND 10 * o{_i} >= 9 * own * s{_i} THEN o{_i} / s{_i} ELSE -1 END")
ORACLES["op9_url_templates"] = URLS.replace("KNOWN", "NULL::VARCHAR")

ORACLES["op11_dense_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT vec_id, max((q, label)) AS top FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id, len(q)),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.top[2] AS same,
         CAST(list_sum(list_transform(list_zip(a.top[1], v.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM a JOIN v ON len(a.top[1]) = len(v.q)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same AND vec_id <> anchor_id),
n AS (
  SELECT p.anchor_id, positive_id, place, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
  WHERE place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def _rounds(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """The rounds of clustering as one query: each assigns by squared distance and floors the means."""
    parts = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, q) - 1 AS c, q FROM v ORDER BY c LIMIT {k})"]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, q, c, d FROM (
    SELECT r, vec_id, v.q, c, list_sum(list_transform(list_zip(v.q, k.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v CROSS JOIN c{i} k)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            parts.append(f"""m{i} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, unnest(range({dim})) AS i FROM a{i}) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(f, q) AS q FROM c{i} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS f FROM m{i} GROUP BY c) USING (c))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} k ON k.c = a.c"""


ORACLES["op13_screened_centroids"] = _rounds()
