"""SQL for the registered queries that SQL can express, over the whole tables.

op5 (a tokenizer's ids), op8 and op10 (trained models) have none; tests hold them against plain
Python. op2 and op6 are exact here and approximate in their candidates there.
"""

from __future__ import annotations

_BASE32 = "||".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((n >> {s}) & 31)::INT, 1)" for s in (15, 10, 5, 0))

OP1 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
  f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first_id FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(list_transform(range(8), lambda i: ('0x' || substr(x, (1 + 5 * i)::INT, 5))::BIGINT), lambda n: {_BASE32}), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f"""

_COMPONENTS = """
  reach AS (SELECT id AS a, id AS b FROM ids UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
  roots AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
  degree AS (SELECT a AS id, count(*)::BIGINT AS n FROM links GROUP BY a)"""

OP2 = f"""
WITH RECURSIVE ids AS (SELECT vec_id AS id FROM embeddings),
  v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links AS (SELECT x.id AS a, y.id AS b FROM v x, v y WHERE x.id <> y.id AND list_cosine_similarity(x.e, y.e) >= 0.9),{_COMPONENTS}
SELECT ids.id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, root AS component_id, ids.id = root AS kept
FROM ids JOIN roots USING (id) LEFT JOIN degree USING (id)"""

_STRENGTH = """(SELECT fold, greatest(1.0, least(1000.0, n, CASE WHEN q > e THEN (v - e) / (q - e) - 1 ELSE 1000.0 END)) AS s FROM (SELECT fold, sum(n) AS n FROM h GROUP BY fold) LEFT JOIN
    (SELECT fold, sum(n * pow(k / n - m, 2)) AS q, sum(m * (1 - m)) AS e, sum(n * m * (1 - m)) AS v FROM {} WHERE n > 0 GROUP BY fold) USING (fold))"""

OP3 = f"""
WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
  w AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, try_cast(regexp_extract(url, '^[^?#]*/([0-9]+)', 1) AS BIGINT) AS doc_id FROM u),
  bad AS (SELECT doc_id, max(toxic) AS bad FROM labels GROUP BY doc_id),
  known AS (SELECT page_id, max(bad) AS bad FROM w JOIN bad USING (doc_id) GROUP BY page_id),
  halved AS (SELECT host, bad, CASE WHEN substr(md5(coalesce(page_id::VARCHAR, '')), 1, 1) < '8' THEN 0 ELSE 1 END AS half FROM w LEFT JOIN known USING (page_id)),
  parts AS (SELECT host, split(host, '.') AS l, fold, count(bad) FILTER (fold IN (2, half))::DOUBLE AS n, coalesce(sum(bad) FILTER (fold IN (2, half)), 0)::DOUBLE AS k,
    count(bad) FILTER (fold < 2 AND fold <> half)::DOUBLE AS other_n, coalesce(sum(bad) FILTER (fold < 2 AND fold <> half), 0)::DOUBLE AS other_k FROM halved, range(3) f(fold) GROUP BY host, fold),
  h AS (SELECT fold, host, l[-1] AS suffix, array_to_string(l[-2:], '.') AS domain, n, k, other_n, other_k FROM parts),
  d0 AS (SELECT fold, suffix, domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY fold, suffix, domain),
  t0 AS (SELECT fold, (sum(k) + 1) / (sum(n) + 2) AS m, sum(n) + 2 AS p FROM h GROUP BY fold),
  s0 AS (SELECT fold, suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS m, any_value(p) AS p FROM h JOIN t0 USING (fold) GROUP BY fold, suffix),
  s1 AS (SELECT fold, suffix, (t * m + k) / (t + n) AS m, t + n AS p FROM (SELECT *, s * p / (s + p) AS t FROM s0 JOIN {_STRENGTH.format("s0")} USING (fold))),
  d1 AS (SELECT d0.*, m, p FROM d0 JOIN s1 USING (fold, suffix)),
  d2 AS (SELECT fold, suffix, domain, (t * m + k) / (t + n) AS m, t + n AS p FROM (SELECT *, s * p / (s + p) AS t FROM d1 JOIN {_STRENGTH.format("d1")} USING (fold))),
  h1 AS (SELECT h.*, m, p FROM h JOIN d2 USING (fold, suffix, domain)),
  ab AS (SELECT fold, host, other_n, other_k, t * m + k AS a, t * (1 - m) + n - k AS b FROM (SELECT *, s * p / (s + p) AS t FROM h1 JOIN {_STRENGTH.format("h1")} USING (fold))),
  bound AS (SELECT *, a / (a + b) AS mean, mean - 2.326 * sqrt(mean * (1 - mean) / (a + b + 1)) AS low FROM ab),
  steps AS (SELECT greatest(0, least(50, ceil(low * 50))) AS step, other_n - other_k AS good, other_k AS bad FROM bound WHERE fold < 2 AND host <> ''),
  loss AS (SELECT j, coalesce((SELECT sum(CASE WHEN step > j THEN good ELSE bad END) FROM steps), 0) AS loss FROM range(51) r(j)),
  most AS (SELECT max(j) / 50 AS most FROM loss WHERE loss = (SELECT min(loss) FROM loss)),
  ruled AS (SELECT page_id, host, path, CASE
      WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM w)
SELECT page_id, ruled.host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN low > most AND ruled.host <> '' THEN 'block' ELSE 'allow' END AS verdict, round(mean, 9) AS bad_rate, round(low, 9) AS bad_bound
FROM ruled LEFT JOIN bound ON ruled.host = bound.host AND fold = 2, most"""

#: crc32 over a text's bytes by the usual table, which is built from its polynomial.
_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_CRC = "list_transform(range(256)::BIGINT[], lambda c: c)"
for _ in range(8):
    _CRC = f"list_transform({_CRC}, lambda c: {_STEP})"

OP4 = f"""
WITH tbl AS (SELECT {_CRC} AS t),
  d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT + 8 AS size FROM documents),
  c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * (size - 8), 2), lambda i: ('0x' || substr(h, i::INT, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, tbl),
  r AS (SELECT *, row_number() OVER (ORDER BY doc_id, size, text_crc32) AS rn, sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, (sum(size) OVER ())::BIGINT AS total FROM c),
  s AS (SELECT *, least(((2 * upto - size) * 24) // (2 * total), 23)::INT AS shard FROM r)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY rn) - 1)::BIGINT AS slot, NULL::INT AS grown_shard FROM s"""

OP6 = f"""
WITH RECURSIVE ids AS (SELECT doc_id AS id FROM documents),
  words AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
  grams AS (SELECT id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM words WHERE len(w) > 0),
  sets AS (SELECT g, sha1(array_to_string(list_sort(g), '|')) AS h, len(g) AS n, id FROM grams),
  classes AS (SELECT h, any_value(n) AS n, any_value(g) AS g FROM sets GROUP BY h),
  items AS (SELECT h, n, unnest(g) AS gram FROM classes),
  pairs AS (SELECT x.h AS a, y.h AS b FROM items x JOIN items y ON x.gram = y.gram AND x.h <> y.h AND x.n >= 0.8 * y.n AND y.n >= 0.8 * x.n
    GROUP BY x.h, y.h, x.n, y.n HAVING count(*) >= 0.8 * (x.n + y.n - count(*)) - 1e-9 UNION ALL SELECT h, h FROM classes),
  links AS (SELECT x.id AS a, y.id AS b FROM pairs JOIN sets x ON x.h = pairs.a JOIN sets y ON y.h = pairs.b WHERE x.id <> y.id),{_COMPONENTS}
SELECT ids.id AS doc_id, root AS class_id, coalesce(n, 0)::BIGINT AS n_links, ids.id = root AS kept
FROM ids JOIN roots USING (id) LEFT JOIN degree USING (id)"""

OP7 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  r AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM r QUALIFY rank <= 10"""

_MD5 = "('0x' || substr(md5('7|' || doc_id), 1, 8))::BIGINT"

OP9 = f"""
WITH t AS (SELECT doc_id, source, 's:' || source AS src, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))::BIGINT AS tokens FROM documents),
  u AS (SELECT * REPLACE (coalesce(src, 'n') AS src) FROM t),
  totals AS (SELECT src, sum(tokens)::BIGINT AS total, count(*) AS n FROM u GROUP BY src),
  shares AS (SELECT src, total, total / sum(total) OVER () AS share FROM totals WHERE total > 0),
  tries AS (SELECT k, sum(exp(k / 1048576.0::DOUBLE * ln(share))) AS s, sum(exp(k / 1048576.0::DOUBLE * ln(share)) * ln(share)) AS w, count(*) AS n FROM shares, range(0, 1048576) r(k) GROUP BY k),
  alpha AS (SELECT CASE WHEN max(n) IS NULL OR max(n) = 1 THEN 1.0 ELSE max(CASE WHEN k = 0 OR ln(s) - k / 1048576.0::DOUBLE * w / s >= 0.95 * ln(n) - 1e-12 THEN k END) / 1048576.0::DOUBLE END AS a FROM tries),
  weights AS (SELECT src, pow(share, a) / sum(pow(share, a)) OVER () AS weight, round(pow(share, a) / sum(pow(share, a)) OVER () * sum(total) OVER ())::BIGINT AS quota FROM shares, alpha),
  sources AS (SELECT totals.src, totals.total, coalesce(quota, 0) AS quota, coalesce(weight, 0) AS weight, greatest(1, ceil(totals.total / 262144), ceil(n / 65536))::BIGINT AS blocks FROM totals LEFT JOIN weights ON totals.src = weights.src),
  dealt AS (SELECT u.*, {_MD5} % blocks AS block FROM u JOIN sources USING (src)),
  sums AS (SELECT src, block, sum(tokens)::BIGINT AS size FROM dealt GROUP BY src, block),
  plan AS (SELECT sums.*, total, quota, weight, unnest(range(0, greatest(1, ceil(quota / greatest(total, 1)))::BIGINT)) AS epoch FROM sums JOIN sources USING (src)),
  starts AS (SELECT *, epoch * total + coalesce(sum(size) OVER (PARTITION BY src, epoch ORDER BY md5('7|' || epoch || '|' || src || '|' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM plan),
  inner_ AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY src, block ORDER BY md5('7|d|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM dealt)
SELECT doc_id, source, tokens AS mix_tokens, round(weight, 9) AS mix_weight, epoch::INT AS mix_epoch, round(coalesce((start + ahead + 0.5::DOUBLE) / nullif(quota, 0), 0), 9) AS mix_at
FROM inner_ JOIN starts USING (src, block) WHERE start + ahead < quota OR total = 0"""

SQL = {
    "op1_warc_shards": OP1,
    "op2_lattice_near_duplicates": OP2,
    "op3_url_reputation": OP3,
    "op4_balanced_shards": OP4,
    "op6_jaccard_join": OP6,
    "op7_metric_tree_top_k": OP7,
    "op9_temperature_mixing": OP9,
}
