"""SQL for the queries that SQL can express, to be run by DuckDB over the same tables."""

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(%s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(%s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT item_id, w, least(8, len(w)) AS n, unnest(generate_series(1, len(w) - least(8, len(w)) + 1)) AS i
        FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM words, sizes WHERE len(w) >= n)
), found AS (SELECT p.doc_id, p.n, p.i, x.item_id FROM places p JOIN windows x ON p.n = x.n AND p.g = x.g),
hits AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM found) GROUP BY doc_id
), owners AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit,
       coalesce(o.n_items, 0)::BIGINT AS n_items, sha256(coalesce(o.ids, '')) AS items_sha256,
       coalesce(o.n_items, 0) >= 2 AS contaminated
FROM words d LEFT JOIN hits h USING (doc_id) LEFT JOIN owners o USING (doc_id)
""" % (_ASCII_LOWER.format("text"), _ASCII_LOWER.format("text"))

OP4 = r"""
WITH RECURSIVE keyed AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, '') AS mix_id, coalesce('s' || source, '') AS mix_source, md5(coalesce(text, '')) AS digest,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 1024 AS block
  FROM documents
), blocks AS (SELECT mix_source, block, sum(n_tokens)::BIGINT AS block_tokens FROM keyed GROUP BY ALL),
sources AS (SELECT mix_source, sum(block_tokens)::BIGINT AS source_tokens FROM blocks GROUP BY ALL),
one AS (
  SELECT max(source_tokens) AS largest, list_transform(list_sort(list(source_tokens)), lambda t: t / max(source_tokens)) AS r
  FROM (SELECT source_tokens FROM sources WHERE source_tokens > 0)
), by_entropy(k, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN h < 0.98 * ln(n) THEN low ELSE mid END, CASE WHEN h < 0.98 * ln(n) THEN mid ELSE high END
  FROM (SELECT k, low, high, mid, n, list_sum(list_transform(w, lambda x: -x / z * ln(x / z))) AS h
        FROM (SELECT k, low, high, mid, len(w) AS n, w, list_sum(w) AS z
              FROM (SELECT k, low, high, (low + high) / 2 AS mid, list_transform(r, lambda x: pow(x, (low + high) / 2)) AS w FROM by_entropy, one WHERE k < 40)))
), by_epochs(k, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END
  FROM (SELECT k, low, high, (low + high) / 2 AS mid, pow(list_min(r), (low + high) / 2 - 1) <= 1.5 AS ok FROM by_epochs, one WHERE k < 40)
), chosen AS (
  SELECT largest, r, ceil(greatest(
           CASE WHEN list_sum(list_transform(r, lambda x: -x / list_sum(r) * ln(x / list_sum(r)))) < 0.98 * ln(len(r))
                THEN (SELECT high FROM by_entropy WHERE k = 40) ELSE 1.0 END,
           CASE WHEN pow(list_min(r), -1) <= 1.5 THEN 0.0 ELSE (SELECT high FROM by_epochs WHERE k = 40) END) * 1000000) / 1000000 AS a
  FROM one
), fit AS (
  SELECT mix_source, a AS exponent, pow(source_tokens / largest, a) / list_sum(list_transform(r, lambda x: pow(x, a))) AS weight,
         CASE WHEN source_tokens > 0 THEN quota // source_tokens ELSE 1 END AS epochs,
         CASE WHEN source_tokens > 0 THEN quota % source_tokens ELSE 0 END AS rest
  FROM (SELECT *, floor(largest * pow(source_tokens / largest, a))::BIGINT AS quota FROM sources, chosen)
), shown AS (SELECT *, unnest(range(epochs::BIGINT + 1)) AS epoch, ceil(block_tokens / 4194304)::BIGINT AS parts FROM blocks JOIN fit USING (mix_source)),
placed AS (
  SELECT *, row_number() OVER w AS block_rank, sum(block_tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS ends FROM shown
  WINDOW w AS (PARTITION BY mix_source, epoch ORDER BY ('0x' || substr(md5(mix_source || ':' || block || ':' || epoch), 1, 8))::BIGINT, block)
), every AS (
  SELECT *, CASE WHEN parts > 1 THEN ('0x' || substr(md5(mix_id || ':part'), 1, 8))::BIGINT % parts ELSE 0 END AS part
  FROM keyed JOIN placed USING (mix_source, block) WHERE epoch < epochs OR ends <= rest OR ends - block_tokens < rest
), ordered AS (
  SELECT *, row_number() OVER w AS place, sum(n_tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM every
  WINDOW w AS (PARTITION BY mix_source, epoch, block
    ORDER BY ('0x' || substr(md5(mix_source || ':' || block || ':' || part || ':' || epoch), 1, 8))::BIGINT, part,
             ('0x' || substr(md5(mix_id || ':' || epoch), 1, 8))::BIGINT, mix_id, digest)
)
SELECT doc_id, source, n_tokens, epoch, block, block_rank, place, exponent, weight FROM ordered
WHERE epoch < epochs OR ends <= rest OR used <= rest - ends + block_tokens
"""

SQL = {"op4_mix_sources": OP4, "op9_decontaminate": OP9}
