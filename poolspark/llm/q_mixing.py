"""Query of operator 11."""

from poolspark.llm.mixing import allot
from poolspark.llm.registry import documents, query

SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR), text)), 1, 15) AS BIGINT) AS k FROM documents),
s AS (SELECT source, sum(size) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
      FROM d GROUP BY source),
o AS (SELECT *, coalesce(sum(2 * source_size) OVER p, 0) AS c_before, coalesce(sum(w) OVER p, 0) AS w_before,
             sum(source_size) OVER () AS words, sum(w) OVER () AS ws
      FROM s WINDOW p AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (c_before * w + 2 * source_size * (ws - w_before)) * 2 <= words * 3 * w AS is_full FROM o),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE)
             ELSE (CAST(words AS DOUBLE) * 3 / 2 - coalesce(sum(2 * source_size) FILTER (is_full) OVER (), 0)) * w
                  / (CAST(ws AS DOUBLE) - coalesce(sum(w) FILTER (is_full) OVER (), 0)) END AS target FROM f),
g AS (SELECT source, k, size, count(*) AS n, coalesce(sum(size * count(*)) OVER (PARTITION BY source ORDER BY k, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d GROUP BY source, k, size),
r AS (SELECT g.*, source_size, target, CAST(floor(target) AS BIGINT) AS b FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source)
SELECT d.doc_id, d.size, CAST(r.source_size AS BIGINT) AS source_size, r.target,
       CASE WHEN r.source_size = 0 THEN 0 ELSE CAST(r.b // r.source_size * r.size
         + greatest(0, least(r.size, (r.b % r.source_size - r.before) // r.n)) AS BIGINT) END AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.k = r.k AND d.size = r.size
"""


@query("op11_mixing", SQL)
def op11_mixing(spark, sf_dir):
    return allot(documents(spark, sf_dir))
