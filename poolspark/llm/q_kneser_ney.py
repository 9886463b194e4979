"""Query of operator 1."""

from pyspark.sql import functions as F

from poolspark.llm import kneser_ney
from poolspark.llm.registry import CRC_SQL, documents, query

SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, crc % 5 = 1 AS held, ws FROM (
  SELECT doc_id, {crc} AS crc, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS ws FROM documents)),
t AS (SELECT r, held, w, lag(w, 1, '  ') OVER (PARTITION BY r ORDER BY i) AS v FROM (SELECT r, held, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d)),
uni AS (SELECT w, count(*) AS n FROM t WHERE NOT held GROUP BY w),
tot AS (SELECT coalesce(sum(n), 0) AS n, count(*) AS k FROM uni),
bi AS (SELECT v, w, count(*) AS n FROM t WHERE NOT held GROUP BY v, w),
ctx AS (SELECT v, sum(n) AS n, count(*) FILTER (n = 1) AS n1, count(*) FILTER (n = 2) AS n2, count(*) FILTER (n > 2) AS n3 FROM bi GROUP BY v),
af AS (SELECT w, count(*) AS a FROM bi GROUP BY w),
cc AS (SELECT 'u' AS lev, count(*) FILTER (n = 1) AS a, count(*) FILTER (n = 2) AS b, count(*) FILTER (n = 3) AS c, count(*) FILTER (n = 4) AS e FROM bi
       UNION ALL SELECT 'l', count(*) FILTER (a = 1), count(*) FILTER (a = 2), count(*) FILTER (a = 3), count(*) FILTER (a = 4) FROM af),
y AS (SELECT *, CASE WHEN a > 0 THEN a::DOUBLE / (a + 2 * b) ELSE 0.5 END AS y FROM cc),
dd AS (SELECT lev, least(greatest(CASE WHEN a > 0 THEN 1 - 2 * y * b / a ELSE y END, 0.05), 0.95) AS d1,
              least(greatest(CASE WHEN b > 0 THEN 2 - 3 * y * c / b ELSE 2 * y END, 0.05), 1.95) AS d2,
              least(greatest(CASE WHEN c > 0 THEN 3 - 4 * y * e / c ELSE 3 * y END, 0.05), 2.95) AS d3 FROM y),
lo AS (SELECT d1, d2, d3, (SELECT count(*) FROM bi) AS pairs, (SELECT k FROM tot) AS k,
              d1 * (SELECT count(*) FROM af WHERE a = 1) + d2 * (SELECT count(*) FROM af WHERE a = 2) + d3 * (SELECT count(*) FROM af WHERE a > 2) AS lft
       FROM dd WHERE lev = 'l'),
p1 AS (SELECT t.r, t.v, t.w, uni.n AS nw, (greatest(coalesce(a, 0) - CASE WHEN a > 2 THEN d3 WHEN a = 2 THEN d2 WHEN a = 1 THEN d1 ELSE 0 END, 0) + lft / (k + 1)) / pairs AS low
       FROM t LEFT JOIN uni USING (w) LEFT JOIN af USING (w), lo),
p2 AS (SELECT p1.r, nw, greatest(coalesce(bi.n, 0) - CASE WHEN bi.n > 2 THEN d3 WHEN bi.n = 2 THEN d2 WHEN bi.n = 1 THEN d1 ELSE 0 END, 0) / coalesce(ctx.n, 1)
              + CASE WHEN ctx.n IS NULL THEN 1.0 ELSE (d1 * n1 + d2 * n2 + d3 * n3) / ctx.n END * low AS p
       FROM p1 LEFT JOIN bi ON bi.v = p1.v AND bi.w = p1.w LEFT JOIN ctx ON ctx.v = p1.v, dd WHERE lev = 'u'),
s AS (SELECT r, count(*) AS n_tokens, count(nw) AS n_known,
             sum(CAST(round_even(log10((coalesce(nw, 0) + 0.5::DOUBLE) / (tot.n + 0.5::DOUBLE * (tot.k + 1))) * 1e7, 0) AS BIGINT))::BIGINT / 1e7::DOUBLE AS base_score,
             sum(CAST(round_even(log10(p) * 1e7, 0) AS BIGINT))::BIGINT / 1e7::DOUBLE AS score FROM p2, tot GROUP BY r)
SELECT doc_id, held AS held_out, n_tokens, n_known, CAST((SELECT n FROM tot) AS BIGINT) AS train_tokens, base_score, score FROM d JOIN s USING (r)
""".replace("{crc}", CRC_SQL)


def remainder(column, by):
    """crc32 of an id as text; a null id has no remainder."""
    return F.crc32(F.col(column).cast("string")) % by


@query("op1_kneser_ney", SQL)
def op1_kneser_ney(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = remainder("doc_id", 5) == 1
    model = kneser_ney.fit(docs.where(~held))  # a row without an id is scored, not learnt from
    out = kneser_ney.score(docs.withColumn("held_out", F.coalesce(held, F.lit(True))), model)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
