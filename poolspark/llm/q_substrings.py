"""Query of operator 5."""

from pyspark.sql import functions as F

from poolspark.llm.registry import documents, query
from poolspark.llm.substrings import dedup_substrings

SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
runs AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
         FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
dup AS (SELECT r, i FROM runs WHERE h IN (SELECT h FROM runs GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + o AS p FROM dup, range(0, 35) t(o)),
word AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""


@query("op5_substring_dedup", SQL)
def op5_substring_dedup(spark, sf_dir):
    out = dedup_substrings(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
