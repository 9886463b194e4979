"""Queries on keys and pools that the smaller tables do not hold."""
from datetime import datetime, timedelta

import duckdb

from poolspark.plans import load


def _tables(spark, folder, lines, orders):
    day = datetime(1996, 5, 1)
    spark.createDataFrame([(o, p, s, n, float(q), day + timedelta(days=o % 400)) for o, p, s, n, q in lines],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(o, 100.0 + o % 7, "O", day + timedelta(days=o % 400)) for o in orders],
                          "o_orderkey long, o_totalprice double, o_orderstatus string, o_orderdate timestamp").write.parquet(f"{folder}/orders.parquet")


def _both(spark, folder, name, tables=("lineitem", "orders")):
    """Sorted rows of the query and of its SQL."""
    queries, sql = load()
    mine = queries[name](spark, str(folder))
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    columns = ", ".join(f'"{c}"' for c in mine.columns)
    return sorted((tuple(r) for r in mine.collect()), key=repr), sorted(con.sql(f"SELECT {columns} FROM ({sql[name]})").fetchall(), key=repr)


def test_a_pool_of_one_match_has_lines_of_another_length(spark, tmp_path):
    # Pools 1 and 10 leave the remainder 1 of 9; the first has one match, the second two.
    lines = [(4, 5, 7, 1, 3), (40, 5, 7, 1, 3), (40, 8, 9, 2, 4), (8, 3, 1, 1, 5)]
    _tables(spark, tmp_path, lines, [4, 8, 40])
    mine, other = _both(spark, tmp_path, "positional_enrichment")
    assert mine == other
    assert dict(r[:2] for r in mine)[1] == "désaccord de longueur"


def test_numbers_beyond_a_million_come_back(spark, tmp_path):
    orders = [0, 999_999, 1_000_000, 1_999_999, 2_500_000, 8_999_999]
    _tables(spark, tmp_path, [(4, 5, 7, 1, 3)], orders)
    mine, other = _both(spark, tmp_path, "date_and_key_functions")
    assert mine == other and len(mine) == len(orders)
