import __spark_entry__ as e
from oracle import SF, connect, same


def test_entry_has_rows(spark):
    assert e.entry(spark).count() > 0


def test_core_queries_match_sql(spark):
    from corvane.plans import ORACLE_SQL, QUERIES

    c = connect()
    for name, q in QUERIES.items():
        same(q(spark, SF), ORACLE_SQL[name], c)


def test_pricing_summary_edge_cases(spark):
    from corvane.operators import pricing_summary

    schema = "l_returnflag string, l_linestatus string, l_extendedprice double, l_discount double, revenue string"
    rows = [("A", "F", 10.0, 0.1, "x"), ("A", "F", None, 0.1, "x"), (None, "F", 5.0, None, None)]
    got = {(r.l_returnflag, r.l_linestatus): (r.revenue, r.n_lines) for r in pricing_summary(spark.createDataFrame(rows, schema)).collect()}
    assert float(got["A", "F"][0]) == 9.0 and got["A", "F"][1] == 2
    assert got[None, "F"] == (None, 1)
    assert pricing_summary(spark.createDataFrame([], schema)).count() == 0


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())
