"""Hosted SQL (S11): joins and aggregates over the star schema, as SQL text through Catalyst. An addition to the record operators."""

from __future__ import annotations

from loomtrace.plans.registry import QUERIES, SQL, table

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

TEXTS = {
    "sql_pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "sql_shipping_priority": """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderpriority""",
    "sql_local_supplier": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""",
    "sql_forecast_revenue": "SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "sql_customers_without_orders": "SELECT c_nationkey, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY c_nationkey",
    "sql_large_orders": "SELECT o_orderkey, o_custkey, round(sum(l_quantity), 2) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey HAVING sum(l_quantity) > 200",
    "sql_set_operations": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "sql_top_parts_by_brand": "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) AS t WHERE rn <= 3",
}


def _register(name: str, text: str) -> None:
    def run(spark, d):
        for t in _TABLES:
            table(spark, d, t).createOrReplaceTempView(t)
        return spark.sql(text)

    run.__name__ = name
    QUERIES[name], SQL[name] = run, text


for _name, _text in TEXTS.items():
    _register(_name, _text)
