"""Star-schema queries: plain Spark capability beyond the corpus operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import corpus as co
from siltstone.plans.base import query

C = F.col


def revenue():
    return C("l_extendedprice") * (1 - C("l_discount"))


@query("tpch_q1", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def q1(t, spark):
    return t("lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(revenue()), 2).alias("sum_disc"), F.round(F.sum(revenue() * (1 + C("l_tax"))), 2).alias("sum_charge"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("tpch_q3", "SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1999-03-15' GROUP BY 1 ORDER BY revenue DESC, o_orderkey LIMIT 10")
def q3(t, spark):
    cust = t("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = t("orders").where("o_orderdate < TIMESTAMP_NTZ '1999-03-15'").join(cust, C("o_custkey") == C("c_custkey"), "left_semi").select("o_orderkey")
    rows = t("lineitem").join(orders, C("l_orderkey") == C("o_orderkey")).groupBy("o_orderkey").agg(F.round(F.sum(revenue()), 2).alias("revenue"))
    return rows.orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query("tpch_q5", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1")
def q5(t, spark):
    asia = t("nation").join(t("region").where("r_name = 'ASIA'"), C("n_regionkey") == C("r_regionkey")).select("n_nationkey", "n_name")
    supp = co.small(t("supplier").join(asia, C("s_nationkey") == C("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name"))
    rows = t("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount").join(supp, C("l_suppkey") == C("s_suppkey"))
    rows = rows.join(t("orders").select("o_orderkey", "o_custkey"), C("l_orderkey") == C("o_orderkey"))
    rows = rows.join(t("customer").select("c_custkey", "c_nationkey"), (C("o_custkey") == C("c_custkey")) & (C("c_nationkey") == C("s_nationkey")))
    return rows.groupBy("n_name").agg(F.round(F.sum(revenue()), 2).alias("revenue"))


@query("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def q6(t, spark):
    return t("lineitem").where("l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24").agg(F.round(F.sum(C("l_extendedprice") * C("l_discount")), 2).alias("revenue"))


@query("order_running_totals", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running FROM orders")
def running(t, spark):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return t("orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


@query("event_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events) SELECT user_id, sum(new)::BIGINT AS sessions, count(*) AS n FROM g GROUP BY user_id")
def sessions(t, spark):
    gap = C("ts").cast("timestamp") - F.lag(C("ts").cast("timestamp")).over(Window.partitionBy("user_id").orderBy("ts"))
    new = F.when(gap <= F.expr("INTERVAL '30' MINUTE"), 0).otherwise(1)
    return t("events").select("user_id", new.alias("new")).groupBy("user_id").agg(F.sum("new").alias("sessions"), F.count("*").alias("n"))
