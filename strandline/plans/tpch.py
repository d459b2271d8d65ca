"""Queries over the star-schema tables: predicates, joins with a condition on matches, pairs, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import matching
from strandline.operators.stats import circular_gap
from strandline.sources.tables import table


def scope_case(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by the scope of their region; the dimension is small by its schema and Catalyst broadcasts it by its size."""
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    scope = F.when(F.col("r_name").isin("ASIA", "EUROPE"), "family").when(F.col("r_name") == "AFRICA", "relay").otherwise("other")
    return table(spark, sf, "customer").select("c_nationkey", "c_acctbal").join(nation.select("n_nationkey", "r_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(scope.alias("scope")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("c_acctbal").cast("decimal(18,2)")), 2).cast("double").alias("balance"))


def unique_match(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with exactly one order of the highest urgency."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"))
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("custkey"), "o_orderkey")
    return matching.unique_match(c, o, on=["custkey"], left_id="custkey", right_id="o_orderkey")


def semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a returned line and no line shipped after 1995."""
    li = table(spark, sf, "lineitem")
    returned = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    late = li.where("l_shipdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(returned, "o_orderkey", "left_semi").join(late, "o_orderkey", "left_anti")


def multi_holder(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that more than one supplier delivers."""
    return matching.multi_holders(table(spark, sf, "lineitem"), item="l_partkey", owner="l_suppkey")


def clash_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of lines of an order whose second of the day, made from part and supplier, is over three hours apart."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.pmod(F.col("l_partkey") * 97 + F.col("l_suppkey") * 13, F.lit(86_400)).alias("s"))
    a, b = li.alias("a"), li.alias("b")
    gap = circular_gap(F.col("a.s"), F.col("b.s"))
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")))
    return pairs.groupBy(F.col("a.l_orderkey").alias("l_orderkey")).agg(F.count_if(gap > 10_800).alias("n_disagree"), F.count_if(gap <= 10_800).alias("n_agree"), F.min(gap).alias("least_gap")).where("n_disagree > n_agree")


def topk(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty parts with most lines; of equals the least part."""
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_partkey").limit(20)


def group_samples(spark: SparkSession, sf: str) -> DataFrame:
    """O3: up to four lines of each return flag and status, the dearest first."""
    w = Window.partitionBy("l_returnflag", "l_linestatus").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf, "lineitem").withColumn("k", F.row_number().over(w)).where("k <= 4").select("l_returnflag", "l_linestatus", "k", "l_orderkey", "l_linenumber")


def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the order table against those made from its lines."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"), F.max("l_linenumber").alias("last_line"))
    o = table(spark, sf, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    return matching.reconciled(o, {"orders with lines": (F.count("n_lines"), F.count(F.lit(1))), "lines by number": (F.sum("last_line"), F.sum("n_lines")), "orders once": (F.countDistinct("o_orderkey"), F.count(F.lit(1)))})


def row_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of customers and suppliers as one set, with the bag difference and the intersection counted."""
    c, s = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = [("union", c.union(s).distinct()), ("except_all", c.exceptAll(s)), ("intersect", c.intersect(s))]
    out = None
    for name, df in parts:
        one = df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("level", "k", "n")


def any_match(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by whether a line agrees with their total price within a fifth."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    checked = matching.any_match(o, li, on="o_orderkey", agrees=F.abs(F.col("l_extendedprice") - F.col("o_totalprice")) <= F.col("o_totalprice") / 5)
    return checked.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "tpch_scope_case": scope_case, "tpch_unique_match": unique_match, "tpch_semi_anti": semi_anti, "tpch_multi_holder": multi_holder, "tpch_clash_pairs": clash_pairs, "tpch_topk": topk,
    "tpch_group_samples": group_samples, "tpch_reconcile": reconcile, "tpch_row_sets": row_sets, "tpch_any_match": any_match,
}

ORACLE = {
    "tpch_scope_case": "SELECT CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'family' WHEN r_name = 'AFRICA' THEN 'relay' ELSE 'other' END AS scope, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "tpch_unique_match": "SELECT o_custkey AS custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1 HAVING count(DISTINCT o_orderkey) = 1",
    "tpch_semi_anti": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01')",
    "tpch_multi_holder": "SELECT l_partkey, count(DISTINCT l_suppkey) AS n_owners FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1",
    "tpch_clash_pairs": """WITH l AS (SELECT l_orderkey, l_linenumber, (l_partkey * 97 + l_suppkey * 13) % 86400 AS s FROM lineitem),
p AS (SELECT a.l_orderkey, least(abs(a.s - b.s), 86400 - abs(a.s - b.s)) AS gap FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
SELECT l_orderkey, count(*) FILTER (gap > 10800) AS n_disagree, count(*) FILTER (gap <= 10800) AS n_agree, min(gap) AS least_gap FROM p GROUP BY 1 HAVING count(*) FILTER (gap > 10800) > count(*) FILTER (gap <= 10800)""",
    "tpch_topk": "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20",
    "tpch_group_samples": "SELECT l_returnflag, l_linestatus, k, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 4",
    "tpch_reconcile": """WITH l AS (SELECT l_orderkey AS k, count(*) AS n, max(l_linenumber) AS m FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, n, m FROM orders LEFT JOIN l ON k = o_orderkey),
p AS (SELECT 'orders with lines' AS check_name, CAST(count(n) AS DOUBLE) AS recomputed, CAST(count(*) AS DOUBLE) AS stored FROM o UNION ALL SELECT 'lines by number', CAST(sum(m) AS DOUBLE), CAST(sum(n) AS DOUBLE) FROM o UNION ALL SELECT 'orders once', CAST(count(DISTINCT o_orderkey) AS DOUBLE), CAST(count(*) AS DOUBLE) FROM o)
SELECT *, recomputed IS NOT DISTINCT FROM stored AS equal FROM p""",
    "tpch_row_sets": """SELECT 'union' AS level, k, 1 AS n FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'except_all', k, count(*) FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) GROUP BY k
UNION ALL SELECT 'intersect', k, 1 FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)""",
    "tpch_any_match": """WITH h AS (SELECT o_orderkey, max(CASE WHEN abs(l_extendedprice - o_totalprice) <= o_totalprice / 5 THEN 1 ELSE 0 END) AS hit FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT CASE WHEN hit IS NULL THEN 'unmatched' WHEN hit = 1 THEN 'agree' ELSE 'differ' END AS status, count(*) AS n FROM orders LEFT JOIN h USING (o_orderkey) GROUP BY 1""",
}
