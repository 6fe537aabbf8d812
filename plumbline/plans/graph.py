"""Lineage over region, nation, customer and order edges."""

from pyspark.sql import functions as F

from plumbline.operators import lineage
from plumbline.registry import query
from plumbline.session import load

_EDGES = """ed AS (
    SELECT 'R' || r_regionkey AS source, 'N' || n_nationkey AS target FROM region JOIN nation ON n_regionkey = r_regionkey
    UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
    UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders
    UNION ALL SELECT 'R' || n_regionkey, 'C' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0)"""
_NODES = """nd AS (SELECT 'R' || r_regionkey AS node, 'Ready' AS state FROM region UNION ALL SELECT 'N' || n_nationkey, 'Ready' FROM nation
    UNION ALL SELECT 'C' || c_custkey, CASE WHEN c_acctbal > 9000 THEN 'Failed' ELSE 'Ready' END FROM customer
    UNION ALL SELECT 'O' || o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'Pending' ELSE 'Ready' END FROM orders)"""
_CLOSURE = f"WITH RECURSIVE {_EDGES}, cl AS (SELECT 'R2' AS node UNION SELECT ed.target FROM cl JOIN ed ON ed.source = cl.node)"


def _id(letter, column):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def edges(spark, sf):
    nation, customer = load(spark, sf, "nation"), load(spark, sf, "customer")
    orders = load(spark, sf, "orders")
    edge = lambda df, s, t: df.select(s.alias("source"), t.alias("target"))
    owed = customer.where("c_acctbal < 0").join(nation, customer.c_nationkey == nation.n_nationkey)
    return (
        edge(nation, _id("R", "n_regionkey"), _id("N", "n_nationkey"))
        .unionByName(edge(customer, _id("N", "c_nationkey"), _id("C", "c_custkey")))
        .unionByName(edge(orders, _id("C", "o_custkey"), _id("O", "o_orderkey")))
        .unionByName(edge(owed, _id("R", "n_regionkey"), _id("C", "c_custkey")))
    )


def nodes(spark, sf):
    ready = F.lit("Ready")
    node = lambda df, key, state: df.select(key.alias("node"), state.alias("state"))
    return (
        node(load(spark, sf, "region"), _id("R", "r_regionkey"), ready)
        .unionByName(node(load(spark, sf, "nation"), _id("N", "n_nationkey"), ready))
        .unionByName(node(load(spark, sf, "customer"), _id("C", "c_custkey"), F.when(F.col("c_acctbal") > 9000, "Failed").otherwise(ready)))
        .unionByName(node(load(spark, sf, "orders"), _id("O", "o_orderkey"), F.when(F.col("o_orderstatus") == "P", "Pending").otherwise(ready)))
    )


def _start(spark, sf):
    asia = load(spark, sf, "region").where("r_name = 'ASIA'")
    return asia.select(_id("R", "r_regionkey").alias("node"))


@query("downstream", f"{_CLOSURE} SELECT node FROM cl")
def downstream(spark, sf):
    return lineage.downstream(edges(spark, sf), _start(spark, sf))


@query(
    "mark_stale",
    f"{_CLOSURE}, {_NODES} SELECT nd.node, CASE WHEN cl.node IS NOT NULL THEN 'Stale' ELSE state END AS state FROM nd LEFT JOIN cl ON cl.node = nd.node",
)
def mark_stale(spark, sf):
    return lineage.mark_stale(nodes(spark, sf), edges(spark, sf), _start(spark, sf))


@query(
    "execution_levels",
    f"""WITH RECURSIVE {_EDGES}, {_NODES}, lv AS (SELECT node, 0 AS level FROM nd WHERE node NOT IN (SELECT target FROM ed)
      UNION SELECT ed.target, lv.level + 1 FROM lv JOIN ed ON ed.source = lv.node) SELECT node, max(level) AS level FROM lv GROUP BY node""",
)
def execution_levels(spark, sf):
    return lineage.execution_levels(nodes(spark, sf), edges(spark, sf))


@query(
    "recompute_set",
    """SELECT o_orderkey AS node FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'F' AND o_totalprice > 50000 AND
      (o_orderpriority = '1-URGENT' OR (o_orderpriority IN ('2-HIGH', '5-LOW') AND o_totalprice > 100000 AND year(o_orderdate) IN (1996, 1997))))""",
)
def recompute_set(spark, sf):
    c = F.col
    status, priority, price, year = c("o_orderstatus"), c("o_orderpriority"), c("o_totalprice"), F.year("o_orderdate")
    table = load(spark, sf, "orders").select(
        c("o_orderkey").alias("node"),
        F.when(status == "P", "Pending").when(status == "F", "Stale").otherwise("Ready").alias("state"),
        (price > 50000).alias("repeatable"),
        F.lit(True).alias("pure"),
        (price > 100000).alias("bounded"),
        F.when(year == 1996, "DependencyRefreshed").when(year == 1997, "InputBehind").when(year == 1998, "Unknown").alias("stale_reason"),
        F.when(priority == "1-URGENT", "Reactive").when(priority == "2-HIGH", "Automatic").when(priority == "5-LOW", None).otherwise("Manual").alias("policy"),
        F.lit(False).alias("requested"),
    )
    return lineage.recompute_set(table).select("node")


@query(
    "provenance_agree",
    """WITH g AS (SELECT o_custkey, count(*) AS n, min(o_orderstatus) AS l1, max(o_orderstatus) AS h1,
        min(CASE WHEN o_totalprice > 100000 THEN o_orderpriority END) AS l2, max(CASE WHEN o_totalprice > 100000 THEN o_orderpriority END) AS h2,
        count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS n2 FROM orders GROUP BY 1)
    SELECT o_custkey, 'fact' AS kind, 'status' AS name, l1 AS "value" FROM g WHERE l1 = h1
    UNION ALL SELECT o_custkey, 'fact', 'priority', l2 FROM g WHERE l2 = h2 AND n2 = n
    UNION ALL (SELECT DISTINCT o_custkey, 'caution', 'pending', '' FROM orders WHERE o_orderstatus = 'P')
    UNION ALL (SELECT DISTINCT o_custkey, 'origin', CAST(year(o_orderdate) AS VARCHAR), '' FROM orders)""",
)
def provenance_agree(spark, sf):
    c = F.col
    facts = {"status": c("o_orderstatus"), "priority": F.when(c("o_totalprice") > 100000, c("o_orderpriority"))}
    cautions = [F.when(c("o_orderstatus") == "P", "pending")]
    origins = [F.year("o_orderdate").cast("string")]
    return lineage.provenance_agree(load(spark, sf, "orders"), ["o_custkey"], facts, cautions, origins)


@query(
    "policy_join",
    """SELECT o_custkey, bool_or(o_totalprice > 400000) AS confidential, bool_or(o_orderstatus = 'P') AS unknown,
      min(CAST(left(o_orderpriority, 1) AS INT)) AS residence FROM orders GROUP BY 1""",
)
def policy_join(spark, sf):
    residence = F.substring("o_orderpriority", 1, 1).cast("int")
    return lineage.policy_join(
        load(spark, sf, "orders"), ["o_custkey"], F.col("o_totalprice") > 400000, F.col("o_orderstatus") == "P", residence
    )
