"""Queries over the evidence graph, prices, routes, review queues and job logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions import scalars as S
from attesta.functions.session import shared_folder
from attesta.operators import costing, graph, matching, merge, release, review, routes, top
from attesta.plans.evidence import table
from attesta.sources import files

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- components, links, browsing --------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier UNION SELECT DISTINCT 's' || s_suppkey, 'b' || floor(s_acctbal / 500)::INT FROM supplier WHERE s_acctbal > 9000),
v AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
r(node, label) AS (SELECT x, x FROM v UNION SELECT v.y, r.label FROM r JOIN v ON v.x = r.node)
SELECT node, min(label) AS component FROM r GROUP BY node""")
def leakage_components(spark, sf_dir):
    return leakage_components_all(spark, sf_dir)


@query()
def leakage_components_all(spark, sf_dir):
    """Components of all suppliers, by nation and, of the largest balances, by bucket."""
    s = table(spark, sf_dir, "supplier")
    node = F.concat(F.lit("s"), "s_suppkey").alias("a")
    e = s.select(node, F.concat(F.lit("n"), "s_nationkey").alias("b")).unionByName(s.filter("s_acctbal > 9000").select(node, F.concat(F.lit("b"), F.floor(F.col("s_acctbal") / 500).cast("int")).alias("b")))
    return graph.components(e, "a", "b")


@query("SELECT p_partkey AS subject_id, f AS object_id, name, 0.7::DOUBLE AS score, 'normalized_name' AS method FROM (SELECT p_partkey, lower(p_name) AS name, min(p_partkey) OVER (PARTITION BY lower(p_name)) AS f FROM part) WHERE p_partkey <> f")
def name_link_candidates(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", S.normalize_name(F.col("p_name")).alias("name"), F.col("p_partkey").alias("seq"))
    return matching.name_links(p, "p_partkey", "name", "seq")


@query("SELECT l_orderkey, count(DISTINCT c_custkey) AS n_owners, min(c_custkey) AS least_owner, max(c_custkey) AS greatest_owner FROM (SELECT DISTINCT l_orderkey, l_suppkey % 25 AS ns, l_linenumber AS v FROM lineitem) JOIN customer ON c_nationkey = ns AND c_custkey % 7 + 1 = v GROUP BY l_orderkey HAVING count(DISTINCT c_custkey) > 1")
def identity_conflicts(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 25).alias("ns"), F.col("l_linenumber").cast("bigint").alias("v")).distinct()
    own = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("ns"), (F.col("c_custkey") % 7 + 1).alias("v"))
    return matching.identity_conflicts(ids, "l_orderkey", ["ns", "v"], own, "c_custkey").drop("about_owners")


_BROWSE = "FROM customer WHERE lower(c_name) LIKE '%00_%1%' AND (c_mktsegment = 'BUILDING' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT'))"


def browsed(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("hit")).distinct()
    c = matching.search(table(spark, sf_dir, "customer"), "c_name", "00_%1")
    return c.join(urgent, "c_custkey", "left").filter(F.coalesce("hit", F.lit(False)) | (F.col("c_mktsegment") == "BUILDING")).drop("hit")


@query(f"SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority), '') FROM orders WHERE o_custkey = c_custkey) AS priorities {_BROWSE} ORDER BY c_name, c_custkey LIMIT 50 OFFSET 20")
def catalogue_browse(spark, sf_dir):
    page = browsed(spark, sf_dir).select("c_custkey", "c_name").orderBy("c_name", "c_custkey").offset(20).limit(50)  # a page of the catalogue
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").join(F.broadcast(page.select("c_custkey")), "c_custkey", "left_semi")  # 50 keys
    counts = own.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("p"))
    return page.join(counts, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("p", F.lit("")).alias("priorities"))


@query(f"SELECT count(*) AS total, count(DISTINCT c_nationkey) AS n_nations {_BROWSE}")
def catalogue_total(spark, sf_dir):
    return browsed(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.countDistinct("c_nationkey").alias("n_nations"))


@query("""SELECT c_custkey, o.orders, l.n_parts, l.first_ship FROM customer LEFT JOIN (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 5 GROUP BY o_custkey) o ON o.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(DISTINCT l_partkey) AS n_parts, min(l_shipdate) AS first_ship FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey) l ON l.o_custkey = c_custkey""")
def drug_detail(spark, sf_dir):
    from pyspark.sql import Window as W

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    rn = F.row_number().over(W.partitionBy("c_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()))
    recent = o.withColumn("rn", rn).filter("rn <= 5").groupBy("c_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("orders"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_shipdate").join(o, "o_orderkey").groupBy("c_custkey").agg(F.countDistinct("l_partkey").alias("n_parts"), F.min("l_shipdate").alias("first_ship"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(recent, "c_custkey", "left").join(line, "c_custkey", "left")


@query("SELECT source AS release_id, count(*) AS n_artifacts, coalesce(sum(octet_length(encode(text))), 0)::BIGINT AS n_bytes, count(DISTINCT sha256(text)) AS n_distinct FROM documents GROUP BY source")
def release_accounting(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("release_id")).agg(F.count(F.lit(1)).alias("n_artifacts"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n_bytes"), F.countDistinct(F.sha2("text", 256)).alias("n_distinct"))


@query("SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS versions FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT l_partkey) > 1")
def immutable_release(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.countDistinct("l_partkey").alias("versions")).filter("versions > 1")


# --- graph ------------------------------------------------------------------------------------

_NODES = """SELECT 'region:' || r_regionkey AS node_id, 'region' AS node_type, r_name AS label, r_regionkey::VARCHAR AS record_id FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, n_nationkey::VARCHAR FROM nation
UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, s_suppkey::VARCHAR FROM supplier UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, c_custkey::VARCHAR FROM customer"""
_EDGES = """SELECT 'nation:' || n_nationkey AS source_id, 'region:' || n_regionkey AS target_id, 'within' AS edge_type FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'based_in' FROM supplier
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'based_in' FROM customer UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'supports' FROM orders WHERE o_orderstatus <> 'P'"""


def graph_edges(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return graph.edges(
        (t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "within"),
        (t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "based_in"),
        (t("customer"), "customer", "c_custkey", "nation", "c_nationkey", "based_in"),
        (t("orders").filter("o_orderstatus <> 'P'"), "order", "o_orderkey", "customer", "o_custkey", "supports"),
    )


@query(_NODES)
def kg_nodes(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return graph.nodes((t("region"), "region", "r_regionkey", "r_name"), (t("nation"), "nation", "n_nationkey", "n_name"), (t("supplier"), "supplier", "s_suppkey", "s_name"), (t("customer"), "customer", "c_custkey", "c_name"))


@query(_EDGES)
def kg_edges(spark, sf_dir):
    return graph_edges(spark, sf_dir)


@query(f"SELECT source_id, target_id, edge_type, (SELECT count(*) > 20 FROM ({_EDGES}) WHERE 'nation:3' IN (source_id, target_id)) AS truncated FROM (SELECT * FROM ({_EDGES}) WHERE 'nation:3' IN (source_id, target_id) ORDER BY edge_type, source_id, target_id LIMIT 20)")
def neighbors(spark, sf_dir):
    return graph.neighbours(graph_edges(spark, sf_dir), "nation:3", limit=20)


@query(f"WITH e AS ({_EDGES}), near AS (SELECT * FROM e WHERE source_id = 'nation:7' OR target_id = 'nation:7') SELECT n.node_id, n.node_type, n.label FROM ({_NODES}) n WHERE n.node_id IN (SELECT source_id FROM near UNION SELECT target_id FROM near)")
def subgraph(spark, sf_dir):
    e = graph_edges(spark, sf_dir).filter((F.col("source_id") == "nation:7") | (F.col("target_id") == "nation:7"))
    ends = e.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    return kg_nodes(spark, sf_dir).join(ends, "node_id", "left_semi").select("node_id", "node_type", "label")


@query(f"WITH RECURSIVE e AS ({_EDGES}), w(node_id, level) AS (SELECT 'region:2', 0 UNION SELECT e.source_id, w.level + 1 FROM w JOIN e ON e.target_id = w.node_id WHERE w.level < 3) SELECT node_id, min(level)::INT AS level FROM w GROUP BY node_id")
def backtrack_graph(spark, sf_dir):
    return graph.backtrack(graph_edges(spark, sf_dir), spark.createDataFrame([("region:2",)], "node_id string"), 3)


# --- prices and routes --------------------------------------------------------------------------


@query("SELECT p.event_id, p.user_id, v.value AS rate FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
def asof_rate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("rate"))
    return top.asof(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "ts", "rate", ["event_id"], width=7 * 86400.0).select("event_id", "user_id", "rate")


_QUOTES = """WITH q AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS quote_id, l_suppkey, ceil(1000 / l_quantity)::BIGINT AS packs, round((ceil(1000 / l_quantity) * l_extendedprice)::DECIMAL(20, 6), 4) AS package_cost, round((1000 / l_quantity * l_extendedprice)::DECIMAL(20, 6), 4) AS continuous_cost FROM lineitem WHERE l_returnflag = 'A')"""


def quotes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("quote_id"), F.col("l_quantity").alias("pack_g"), F.col("l_extendedprice").alias("price"), F.lit(1.0).alias("rate"), F.lit(1000.0).alias("need_g"))


@query(_QUOTES + " SELECT l_partkey, min(package_cost) AS package_cost FROM q GROUP BY l_partkey")
def cheapest_quote(spark, sf_dir):
    return costing.cheapest_quotes(quotes(spark, sf_dir), "l_partkey").select("l_partkey", "package_cost")


@query(_QUOTES + ", b AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY package_cost, quote_id, packs) AS n FROM q) SELECT l_partkey % 50 AS grp, count(*) AS n, sum(package_cost) AS package_cost FROM b WHERE n = 1 GROUP BY 1")
def package_cost(spark, sf_dir):
    best = costing.cheapest_quotes(quotes(spark, sf_dir), "l_partkey")
    return best.groupBy((F.col("l_partkey") % 50).alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.sum("package_cost").alias("package_cost"))


def _leaf_tables(spark, sf_dir, least=1):
    """Suppliers as routes: 1000 g of R<k> are made from A<k> in one step and that from B<k>, of a weight of ``least`` or more, and C."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("r"), "s_suppkey").alias("route"))
    k = F.col("s_suppkey").cast("string")
    name = lambda p: F.concat(F.lit(p), k)
    steps = s.select("route", name("1-").alias("step"), name("R").alias("product"), F.lit(80.0).alias("yield_percent")).unionByName(s.select("route", name("2-").alias("step"), name("A").alias("product"), F.lit(50.0).alias("yield_percent")))
    inputs = s.select(name("1-").alias("step"), name("A").alias("compound"), F.lit(1.0).alias("stoichiometry")).unionByName(s.select(name("2-").alias("step"), name("B").alias("compound"), F.lit(2.0).alias("stoichiometry"))).unionByName(s.select(name("2-").alias("step"), F.lit("C").alias("compound"), F.lit(1.0).alias("stoichiometry")))
    target = s.select("route", name("R").alias("compound"), F.lit(1000.0).alias("mass_g"))
    weights = s.select(name("R").alias("compound"), F.lit(200.0).alias("mw")).unionByName(s.select(name("A").alias("compound"), F.lit(100.0).alias("mw"))).unionByName(s.select(name("B").alias("compound"), (F.col("s_suppkey") % 8 + least).cast("double").alias("mw"))).unionByName(spark.createDataFrame([("C", 16.0)], "compound string, mw double"))
    return steps, inputs, target, weights


@query("SELECT 'r' || s_suppkey AS route, 'B' || s_suppkey AS compound, 1000.0 / 200 / 0.8 / 0.5 * 2 * (s_suppkey % 8) AS mass_g FROM supplier WHERE s_suppkey % 8 > 0 UNION ALL SELECT 'r' || s_suppkey, 'C', 1000.0 / 200 / 0.8 / 0.5 * 16 FROM supplier")
def leaf_requirements(spark, sf_dir):
    return costing.leaf_requirements(*_leaf_tables(spark, sf_dir, 0))


@query("""SELECT 'r' || s_suppkey AS route, '1-' || s_suppkey AS step, NULL::VARCHAR AS compound, 'missing molecular weight or yield' AS reason FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL SELECT 'r' || s_suppkey, '2-' || s_suppkey, 'B' || s_suppkey, 'missing molecular weight or stoichiometry' FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey % 8 = 0""")
def leaf_warnings(spark, sf_dir):
    """What the mass balance of the suppliers' routes cannot tell: every fifth first step has a yield of 0, every eighth B a weight of 0."""
    steps, inputs, target, weights = _leaf_tables(spark, sf_dir, 0)
    lost = F.col("step").startswith("1-") & (F.substr("step", F.lit(3)).cast("bigint") % 5 == 0)
    return costing.mass_balance(steps.withColumn("yield_percent", F.when(lost, 0.0).otherwise(F.col("yield_percent"))), inputs, target, weights)[1]


_ROUTES = """WITH r AS (SELECT l_orderkey AS target, l_orderkey || '-' || l_returnflag AS route, count(*) AS n_steps, sum(l_quantity) AS total_g, sum(CASE WHEN l_discount >= 0.02 THEN l_quantity ELSE 0 END) AS priced_g, sum(l_extendedprice::DECIMAL(18, 2))::DOUBLE AS cost, max(l_quantity) AS max_scale_g, avg(l_linenumber) / 10 AS severity, CASE WHEN min(l_tax) = 0 THEN 0.0 ELSE 0.5 END AS cumulative_yield,
 CASE WHEN max(l_linestatus) = 'O' THEN 1.0 ELSE 0.25 END AS evidence_share, 50.0 AS target_g FROM lineitem GROUP BY 1, 2),
e AS (SELECT *, coalesce(priced_g / nullif(total_g, 0), 0) AS coverage, 100 * (0.30 * least(total_g / target_g / 5, 1) + 0.25 * (1 - cumulative_yield) + 0.15 * least(n_steps / 12, 1) + 0.10 * severity + 0.05 * (1 - evidence_share)) AS relative_cost_index,
 100 * (0.25 * cumulative_yield + 0.15 * (1 - least(n_steps / 12, 1)) + 0.20 * (1 - severity) + 0.15 + 0.15 * least(1, max_scale_g / target_g) + 0.10 * evidence_share) AS feasibility_score FROM r),
t AS (SELECT *, CASE WHEN coverage >= 0.8 THEN cost END AS actual_cost, CASE WHEN coverage >= 0.8 THEN 'cost_complete' ELSE 'cost_incomplete' END AS tier FROM e)"""


def routes_evaluated(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    r = line.groupBy(F.col("l_orderkey").alias("target"), F.concat_ws("-", F.col("l_orderkey").cast("string"), "l_returnflag").alias("route")).agg(
        F.count(F.lit(1)).alias("n_steps"), F.sum("l_quantity").alias("total_g"), F.sum(F.when(F.col("l_discount") >= 0.02, F.col("l_quantity")).otherwise(0)).alias("priced_g"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("cost"),
        F.max("l_quantity").alias("max_scale_g"), (F.avg("l_linenumber") / 10).alias("severity"), F.when(F.min("l_tax") == 0, 0.0).otherwise(0.5).alias("cumulative_yield"), F.when(F.max("l_linestatus") == "O", 1.0).otherwise(0.25).alias("evidence_share"),
    )
    return costing.evaluate(r.withColumn("target_g", F.lit(50.0)))


@query(_ROUTES + " SELECT tier, count(*) AS n, sum(round(relative_cost_index::DECIMAL(18, 6), 2))::DECIMAL(28, 2) AS relative, sum(round(feasibility_score::DECIMAL(18, 6), 2))::DECIMAL(28, 2) AS feasible, sum(actual_cost::DECIMAL(18, 2))::DECIMAL(28, 2) AS cost FROM t GROUP BY tier")
def route_evaluation(spark, sf_dir):
    two = lambda c: F.sum(F.round(F.col(c).cast("decimal(18,6)"), 2)).cast("decimal(28,2)")
    return routes_evaluated(spark, sf_dir).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), two("relative_cost_index").alias("relative"), two("feasibility_score").alias("feasible"), F.sum(F.col("actual_cost").cast("decimal(18,2)")).cast("decimal(28,2)").alias("cost"))


@query(_ROUTES + """, w AS (SELECT *, min(actual_cost) OVER (PARTITION BY target) AS lo, max(actual_cost) OVER (PARTITION BY target) AS hi FROM t),
s AS (SELECT *, round((CASE WHEN tier = 'cost_complete' THEN 0.5 * (CASE WHEN hi > lo THEN 100 * (actual_cost - lo) / (hi - lo) ELSE 0 END) + 0.5 * (100 - feasibility_score) ELSE 100 - feasibility_score END)::DECIMAL(18, 6), 4) AS score FROM w)
SELECT target, route, tier, score, row_number() OVER (PARTITION BY target ORDER BY tier, score, route) AS rank FROM s""")
def route_rank(spark, sf_dir):
    out = costing.rank(routes_evaluated(spark, sf_dir), ["target"]).withColumn("score", F.round(F.col("rank_score").cast("decimal(18,6)"), 4))
    return out.select("target", "route", "tier", "score", F.row_number().over(W.partitionBy("target").orderBy("tier", "score", "route")).alias("rank"))


@query("SELECT 'M' || s_nationkey AS compound, 1 AS n_steps, count(*) AS n FROM supplier GROUP BY s_nationkey")
def route_enumeration(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    reactions = s.select(F.concat(F.lit("x"), "s_suppkey").alias("reaction"), F.concat(F.lit("M"), "s_nationkey").alias("product"), F.lit(0.9).alias("confidence"))
    inputs = s.select(F.concat(F.lit("x"), "s_suppkey").alias("reaction"), F.concat(F.lit("S"), "s_suppkey").alias("compound"))
    starting, target = inputs.select("compound"), reactions.select(F.col("product").alias("compound")).distinct()
    return routes.enumerate_routes(reactions, inputs, starting, target, top=1 << 30).groupBy("compound", "n_steps").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH y AS (SELECT n_regionkey AS r, 'z' || n_nationkey || '>y' || n_nationkey AS path FROM nation),
a AS (SELECT 'M' || s_nationkey AS compound, path || '>x' || s_suppkey AS path, 3 AS n_steps, 1.5::DOUBLE AS confidence FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN y ON r = n_regionkey
      UNION ALL SELECT 'M' || s_nationkey, 'w' || s_suppkey, 1, 0.125 FROM supplier WHERE s_acctbal < 0),
i AS (SELECT *, 'route:' || substr(sha256(compound || '|' || path), 1, 24) AS route_id FROM a),
n AS (SELECT *, count(*) OVER (PARTITION BY compound) AS n_routes, row_number() OVER (PARTITION BY compound ORDER BY n_steps, confidence DESC, route_id) AS rn FROM i)
SELECT compound, path, n_steps, confidence, route_id, n_routes FROM n WHERE rn <= 10""")
def route_enumeration_top(spark, sf_dir):
    """The ten best routes to each nation's product and the number of all: from each supplier's material and one of the intermediates of the region, made in two steps; or from the material alone."""
    return routes.enumerate_routes(*_network(spark, sf_dir))


def _network(spark, sf_dir):
    """Reactions, inputs, starting materials and targets of ``route_enumeration_top``."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey")
    n = table(spark, sf_dir, "nation")
    name = lambda prefix, key: F.concat(F.lit(prefix), key)
    made = lambda t, reaction, product, confidence: t.select(reaction.alias("reaction"), product.alias("product"), F.lit(confidence).alias("confidence"))
    uses = lambda t, reaction, compound: t.select(reaction.alias("reaction"), compound.alias("compound"))
    x, w, y, z = name("x", "s_suppkey"), name("w", "s_suppkey"), name("y", "n_nationkey"), name("z", "n_nationkey")
    material, short = name("S", "s_suppkey"), s.filter("s_acctbal < 0")
    reactions = made(s, x, name("M", "s_nationkey"), 0.75).unionByName(made(short, w, name("M", "s_nationkey"), 0.125)).unionByName(made(n, y, name("P", "n_regionkey"), 0.5)).unionByName(made(n, z, name("Q", "n_nationkey"), 0.25))
    inputs = uses(s, x, material).unionByName(uses(s, x, name("P", "n_regionkey"))).unionByName(uses(short, w, material)).unionByName(uses(n, y, name("Q", "n_nationkey"))).unionByName(uses(n, y, F.lit("S0"))).unionByName(uses(n, z, name("B", "n_nationkey")))
    starting = s.select(material.alias("compound")).unionByName(n.select(name("B", "n_nationkey").alias("compound"))).unionByName(n.select(F.lit("S0").alias("compound")))
    return reactions, inputs, starting, s.select(name("M", "s_nationkey").alias("compound"))


@query("""WITH y AS (SELECT n_regionkey AS r, n_nationkey AS n, 'z' || n_nationkey || '>y' || n_nationkey AS path FROM nation),
a AS (SELECT 'M' || s_nationkey AS compound, path || '>x' || s_suppkey AS path, 3 AS n_steps, 1.5::DOUBLE AS confidence, s_suppkey AS k, y.n AS b FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN y ON r = n_regionkey
      UNION ALL SELECT 'M' || s_nationkey, 'w' || s_suppkey, 1, 0.125, s_suppkey, NULL FROM supplier WHERE s_acctbal < 0),
i AS (SELECT *, 'route:' || substr(sha256(compound || '|' || path), 1, 24) AS route_id FROM a), t AS (SELECT *, row_number() OVER (PARTITION BY compound ORDER BY n_steps, confidence DESC, route_id) AS rn FROM i),
q AS (SELECT compound, path, n_steps, 'route-' || substr(sha256(route_id || '|1000.0|USD|2024-05-01'), 1, 16) AS route, k, b, CASE n_steps WHEN 3 THEN 1000 / 0.8 ELSE 1000 / 0.6 END AS need_s, CASE n_steps WHEN 3 THEN 1000 / 0.8 / 0.5 / 0.9 ELSE 0 END AS need_b, CASE n_steps WHEN 3 THEN 1000 / 0.8 / 0.5 ELSE 0 END AS need_0,
 CASE n_steps WHEN 3 THEN 0.36 ELSE 0.6 END AS yield, CASE n_steps WHEN 3 THEN 1.0 ELSE 0.1 END AS scale, CASE WHEN n_steps = 1 THEN 0.0 WHEN k % 4 = 0 THEN 2 / 3.0 ELSE 1.0 END AS evidence FROM t WHERE rn <= 10),
p AS (SELECT *, need_s + need_b + need_0 AS total, ceil(need_s / 1000) * (10 + k % 7) + CASE WHEN n_steps = 3 THEN ceil(need_0 / 1000) * 5 ELSE 0 END + CASE WHEN b % 5 > 0 THEN ceil(need_b / 100) * 2 ELSE 0 END AS cost FROM q),
e AS (SELECT *, (total - CASE WHEN b % 5 = 0 THEN need_b ELSE 0 END) / total AS coverage, 100 * (0.25 * yield + 0.15 * (1 - n_steps / 12.0) + 0.20 + 0.15 + 0.15 * scale + 0.10 * evidence) AS f FROM p),
c AS (SELECT *, CASE WHEN coverage >= 0.8 THEN cost END AS actual FROM e), w AS (SELECT *, min(actual) OVER (PARTITION BY compound) AS lo, max(actual) OVER (PARTITION BY compound) AS hi FROM c),
z AS (SELECT *, CASE WHEN actual IS NULL THEN 100 - f ELSE 0.5 * CASE WHEN hi > lo THEN 100 * (actual - lo) / (hi - lo) ELSE 0 END + 0.5 * (100 - f) END AS score FROM w)
SELECT compound, path, route, n_steps, CASE WHEN actual IS NULL THEN 'cost_incomplete' ELSE 'cost_complete' END AS tier, round(coverage::DECIMAL(18, 9), 4) AS coverage, round(actual::DECIMAL(18, 6), 4) AS actual_cost, round(score::DECIMAL(18, 9), 4) AS rank_score, row_number() OVER (PARTITION BY compound ORDER BY actual IS NULL, round(score, 6), route) AS rank FROM z""")
def route_generation(spark, sf_dir):
    """1000 g of each nation's product: routes found, priced, scored, ranked, published and read back."""
    reactions, inputs, starting, target = _network(spark, sf_dir)
    c = F.col
    kind, k = F.substring("reaction", 1, 1), F.substr("reaction", F.lit(2)).cast("bigint")
    pick = lambda **v: F.coalesce(*[F.when(kind == n, F.lit(x)) for n, x in v.items()])
    paper = F.when((kind == "x") & (k % 4 != 0), "US-1-A1").when(kind.isin("y", "z"), "US-2-A1")
    reactions = reactions.withColumns({"yield_percent": pick(x=80.0, w=60.0, y=50.0, z=90.0), "scale_g": pick(x=500.0, w=100.0, y=2000.0), "publication": paper, "is_synthetic": F.lit(False)})
    material, j = F.substring("compound", 1, 1), F.substr("compound", F.lit(2)).cast("bigint")
    price = F.when(c("compound") == "S0", 5.0).when(material == "S", 10.0 + j % 7).when(j % 5 > 0, 2.0)
    quotes = starting.distinct().select("compound", F.concat(F.lit("q"), "compound").alias("quote_id"), F.lit(1.0).alias("pack_value"), F.when(material == "B", "hg").otherwise("kg").alias("pack_unit"), price.alias("price"), F.lit("USD").alias("currency"), F.lit("accepted").alias("status")).filter("price is not null")
    quotes = quotes.withColumns({"pack_value": F.when(c("pack_unit") == "hg", 100.0).otherwise(1.0), "pack_unit": F.when(c("pack_unit") == "hg", "g").otherwise("kg")})
    compounds = inputs.select("compound").unionByName(reactions.select(c("product").alias("compound"))).distinct()
    none = lambda schema: spark.createDataFrame([], schema)
    network = {
        "reactions": reactions, "inputs": inputs.withColumn("stoichiometry", F.lit(1.0)), "starting": starting, "weights": compounds.withColumn("mw", F.lit(100.0)), "quotes": quotes,
        "rates": none("rate_date string, base string, quote string, rate double"), "participants": inputs, "hazards": none("compound string, severity double, status string"),
    }
    out = routes.request(network, target.distinct().withColumn("mass_g", F.lit(1000.0)), "USD", "2024-05-01")
    root = f"{shared_folder(spark)}/routes-{uuid.uuid4().hex}"
    routes.store(spark, root, out)
    found = release.read(spark, root, "route_candidate").join(release.read(spark, root, "route_evaluation"), "route")
    four = lambda n, d=9: F.round(c(n).cast(f"decimal(18,{d})"), 4).alias(n)
    by = W.partitionBy("compound").orderBy("tier", F.round("rank_score", 6), "route")
    return found.select("compound", "path", "route", "n_steps", "tier", four("coverage"), four("actual_cost", 6), four("rank_score"), F.row_number().over(by).alias("rank"))


@query("""WITH p AS (SELECT a.l_orderkey, a.n AS hs, b.n AS bs, a.m AS hm, b.m AS bm, a.y AS hy, b.y AS by_, a.t AS t, a.n % 3 AS u FROM (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS m, max(l_discount) AS y, min(l_tax) AS t FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS m, max(l_discount) AS y FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b USING (l_orderkey)),
d AS (SELECT *, (bs > hs)::INT + (bm > hm)::INT + (hy - by_ > 1e-9)::INT AS better, (bs < hs)::INT + (bm < hm)::INT + (by_ - hy > 1e-9)::INT AS worse, CASE WHEN t = 0 THEN 'rejected' WHEN t < 0.02 OR u = 2 THEN 'needs_validation' ELSE 'eligible' END AS gate FROM p)
SELECT gate, CASE WHEN gate <> 'eligible' THEN 'blocked_validation' WHEN better > 0 AND worse = 0 THEN 'improved' WHEN worse > 0 AND better = 0 THEN 'not_improved' ELSE 'mixed' END AS verdict, count(*) AS n FROM d GROUP BY ALL""")
def route_compare(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    side = lambda flag, p: line.filter(F.col("l_returnflag") == flag).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias(f"{p}_step_count"), F.sum("l_quantity").alias(f"{p}_process_mass_intensity"), F.max("l_discount").alias(f"{p}_yield"), F.min("l_tax").alias(f"{p}_t"))
    none = F.lit(None).cast("double")
    pairs = side("A", "hyp").join(side("R", "base"), "l_orderkey").withColumns({f"{p}_{m}": none for p in ("hyp", "base") for m in ("hazard_score", "material_cost_per_kg")})
    t = F.col("hyp_t")
    pairs = pairs.withColumns({"checks": F.array(t > 0, F.when(t >= 0.02, True)), "unsupported": F.when(F.col("hyp_step_count") % 3 == 2, 1).otherwise(0)})
    return costing.compare(pairs).groupBy("gate", "verdict").agg(F.count(F.lit(1)).alias("n"))


# --- review, pages, jobs --------------------------------------------------------------------------

@query("""WITH s AS (SELECT p_brand AS entity, p_size AS family, p_partkey AS publication, (length(lower(p_name)) >= 5 AND contains(' ' || trim(regexp_replace(lower(p_type || ' ' || p_name), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ' '))::INT AS tm,
 -(contains(lower(p_type), 'std')::INT + contains(lower(p_type), 'eco')::INT) AS neg, p_retailprice FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY entity, family ORDER BY tm DESC, neg DESC, p_retailprice DESC, publication DESC) AS n FROM s), g AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY tm DESC, neg DESC, p_retailprice DESC, publication DESC) AS m FROM f WHERE n = 1)
SELECT entity, family, publication, tm AS title_match, neg AS negative_hits FROM g WHERE m = 1""")
def pilot_queue(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    title, phrase = S.normalize_name(F.concat_ws(" ", "p_type", "p_name")), S.normalize_name(F.col("p_name"))
    scores = review.queue_scores(title, F.array(phrase), ("std", "eco"), ("synth", "process"), ("synth", "prepar"))
    c = p.select(F.col("p_brand").alias("entity"), F.col("p_size").alias("family"), F.col("p_partkey").alias("publication"), "p_retailprice", *[v.alias(k) for k, v in scores.items()])
    order = [F.col(x).desc() for x in ("title_match", "direct", "negative_hits", "route_hits", "p_retailprice", "publication")]
    return review.pilot_queue(c, "entity", "family", order).select("entity", "family", "publication", "title_match", "negative_hits")


@query("WITH b AS (SELECT min_by(o_orderkey, struct_pack(p := o_totalprice, k := o_orderkey)) AS o_orderkey, min(o_totalprice) AS o_totalprice FROM orders GROUP BY o_orderpriority), a AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b) AND o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT (SELECT 100 - count(*) FROM b)) SELECT * FROM b UNION ALL SELECT * FROM a")
def review_batch(spark, sf_dir):
    """A batch of 100: the cheapest order of each priority is fixed, and the dearest finished ones fill it."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    fixed = o.groupBy("o_orderpriority").agg(F.min(F.struct("o_totalprice", "o_orderkey")).alias("r")).select("r.o_orderkey", "r.o_totalprice")
    return review.batch(fixed, o.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), 100, "o_orderkey", [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])


@query("SELECT conv_id, turn, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start, (coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text))::BIGINT AS char_end FROM conversations")
def page_offsets(spark, sf_dir):
    return review.page_offsets(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("SELECT *, CASE WHEN n_text >= greatest(1000, 100 * n_pages) AND n_with_text * 10 >= 8 * n_pages THEN 'text_extraction' ELSE 'ocr' END AS route FROM (SELECT conv_id, count(*) AS n_pages, sum(length(t))::BIGINT AS n_text, count(*) FILTER (length(t) > 0) AS n_with_text FROM (SELECT conv_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations UNION ALL SELECT conv_id, '' FROM conversations WHERE turn % 2 = 0) GROUP BY conv_id)")
def pdf_routing(spark, sf_dir):
    """Conversations as documents and turns as pages, every other one followed by a page of white space."""
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    blank = pages.filter("turn % 2 = 0").select("conv_id", F.lit("\n\t \r\n").alias("text"))
    return review.pdf_routing(pages.select("conv_id", "text").unionByName(blank), "conv_id", "text", pages)


@query("SELECT user_id, max_by(event_type, struct_pack(ts := ts, event_id := event_id)) AS status, count(*) FILTER (event_type = 'click') AS attempts, count(*) AS n_events FROM events GROUP BY user_id")
def job_state(spark, sf_dir):
    return review.job_state(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", "click")


@query("WITH s AS (SELECT user_id, max_by(event_type, struct_pack(ts := ts, event_id := event_id)) AS status FROM events GROUP BY user_id) SELECT status, count(*) AS n FROM s GROUP BY status")
def job_exceptions(spark, sf_dir):
    return job_state(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --- merges ------------------------------------------------------------------------------------


def versions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_type") != "view", F.col("value")).alias("value"))
    return e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")


_VERSIONS = "WITH v AS (SELECT user_id, event_id, event_type, CASE WHEN event_type <> 'view' THEN value END AS value FROM events)"


@query(_VERSIONS + " SELECT user_id, max_by(event_type, event_id) AS event_type, arg_max_null(value, event_id) AS value FROM v GROUP BY user_id")
def merge_overwrite(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    return merge.merge(old.unionByName(new), ["user_id"], ["event_id"], {})


@query(_VERSIONS + " SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) FILTER (value IS NOT NULL) AS value FROM v GROUP BY user_id")
def merge_coalesce_new(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    return merge.merge(old.unionByName(new), ["user_id"], ["event_id"], {"value": merge.NEW_UNLESS_NULL})


@query(_VERSIONS + " SELECT user_id, min_by(event_type, event_id) AS event_type, min_by(value, event_id) FILTER (value IS NOT NULL) AS value FROM v GROUP BY user_id")
def merge_coalesce_old(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    return merge.merge(old.unionByName(new), ["user_id"], ["event_id"], {"value": merge.OLD_UNLESS_NULL}, merge.FROZEN)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0 UNION ALL SELECT o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) WHERE n = 1")
def insert_ignore(spark, sf_dir):
    old = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"), "o_orderkey")
    return merge.insert_ignore(old, new, ["c_custkey"], "o_orderkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')) WHERE n = 1")
def insert_ignore_by_segment(spark, sf_dir):
    old = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_mktsegment")
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"), "o_orderkey")
    return merge.insert_ignore(old, new, ["c_custkey"], "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') UNION ALL SELECT l_orderkey, l_linenumber + 100, l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def delete_insert(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    new = line.filter("l_returnflag = 'A'").select("l_orderkey", (F.col("l_linenumber") + 100).alias("l_linenumber"), "l_partkey")
    return merge.replace_children(line.select("l_orderkey", "l_linenumber", "l_partkey"), new, ["l_orderkey"])


@query("SELECT c_custkey, c_name, CASE WHEN o IS NULL THEN c_mktsegment ELSE o END AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS o FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) ON o_custkey = c_custkey")
def keyed_update(spark, sf_dir):
    changes = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_mktsegment"))
    return merge.update_where(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), changes, ["c_custkey"], ["c_mktsegment"])


# --- converters, look-ups, keep rules ------------------------------------------------------------------


def _outcomes(df):
    return df.groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("""SELECT outcome, reason, count(*) AS n, min(id) AS first_id FROM (SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'excluded' WHEN p_brand LIKE '%1' THEN 'excluded' WHEN length(p_name) < 9 THEN 'rejected' ELSE 'accepted' END AS outcome,
CASE WHEN p_size % 5 = 0 THEN 'not_approved' WHEN p_brand LIKE '%1' THEN 'not_small_molecule' WHEN length(p_name) < 9 THEN 'missing_key' END AS reason FROM part) GROUP BY ALL""")
def converter_pubchem(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return _outcomes(review.convert(p, [("excluded", "not_approved", F.col("p_size") % 5 == 0), ("excluded", "not_small_molecule", F.col("p_brand").endswith("1")), ("rejected", "missing_key", F.length("p_name") < 9)], [F.col("p_partkey").alias("id")]))


@query("SELECT s_suppkey, 'UNICHEM_SOURCE_' || upper(regexp_replace(s_nationkey::VARCHAR || ' x', '[^A-Za-z0-9]+', '_', 'g')) AS namespace, s_name AS value FROM supplier WHERE s_name IS NOT NULL")
def converter_unichem(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    out = review.convert(s, [("rejected", "missing_identifier", F.col("s_name").isNull())], ["s_suppkey", F.concat(F.lit("UNICHEM_SOURCE_"), S.namespace(F.concat(F.col("s_nationkey").cast("string"), F.lit(" x")))).alias("namespace"), F.col("s_name").alias("value")])
    return out.filter("outcome = 'accepted'").select("s_suppkey", "namespace", "value")


@query("SELECT c_custkey, trim(x) AS substance FROM (SELECT c_custkey, unnest(string_split(c_mktsegment || ';' || c_name, ';')) AS x FROM customer WHERE c_nationkey <> 3 AND c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY')")
def converter_ema(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rules = [("excluded", "not_human_medicine", F.col("c_nationkey") == 3), ("excluded", "not_authorised", F.col("c_acctbal") < 0), ("excluded", "biologic_or_advanced_therapy", F.col("c_mktsegment") == "MACHINERY")]
    out = review.convert(c, rules, ["c_custkey", S.split_list(F.concat_ws(";", "c_mktsegment", "c_name"), "[|;]").alias("substances")])
    return out.filter("outcome = 'accepted'").select("c_custkey", F.explode("substances").alias("substance"))


@query("""WITH q AS (SELECT n_nationkey, lower(n_name) AS t FROM nation), c AS (SELECT n_nationkey, 1 AS stage, s_suppkey AS hit, length(s_name) AS len FROM q JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 8000 UNION ALL SELECT n_nationkey, 2, c_custkey, length(c_name) FROM q JOIN customer ON c_nationkey = n_nationkey)
SELECT n_nationkey, stage, hit FROM (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY stage, len, hit) AS n FROM c) WHERE n = 1""")
def target_resolve(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(1).alias("stage"), F.col("s_suppkey").alias("hit"), F.length("s_name").alias("len"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.lit(2).alias("stage"), F.col("c_custkey").alias("hit"), F.length("c_name").alias("len"))
    return top.first_stage(s.unionByName(c), ["n_nationkey"], "stage", [F.col("len").asc(), F.col("hit").asc()]).select("n_nationkey", "stage", "hit")


@query("SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def dedupe_last_wins(spark, sf_dir):
    return merge.merge(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.col("event_id").alias("seq")), ["user_id", "event_type"], ["seq"], {})


@query("SELECT p_brand, lower(p_name) AS name, min(p_partkey) AS p_partkey FROM part GROUP BY ALL")
def dedupe_first_ci(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.lower("p_name").alias("name"), "p_partkey", F.col("p_partkey").alias("seq"))
    return merge.merge(p, ["p_brand", "name"], ["seq"], {}, merge.FROZEN)


@query()
def manifest_listing(spark, sf_dir):
    """Path, size and digest of every file of the release, and its media type."""
    found = files.manifest(spark, sf_dir)
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "size_bytes", "sha256", S.media_type(F.col("path")).alias("media_type"))
