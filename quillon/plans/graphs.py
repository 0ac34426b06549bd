"""Queries of the knowledge graph; trade between customers, nations, suppliers and parts plays the facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.catalogue import register
from quillon.operators import graph as G
from quillon.plans.common import table

# Node numbers: nations n, regions 100 + n, customers 1000 + n.
_EDGES = """edges AS (
  SELECT n_nationkey::BIGINT AS id, n_nationkey::BIGINT AS src, 'PART_OF' AS rel, 100 + n_regionkey::BIGINT AS dst, 0.9::DOUBLE AS conf, true AS active, n_nationkey % 7 AS chunk FROM nation
  UNION ALL SELECT 1000000000 + c_custkey, 1000 + c_custkey, 'IS_A', c_nationkey::BIGINT, 0.4::DOUBLE + (c_custkey % 6) / 10::DOUBLE, c_acctbal > 0, c_custkey % 50 FROM customer
  UNION ALL SELECT 100000 + s_suppkey, s_nationkey::BIGINT, 'PARTNERS_WITH', ((s_nationkey + s_suppkey) % 25)::BIGINT, 0.5::DOUBLE, s_acctbal > 0, s_suppkey % 50 FROM supplier WHERE (s_nationkey + s_suppkey) % 25 <> s_nationkey)"""


def _edges(spark, sf_dir):
    d = lambda c: c.cast("double")
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_nationkey").cast("long").alias("src"), F.lit("PART_OF").alias("rel"), (100 + F.col("n_regionkey")).cast("long").alias("dst"),
        F.lit(0.9).alias("conf"), F.lit(True).alias("active"), (F.col("n_nationkey") % 7).cast("long").alias("chunk"),
    )
    customer = table(spark, sf_dir, "customer").select(
        (1000000000 + F.col("c_custkey")).alias("id"), (1000 + F.col("c_custkey")).alias("src"), F.lit("IS_A").alias("rel"), F.col("c_nationkey").cast("long").alias("dst"),
        (0.4 + d(F.col("c_custkey") % 6) / 10).alias("conf"), (F.col("c_acctbal") > 0).alias("active"), (F.col("c_custkey") % 50).alias("chunk"),
    )
    other = (F.col("s_nationkey") + F.col("s_suppkey")) % 25
    supplier = table(spark, sf_dir, "supplier").where(other != F.col("s_nationkey")).select(
        (100000 + F.col("s_suppkey")).alias("id"), F.col("s_nationkey").cast("long").alias("src"), F.lit("PARTNERS_WITH").alias("rel"), other.cast("long").alias("dst"),
        F.lit(0.5).alias("conf"), (F.col("s_acctbal") > 0).alias("active"), (F.col("s_suppkey") % 50).alias("chunk"),
    )
    return nation.unionByName(customer).unionByName(supplier)


_BOTH = "both_ways AS (SELECT DISTINCT src AS node, dst AS nxt FROM edges UNION SELECT dst, src FROM edges)"
_REACH = f"""{_EDGES}, {_BOTH}, s0 AS (SELECT seed FROM (VALUES (3), (8)) AS v(seed)),
  h1 AS (SELECT DISTINCT seed, nxt AS node FROM s0 JOIN both_ways ON seed = node WHERE nxt <> seed),
  h2 AS (SELECT DISTINCT seed, b.nxt AS node FROM h1 JOIN both_ways b USING (node) WHERE b.nxt <> seed AND (seed, b.nxt) NOT IN (SELECT (seed, node) FROM h1)),
  reached AS (SELECT seed, seed AS node, 0 AS dist FROM s0 UNION ALL SELECT seed, node, 1 FROM h1 UNION ALL SELECT seed, node, 2 FROM h2)"""


def _seeds(spark):
    return spark.createDataFrame([(3,), (8,)], "seed long")


@register("graph_edges", f"WITH {_EDGES} SELECT node, other, count(*) AS n FROM (SELECT src AS node, dst AS other FROM edges WHERE active UNION ALL SELECT dst, src FROM edges WHERE active) GROUP BY ALL")
def graph_edges(spark, sf_dir):
    return G.incident(_edges(spark, sf_dir), active_only=True).groupBy("node", "other").agg(F.count(F.lit(1)).alias("n"))


@register("graph_edges_out", f"WITH {_EDGES} SELECT node, count(*) AS n FROM (SELECT src AS node, id FROM edges UNION ALL SELECT dst, id FROM edges WHERE rel = 'PARTNERS_WITH') GROUP BY node")
def graph_edges_out(spark, sf_dir):
    return G.incident(_edges(spark, sf_dir), "out", symmetric=["PARTNERS_WITH"]).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@register("degree", f"WITH {_EDGES} SELECT node, count(*) AS degree, count(*) FILTER (active) AS active_degree FROM (SELECT src AS node, active FROM edges UNION ALL SELECT dst, active FROM edges) GROUP BY node")
def degree(spark, sf_dir):
    return G.incident(_edges(spark, sf_dir)).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.count_if("active").alias("active_degree"))


@register("k_hop", f"WITH {_REACH} SELECT seed::BIGINT AS seed, node, dist FROM reached")
def k_hop(spark, sf_dir):
    return G.reach(_edges(spark, sf_dir), _seeds(spark), 2)


@register("bridge_nodes", f"WITH {_REACH} SELECT node, count(DISTINCT seed) AS n_seeds FROM reached WHERE dist > 0 GROUP BY node HAVING count(DISTINCT seed) >= 2")
def bridge_nodes(spark, sf_dir):
    return G.bridges(G.reach(_edges(spark, sf_dir), _seeds(spark), 2))


@register(
    "graph_search",
    f"""WITH {_REACH}, br AS (SELECT node FROM reached WHERE dist > 0 GROUP BY node HAVING count(DISTINCT seed) >= 2), near AS (SELECT node, min(dist) AS d FROM reached WHERE dist <= 1 GROUP BY node),
    t AS (SELECT e.chunk, e.conf, e.rel, least(a.d, b.d) AS d, (a.d IS NOT NULL AND src IN (SELECT node FROM br)) OR (b.d IS NOT NULL AND dst IN (SELECT node FROM br)) AS bridge FROM edges e LEFT JOIN near a ON src = a.node LEFT JOIN near b ON dst = b.node WHERE a.d IS NOT NULL OR b.d IS NOT NULL),
    w AS (SELECT chunk, conf / (1 + d) * CASE WHEN rel = 'PARTNERS_WITH' THEN 1.5::DOUBLE ELSE 1::DOUBLE END * CASE WHEN bridge THEN 1.3::DOUBLE ELSE 1::DOUBLE END * CASE WHEN d = 0 THEN 1.3::DOUBLE ELSE 1::DOUBLE END AS w FROM t)
    SELECT chunk, round(sum(w), 6) AS score FROM w WHERE w >= 0.12 GROUP BY chunk""",
)
def graph_search(spark, sf_dir):
    return G.chunk_scores(_edges(spark, sf_dir), _seeds(spark), ["PARTNERS_WITH"])


@register("adjacency_weights", f"WITH {_EDGES}, a AS (SELECT src AS u, dst AS v, conf * CASE WHEN rel IN ('IS_A', 'VARIANT_OF') THEN 0.5::DOUBLE ELSE 1::DOUBLE END * CASE WHEN active THEN 1::DOUBLE ELSE 0.6::DOUBLE END AS w FROM edges) SELECT u, v, round(sum(w), 6) AS w FROM (SELECT * FROM a UNION ALL SELECT v, u, w FROM a) GROUP BY ALL")
def adjacency_weights(spark, sf_dir):
    return G.adjacency(_edges(spark, sf_dir)).select("u", "v", F.round("w", 6).alias("w"))


_STEPS = f"""{_EDGES}, st AS (SELECT src AS x, dst AS y FROM edges UNION SELECT dst, src FROM edges),
  goals AS (SELECT 100 + r_regionkey::BIGINT AS goal FROM region),
  w AS (SELECT goal, y AS node, 1 AS n FROM goals JOIN st ON x = goal),
  v AS (SELECT goal, st.y AS node, 2 AS n FROM w JOIN st ON x = node UNION SELECT * FROM w),
  u AS (SELECT goal, st.y AS node, 3 AS n FROM v JOIN st ON x = node WHERE v.n = 2 UNION SELECT * FROM v)"""


@register("shortest_path", f"WITH {_STEPS} SELECT goal, node, min(n)::INT AS n FROM u WHERE node <> goal GROUP BY ALL")
def shortest_path(spark, sf_dir):
    """How many edges a shortest path of at most three has from every region to each node that it reaches."""
    goals = table(spark, sf_dir, "region").select((100 + F.col("r_regionkey")).cast("long").alias("seed"))
    return G.reach(_edges(spark, sf_dir), goals, 3).where("dist > 0").select(F.col("seed").alias("goal"), "node", F.col("dist").alias("n"))


@register("timeline", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END, ''), o_orderstatus, o_orderkey)::INT AS position FROM orders")
def timeline(spark, sf_dir):
    from pyspark.sql import Window

    day = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd"))
    w = Window.partitionBy("o_custkey").orderBy(F.coalesce(day, F.lit("")), "o_orderstatus", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("position"))


@register("best_fact_per_triple", "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY (l_shipdate IS NOT NULL)::INT DESC, l_discount DESC, l_orderkey, l_linenumber) = 1")
def best_fact_per_triple(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_discount")
    return G.best_by(rows, ["l_partkey", "l_suppkey"], F.desc(F.col("l_shipdate").isNotNull().cast("int")), F.desc("l_discount"), F.asc("l_orderkey"), F.asc("l_linenumber")).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@register("conflict_resolution", "SELECT l_partkey AS src, 'SHIPS' AS rel, l_suppkey AS dst, count(DISTINCT l_shipdate::DATE) AS n_days, arg_max(l_shipdate::DATE, (1 - l_discount, l_shipdate::DATE))::VARCHAR AS day, max(1 - l_discount) AS authority FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_shipdate::DATE) >= 2 AND count(DISTINCT l_orderkey) >= 2")
def conflict_resolution(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lit("SHIPS").alias("rel"), F.col("l_suppkey").alias("dst"), F.col("l_orderkey").alias("doc"), F.to_date("l_shipdate").alias("day"), (1 - F.col("l_discount")).alias("authority"))
    return G.conflicts(facts).withColumn("day", F.col("day").cast("string"))


_LEGAL = "(VALUES ('RELEASED', 'ORG', 'MODEL'), ('PARTNERS_WITH', 'ORG', 'ORG'), ('USES', 'MODEL', 'TECH')) AS o(rel, dom, rng)"
_CLAIMED = "(VALUES (1, 'a', 'ORG', 'RELEASED', 'b', 'MODEL'), (2, 'a', 'ORG', 'RELEASED', 'c', 'ORG'), (3, 'a', 'ORG', 'PARTNERS_WITH', 'a', 'ORG'), (4, 'b', 'MODEL', 'USES', 'd', 'TECH')) AS f(id, src, st, rel, dst, dt)"


@register("relation_constraint", f"SELECT id FROM {_CLAIMED} JOIN {_LEGAL} USING (rel) WHERE st = dom AND dt = rng AND src <> dst")
def relation_constraint(spark, sf_dir):
    legal = spark.createDataFrame([("RELEASED", "ORG", "MODEL"), ("PARTNERS_WITH", "ORG", "ORG"), ("USES", "MODEL", "TECH")], "rel string, dom string, rng string")
    rows = [(1, "a", "ORG", "RELEASED", "b", "MODEL"), (2, "a", "ORG", "RELEASED", "c", "ORG"), (3, "a", "ORG", "PARTNERS_WITH", "a", "ORG"), (4, "b", "MODEL", "USES", "d", "TECH")]
    facts = spark.createDataFrame(rows, "id int, src string, st string, rel string, dst string, dt string")
    return facts.join(F.broadcast(legal), "rel").where("st = dom and dt = rng and src != dst").select("id")


@register("confidence_floor", "SELECT l_orderkey, l_linenumber, round((1 - l_discount) * (0.6::DOUBLE + 0.4::DOUBLE * (l_quantity / 50)), 6) AS conf FROM lineitem WHERE round((1 - l_discount) * (0.6::DOUBLE + 0.4::DOUBLE * (l_quantity / 50)), 6) >= 0.5")
def confidence_floor(spark, sf_dir):
    conf = F.round((1 - F.col("l_discount")) * (0.6 + 0.4 * (F.col("l_quantity") / 50)), 6)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", conf.alias("conf")).where("conf >= 0.5")


@register("mention_pairs", "SELECT l_orderkey, l_linenumber, l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem QUALIFY b IS NOT NULL")
def mention_pairs(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("a"), F.lead("l_partkey").over(w).alias("b")).where("b is not null")


@register(
    "graph_search_batch",
    f"""WITH {_EDGES}, {_BOTH}, s0 AS (SELECT n_regionkey::BIGINT AS query, n_nationkey::BIGINT AS seed FROM nation),
    h1 AS (SELECT DISTINCT query, seed, nxt AS node FROM s0 JOIN both_ways ON seed = node WHERE nxt <> seed),
    h2 AS (SELECT DISTINCT query, seed, b.nxt AS node FROM h1 JOIN both_ways b USING (node) WHERE b.nxt <> seed),
    near AS (SELECT query, node, min(d) AS d FROM (SELECT query, seed AS node, 0 AS d FROM s0 UNION ALL SELECT query, node, 1 FROM h1) GROUP BY ALL),
    br AS (SELECT query, node FROM (SELECT * FROM h1 UNION SELECT * FROM h2) GROUP BY ALL HAVING count(DISTINCT seed) >= 2),
    t AS (SELECT query, id, any_value(chunk) AS chunk, any_value(conf) AS conf, any_value(rel) AS rel, min(d) AS d, bool_or((query, node) IN (SELECT (query, node) FROM br)) AS bridge FROM (SELECT src AS node, * FROM edges UNION SELECT dst, * FROM edges) JOIN near USING (node) GROUP BY query, id),
    w AS (SELECT query, chunk, conf / (1 + d) * CASE WHEN rel = 'PARTNERS_WITH' THEN 1.5::DOUBLE ELSE 1::DOUBLE END * CASE WHEN bridge THEN 1.3::DOUBLE ELSE 1::DOUBLE END * CASE WHEN d = 0 THEN 1.3::DOUBLE ELSE 1::DOUBLE END AS w FROM t)
    SELECT query, chunk AS doc, round(sum(w), 6) AS score FROM w WHERE w >= 0.12 GROUP BY ALL""",
)
def graph_search_batch(spark, sf_dir):
    """Each region asks by its nations."""
    seeds = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("query"), F.col("n_nationkey").cast("long").alias("seed"))
    return G.scores_by_query(_edges(spark, sf_dir), seeds, ["PARTNERS_WITH"])
