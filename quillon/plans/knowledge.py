"""Queries of entities, communities and their reports, and tables that follow a crawl."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.catalogue import register
from quillon.functions import text as T
from quillon.operators import communities as C
from quillon.operators import entities as N
from quillon.operators import graph as G
from quillon.operators import reports
from quillon.operators import retrieval as R
from quillon.operators import tables as S
from quillon.plans.common import sql, table, tokens_sql
from quillon.plans.graphs import _EDGES, _edges

# ---- communities: regions with their nations and these nations' customers

_MEMBERS = """members AS (SELECT 0 AS level, 100 + r_regionkey::BIGINT AS community, 100 + r_regionkey::BIGINT AS node, r_name AS name, 'REGION' AS type FROM region
  UNION ALL SELECT 0, 100 + n_regionkey, n_nationkey, n_name, 'NATION' FROM nation
  UNION ALL SELECT 0, 100 + n_regionkey, 1000 + c_custkey, c_name, 'CUSTOMER' FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _members(spark, sf_dir):
    return sql(
        spark, sf_dir,
        """SELECT 0 AS level, 100 + CAST(r_regionkey AS BIGINT) AS community, 100 + CAST(r_regionkey AS BIGINT) AS node, r_name AS name, 'REGION' AS type FROM {region}
        UNION ALL SELECT 0, 100 + CAST(n_regionkey AS BIGINT), CAST(n_nationkey AS BIGINT), n_name, 'NATION' FROM {nation}
        UNION ALL SELECT 0, 100 + CAST(n_regionkey AS BIGINT), 1000 + c_custkey, c_name, 'CUSTOMER' FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    )


@register("community_contraction", f"WITH {_EDGES}, {_MEMBERS}, a AS (SELECT src AS u, dst AS v, conf * CASE WHEN rel IN ('IS_A', 'VARIANT_OF') THEN 0.5::DOUBLE ELSE 1::DOUBLE END * CASE WHEN active THEN 1::DOUBLE ELSE 0.6::DOUBLE END AS w FROM edges) SELECT x.community AS cu, y.community AS cv, round(sum(w), 6) AS w FROM (SELECT * FROM a UNION ALL SELECT v, u, w FROM a) JOIN members x ON u = x.node JOIN members y ON v = y.node GROUP BY ALL")
def community_contraction(spark, sf_dir):
    member = _members(spark, sf_dir).select("node", F.col("community").alias("c"))
    return G.contract(G.adjacency(_edges(spark, sf_dir)), member).select("cu", "cv", F.round("w", 6).alias("w"))


_DESCRIBED = f"""{_EDGES}, {_MEMBERS},
  f AS (SELECT *, '199' || (id % 8) || '-0' || (1 + id % 9) AS valid_from, 'Node ' || src % 50 || ' ' || lower(rel) || ' node ' || dst || CASE WHEN id % 3 = 0 THEN ' since 199' || (id % 8) ELSE '' END || '.' AS sentence FROM edges),
  fin AS (SELECT x.community, f.* FROM f JOIN members x ON src = x.node JOIN members y ON dst = y.node AND x.community = y.community WHERE conf >= 0.5),
  deg AS (SELECT community, node, count(*) AS degree FROM (SELECT community, src AS node FROM fin UNION ALL SELECT community, dst FROM fin WHERE src <> dst) GROUP BY ALL),
  central AS (SELECT community, list(name ORDER BY r) AS names FROM (SELECT m.community, name, row_number() OVER (PARTITION BY m.community ORDER BY coalesce(degree, 0) DESC, name) AS r FROM members m LEFT JOIN deg ON deg.node = m.node AND deg.community = m.community) WHERE r <= 6 GROUP BY community),
  mix AS (SELECT community, string_agg(c || ' ' || type, ', ' ORDER BY c DESC, type) AS mix, sum(c)::BIGINT AS n FROM (SELECT community, lower(type) AS type, count(*) AS c FROM members GROUP BY ALL) GROUP BY community),
  once AS (SELECT * FROM fin QUALIFY row_number() OVER (PARTITION BY community, trim(regexp_replace(lower(sentence), '\\W+', ' ', 'g')) ORDER BY conf * CASE WHEN active THEN 1::DOUBLE ELSE 0.7::DOUBLE END DESC, valid_from, id) = 1),
  head AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY conf * CASE WHEN active THEN 1::DOUBLE ELSE 0.7::DOUBLE END DESC, valid_from, id) AS r FROM once QUALIFY r <= 8),
  told AS (SELECT community, string_agg('- ' || sentence || CASE WHEN contains(sentence, substr(valid_from, 1, 4)) THEN ' (' || substr(valid_from, 1, 7) || ')' ELSE '' END, chr(10) ORDER BY r) AS told FROM head GROUP BY community),
  sums AS (SELECT community, count(*) AS n_facts, max(valid_from) AS day FROM fin GROUP BY community),
  described AS (SELECT 0 AS level, community, n, n_facts, day, array_to_string(names[1:3], ', ') || CASE WHEN n > 3 THEN ' +' || (n - 3) ELSE '' END AS title,
    'Community of ' || n || ' related entities (' || mix || '). Central entities: ' || array_to_string(names, ', ') || '.' || chr(10) || told AS report FROM mix JOIN central USING (community) JOIN sums USING (community) JOIN told USING (community))"""


def _described(spark, sf_dir):
    members, e = _members(spark, sf_dir), _edges(spark, sf_dir)
    year = F.concat(F.lit("199"), F.col("id") % 8)
    since = F.when(F.col("id") % 3 == 0, F.concat(F.lit(" since "), year)).otherwise("")
    sentence = F.concat(F.lit("Node "), F.col("src") % 50, F.lit(" "), F.lower("rel"), F.lit(" node "), "dst", since, F.lit("."))
    facts = e.withColumns({"valid_from": F.concat(year, F.lit("-0"), 1 + F.col("id") % 9), "sentence": sentence})
    return C.described(members.select("level", "community", "node"), members.select("node", "name", "type"), facts)


@register("community_report", f"WITH {_DESCRIBED} SELECT level, community, n, n_facts, day, title, report FROM described")
def community_report(spark, sf_dir):
    return _described(spark, sf_dir).drop("id")


@register("community_chunks", f"WITH {_DESCRIBED} SELECT 'community:L0-' || community AS document, report AS text, 'Community: ' || title AS head, 'derived' AS source_type, day AS published, 'community' AS kind FROM described WHERE n >= 3 AND n_facts >= 2")
def community_chunks(spark, sf_dir):
    return C.as_chunks(_described(spark, sf_dir)).drop("id")


@register("community_levels")
def community_levels(spark, sf_dir):
    """Sizes of the communities of both levels, by the method's own moves; tests hold it against small graphs."""
    return C.levels(G.adjacency(_edges(spark, sf_dir))).groupBy("level", "community").agg(F.count(F.lit(1)).alias("n"))


@register(
    "conflict_claims",
    """WITH f AS (SELECT l_partkey AS src, l_suppkey AS dst, l_orderkey AS doc, l_shipdate::DATE AS day, 1 - l_discount AS authority FROM lineitem),
    c AS (SELECT src, dst FROM f GROUP BY ALL HAVING count(DISTINCT day) >= 2 AND count(DISTINCT doc) >= 2)
    SELECT src, dst, doc, day::VARCHAR AS day, row_number() OVER (PARTITION BY src, dst ORDER BY authority DESC, day, doc)::INT AS place FROM f SEMI JOIN c USING (src, dst)""",
)
def conflict_claims(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lit("SHIPS").alias("rel"), F.col("l_suppkey").alias("dst"), F.col("l_orderkey").alias("doc"), F.to_date("l_shipdate").alias("day"), (1 - F.col("l_discount")).alias("authority"))
    return G.ranked_claims(facts).select("src", "dst", "doc", F.col("day").cast("string").alias("day"), "place")


# ---- entities: parts play technologies, suppliers companies


_ONTOLOGY = """ontology AS (SELECT p_name AS name, 'PART' AS type, p_brand AS alias FROM part UNION ALL SELECT s_name, 'SUPPLIER', NULL FROM supplier),
  slugs AS (SELECT *, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS entity FROM ontology)"""


def _seed(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.lit("PART").alias("type"), F.array("p_brand").alias("aliases"))
    firms = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit("SUPPLIER").alias("type"), F.lit(None).cast("array<string>").alias("aliases"))
    return N.seed(parts.unionByName(firms))


@register("ontology_seed", f"WITH {_ONTOLOGY} SELECT entity, min(name) AS name, arg_min(type, name) AS type FROM slugs GROUP BY entity")
def ontology_seed(spark, sf_dir):
    return _seed(spark, sf_dir)[0]


@register(
    "alias_seed",
    f"""WITH {_ONTOLOGY}, named AS (SELECT entity, name AS alias FROM slugs UNION ALL SELECT entity, alias FROM slugs WHERE alias IS NOT NULL),
    keyed AS (SELECT *, regexp_replace(lower(alias), '[^a-z0-9+]', '', 'g') AS key FROM named)
    SELECT key, min(entity) AS entity, false AS learned FROM keyed GROUP BY key UNION ALL SELECT 'nation' || regexp_replace(lower(n_name), '[^a-z0-9+]', '', 'g'), 'n' || n_nationkey, true FROM nation""",
)
def alias_seed(spark, sf_dir):
    """The seed's aliases, and those learned since: keys that are taken keep their entity."""
    aliases = _seed(spark, sf_dir)[1]
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation "), F.lower("n_name")).alias("alias"), F.concat(F.lit("n"), "n_nationkey").alias("entity"), F.lit("NATION").alias("type"))
    taken = aliases.select("alias", F.lit("someone-else").alias("entity"), "type")
    return N.learn(aliases, nations.unionByName(taken)).select("key", "entity", (F.col("type") == "NATION").alias("learned"))


@register("entity_resolution")
def entity_resolution(spark, sf_dir):
    """Part names with their fifth letter left out, or as they are: an exact key, or the most alike one."""
    parts = table(spark, sf_dir, "part")
    spoiled = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.substring("p_name", 1, 4), F.substring("p_name", 6, 1000))).otherwise(F.col("p_name"))
    names = parts.select(spoiled.alias("name"), F.lit("PART").alias("type"))
    return N.resolve(names, _seed(spark, sf_dir)[1].where("type = 'PART'"))


# ---- tables that follow a crawl


@register("fact_upsert", "SELECT coalesce(a.fact, b.fact) AS fact, CASE WHEN b.fact IS NULL THEN a.conf ELSE b.conf END AS confidence, coalesce(a.since, b.since) AS valid_from, CASE WHEN a.fact IS NULL THEN 2 ELSE 1 END AS first_version, CASE WHEN b.fact IS NULL THEN 1 ELSE 2 END AS last_version, b.fact IS NOT NULL OR a.active AS active, CASE WHEN b.fact IS NULL AND NOT a.active THEN '1999-01-01' END AS valid_until, a.fact IS NULL AS is_new FROM (SELECT o_orderkey AS fact, o_totalprice AS conf, strftime(o_orderdate, '%Y-%m-%d') AS since, o_orderstatus <> 'F' AS active FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey AS fact, o_totalprice / 2 AS conf, '2020-01-01' AS since FROM orders WHERE o_orderkey % 2 = 0) b ON a.fact = b.fact")
def fact_upsert(spark, sf_dir):
    """What was retired and is told again is active again; when it was first told stays."""
    orders = table(spark, sf_dir, "orders")
    active = F.col("o_orderstatus") != "F"
    each = lambda rows, conf, since, version: [F.col("o_orderkey").alias("fact"), conf.alias("confidence"), since.alias("valid_from"), F.lit(version).alias("first_version"), F.lit(version).alias("last_version"), F.lit("2020-01-01").alias("observed_at")]
    old = orders.where("o_orderkey % 3 != 0").select(*each(orders, F.col("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd"), 1), active.alias("active"), F.when(~active, "1999-01-01").alias("valid_until"))
    new = orders.where("o_orderkey % 2 = 0").select(*each(orders, F.col("o_totalprice") / 2, F.lit("2020-01-01"), 2))
    return S.put_facts(old, new).drop("observed_at")


_TOMBS = """d AS (SELECT c_custkey AS document, c_name AS url, CASE WHEN c_custkey % 9 = 0 THEN 'gone' ELSE 'active' END AS status, '1998-01-01' AS seen FROM customer),
  hit AS (SELECT document FROM d WHERE document % 4 = 0 AND status <> 'gone')"""


def _tombstones(spark, sf_dir):
    status = F.when(F.col("c_custkey") % 9 == 0, "gone").otherwise("active")
    documents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document"), F.col("c_name").alias("url"), status.alias("status"), F.lit("1998-01-01").alias("last_seen"))
    ended = lambda c: F.when(~c, "1997-01-01").alias("valid_until")
    on = F.col("o_orderstatus") != "F"
    chunks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("id"), on.alias("active"), ended(on))
    sure = F.col("o_orderpriority") != "5-LOW"
    facts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("id"), sure.alias("active"), ended(sure))
    gone = documents.where("document % 4 = 0").select("url")
    return S.tombstone(documents, chunks, facts, gone, F.lit("1999-06-01"))


@register("tombstones", f"WITH {_TOMBS} SELECT document, CASE WHEN document IN (SELECT document FROM hit) THEN 'gone' ELSE status END AS status, CASE WHEN document IN (SELECT document FROM hit) THEN '1999-06-01' ELSE seen END AS last_seen FROM d")
def tombstones(spark, sf_dir):
    return _tombstones(spark, sf_dir)[0].select("document", "status", "last_seen")


@register(
    "tombstoned_rows",
    f"""WITH {_TOMBS}, r AS (SELECT 'chunk' AS kind, o_custkey AS document, o_orderkey AS id, o_orderstatus <> 'F' AS on FROM orders UNION ALL SELECT 'fact', o_custkey, o_orderkey, o_orderpriority <> '5-LOW' FROM orders)
    SELECT kind, id, r."on" AND hit.document IS NULL AS active, CASE WHEN NOT r."on" THEN '1997-01-01' WHEN hit.document IS NOT NULL THEN '1999-06-01' END AS valid_until FROM r LEFT JOIN hit USING (document)""".replace("AS on FROM", 'AS "on" FROM'),
)
def tombstoned_rows(spark, sf_dir):
    """Chunks and facts of pages that are gone end then; what ended before keeps its end."""
    _, chunks, facts = _tombstones(spark, sf_dir)
    return chunks.withColumn("kind", F.lit("chunk")).unionByName(facts.withColumn("kind", F.lit("fact"))).select("kind", "id", "active", "valid_until")


@register("bridge_replacement", "SELECT l_orderkey AS chunk, l_partkey AS entity FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey % 10 = 0")
def bridge_replacement(spark, sf_dir):
    """Chunks read again get the entities found now; half of them have none left."""
    items = table(spark, sf_dir, "lineitem")
    old = items.select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("entity"))
    new = items.where("l_orderkey % 10 = 0").select(F.col("l_orderkey").alias("chunk"), F.col("l_suppkey").alias("entity"))
    return S.replace_rows(old, old.where("chunk % 5 = 0").select("chunk"), new, "chunk")


@register("url_updates", "SELECT event_id AS url, CASE WHEN event_id % 3 = 0 THEN 'CRAWLED' ELSE event_type END AS state, CASE WHEN event_id % 3 = 0 THEN 'e' || event_id ELSE NULL END AS etag, user_id AS source FROM events")
def url_updates(spark, sf_dir):
    """Some fields of some urls change; an unknown url adds no row."""
    urls = table(spark, sf_dir, "events").select(F.col("event_id").alias("url"), F.col("event_type").alias("state"), F.lit(None).cast("string").alias("etag"), F.col("user_id").alias("source"))
    changes = urls.where("url % 3 = 0").select("url", F.lit("CRAWLED").alias("state"), F.concat(F.lit("e"), "url").alias("etag"))
    return S.updated(urls, changes.unionByName(changes.withColumn("url", -F.col("url") - 1)), ["url"])


@register(
    "index_removal",
    f"""WITH live AS (SELECT doc_id, text FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) g USING (doc_id)), {tokens_sql("live", "doc_id", "text")}, post AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM tok GROUP BY ALL),
    st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM (SELECT sum(tf) AS dl FROM post GROUP BY doc_id))
    SELECT term, df, round(ln(1::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf, n, round(avgdl, 6) AS avgdl FROM (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term), st""",
)
def index_removal(spark, sf_dir):
    """Postings of withdrawn documents leave the index; frequencies and lengths are those of the rest, and terms without postings are no more."""
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("doc"))
    left = R.without(R.postings(table(spark, sf_dir, "documents"), "doc_id", "text"), gone)
    return R.document_frequency(left).select("term", "df", F.round("idf", 6).alias("idf"), "n", F.round("avgdl", 6).alias("avgdl"))


@register("vector_codec", "SELECT vec_id, 'hashing-64' AS model, len(embedding) AS dim, 4 * len(embedding) AS bytes, embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings WHERE label % 2 = 0")
def vector_codec(spark, sf_dir):
    """Vectors as bytes (32-bit floats, little-endian) beside their model's name, and back again for one model."""
    named = table(spark, sf_dir, "embeddings").withColumn("model", F.when(F.col("label") % 2 == 0, "hashing-64").otherwise("other"))
    stored = named.select("vec_id", "model", F.size("embedding").cast("long").alias("dim"), reports.packed(F.col("embedding")).alias("vec"))
    mine = stored.where("model = 'hashing-64'").withColumn("v", reports.unpacked(F.col("vec")))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return mine.select("vec_id", "model", "dim", F.length("vec").cast("long").alias("bytes"), F.get("v", F.lit(0)).cast("double").alias("first"), F.element_at("v", -1).cast("double").alias("last"), F.round(total, 4).alias("total"))


@register("alias_lookup", "SELECT s_suppkey AS asked, regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g') AS entity FROM supplier")
def alias_lookup(spark, sf_dir):
    """Names in other writings find their entity by what all writings share."""
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asked"), T.alias_key(F.concat(F.lit("The "), F.upper("s_name"), F.lit(" Inc."))).alias("key"))
    return asked.join(_seed(spark, sf_dir)[1], "key").select("asked", "entity")
