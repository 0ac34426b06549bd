"""Queries of evidence: scopes, coverage of sub-questions, facts, refinement, handles, caches, pacing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.catalogue import register
from quillon.functions import text as T
from quillon.operators import evidence as E
from quillon.plans.common import table

# Orders play chunks: the customer is the document, the clerk's day of order its date, open ones summaries; parts of an order are its entities.
_CHUNKS = """chunks AS (SELECT o_orderkey AS chunk, CASE o_orderstatus WHEN 'O' THEN 'doc_summary' ELSE 'chunk' END AS kind, o_orderpriority AS source_type, o_custkey AS document,
  CASE WHEN o_orderkey % 10 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS published, coalesce(p, []) AS entities
  FROM orders LEFT JOIN (SELECT l_orderkey, list(DISTINCT l_suppkey) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def _chunks(spark, sf_dir):
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chunk")).agg(F.collect_set("l_suppkey").alias("entities"))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("chunk"), F.when(F.col("o_orderstatus") == "O", "doc_summary").otherwise("chunk").alias("kind"), F.col("o_orderpriority").alias("source_type"),
        F.col("o_custkey").alias("document"), F.when(F.col("o_orderkey") % 10 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("published"),
    )
    return rows.join(held, "chunk", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<long>")))


_SCOPED = "kind = 'chunk' AND source_type IN ('1-URGENT', '2-HIGH') AND published >= '1994-01-01' AND published <= '1996-12-31' AND list_has_any(entities, [1, 2, 3]::BIGINT[])"


@register("scope_filter", f"WITH {_CHUNKS} SELECT chunk, document, published FROM chunks WHERE {_SCOPED}")
def scope_filter(spark, sf_dir):
    kept = E.scope(source_types=["1-URGENT", "2-HIGH"], entities=[1, 2, 3], since="1994-01-01", until="1996-12-31")
    return _chunks(spark, sf_dir).where(kept).select("chunk", "document", "published")


@register("scope_relaxed", f"WITH {_CHUNKS} SELECT document, count(*) AS n, count(*) FILTER ({_SCOPED}) AS n_strict, false AS summaries FROM chunks WHERE kind = 'chunk' GROUP BY document UNION ALL SELECT document, count(*), 0, true FROM chunks WHERE kind = 'doc_summary' GROUP BY document")
def scope_relaxed(spark, sf_dir):
    """Without constraints on content the kind still counts; summaries come only when asked for."""
    strict = dict(source_types=["1-URGENT", "2-HIGH"], entities=[1, 2, 3], since="1994-01-01", until="1996-12-31")
    chunks = _chunks(spark, sf_dir)
    loose = chunks.where(E.relaxed(**strict)).groupBy("document").agg(F.count(F.lit(1)).alias("n"), F.count_if(E.scope(**strict)).alias("n_strict"), F.lit(False).alias("summaries"))
    derived = chunks.where(E.relaxed(kinds=["doc_summary"], **strict)).groupBy("document").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("n_strict"), F.lit(True).alias("summaries"))
    return loose.unionByName(derived)


# Items of an order play its candidates: the ship mode's sub-question, the part's document.
def _candidates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query"), F.col("l_returnflag").alias("step"), F.col("l_linenumber").alias("chunk"), (F.col("l_partkey") % 3).alias("document"),
        F.round(F.col("l_quantity") / 50, 6).alias("final"), (F.col("l_extendedprice") / 100000).alias("rerank"), F.col("l_suppkey").alias("fact"),
    )


_CANDIDATES = "cand AS (SELECT l_orderkey AS query, l_returnflag AS step, l_linenumber AS chunk, l_partkey % 3 AS document, round(l_quantity / 50, 6) AS final, l_extendedprice / 100000 AS rerank, l_suppkey AS fact FROM lineitem)"


@register("evidence_strength", f"WITH {_CANDIDATES} SELECT query, step, count(*) AS n, count(*) FILTER (rerank >= 0.3) AS strong, max(rerank) AS best FROM cand GROUP BY ALL")
def evidence_strength(spark, sf_dir):
    return E.strength(_candidates(spark, sf_dir), "query", "step")


@register("unreranked_score", f"WITH {_CANDIDATES} SELECT query, chunk, document, round(least(1::DOUBLE, final / 30 / (sum(final) OVER (PARTITION BY query) / 61)), 6) AS rerank FROM cand")
def unreranked_score(spark, sf_dir):
    from pyspark.sql import Window

    weights = F.sum("final").over(Window.partitionBy("query"))
    return _candidates(spark, sf_dir).select("query", "chunk", "document", F.round(E.unreranked(F.col("final") / 30, weights), 6).alias("rerank"))


@register("coverage_first")
def coverage_first(spark, sf_dir):
    return E.coverage_first(_candidates(spark, sf_dir))


_FACTS = """fact_rows AS (SELECT o_custkey AS query, l_orderkey * 8 + l_linenumber AS fact, l_orderkey AS chunk, l_extendedprice AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  strong AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY weight DESC, fact)::INT AS position FROM fact_rows QUALIFY position <= 40)"""


def _facts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk"), F.col("o_custkey").alias("query"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fact"), F.col("l_extendedprice").alias("weight"))
    return E.strongest_facts(items.join(orders, "chunk").select("query", "fact", "chunk", "weight"))


@register("strongest_facts", f"WITH {_FACTS} SELECT query, fact, position FROM strong")
def strongest_facts(spark, sf_dir):
    return _facts(spark, sf_dir).select("query", "fact", "position")


@register(
    "facts_of_evidence",
    f"""WITH {_FACTS}, ev AS (SELECT o_custkey AS query, o_orderkey AS chunk, 'E' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
    SELECT query, fact, name, row_number() OVER (PARTITION BY query ORDER BY position, fact)::INT AS place FROM strong JOIN (SELECT * FROM ev WHERE r <= 9) ev USING (query, chunk) QUALIFY place <= 8""",
)
def facts_of_evidence(spark, sf_dir):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    chosen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("chunk"), r.alias("r")).where("r <= 9").select("query", "chunk", F.concat(F.lit("E"), "r").alias("name"))
    return E.facts_of_evidence(_facts(spark, sf_dir), chosen)


@register(
    "evidence_handles",
    "SELECT user_id AS query, k AS chunk, 'E' || row_number() OVER (PARTITION BY user_id ORDER BY first, k) AS handle, score, methods FROM (SELECT user_id, event_id % 5 AS k, min(event_id) AS first, round(max(value), 6) AS score, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS methods FROM events GROUP BY ALL)",
)
def evidence_handles(spark, sf_dir):
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("at"), (F.col("event_id") % 5).alias("chunk"), F.round("value", 6).alias("score"), F.col("event_type").alias("method"))
    return E.handles(seen).withColumn("methods", F.array_join("methods", ","))


@register("knowledge_refinement")
def knowledge_refinement(spark, sf_dir):
    """What of each long document bears on its source's name and on rare words of a question."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    wanted = T.tokens(F.lit("permission notice of the license"))
    return docs.select("doc_id", E.refine(F.col("text"), wanted, F.array("source")).alias("refined")).where("refined is not null")


_CACHE = """entries AS (SELECT vec_id AS entry, embedding AS v, label % 3 AS tag, (vec_id % 5 > 0)::INT AS version, TIMESTAMP '2024-01-01' + to_seconds(vec_id * 60) AS made FROM embeddings ORDER BY made DESC, entry DESC LIMIT 64),
  fresh AS (SELECT * FROM entries WHERE version = 1 AND epoch((SELECT max(made) FROM entries)) - epoch(made) <= 1800)"""


@register("answer_cache", f"WITH {_CACHE} SELECT query, entry, score FROM (SELECT q.vec_id AS query, entry, round(list_inner_product(q.embedding::DOUBLE[], v::DOUBLE[]), 6) AS score FROM embeddings q JOIN fresh ON q.label % 3 = tag) WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, entry) = 1")
def answer_cache(spark, sf_dir):
    """Every vector asks the cache of the last 64 answers; only those of its tag, of this index and of the last half hour may serve."""
    v = table(spark, sf_dir, "embeddings")
    at = F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit("2024-01-01"))) + F.col("vec_id") * 60)
    entries = v.select(F.col("vec_id").alias("entry"), F.col("embedding").alias("v"), (F.col("label") % 3).alias("tag"), (F.col("vec_id") % 5 > 0).cast("int").alias("version"), at.alias("at"))
    now = F.lit(entries.agg(F.max("at")).first()[0])
    asked = v.select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), (F.col("label") % 3).alias("tag"))
    return E.cached(asked, entries, 1, now, ttl_s=1800, least=0.2)


@register("politeness", """WITH RECURSIVE f AS (SELECT user_id AS host, event_id AS url, floor(epoch(ts))::DOUBLE AS asked, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n, CASE WHEN user_id % 2 = 0 THEN 9000 ELSE 3600 END::DOUBLE AS wait FROM events),
  s AS (SELECT host, url, n, asked AS start FROM f WHERE n = 1 UNION ALL SELECT f.host, f.url, f.n, greatest(f.asked, s.start + f.wait) FROM s JOIN f ON f.host = s.host AND f.n = s.n + 1)
  SELECT host, url, start FROM s""")
def politeness(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), F.col("event_id").alias("url"), F.unix_timestamp("ts").cast("double").alias("asked"), F.when(F.col("user_id") % 2 == 0, 9000.0).alias("crawl_delay"))
    return E.paced(asked, 3600.0).select("host", "url", "start")


@register("judge_summary", "SELECT source, round(avg(quality), 3) AS correctness, round(avg(1 - toxic), 3) AS groundedness, count(quality) AS judged, count(*) - count(quality) AS errors FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def judge_summary(spark, sf_dir):
    """Mean marks of what was judged, and how much failed to be."""
    marks = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return marks.groupBy("source").agg(F.round(F.avg("quality"), 3).alias("correctness"), F.round(F.avg(1 - F.col("toxic")), 3).alias("groundedness"), F.count("quality").alias("judged"), F.count_if(F.col("quality").isNull()).alias("errors"))


@register("squashed_score", f"WITH {_CANDIDATES} SELECT query, chunk, round(0.7::DOUBLE / (1 + exp(-(final * 8 - 4))) + 0.3::DOUBLE * rerank, 9) AS score FROM cand")
def squashed_score(spark, sf_dir):
    return _candidates(spark, sf_dir).select("query", "chunk", F.round(E.squashed(F.col("final") * 8 - 4, F.col("rerank")), 9).alias("score"))
