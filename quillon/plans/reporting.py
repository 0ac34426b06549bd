"""Queries of merging, windows, summaries, expositions, relations and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.catalogue import register
from quillon.functions import text as T
from quillon.operators import language, relations, reports, similarity
from quillon.operators import retrieval as R
from quillon.plans.common import sql, table, tokens_sql
from quillon.sources import robots
from quillon.streaming import ingest


@register("candidate_merge", "SELECT l_partkey, max(l_extendedprice) AS price, max(l_discount) AS discount, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags FROM lineitem GROUP BY l_partkey")
def candidate_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flags"))
    return reports.merged(rows, ["l_partkey"], ["price", "discount"], ["flags"]).withColumn("flags", F.array_join("flags", ","))


_WINDOWS = "(VALUES (1, DATE '1994-01-01', DATE '1995-12-31'), (2, DATE '1996-01-01', DATE '1997-12-31')) AS w(step, lo, hi)"


@register("window_join", f"SELECT step, o_orderpriority AS priority, count(*) AS n FROM orders JOIN {_WINDOWS} ON o_orderdate::DATE BETWEEN lo AND hi GROUP BY ALL")
def window_join(spark, sf_dir):
    """Evidence of each sub-question lies in its window; the few windows are broadcast."""
    steps = spark.createDataFrame([(1, "1994-01-01", "1995-12-31"), (2, "1996-01-01", "1997-12-31")], "step int, lo string, hi string").select("step", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))
    day = F.to_date("o_orderdate")
    joined = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderpriority").join(F.broadcast(steps), day.between(F.col("lo"), F.col("hi")))
    return joined.groupBy("step", F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@register("entities_with_aliases", "SELECT n_nationkey, n_name, count(s_suppkey) AS n_aliases, min(s_name) AS first_alias FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def entities_with_aliases(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT n_nationkey, n_name, count(s_suppkey) AS n_aliases, min(s_name) AS first_alias FROM {nation} LEFT JOIN {supplier} ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name")


@register("point_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 2, 3, 5, 8, 13)")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.col("o_orderkey").isin(1, 2, 3, 5, 8, 13)).select("o_orderkey", "o_totalprice")


@register("span_times", "SELECT event_type AS span, round(sum(value), 4) AS total, count(*) AS n FROM events WHERE value > 0 GROUP BY event_type")
def span_times(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value > 0").groupBy(F.col("event_type").alias("span")).agg(F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


@register("token_bigrams", f"WITH {tokens_sql('benchmark', 'item_id', 'text')}, p AS (SELECT item_id, term || ' ' || lead(term) OVER (PARTITION BY item_id ORDER BY pos, part) AS g FROM tok) SELECT g, count(*) AS n FROM p WHERE g IS NOT NULL GROUP BY g")
def token_bigrams(spark, sf_dir):
    pairs = table(spark, sf_dir, "benchmark").select(F.explode(T.bigrams(T.tokens(F.col("text")))).alias("g"))
    return pairs.groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@register("keywords_by_idf", f"WITH {tokens_sql('documents', 'doc_id', 'text')}, d AS (SELECT term, count(DISTINCT doc_id)::DOUBLE AS df FROM tok GROUP BY term), n AS (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM tok), {tokens_sql('benchmark', 'item_id', 'text', name='q')}, t AS (SELECT DISTINCT item_id, term FROM q) SELECT item_id, term, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM t JOIN d USING (term), n QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) DESC, term) <= 4")
def keywords_by_idf(spark, sf_dir):
    """The four rarest terms of each question."""
    terms = R.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")
    df = R.known_terms(R.statistics(R.postings(table(spark, sf_dir, "documents"), "doc_id", "text", only=R.listed(terms)), terms))
    terms = terms.join(df, "term").select("query", "term", F.round("idf", 6).alias("idf"))
    return R.top(terms, 4, item="term", score="idf").select(F.col("query").alias("item_id"), "term", "idf")


@register("freshest_of_best", "WITH best AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 12) SELECT o_custkey, o_orderkey FROM best QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3")
def freshest_of_best(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    best = R.top(orders, 12, by="o_custkey", item="o_orderkey", score="o_totalprice").drop("rank")
    return R.top(best, 3, by="o_custkey", item="o_orderkey", score="o_orderdate").select("o_custkey", "o_orderkey")


@register("ordered_distinct", "SELECT user_id, event_type FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY first) <= 2")
def ordered_distinct(spark, sf_dir):
    """The first two kinds of each user, in the order they came up."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return first.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("first"))).where("r <= 2").select("user_id", "event_type")


@register("variant_dedupe", "SELECT lower(trim(source)) AS variant, min(doc_id) AS first FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE ' ' || source END AS source FROM documents) GROUP BY 1")
def variant_dedupe(spark, sf_dir):
    written = F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.concat(F.lit(" "), "source"))
    return table(spark, sf_dir, "documents").groupBy(F.lower(F.trim(written)).alias("variant")).agg(F.min("doc_id").alias("first"))


@register("metrics_exposition", "SELECT 'requests_total{event_type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def metrics_exposition(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return reports.exposition(counts, "requests_total", "event_type", "n")


@register("aligned_report", "SELECT rtrim(rpad(lang, 16, ' ') || rpad(count(*)::VARCHAR, 16, ' ')) AS line FROM documents GROUP BY lang")
def aligned_report(spark, sf_dir):
    return reports.aligned(table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")), ["lang", "n"])


@register("lead_summaries")
def lead_summaries(spark, sf_dir):
    """The first sentences of a conversation's first six turns."""
    parts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(T.sentences(F.col("text")), F.lit(0)).alias("lead"))
    return reports.summaries(parts, "conv_id", "turn", "lead")


_SETS = "sets AS (SELECT p_partkey, list_distinct(string_split(lower(p_name || ' ' || p_brand || ' ' || p_type), ' ')) AS w FROM part)"


@register("jaccard_pairs", f"WITH {_SETS} SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE, 6) AS jaccard FROM sets a JOIN sets b ON a.p_partkey < b.p_partkey WHERE len(list_intersect(a.w, b.w)) >= 0.8::DOUBLE * len(list_distinct(list_concat(a.w, b.w)))")
def jaccard_pairs(spark, sf_dir):
    """All pairs of parts whose words (name, brand, type) have a similarity of 0.8 and more: classes of equal sets, joined on their rarest words, and the pairs of their members."""
    words = F.array_sort(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), " ")))
    sets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), words.alias("set"))
    classes = sets.withColumn("rep", F.min("doc").over(Window.partitionBy("set")))
    near = similarity.similar_pairs(classes, 0.8)
    same = classes.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("jaccard")).distinct()
    first, second = classes.select(F.col("rep").alias("a"), F.col("doc").alias("x")), classes.select(F.col("rep").alias("b"), F.col("doc").alias("y"))
    pairs = near.unionByName(same).join(first, "a").join(second, "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


@register("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return ingest.latencies(table(spark, sf_dir, "events")).withColumn("mean", F.round("mean", 6)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("event_sessions", "WITH g AS (SELECT user_id, ts, sum(CASE WHEN ts - prev < INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s")
def event_sessions(spark, sf_dir):
    return ingest.sessions(table(spark, sf_dir, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@register("robots_allowed", "SELECT * FROM (VALUES ('https://a.com/x', true), ('https://a.com/private/x', false), ('https://b.com/x', true), ('https://c.com/x', false), ('https://d.com/x', false)) AS v(url, allowed)")
def robots_allowed(spark, sf_dir):
    urls = spark.createDataFrame([(u,) for u in ("https://a.com/x", "https://a.com/private/x", "https://b.com/x", "https://c.com/x", "https://d.com/x")], "url string")
    rules = spark.createDataFrame([("a.com", 200, "User-agent: *\nDisallow: /private"), ("b.com", 404, None), ("c.com", 503, None)], "host string, status int, body string")
    return robots.allowed(urls, rules)


_NAMES = [("OpenAI", "openai", "ORGANIZATION"), ("Acme", "acme", "ORGANIZATION"), ("GPT-4", "gpt-4", "MODEL"), ("Swift", "swift", "MODEL"), ("Mixture of Experts", "moe", "TECHNOLOGY")]
_STATED = [
    (1, "OpenAI released GPT-4 and Swift. Acme partnered with OpenAI."), (2, "GPT-4 was developed by OpenAI."), (3, "Swift uses mixture of experts."),
    (4, "GPT-4 acquired Acme."), (5, "OpenAI's GPT-4 outperforms Swift."),
]


@register(
    "relation_facts",
    "SELECT * FROM (VALUES (1, 'openai', 'RELEASED', 'gpt-4'), (1, 'openai', 'RELEASED', 'swift'), (1, 'acme', 'PARTNERS_WITH', 'openai'), (2, 'openai', 'DEVELOPS', 'gpt-4'), (3, 'swift', 'USES', 'moe'), (5, 'openai', 'RELEASED', 'gpt-4'), (5, 'gpt-4', 'OUTPERFORMS', 'swift')) AS v(doc_id, src, rel, dst)",
)
def relation_facts(spark, sf_dir):
    return relations.extracted(spark.createDataFrame(_STATED, "doc_id int, text string"), language.Gazetteer(_NAMES)).select("doc_id", "src", "rel", "dst")
