"""Queries of sources, the frontier, versions, upserts and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.catalogue import register
from quillon.functions import text as T
from quillon.operators import frontier as U
from quillon.operators import tables as S
from quillon.plans.common import sql, table

# ---- sources and frontier: suppliers play sources, pages and events play urls

_SOURCES = "SELECT s_suppkey AS source_id, s_name AS name, (s_suppkey % 5)::INT AS priority, s_acctbal > 0 AS active FROM supplier"


@register("source_registry", f"WITH s AS ({_SOURCES}) SELECT source_id, name, priority, row_number() OVER (ORDER BY priority DESC, name)::INT AS position FROM s WHERE active")
def source_registry(spark, sf_dir):
    from pyspark.sql import Window

    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 5).cast("int").alias("priority"))
    return s.withColumn("position", F.row_number().over(Window.orderBy(F.desc("priority"), "name")))


_URL = r"""
u0 AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
u1 AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM u0),
u2 AS (SELECT page_id, scheme, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '(:80|:443|:)$', '') AS host,
  regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/{2,}', '/', 'g') AS path, string_split(regexp_extract(rest, '\?(.*)$', 1), '&') AS q FROM u1),
u3 AS (SELECT page_id, scheme, host, CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END AS path,
  array_to_string(list_sort(list_transform(list_filter(q, lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '^(utm_|fbclid|gclid|mc_|ref$|ref_src|igshid|_hs)')), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)), '&') AS q FROM u2),
canon AS (SELECT page_id, scheme || '://' || host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url, host FROM u3 WHERE scheme IN ('http', 'https') AND host <> '')"""


def _canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.canonical(F.col("url")).alias("url")).where(F.col("url").isNotNull())


@register("url_normalised", f"WITH {_URL} SELECT page_id, url FROM canon")
def url_normalised(spark, sf_dir):
    return _canonical(spark, sf_dir)


@register("url_duplicates", f"WITH {_URL} SELECT url, count(*) AS n, min(page_id) AS first_page FROM canon GROUP BY url")
def url_duplicates(spark, sf_dir):
    return _canonical(spark, sf_dir).groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


@register("url_accept", rf"WITH {_URL} SELECT page_id, (host = 'example.com' OR host LIKE '%.example.com' OR host = 'example.org' OR host LIKE '%.example.org') AND NOT regexp_matches(url, '/(login|tag)/') AND NOT regexp_matches(lower(url), '\.(png|jpe?g|gif|svg|webp|pdf|zip|gz|mp4|mp3|css|js|ico|woff2?)$') AS accepted FROM canon")
def url_accept(spark, sf_dir):
    return _canonical(spark, sf_dir).select("page_id", U.accepted(F.col("url"), ["example.com", "example.org"], exclude=["/(login|tag)/"]).alias("accepted"))


@register(
    "frontier_add",
    f"""WITH {_URL}, f AS (SELECT url, (page_id % 7)::INT AS source_id, (page_id % 4)::INT AS depth, page_id % 10 = 0 AS is_seed, (page_id % 5)::INT + CASE WHEN page_id % 10 = 0 THEN 3 ELSE 0 END - (page_id % 4)::INT AS priority FROM canon WHERE page_id % 4 <= 2),
    known AS (SELECT url FROM canon WHERE page_id < 20)
    SELECT url, source_id, priority, depth, is_seed, 'QUEUED' AS state FROM f ANTI JOIN known USING (url) QUALIFY row_number() OVER (PARTITION BY url ORDER BY priority DESC, depth, source_id DESC) = 1""",
)
def frontier_add(spark, sf_dir):
    pages = _canonical(spark, sf_dir)
    found = pages.select(
        "url", (F.col("page_id") % 7).cast("int").alias("source_id"), (F.col("page_id") % 5).cast("int").alias("source_priority"),
        (F.col("page_id") % 4).cast("int").alias("depth"), (F.col("page_id") % 10 == 0).alias("is_seed"),
    )
    return U.enqueue(pages.where("page_id < 20"), found, max_depth=2)


_FRONTIER = "SELECT event_id, user_id AS source_id, CASE event_type WHEN 'click' THEN 'QUEUED' WHEN 'view' THEN 'CRAWLED' WHEN 'purchase' THEN 'CHANGED' ELSE 'FAILED' END AS state, (event_id % 9)::INT AS priority, (event_id % 3)::INT AS depth, ts AS discovered_at FROM events"


def _frontier(spark, sf_dir):
    state = F.when(F.col("event_type") == "click", "QUEUED").when(F.col("event_type") == "view", "CRAWLED").when(F.col("event_type") == "purchase", "CHANGED").otherwise("FAILED")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("url"), F.col("user_id").alias("source_id"), state.alias("state"),
        (F.col("event_id") % 9).cast("int").alias("priority"), (F.col("event_id") % 3).cast("int").alias("depth"), F.col("ts").alias("discovered_at"),
    )


@register("frontier_batch", f"WITH f AS ({_FRONTIER}) SELECT event_id AS url, priority, depth FROM f WHERE state = 'QUEUED' ORDER BY priority DESC, depth, discovered_at, event_id LIMIT 50")
def frontier_batch(spark, sf_dir):
    return U.next_batch(_frontier(spark, sf_dir), 50).select("url", "priority", "depth")


@register(
    "schedule_due",
    f"""WITH f AS ({_FRONTIER}), s AS (SELECT c_custkey AS source_id, c_acctbal > 0 AS active, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE TIMESTAMP '2024-01-15' - to_seconds((c_custkey % 100) * 3600) END AS last_crawled, 86400 AS freq FROM customer)
    SELECT CASE WHEN state = 'FAILED' OR (due AND state IN ('CRAWLED', 'CHANGED')) THEN 'QUEUED' ELSE state END AS state, count(*) AS n FROM (SELECT f.state, coalesce(s.active AND (last_crawled IS NULL OR epoch(TIMESTAMP '2024-01-15') - epoch(last_crawled) >= freq), false) AS due FROM f LEFT JOIN s USING (source_id)) GROUP BY 1""",
)
def schedule_due(spark, sf_dir):
    now = F.to_timestamp(F.lit("2024-01-15 00:00:00"))
    ago = F.timestamp_seconds(F.unix_timestamp(now) - (F.col("c_custkey") % 100) * 3600)
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), (F.col("c_acctbal") > 0).alias("active"), F.when(F.col("c_custkey") % 11 != 0, ago).alias("last_crawled"), F.lit(86400).alias("frequency_s"))
    return U.schedule(_frontier(spark, sf_dir), sources, now).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@register("state_counts", "SELECT event_type AS state, count(*) AS n FROM events GROUP BY event_type")
def state_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "corpus_counts",
    "SELECT count(*) AS n, count(*) FILTER (lang = 'en') AS n_en, count(*) FILTER (lang <> 'en') AS n_other, count(DISTINCT source) AS n_sources, count(*) FILTER (toxic = 1) AS n_toxic, count(*) FILTER (quality IS NULL) AS n_unlabelled, sum(n_chars)::BIGINT AS chars FROM documents LEFT JOIN labels USING (doc_id)",
)
def corpus_counts(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("n_en"), F.count_if(F.col("lang") != "en").alias("n_other"),
        F.countDistinct("source").alias("n_sources"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.count_if(F.col("quality").isNull()).alias("n_unlabelled"), F.sum("n_chars").alias("chars"),
    )


@register("latency_percentiles", "SELECT event_type, n, round(v[least(n, floor(n * 0.5)::INT + 1)], 6) AS p50, round(v[least(n, floor(n * 0.95)::INT + 1)], 6) AS p95 FROM (SELECT event_type, count(*) AS n, list_sort(list(value)) AS v FROM events GROUP BY event_type)")
def latency_percentiles(spark, sf_dir):
    """Nearest-rank percentiles by counting: values are summed up to distinct ones first, so that no group is gathered in one row."""
    from pyspark.sql import Window

    counted = table(spark, sf_dir, "events").where(F.col("value").isNotNull()).groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("event_type")
    upto = counted.withColumns({"below": F.sum("c").over(w.orderBy("value")), "n": F.sum("c").over(w)})
    at = lambda q: F.min(F.when(F.col("below") >= F.least(F.col("n"), F.floor(F.col("n") * F.lit(q)) + 1), F.col("value")))
    return upto.groupBy("event_type").agg(F.first("n").alias("n"), F.round(at(0.5), 6).alias("p50"), F.round(at(0.95), 6).alias("p95"))


@register("rate_window", "SELECT user_id, max(n) AS peak, count(*) FILTER (n > 2) AS over FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY user_id")
def rate_window(spark, sf_dir):
    """A sliding limiter: requests within the last hour, at each request. Times are rounded to whole seconds, halves to the even one."""
    from pyspark.sql import Window

    seconds = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")
    w = Window.partitionBy("user_id").orderBy(seconds).rangeBetween(-3600, 0)
    return table(spark, sf_dir, "events").select("user_id", F.count(F.lit(1)).over(w).alias("n")).groupBy("user_id").agg(F.max("n").alias("peak"), F.count_if(F.col("n") > 2).alias("over"))


# ---- versions: the orders of a customer are the versions of a document


def _history(spark, sf_dir):
    return S.versions(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


_HISTORY = "SELECT *, row_number() OVER w::INT AS version, o_orderdate AS valid_from, lead(o_orderdate) OVER w AS valid_until FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@register("scd2_versions", f"WITH h AS ({_HISTORY}) SELECT o_custkey, o_orderkey, version, valid_from, valid_until FROM h")
def scd2_versions(spark, sf_dir):
    return _history(spark, sf_dir).select("o_custkey", "o_orderkey", "version", "valid_from", "valid_until")


@register("as_of_version", f"WITH h AS ({_HISTORY}) SELECT o_custkey, o_orderkey, version FROM h WHERE valid_from <= TIMESTAMP '1996-06-01' AND (valid_until IS NULL OR TIMESTAMP '1996-06-01' < valid_until)")
def as_of_version(spark, sf_dir):
    return S.as_of(_history(spark, sf_dir), F.to_timestamp(F.lit("1996-06-01"))).select("o_custkey", "o_orderkey", "version")


@register("current_version", f"WITH h AS ({_HISTORY}), d AS (SELECT o_custkey, max(version) AS current FROM h GROUP BY o_custkey) SELECT h.o_custkey, version, o_totalprice FROM h JOIN d ON h.o_custkey = d.o_custkey AND version = current")
def current_version(spark, sf_dir):
    history = _history(spark, sf_dir)
    current = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("int").alias("version"))
    return history.join(current, ["o_custkey", "version"]).select("o_custkey", "version", "o_totalprice")


@register("documents_with_sources", "SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0")
def documents_with_sources(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT c_custkey, c_name, n_name, r_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE c_acctbal > 0")


@register("chunk_entities_join", "SELECT l_orderkey AS chunk, count(DISTINCT l_partkey) AS n_entities, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS sources FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY l_orderkey")
def chunk_entities_join(spark, sf_dir):
    active = table(spark, sf_dir, "orders").where("o_orderstatus != 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(active, "l_orderkey")
    return found.groupBy(F.col("l_orderkey").alias("chunk")).agg(F.countDistinct("l_partkey").alias("n_entities"), F.array_join(F.sort_array(F.collect_set("l_suppkey")).cast("array<string>"), ",").alias("sources"))


@register("active_vectors", "SELECT vec_id, label FROM embeddings e SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON e.vec_id = l.doc_id")
def active_vectors(spark, sf_dir):
    usable = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label").join(usable, "vec_id", "left_semi")


@register("keep_difference", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 EXCEPT SELECT doc_id FROM labels")
def keep_difference(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id % 3 != 0").select("doc_id").distinct()
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


# ---- two rounds of crawling: documents as they are, and with every seventh edited, every eleventh gone, some new

_ROUNDS = """r1 AS (SELECT doc_id, source, text FROM documents WHERE doc_id % 13 <> 0),
r2 AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN text || ' edited' WHEN doc_id % 5 = 0 THEN replace(text, ' ', '  ') ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0)"""


def _rounds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" edited"))).when(F.col("doc_id") % 5 == 0, F.replace("text", F.lit(" "), F.lit("  "))).otherwise(F.col("text"))
    return docs.where("doc_id % 13 != 0"), docs.where("doc_id % 11 != 0").withColumn("text", edited)


@register(
    "change_ladder",
    f"""WITH {_ROUNDS}, a AS (SELECT doc_id, sha256(text) AS raw, sha256(trim(lower(regexp_replace(text, '\\s+', ' ', 'g')))) AS content FROM r1), b AS (SELECT doc_id, sha256(text) AS raw, sha256(trim(lower(regexp_replace(text, '\\s+', ' ', 'g')))) AS content FROM r2)
    SELECT doc_id, CASE WHEN b.raw IS NULL THEN 'gone' WHEN a.raw IS NULL THEN 'new' WHEN a.raw = b.raw THEN 'unchanged_bytes' WHEN a.content = b.content THEN 'unchanged_content' ELSE 'changed' END AS change FROM a FULL JOIN b USING (doc_id)""",
)
def change_ladder(spark, sf_dir):
    one, two = (r.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias(f"raw{i}"), F.sha2(F.encode(T.normalize(F.col("text")), "UTF-8"), 256).alias(f"content{i}")) for i, r in enumerate(_rounds(spark, sf_dir)))
    both = one.join(two, "doc_id", "full_outer")
    change = S.change_type(F.col("raw0").isNotNull(), F.col("raw0") == F.col("raw1"), F.col("content0") == F.col("content1"), F.col("raw1").isNull())
    return both.select("doc_id", change.alias("change"))


@register("change_counts", f"""WITH {_ROUNDS} SELECT CASE WHEN r2.text IS NULL THEN 'gone' WHEN r1.text IS NULL THEN 'new' WHEN r1.text = r2.text THEN 'same' ELSE 'changed' END AS change, count(*) AS n FROM r1 FULL JOIN r2 USING (doc_id) GROUP BY 1""")
def change_counts(spark, sf_dir):
    """The counters of a crawl round, from hashes of the texts rather than the texts."""
    one, two = (r.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias(f"h{i}")) for i, r in enumerate(_rounds(spark, sf_dir)))
    change = F.when(F.col("h1").isNull(), "gone").when(F.col("h0").isNull(), "new").when(F.col("h0") == F.col("h1"), "same").otherwise("changed")
    return one.join(two, "doc_id", "full_outer").groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


@register("chunk_upsert", f"WITH {_ROUNDS} SELECT coalesce(r1.doc_id, r2.doc_id) AS doc_id, md5(CASE WHEN r1.doc_id IS NOT NULL THEN r1.text ELSE r2.text END) AS text_md5, CASE WHEN r1.doc_id IS NOT NULL THEN 1 ELSE 2 END AS first_version, CASE WHEN r2.doc_id IS NOT NULL THEN 2 ELSE 1 END AS last_version, r1.doc_id IS NULL AS is_new FROM r1 FULL JOIN r2 USING (doc_id)")
def chunk_upsert(spark, sf_dir):
    """Text and first version of a chunk that was there stay; its last version moves on."""
    one, two = (r.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), F.lit(i + 1).alias("first_version"), F.lit(i + 1).alias("last_version")) for i, r in enumerate(_rounds(spark, sf_dir)))
    return S.upsert(one, two, ["doc_id"], sticky=["text_md5", "first_version"])


@register("source_upsert", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name || '!' ELSE c_name END AS name, false AS is_new FROM customer UNION ALL SELECT -s_suppkey - 1, s_name, true FROM supplier")
def source_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = old.where("id % 2 = 0").select("id", F.concat("name", F.lit("!")).alias("name"))
    new = new.unionByName(table(spark, sf_dir, "supplier").select((-F.col("s_suppkey") - 1).alias("id"), F.col("s_name").alias("name")))
    return S.upsert(old, new, ["id"])


@register("insert_or_ignore", "SELECT doc_id AS id, lang AS name FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, source FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 <> 0")
def insert_or_ignore(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("lang").alias("name"))
    return S.insert_or_ignore(old, docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.col("source").alias("name")), ["id"])


@register("retire_facts", "SELECT o_orderkey, o_orderstatus <> 'F' AND l.k IS NOT NULL AS active, CASE WHEN o_orderstatus <> 'F' AND l.k IS NULL THEN TIMESTAMP '2000-01-01' ELSE NULL END AS valid_until FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01') l ON o_orderkey = l.k")
def retire_facts(spark, sf_dir):
    facts = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") != "F").alias("active"), F.lit(None).cast("timestamp").alias("valid_until"))
    seen = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.to_timestamp(F.lit("1996-01-01"))).select(F.col("l_orderkey").alias("o_orderkey"))
    return S.retire(facts, seen, ["o_orderkey"], F.to_timestamp(F.lit("2000-01-01")))


@register("section_diff", f"WITH {_ROUNDS} SELECT doc_id, CASE WHEN r1.text IS NULL THEN 'added' WHEN r2.text IS NULL THEN 'removed' ELSE 'modified' END AS change FROM r1 FULL JOIN r2 USING (doc_id) WHERE r1.text IS DISTINCT FROM r2.text")
def section_diff(spark, sf_dir):
    one, two = (r.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("h")) for r in _rounds(spark, sf_dir))
    return S.section_diff(one, two, ["doc_id"], "h")


@register("change_summary", f"WITH {_ROUNDS}, d AS (SELECT source, coalesce(r1.doc_id, r2.doc_id) AS doc_id, CASE WHEN r1.text IS NULL THEN 'added' WHEN r2.text IS NULL THEN 'removed' ELSE 'modified' END AS change FROM r1 FULL JOIN r2 USING (doc_id, source) WHERE r1.text IS DISTINCT FROM r2.text) SELECT source, change, count(*) AS n, array_to_string(list_sort(list(doc_id))[1:4], ', ') AS first_four FROM d GROUP BY ALL")
def change_summary(spark, sf_dir):
    """The first four of each kind of change; only those are kept for each part before they are gathered."""
    from pyspark.sql import Window

    one, two = (r.select("source", "doc_id", F.md5(F.encode("text", "UTF-8")).alias("h")) for r in _rounds(spark, sf_dir))
    diff = S.section_diff(one, two, ["source", "doc_id"], "h")
    counts = diff.groupBy("source", "change").agg(F.count(F.lit(1)).alias("n"))
    first = diff.withColumn("r", F.row_number().over(Window.partitionBy("source", "change").orderBy("doc_id"))).where("r <= 4").groupBy("source", "change").agg(F.array_join(F.sort_array(F.collect_list("doc_id")).cast("array<string>"), ", ").alias("first_four"))
    return counts.join(first, ["source", "change"])


@register("url_transitions", f"WITH f AS ({_FRONTIER}) SELECT source_id, state, prev, count(*) AS n FROM (SELECT source_id, state, coalesce(lag(state) OVER (PARTITION BY source_id ORDER BY discovered_at, event_id), 'NONE') AS prev FROM f) GROUP BY ALL")
def url_transitions(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("source_id").orderBy("discovered_at", "url")
    return _frontier(spark, sf_dir).withColumn("prev", F.coalesce(F.lag("state").over(w), F.lit("NONE"))).groupBy("source_id", "state", "prev").agg(F.count(F.lit(1)).alias("n"))


@register("missing_vectors", "SELECT doc_id FROM documents ANTI JOIN embeddings ON doc_id = vec_id")
def missing_vectors(spark, sf_dir):
    """What an incremental index has still to embed."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@register("ablation_means", "SELECT lang, source, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def ablation_means(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("lang", "source").agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"), F.count(F.lit(1)).alias("n"))


@register("stride_sample", "WITH s AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS r FROM documents) SELECT source, min(doc_id) AS doc_id FROM s WHERE r % 7 = 0 GROUP BY source")
def stride_sample(spark, sf_dir):
    """Every seventh document by id, one for each source. Ranks come from counts of id ranges, not from one sorted partition."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return _ranked(docs, "doc_id").where("r % 7 = 0").groupBy("source").agg(F.min("doc_id").alias("doc_id"))


def _ranked(df, by):
    """df with r, its rank from 1 by a whole number: rank within blocks of 1024 numbers, after the counts of the blocks before."""
    from pyspark.sql import Window

    blocked = df.withColumn("_b", F.floor(F.col(by) / 1024))
    sizes = blocked.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.withColumn("_base", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).select("_b", "_base")
    return blocked.join(base, "_b").withColumn("r", F.col("_base") + F.row_number().over(Window.partitionBy("_b").orderBy(by))).drop("_b", "_base")
