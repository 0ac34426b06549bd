"""Retrieval over many queries at once: BM25, dense vectors, fusion, reranking features, evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T

K1, B, FIELD_BOOST = 1.5, 0.75, 2.0
RRF_K = 60
# Weights of the reranking features.
RERANK_WEIGHTS = {"cov": 0.30, "bigram": 0.12, "entity": 0.18, "title": 0.08, "prox": 0.10, "year": 0.05, "dense": 0.12, "bm25": 0.05}


#: Rows up to which the side of the questions is sent to all tasks.
FEW = 1_000_000


def is_few(rows: DataFrame, times: int = 1) -> bool:
    """Whether the rows, times so many, are few enough to be sent to all tasks. Counts them, so rows are those of questions and not of documents."""
    return rows.limit(FEW // times + 1).count() <= FEW // times


def few(rows: DataFrame, of: DataFrame | None = None, times: int = 1) -> DataFrame:
    """The rows, marked for broadcast where they are few: at most `times` for each row of `of`, or counted themselves."""
    return F.broadcast(rows) if is_few(rows if of is None else of, times) else rows


#: Terms of questions up to which other words are told from them word by word.
LISTED = 10_000


def listed(terms: DataFrame) -> list[str] | None:
    """The distinct terms of questions(term), or None if they are too many to be named in a plan."""
    found = [r[0] for r in terms.select("term").distinct().limit(LISTED + 1).collect()]
    return found if len(found) <= LISTED else None


def postings(docs: DataFrame, doc: str, text: str, fields: list[str] | None = None, boost: float = FIELD_BOOST, only: list[str] | None = None) -> DataFrame:
    """doc, term, tf, dl, first: a row for each term of each document, of which one is its first. Terms of the fields weigh boost.

    only: the terms that matter; all others of a document are one row of the empty term, so that statistics, matches and scores for these terms stay the same.

    Texts meet by document once, as they are; terms are counted within a row, so that nothing of the index is dealt out, sorted or kept."""
    head = F.concat_ws(" ", *fields) if fields else F.lit(None).cast("string")
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), head.alias("head")).where(F.col("doc").isNotNull())
    joined = lambda c: F.array_join(F.collect_list(c), "\n").alias(c)
    whole = rows.repartition("doc").groupBy("doc").agg(joined("text"), *([joined("head")] if fields else []))
    words = whole.select("doc", T.tokens(F.col("text")).alias("words"), *([T.tokens(F.col("head")).alias("heads")] if fields else []))
    length = F.size("words") + F.size("heads") * float(boost) if fields else F.size("words").cast("double")
    counted = words.select("doc", length.alias("dl"), "words", *(["heads"] if fields else []))
    if only is not None:
        told = ", ".join(f"'{t}'" for t in sorted(only)) or "''"  # terms hold letters, digits, points and hyphens
        counted = counted.withColumns({c: F.expr(f"filter({c}, w -> w IN ({told}))") for c in ("words", "heads") if c in counted.columns})
    bag = T.bag(F.col("words"), F.col("heads") if fields else None, boost)
    if only is not None:
        left = F.col("dl") - F.size("words") - (F.size("heads") * float(boost) if fields else 0)
        others = F.when(F.col("dl") > 0, F.array(F.struct(F.lit("").alias("term"), left.cast("double").alias("tf"))))
        bag = F.concat(others, F.coalesce(bag, F.array().cast("array<struct<term:string,tf:double>>")))
    counted = counted.select("doc", "dl", bag.alias("bag"))
    each = counted.select("doc", "dl", F.posexplode("bag").alias("_at", "_t"))
    return each.select("doc", F.col("_t.term").alias("term"), F.col("_t.tf").alias("tf"), "dl", (F.col("_at") == 0).cast("int").alias("first"))


def without(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index less the postings of gone(doc); what is counted from it afterwards knows nothing of them."""
    return index.join(gone.select("doc").distinct(), "doc", "left_anti")


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: n documents and their average length."""
    return index.agg(F.sum("first").cast("double").alias("n"), (F.sum("tf") / F.sum("first")).alias("avgdl"))


def statistics(index: DataFrame, terms: DataFrame) -> DataFrame:
    """term, df, tf, first of the index for the terms of questions, and a row of the empty term for all other postings: what is counted in one pass. Kept."""
    asked = few(terms.select("term").distinct(), terms).withColumn("_asked", F.lit(True))
    term = F.when(F.col("_asked"), F.col("term")).otherwise("").alias("term")
    counted = index.join(asked, "term", "left").select(term, "tf", "first").groupBy("term")
    return counted.agg(F.count(F.lit(1)).cast("double").alias("df"), F.sum("tf").alias("tf"), F.sum("first").alias("first")).persist()


def known_terms(stats: DataFrame) -> DataFrame:
    """term, df, n, avgdl, idf of the terms of questions that the index holds, from its statistics."""
    counted = stats.where("term != ''").select("term", "df").crossJoin(F.broadcast(corpus_stats(stats)))
    return counted.withColumn("idf", idf(F.col("n"), F.col("df")))


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def document_frequency(index: DataFrame) -> DataFrame:
    """term, df, n, avgdl, idf of every term. Both sides of the join read the same counts, dealt out once: what is asked of them is the same."""
    counted = index.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"), F.sum("tf").alias("tf"), F.sum("first").alias("first")).where("df > 0 AND tf >= 0 AND first >= 0")
    return counted.select("term", "df").crossJoin(F.broadcast(corpus_stats(counted))).withColumn("idf", idf(F.col("n"), F.col("df")))


def query_terms(queries: DataFrame, query: str, text: str) -> DataFrame:
    return T.terms(queries, [F.col(query).alias("query")], F.col(text)).distinct()


def matched(index: DataFrame, terms: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """query, doc, score by BM25, and shared, the number of terms that they share, for terms(query, term). stats: the index's statistics for these terms, if they are there already.

    Few terms of questions go to the documents, whose postings are not dealt out for them."""
    weights = terms.join(known_terms(statistics(index, terms) if stats is None else stats), "term").select("query", "term", "idf", "avgdl")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    found = index.join(few(weights, terms), "term").select("query", "doc", part.alias("part"))
    return found.groupBy("query", "doc").agg(F.round(F.sum("part"), 6).alias("score"), F.count(F.lit(1)).cast("double").alias("shared"))


def bm25(index: DataFrame, terms: DataFrame, allowed: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """query, doc, score. Statistics cover the whole index; `allowed` (doc) only limits what is scored."""
    scored = matched(index, terms, stats).select("query", "doc", "score")
    return scored if allowed is None else scored.join(allowed, "doc", "left_semi")


def top(scored: DataFrame, k: int, by: str | list[str] = "query", item: str = "doc", score: str = "score") -> DataFrame:
    """The k best items of each group with their rank; ties go to the smaller item."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), F.asc(item)))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Query vectors that meet the stored vectors in one pass, scores that a task works out at once, and found rows that it holds.
BLOCK, TILE, HELD = 2048, 1 << 20, 100_000


def _tiles(batches, asked, q, apart: bool):
    """(docs, scores) of slices of the batches: scores has a row for each query and at most TILE entries, whatever the batches' sizes. -inf: a query's own vector."""
    import numpy as np
    import pyarrow as pa

    own: dict = {}
    for i, name in enumerate(asked):
        own.setdefault(name, []).append(i)
    step = max(1, TILE // max(1, len(asked)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            column = part.column("doc")
            docs = column.to_numpy() if pa.types.is_integer(column.type) and not column.null_count else np.array(column.to_pylist(), object)
            vectors = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(np.float64)
            score = q @ vectors.T
            np.round(score, 6, out=score)
            if apart:
                for j, d in enumerate(docs.tolist()):
                    for i in own.get(d, ()):
                        score[i, j] = -np.inf
            yield docs, score


def _in_blocks(vectors: DataFrame, queries: DataFrame, scan, schema: str) -> DataFrame:
    """The rows that scan(queries of a block, shared) finds, over all blocks of BLOCK queries, each sent to the stored vectors by itself, so that no task or broadcast holds more of them."""
    import numpy as np

    from quillon.sharing import Shared

    spark, found, held = vectors.sparkSession, None, []

    def flush():
        nonlocal found, held
        if held:
            block = Shared(spark, ([r["query"] for r in held], np.array([r["q"] for r in held], np.float64)))
            part = vectors.select("doc", "v").mapInArrow(scan(block), schema)
            found = part if found is None else found.unionByName(part)
            held = []

    for row in queries.select("query", "q").toLocalIterator():
        held.append(row)
        if len(held) == BLOCK:
            flush()
    flush()
    return found if found is not None else spark.createDataFrame([], schema)


def _arrow(kind: str):
    import pyarrow as pa

    return {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())


def dense(vectors: DataFrame, queries: DataFrame, k: int | None = None, least: float | None = None, apart: bool = True) -> DataFrame:
    """query, doc, score of vectors(doc, v) for queries(query, q): the k best of each task, or all that score at least `least`.

    apart: a vector is no answer to the query of its own id. All vectors have one length."""
    import numpy as np
    import pyarrow as pa

    if (k is None) == (least is None):
        raise ValueError("either k or least")
    kinds = dict(queries.dtypes)["query"], dict(vectors.dtypes)["doc"]
    asks, answers = map(_arrow, kinds)
    tiles = _tiles

    def scan(block):
        def run(batches):
            asked, q = block.value()
            floor, held = np.full(len(asked), -np.inf if k is not None else least), ([], [], [])

            def settled():
                who, docs, score = (np.concatenate(x) for x in held)
                order = np.lexsort((docs, -score, who))
                who, docs, score = who[order], docs[order], score[order]
                if k is not None:
                    place = np.arange(len(who)) - np.searchsorted(who, who)
                    floor[who[place == k - 1]] = score[place == k - 1]
                    who, docs, score = who[place < k], docs[place < k], score[place < k]
                return who, docs, score

            def rows():
                who, docs, score = settled()
                return pa.RecordBatch.from_arrays([pa.array([asked[i] for i in who], asks), pa.array(docs.tolist(), answers), pa.array(score)], ["query", "doc", "score"])

            for docs, score in tiles(batches, asked, q, apart):
                least_here = floor
                if k is not None and k < len(docs) and np.isinf(floor).any():
                    least_here = np.maximum(floor, np.partition(score, -k, axis=1)[:, -k])
                who, at = np.nonzero((score >= least_here[:, None]) & (score > -np.inf))
                for column, x in zip(held, (who, docs[at], score[who, at]), strict=True):
                    column.append(x)
                if sum(map(len, held[0])) > HELD:
                    if k is None:
                        yield rows()
                        for column in held:
                            column.clear()
                    else:
                        for column, x in zip(held, settled(), strict=True):
                            column[:] = [x]
            if held[0]:
                yield rows()

        return run

    return _in_blocks(vectors, queries, scan, f"query {kinds[0]}, doc {kinds[1]}, score double")


def near(vectors: DataFrame, queries: DataFrame, least: float, apart: bool = True) -> DataFrame:
    """query, hits and best: how many vectors(doc, v) score at least `least` for each of queries(query, q), and the best score. What is found is counted where it is found."""
    import numpy as np
    import pyarrow as pa

    kind = dict(queries.dtypes)["query"]
    asks, tiles = _arrow(kind), _tiles

    def scan(block):
        def run(batches):
            asked, q = block.value()
            hits, best = np.zeros(len(asked), np.int64), np.full(len(asked), -np.inf)
            for _, score in tiles(batches, asked, q, apart):
                hits += (score >= least).sum(1)
                np.maximum(best, score.max(1), out=best)
            some = np.flatnonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array([asked[i] for i in some], asks), pa.array(hits[some]), pa.array(best[some])], ["query", "hits", "best"])

        return run

    return _in_blocks(vectors, queries, scan, f"query {kind}, hits bigint, best double").groupBy("query").agg(F.sum("hits").alias("hits"), F.max("best").alias("best"))


def fuse(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """query, doc, fused from ranked(query, list, doc, rank, weight): reciprocal ranks, weighted and summed."""
    return ranked.groupBy("query", "doc").agg(F.round(F.sum(F.col("weight") / (F.lit(float(k)) + F.col("rank"))), 9).alias("fused"))


def metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """query with recall, precision, mrr and ndcg at k, from ranked(query, doc, rank) and gold(query, doc)."""
    wanted = gold.groupBy("query").agg(F.count(F.lit(1)).cast("double").alias("n_gold"))
    return rated(ranked.where(F.col("rank") <= k).join(gold, ["query", "doc"], "left_semi"), wanted, k)


def rated(right: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The metrics from the ranked rows right(query, doc, rank) that are gold, none beyond k, and wanted(query, n_gold), for gold too large to be listed."""
    hits = right.groupBy("query").agg(F.count(F.lit(1)).cast("double").alias("hits"), F.min("rank").alias("first"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_gold").cast("int"))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return wanted.join(hits, "query", "left").select(
        "query",
        F.round(zero(F.col("hits") / F.col("n_gold")), 6).alias("recall"),
        F.round(zero(F.col("hits") / F.lit(float(k))), 6).alias("precision"),
        F.round(zero(1.0 / F.col("first")), 6).alias("mrr"),
        F.round(zero(F.col("dcg") / ideal), 6).alias("ndcg"),
    )


def proximity(words: Column, wanted: Column) -> Column:
    """How densely the best stretch of words holds 0.6 of the wanted ones that occur: the least span is found by two pointers, batch by batch."""

    @F.pandas_udf("double")
    def run(lists: pd.Series, terms: pd.Series) -> pd.Series:
        from quillon.operators import language

        return pd.Series([language.proximity(list(x), set(y)) if x is not None and y is not None else 0.0 for x, y in zip(lists, terms, strict=True)], dtype=float)

    return run(words, wanted)


def rerank_features(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """query, doc with cov, bigram, title, year, entity and prox, from pairs(query, question, doc, text, head) and weights(query, term, w).

    pairs may tell entities and asked_entities (arrays) and published (a date as text); without them what they give is 0."""
    given = set(pairs.columns)
    years = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b(?:19|20)[0-9]{2}\b"), F.lit(0)))
    share = lambda a, b: F.when(F.size(b) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(b))
    published = F.substring("published", 1, 4) if "published" in given else F.lit("")
    named = share(F.array_distinct("entities"), F.array_distinct("asked_entities")) if {"entities", "asked_entities"} <= given else F.lit(0.0)
    whole = pairs.select(
        "query", "doc",
        T.tokens(F.col("text")).alias("words"), T.tokens(F.col("head")).alias("heads"), T.tokens(F.col("question")).alias("asked"),
        F.coalesce(F.exists(years(F.col("question")), lambda y: F.contains("text", y) | F.coalesce(y == published, F.lit(False))), F.lit(False)).cast("double").alias("year"),
        F.coalesce(named, F.lit(0.0)).alias("entity"),
    )
    weighted = weights.groupBy("query").agg(F.collect_list(F.struct("term", "w")).alias("terms"), F.sum("w").alias("total"))
    covered = lambda words: F.aggregate(F.filter("terms", lambda t: F.array_contains(words, t["term"])), F.lit(0.0), lambda s, t: s + t["w"]) / F.col("total")
    return whole.join(weighted, "query").select(
        "query", "doc", "year",
        F.round(covered(F.col("words")), 6).alias("cov"),
        F.round(share(F.array_distinct(T.bigrams(F.col("words"))), F.array_distinct(T.bigrams(F.col("asked")))), 6).alias("bigram"),
        F.round(covered(F.col("heads")), 6).alias("title"),
        F.round("entity", 6).alias("entity"),
        F.round(proximity(F.col("words"), F.transform("terms", lambda t: t["term"])), 6).alias("prox"),
    )


def priors(scored: DataFrame) -> DataFrame:
    """query, doc, dense and bm25 from scored(query, doc, list, score): each list's score as a share of the best among the query's candidates; nothing below 0."""
    best = F.max("score").over(Window.partitionBy("query", "list"))
    part = scored.withColumn("p", F.when(best > 0, F.greatest(F.col("score"), F.lit(0.0)) / best).otherwise(0.0))
    of = lambda name: F.coalesce(F.max(F.when(F.col("list") == name, F.col("p"))), F.lit(0.0)).alias(name)
    return part.groupBy("query", "doc").agg(of("dense"), of("bm25"))
