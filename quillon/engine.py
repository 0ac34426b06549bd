"""The engine's front door: a corpus, searched and asked in batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import context, graph, language
from quillon.operators import retrieval as R

MODES = ("bm25", "dense", "graph", "rrf", "hybrid")
#: What each method's list weighs.
WEIGHTS = {"bm25": 1.0, "dense": 1.0, "graph": 1.0}
#: Candidates that each list sends on, and that are reranked.
CANDIDATES = 50


class Corpus:
    """Chunks(id, text, head, document, source, kind) with a term index, read from the texts for each search, and hashed vectors, made once and kept.

    Chunks may tell entities (an array) and published (a date as text). facts(id, src, rel, dst, conf, active, chunk) are the edges between entities."""

    def __init__(self, chunks: DataFrame, facts: DataFrame | None = None):
        self.chunks, self.facts = chunks, facts
        self.kept: list[DataFrame] = []
        self.vectors = chunks.select(F.col("id").alias("doc"), language.embed("text").alias("v")).persist()

    def close(self) -> None:
        for kept in (self.vectors, *self.kept):
            kept.unpersist()
        self.kept.clear()

    def index(self, terms: DataFrame) -> DataFrame:
        """The term index for terms of questions."""
        return R.postings(self.chunks, "id", "text", ["head"], only=R.listed(terms))

    def keep(self, rows: DataFrame) -> DataFrame:
        """Rows of a search that several steps read: at most some for each question."""
        self.kept.append(rows)
        return rows.persist()

    def lists(self, questions: DataFrame, methods: list[str], k: int, allowed: DataFrame | None = None, hinted: list[str] | None = None, stats: DataFrame | None = None) -> DataFrame:
        """query, list, doc, score, rank: the k best of each method. stats: the index's statistics for the questions' terms, if they are there already."""
        found = []
        for method in methods:
            if method == "bm25":
                terms = R.query_terms(questions, "query", "text")
                scored = R.bm25(self.index(terms), terms, allowed, stats)
            elif method == "dense":
                vectors = self.vectors.join(allowed, "doc", "left_semi") if allowed is not None else self.vectors
                scored = R.dense(vectors, questions.select("query", language.embed("text").alias("q")), k, apart=False)
            else:
                mentions = self.chunks.select(F.col("id").alias("doc"), F.explode("entities").alias("node")) if "entities" in self.chunks.columns else None
                seeds = questions.select("query", F.explode("entities").alias("seed"))
                scored = graph.scores_by_query(self.facts, seeds, hinted or [], mentions).join(self.chunks.select(F.col("id").alias("doc")), "doc", "left_semi")
                scored = scored.join(allowed, "doc", "left_semi") if allowed is not None else scored
            found.append(R.top(scored.select("query", "doc", "score"), k).select("query", F.lit(method).alias("list"), "doc", "score", "rank"))
        return reduce(DataFrame.unionByName, found)

    def search(self, questions: DataFrame, mode: str = "hybrid", k: int = 10, allowed: DataFrame | None = None, hinted: list[str] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
        """query, doc, score, rank for questions(query, text), which may tell their entities (an array); these and facts give the list of the graph.

        hinted: relations that the questions ask about. weights: what the lists of bm25, dense and graph weigh; 0 leaves one out."""
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        linked = self.facts is not None and "entities" in questions.columns
        if mode == "graph" and not linked:
            raise ValueError("the graph is searched by facts of the corpus and entities of the questions")
        if mode in WEIGHTS:
            return self.lists(questions, [mode], k, allowed, hinted).drop("list")
        weight = {m: w for m, w in {**WEIGHTS, **(weights or {})}.items() if w > 0 and (m != "graph" or linked)}
        terms = R.query_terms(questions, "query", "text")
        stats = R.statistics(self.index(terms), terms)
        self.kept.append(stats)
        ranked = self.keep(self.lists(questions, list(weight), CANDIDATES if mode == "hybrid" else max(k, CANDIDATES), allowed, hinted, stats))
        heavy = reduce(lambda c, m: c.when(F.col("list") == m, weight[m]), weight, F.when(F.lit(False), 0.0))
        fused = R.fuse(ranked.withColumn("weight", heavy)).withColumnRenamed("fused", "score")
        if mode == "rrf":
            return R.top(fused, k)
        best = R.top(fused, CANDIDATES).select("query", "doc")
        return R.top(self.reranked(questions, best, ranked, stats), k)

    def reranked(self, questions: DataFrame, best: DataFrame, ranked: DataFrame, stats: DataFrame) -> DataFrame:
        """query, doc, score: all eight features of the candidates best(query, doc), weighted. stats: the index's statistics for the questions' terms."""
        df = R.known_terms(stats).select("term", "idf")
        terms = R.query_terms(questions, "query", "text").join(df, "term", "left").select("query", "term", F.coalesce("idf", F.lit(0.5)).alias("w"))
        text = self.chunks.select(F.col("id").alias("doc"), "text", "head", *(c for c in ("entities", "published") if c in self.chunks.columns))
        asked = questions.select("query", F.col("text").alias("question"), *([F.col("entities").alias("asked_entities")] if "entities" in questions.columns else []))
        features = R.rerank_features(R.few(best, questions, CANDIDATES).join(text, "doc").join(asked, "query"), terms)
        known = R.priors(ranked.join(best, ["query", "doc"], "left_semi"))
        whole = features.join(known, ["query", "doc"])
        score = reduce(lambda s, c: s + F.col(c) * R.RERANK_WEIGHTS[c], R.RERANK_WEIGHTS, F.lit(0.0))
        return whole.select("query", "doc", F.round(score, 6).alias("score"))

    def ask(self, questions: DataFrame, k: int = 15, most: int = 9) -> DataFrame:
        """query and answer: sentences of the evidence, each cited; no answer where the evidence is too weak."""
        import pandas as pd

        best = R.few(self.search(questions, "hybrid", k), questions, k)
        found = best.join(self.chunks.withColumnRenamed("id", "doc"), "doc")
        candidates = found.select("query", F.col("doc").alias("chunk"), "document", "source", "kind", "text", "score", F.lit(1.0).alias("freshness"), language.embed("text").alias("v"))
        kept = R.few(context.build(candidates, most), questions, most).join(self.chunks.select(F.col("id").alias("chunk"), "text"), "chunk")
        pieces = kept.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("pieces"), F.max("final").alias("best"))

        def write(frames):
            for rows in frames:
                out = []
                for query, text, found_, best in rows[["query", "text", "pieces", "best"]].itertuples(index=False):
                    evidence = [(f"E{p['position']}", p["text"]) for p in found_] if found_ is not None else []
                    answer = context.extract(text, evidence) if evidence and best >= 0.12 else ""
                    out.append((query, answer or None, len(evidence)))
                yield pd.DataFrame(out, columns=["query", "answer", "n_evidence"])

        asked = questions.select("query", "text").join(pieces, "query", "left")
        return asked.mapInPandas(write, f"query {dict(questions.dtypes)['query']}, answer string, n_evidence int")
