"""Queries of the sequential operators: pages, dates, sentences, chunks, mentions, context, claims, communities, questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.catalogue import register
from quillon.functions import text as T
from quillon.operators import claims as checks
from quillon.operators import communities, context, language, questions
from quillon.operators import retrieval as R
from quillon.plans.common import table
from quillon.sharing import Shared, by_rows
from quillon.sources import html


@register("html_parse")
def html_parse(spark, sf_dir):
    parsed = html.documents(table(spark, sf_dir, "pages"))
    n = F.aggregate("doc.sections", F.lit(0), lambda s, x: s + F.size(x["blocks"]))
    return parsed.select("page_id", "doc.title", "doc.published", "doc.lang", F.size("doc.links").alias("n_links"), F.size("doc.sections").alias("n_sections"), n.alias("n_blocks"), html.content_hash(F.col("doc")).alias("content"))


@register("page_markdown")
def page_markdown(spark, sf_dir):
    return html.documents(table(spark, sf_dir, "pages")).select("page_id", html.markdown(F.col("doc")).alias("markdown"))


@register("page_chunks")
def page_chunks(spark, sf_dir):
    parsed = html.documents(table(spark, sf_dir, "pages")).select("page_id", F.explode(language.chunked("doc.sections")).alias("c"))
    return chunk_ids(parsed.select("page_id", "c.ordinal", "c.path", "c.text", "c.tokens"), "page_id").select("page_id", "ordinal", "path", "tokens", "chunk_id")


def chunk_ids(chunks, page):
    """chunks(page, ordinal, path, text) with chunk_id: equal passages of a section are told apart by how many came before."""
    before = F.row_number().over(Window.partitionBy(page, "path", T.normalize(F.col("text"))).orderBy("ordinal")) - 1
    return chunks.withColumn("chunk_id", T.chunk_id(F.col(page), F.col("path"), F.col("text"), before))


@register("document_codec", "SELECT doc_id, source, lang, n_chars FROM documents")
def document_codec(spark, sf_dir):
    """Through JSON and back."""
    whole = F.to_json(F.struct("doc_id", "source", "lang", "n_chars"))
    back = F.from_json("j", "struct<doc_id:bigint,source:string,lang:string,n_chars:bigint>")
    return table(spark, sf_dir, "documents").select(whole.alias("j")).select(back.alias("d")).select("d.*")


@register("dates")
def dates(spark, sf_dir):
    rows = [(1, "Released on March 3, 2024 and 2023-05-06."), (2, "Q2 2023 results; 5 May 2022"), (3, "2024B tokens, in June 2021"), (4, "nothing in 2023-02-30")]
    found = spark.createDataFrame(rows, "id int, text string").select("id", F.explode(language.find_dates("text")).alias("d"))
    return found.select("id", F.col("d.start").cast("string").alias("start"), F.col("d.stop").cast("string").alias("stop"), "d.precision", "d.raw")


@register("sentences")
def sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n"))


@register("hashed_embeddings")
def hashed_embeddings(spark, sf_dir):
    v = language.embed("text")
    return table(spark, sf_dir, "documents").select("doc_id", v.alias("v")).select("doc_id", F.size("v").alias("size"), F.round(R.dot(F.col("v"), F.col("v")), 4).alias("norm"))


ALIASES = [("OpenAI", "openai", "ORGANIZATION"), ("Apache", "apache", "ORGANIZATION"), ("Mixture of Experts", "moe", "TECHNOLOGY"), ("GPT-4", "gpt-4", "MODEL"), ("License", "license", "TECHNOLOGY"), ("The", "the", "ORGANIZATION")]


@register("mentions")
def mentions(spark, sf_dir):
    """Names of a bounded gazetteer in all documents."""
    names = Shared(spark, language.Gazetteer(ALIASES))

    find = by_rows(lambda t: [dict(zip(("entity", "type", "begin", "end"), m, strict=True)) for m in names.value().mentions(t or "")], "array<struct<entity:string,type:string,begin:int,end:int>>")
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(find("text")).alias("m"))
    return found.select("doc_id", "m.entity", "m.begin", "m.end")


@register("mmr_context")
def mmr_context(spark, sf_dir):
    """Evidence for each benchmark passage as a question."""
    docs = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "benchmark")
    terms = R.query_terms(items, "item_id", "text")
    best = R.top(R.bm25(R.postings(docs, "doc_id", "text", only=R.listed(terms)), terms), 15)
    most = F.max("score").over(Window.partitionBy("query"))
    joined = R.few(best.withColumn("score", F.col("score") / most), items, 15).join(docs.select(F.col("doc_id").alias("doc"), "text", "source"), "doc")
    candidates = joined.select("query", F.col("doc").alias("chunk"), F.col("doc").alias("document"), "source", F.lit("news").alias("kind"), "text", "score", F.lit(1.0).alias("freshness"), language.embed("text").alias("v"))
    return context.build(candidates)


@register("claims")
def claims(spark, sf_dir):
    """Each benchmark passage as an answer that cites the first of the documents that hold it best, checked against these."""
    docs = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "benchmark")
    terms = R.query_terms(items, "item_id", "text")
    best = R.top(R.bm25(R.postings(docs, "doc_id", "text", only=R.listed(terms)), terms), 3).select("query", "doc", "rank")
    piece = F.struct(F.concat(F.lit("E"), "rank").alias("name"), "text", F.lit("").alias("title"), "source")
    texts = R.few(best, items, 3).join(docs.select(F.col("doc_id").alias("doc"), "text", "source"), "doc").groupBy("query").agg(F.array_sort(F.collect_list(piece)).alias("evidence"))
    answers = items.select(F.col("item_id").alias("query"), F.concat("text", F.lit(" [E1]")).alias("answer")).join(texts, "query")
    return checks.verify(answers).select("query", "number", "claim", "verdict", F.round("coverage", 6).alias("coverage"), "cited_ok")


_EVIDENCE = [
    ("E1", "Acme released Turbo 3 on March 8, 2024. Turbo 3 comes in 9B and 60B parameter sizes.", "T", "S"),
    ("E2", "Mixto is a sparse Mixture of Experts model released under the Apache 2.0 license.", "T", "S"),
]
_CLAIMED = [
    (1, "Acme introduced Turbo 3 in March 2024 [E1].", "supported", True), (2, "Turbo 3 was released on May 2, 2024 [E1].", "unsupported", False), (3, "Turbo 3 has 305B parameters [E1].", "unsupported", False),
    (4, "Mixto uses MoE under an Apache 2.0 license [E2].", "supported", True), (5, "Other Lab acquired Another Firm last year [E2].", "unsupported", False),
    (6, "Turbo 3 comes in 9B and 60B sizes [E2].", "supported", False), (7, "Mixto is released under Apache 2.0", "supported", None),
]


@register("claim_verdicts", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{v}', '{'none' if ok is None else str(ok).lower()}')" for i, _, v, ok in _CLAIMED) + ") AS v(id, verdict, cited_ok)")
def claim_verdicts(spark, sf_dir):
    """Cases with a known outcome: a paraphrase, a wrong date, an invented number, an acronym for its words, an unrelated assertion, a citation of the wrong piece."""
    rows = spark.createDataFrame([(i, text, _EVIDENCE) for i, text, _, _ in _CLAIMED], f"id int, answer string, evidence array<struct<{checks.READING.replace(' ', ':').replace(',:', ',')}>>")
    return checks.verify(rows, "id").select("id", "verdict", F.coalesce(F.col("cited_ok").cast("string"), F.lit("none")).alias("cited_ok"))


@register("louvain")
def louvain(spark, sf_dir):
    from quillon.operators.graph import adjacency
    from quillon.plans.graphs import _edges

    return communities.detect(adjacency(_edges(spark, sf_dir)))


_QUESTIONS = [
    (1, "Compare GPT-4 and Llama 3.1", 2, ["GPT-4", "Llama 3.1"]), (2, "When was the model released?", 1, ["model"]), (3, "How has pricing evolved since 2021?", 0, []),
    (4, "Which companies partnered with Acme?", 1, ["Acme"]), (5, "Why is attention efficient?", 0, []), (6, "Give me an overview of the chip landscape", 0, []),
    (7, "Who developed the 70b model, and what is its license?", 0, []), (8, "What is the capital", 0, []),
]


def _asked(spark):
    return questions.analyse(spark.createDataFrame(_QUESTIONS, "id int, text string, n_entities int, names array<string>"))


@register("question_types", "SELECT * FROM (VALUES (1, 'comparative'), (2, 'factual'), (3, 'temporal'), (4, 'relational'), (5, 'analytical'), (6, 'exploratory'), (7, 'relational'), (8, 'factual')) AS v(id, type)")
def question_types(spark, sf_dir):
    return _asked(spark).select("id", "type")


@register("routing")
def routing(spark, sf_dir):
    return questions.route(_asked(spark)).select("id", "type", "bm25", "dense", "graph", "diversity", "hyde")


@register("decomposition")
def decomposition(spark, sf_dir):
    return questions.decompose(_asked(spark), "id")


@register("search_hybrid")
def search_hybrid(spark, sf_dir):
    from quillon.engine import Corpus

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("head"), F.col("doc_id").alias("document"), "source", F.lit("news").alias("kind"))
    asked = spark.createDataFrame([(0, "apache license version 2.0"), (1, "disgusting trash")], "query int, text string")
    return Corpus(docs).search(asked, "hybrid", 10).select("query", "doc", "score", "rank")


@register("ask")
def ask(spark, sf_dir):
    from quillon.engine import Corpus

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("head"), F.col("doc_id").alias("document"), "source", F.lit("news").alias("kind"))
    asked = spark.createDataFrame([(0, "apache license version 2.0"), (1, "zzyzx quuxblat")], "query int, text string")
    return Corpus(docs).ask(asked)


@register(
    "question_variants",
    "SELECT * FROM (VALUES (1, 'original', 'What is a moe release?', 1.0::DOUBLE), (1, 'rewrite', 'a moe release GPT-4', 0.7::DOUBLE), (1, 'expansion', 'What is a moe release? mixture of experts introduce announce launch', 0.5::DOUBLE), (2, 'original', 'cats', 1.0::DOUBLE)) AS v(id, kind, text, weight)",
)
def question_variants(spark, sf_dir):
    rows = spark.createDataFrame([(1, "What is a moe release?", ["GPT-4"]), (2, "cats", [])], "id int, text string, names array<string>")
    return questions.variants(rows, "id")


@register(
    "condensed_turns",
    "SELECT * FROM (VALUES (1, 1, 'Who made GPT-4?'), (1, 2, 'What is GPT-4''s license?'), (1, 3, 'And when was GPT-4 released?'), (2, 1, 'What is it?'), (3, 2, 'how much (regarding A and B)?'), (3, 1, 'Compare A and B')) AS v(conv_id, turn, standalone)",
)
def condensed_turns(spark, sf_dir):
    rows = [(1, 1, "Who made GPT-4?", ["GPT-4"]), (1, 2, "What is its license?", []), (1, 3, "And when was it released?", []), (2, 1, "What is it?", []), (3, 1, "Compare A and B", ["A", "B"]), (3, 2, "how much", [])]
    return questions.condense(spark.createDataFrame(rows, "conv_id int, turn int, text string, names array<string>")).select("conv_id", "turn", "standalone")
