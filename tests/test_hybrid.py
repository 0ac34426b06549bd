"""Hybrid search with all lists and features, against the formulas worked out in plain Python."""

import math
import re

import pytest
from pyspark.sql import functions as F

from quillon.engine import Corpus
from quillon.operators import graph as G
from quillon.operators import language
from quillon.operators import retrieval as R

CHUNKS = [
    ("c1", "Acme released the Zeta model in March 2021.", "Acme news", ["acme", "zeta"], "2021-03-04"),
    ("c2", "The Zeta model uses sparse attention. Attention is sparse there.", "Zeta", ["zeta"], "2022-01-01"),
    ("c3", "Borealis partnered with Acme on safety work.", "Partners", ["acme", "borealis"], None),
    ("c4", "Cooking with lemons is a joy in summer.", "Kitchen", None, "2020-01-01"),
    ("c5", "Gamma models were released by Borealis long after the Zeta model.", "", ["borealis", "gamma"], "2023-05-05"),
    ("c6", "", "", [], None),
]
QUESTIONS = [(1, "Which model did Acme release in 2021?", ["acme"]), (2, "sparse attention of the Zeta model", ["zeta", "acme"]), (3, "lemons", [])]
FACTS = [(1, "acme", "RELEASED", "zeta", 0.9, True, "c1"), (2, "acme", "PARTNERS_WITH", "borealis", 0.8, True, "c3"), (3, "borealis", "RELEASED", "gamma", 0.7, True, "c5"), (4, "zeta", "USES", "attention", 0.6, False, "c2")]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = spark.createDataFrame(CHUNKS, "id string, text string, head string, entities array<string>, published string")
    made = Corpus(rows.selectExpr("*", "id AS document", "'s' AS source", "'news' AS kind"), spark.createDataFrame(FACTS, "id int, src string, rel string, dst string, conf double, active boolean, chunk string"))
    yield made
    made.close()


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "query int, text string, entities array<string>")


def test_graph_list_is_that_of_each_question(spark, corpus, questions):
    found = {(r.query, r.doc): r.score for r in corpus.search(questions, "graph", 10, hinted=["RELEASED"]).collect()}
    for query, _, seeds in QUESTIONS:
        want = {}
        if seeds:
            rows = G.chunk_scores(corpus.facts, spark.createDataFrame([(s,) for s in seeds], "seed string"), ["RELEASED"]).collect()
            want = {r.chunk: r.score for r in rows}
        for name, _, _, entities, _ in CHUNKS:
            n = len(set(entities or []) & set(seeds))
            if n:
                want[name] = want.get(name, 0.0) + 0.3 * n + (0.4 if n > 1 else 0.0)
        assert {d: s for (q, d), s in found.items() if q == query} == pytest.approx(want)


def test_hybrid_weighs_eight_features(corpus, questions):
    found = {(r.query, r.doc): r.score for r in corpus.search(questions, "hybrid", 10).collect()}
    lists = {}
    for r in corpus.lists(questions, ["bm25", "dense", "graph"], 50).collect():
        lists.setdefault(r.query, {}).setdefault(r.list, {})[r.doc] = r.score
    words = {c[0]: language.tokens(c[1]) + 2 * language.tokens(c[2]) for c in CHUNKS}
    held = {w for ws in words.values() for w in ws}
    n = sum(1 for ws in words.values() if ws)
    pairs = lambda ts: set(zip(ts, ts[1:], strict=False))
    for query, text, seeds in QUESTIONS:
        asked = language.tokens(text)
        df = lambda t: sum(t in ws for ws in words.values())
        weight = {t: math.log(1 + (n - df(t) + 0.5) / (df(t) + 0.5)) if t in held else 0.5 for t in asked}
        for name, body, head, entities, published in CHUNKS:
            if (query, name) not in found:
                assert all(name not in of for of in lists[query].values())
                continue
            own, years = language.tokens(body), re.findall(r"\b(?:19|20)\d{2}\b", text)
            part = lambda ts: sum(w for t, w in weight.items() if t in ts) / sum(weight.values())  # noqa: B023, E731
            prior = lambda m: max(0.0, lists[query].get(m, {}).get(name, 0.0)) / (max(lists[query].get(m, {}).values(), default=0.0) or 1.0)  # noqa: B023, E731
            feature = {
                "cov": part(own), "bigram": len(pairs(own) & pairs(asked)) / len(pairs(asked)) if pairs(asked) else 0.0, "entity": len(set(seeds) & set(entities or [])) / len(seeds) if seeds else 0.0,
                "title": part(language.tokens(head)), "prox": language.proximity(own, set(weight)), "year": float(any(y in body or y == (published or "")[:4] for y in years)), "dense": prior("dense"), "bm25": prior("bm25"),
            }
            assert found[query, name] == pytest.approx(sum(R.RERANK_WEIGHTS[c] * v for c, v in feature.items()), abs=1e-5), (query, name, feature)


def test_proximity_is_the_least_span(spark):
    import random

    r = random.Random(2)
    rows = [(i, [r.choice("abcdxyz") for _ in range(r.randrange(14))], r.sample("abcd", r.randrange(1, 5))) for i in range(200)]
    found = {x.i: x.p for x in spark.createDataFrame(rows, "i int, words array<string>, wanted array<string>").select("i", R.proximity(F.col("words"), F.col("wanted")).alias("p")).collect()}
    for i, words, wanted in rows:
        there = set(words) & set(wanted)
        need = max(1, int(0.6 * len(there)))
        spans = [b - a + 1 for a in range(len(words)) for b in range(a, len(words)) if len(set(words[a : b + 1]) & set(wanted)) >= need]
        assert found[i] == pytest.approx(min(1.0, need / min(spans)) if there else 0.0)


def test_filters_reach_every_list_and_modes_are_named(spark, corpus, questions):
    allowed = spark.createDataFrame([("c1",), ("c4",)], "doc string")
    for mode in ("bm25", "dense", "graph", "rrf", "hybrid"):
        assert {r.doc for r in corpus.search(questions, mode, 5, allowed).collect()} <= {"c1", "c4"}
    assert {r.doc for r in corpus.search(questions.drop("entities"), "rrf", 5, allowed).collect()} <= {"c1", "c4"}
    with pytest.raises(ValueError):
        corpus.search(questions.drop("entities"), "graph")
    with pytest.raises(ValueError):
        corpus.search(questions, "psychic")
