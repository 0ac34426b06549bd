"""Operators of evidence and of entities against plain versions in Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import evidence as E


def picked(rows, per_document=2):
    steps, taken = {}, []
    for step, chunk, document, final in rows:
        steps.setdefault(step, []).append((-final, chunk, document))
    if len(steps) < 2:
        return []
    for step in sorted(steps):
        ranked = sorted(steps[step])
        if any(c in [t[0] for t in taken] for _, c, _ in ranked[:3]):
            continue
        for _, c, d in ranked:
            if c not in [t[0] for t in taken] and sum(t[1] == d for t in taken) < per_document:
                taken.append((c, d))
                break
    return [c for c, _ in taken]


def test_coverage_first(spark):
    r = random.Random(5)
    rows = [(q, r.randrange(r.choice([1, 5])), c, c % 3, round(r.random(), 1)) for q in range(60) for c in r.sample(range(12), 9)]
    rows += [(q, s + 1, c, d, f) for q, s, c, d, f in rows if r.random() < 0.3]
    found = dict(E.coverage_first(spark.createDataFrame(rows, "query int, step int, chunk int, document int, final double")).collect())
    assert found == {q: picked([x[1:] for x in rows if x[0] == q]) for q in range(60)}


def test_refinement(spark):
    filler = " ".join(["Nothing of note happened on that long and quiet day in the valley beyond."] * 2)
    text = f"An opening line. {filler} A license was granted to all. {filler} Acme stood by. In 1999 it ended. Words {' '.join(['word'] * 80)}."
    wanted = T.tokens(F.lit("license"))
    row = spark.range(1).select(
        E.refine(F.lit(text), wanted, F.array(F.lit("acme"))).alias("long"), E.refine(F.lit("One. Two. Three. Four."), wanted, F.array(F.lit("acme"))).alias("short"),
        E.refine(F.lit(None).cast("string"), wanted, F.array(F.lit("acme"))).alias("none"),
    ).first()
    assert row.long == "An opening line. A license was granted to all. Acme stood by. In 1999 it ended."
    assert row.short is None and row.none is None


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('<think>{"no": 1}</think>\n```json\n{"a": [1, 2]}\n```', {"a": [1, 2]}),
        ('Sure: {"a": 1} is it.', {"a": 1}),
        ("the list [1, 2, 3] ends", [1, 2, 3]),
        ("[1, {}]", [1, {}]),
        ("no json", None),
        ("{broken", None),
    ],
)
def test_json_of(spark, reply, want):
    found = spark.range(1).select(E.json_of(F.lit(reply)).alias("j")).first().j
    assert (json.loads(found) if found else None) == want


def test_unknown_dates_fail_and_kinds_are_opt_in(spark):
    rows = [(1, "chunk", "news", 1, ["a"], "2020-01-01"), (2, "chunk", "news", 1, ["a"], None), (3, "doc_summary", "news", 1, ["a"], "2020-01-01"), (4, "chunk", None, 1, None, "2020-01-01")]
    chunks = spark.createDataFrame(rows, "id int, kind string, source_type string, document int, entities array<string>, published string")
    ids = lambda c: [r.id for r in chunks.where(c).orderBy("id").collect()]
    assert ids(E.scope()) == [1, 2, 4]
    assert ids(E.scope(since="2019-01-01")) == [1, 4]
    assert ids(E.scope(kinds=["doc_summary"])) == [3]
    assert ids(E.scope(source_types=["news"], entities=["a"])) == [1, 2]
    assert ids(E.relaxed(source_types=["news"], since="2019-01-01")) == [1, 2, 4]


def test_refinement_of_documents_by_hand(spark):
    """Against the sequential tokens and sentences, on whole documents."""
    import re

    from quillon import catalogue
    from quillon.operators import language

    folder = "/root/testdata/sf0.001"
    wanted, found = set(language.tokens("permission notice of the license")), {r.doc_id: r.refined for r in catalogue.queries()["knowledge_refinement"](spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        parts = [s for _, _, s in language.sentences(r.text or "")]
        kept = [s for i, s in enumerate(parts) if i == 0 or set(language.tokens(s)) & wanted or r.source in s.lower() or re.search(r"\b(19|20)\d{2}\b", s)]
        strip = len(parts) >= 4 and language.token_count(r.text) >= 100 and len(kept) < len(parts)
        assert (" ".join(x.strip() for x in found[r.doc_id].split()) if r.doc_id in found else None) == (" ".join(" ".join(kept).split()) if strip else None)
