"""Odd rows and steps that have to stay small on large tables, against SQL or plain Python."""

import re
from datetime import datetime, timedelta

import duckdb

from quillon import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


def same_as_sql(spark, folder, name, *tables):
    """The query's rows over a folder's tables, and those of its SQL."""
    duck = duckdb.connect()
    for t in tables:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    found = QUERIES[name](spark, str(folder))
    want = duck.sql(f"SELECT {', '.join(found.columns)} FROM ({ORACLES[name]})").fetchall()
    return sorted(map(tuple, found.collect()), key=str), sorted(want, key=str)


def test_rate_window_rounds_seconds(spark, tmp_path):
    start = datetime(2024, 1, 1)
    times = [0, 0.4, 0.5, 0.6, 1.5, 2.5, 3599.5, 3600.4, 3600.5, 3600.6, 3601.5, 3602.5, 7200.5, 7201.49, None]
    rows = [(i, start + timedelta(seconds=t) if t is not None else None, u) for u in (1, 2) for i, t in enumerate(times[u - 1 :])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    found, want = same_as_sql(spark, tmp_path, "rate_window", "events")
    assert found == want


def test_dense_works_in_tiles(spark, tmp_path, monkeypatch):
    """No task holds more scores at once than a tile has, and gold is not listed: the four queries still give the rows of their SQL, with ties and repeated ids."""
    import random

    from quillon.operators import retrieval as R

    r = random.Random(3)
    rows = [(i if i < 280 else i - 100, [float(r.choice((-0.5, 0.0, 0.5))) for _ in range(4)], r.choice((1, 2, 3, 4, None))) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(R, "BLOCK", 7)
    for name in ("dense_knn", "dense_filtered", "semantic_cache_hits", "retrieval_metrics"):
        found, want = same_as_sql(spark, tmp_path, name, "embeddings")
        assert [tuple(round(x, 6) if isinstance(x, float) else x for x in row) for row in found] == [tuple(round(x, 6) if isinstance(x, float) else x for x in row) for row in want], name


def test_tiles_are_small():
    import numpy as np
    import pyarrow as pa

    from quillon.operators import retrieval as R

    n, queries = 5000, 2048
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(np.ones((n, 2)).tolist())], ["doc", "v"])
    shapes = [score.shape for _, score in R._tiles(iter([batch]), list(range(queries)), np.ones((queries, 2)), True)]
    assert sum(x[1] for x in shapes) == n and all(x[0] == queries and x[0] * x[1] <= R.TILE for x in shapes)


ODD = [(1, "Zeta models, GPT-4 and models"), (1, "the zeta model of 3.1"), (2, None), (3, ""), (4, "the of and"), (5, "alpha beta alpha GPT-4 beta's"), (6, "alpha zeta licensed licenses"), (7, "x alpha beta alpha GPT-4 beta's y")]


def test_index_of_odd_documents(spark, tmp_path):
    """Repeated ids are one document; empty and missing texts are none; terms that nobody asks for still count in lengths."""
    spark.createDataFrame([(i, t, "en", "s0", 0) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(1, "alpha beta alpha GPT-4 beta's"), (2, "zeta licenses of unknown things"), (3, "nothing there")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("bm25_topk", "bm25_idf", "bm25_batch", "bm25_field_boost", "rrf_fusion", "fused_topk", "prior_normalised", "metrics_by_mode", "keywords_by_idf"):
        found, want = same_as_sql(spark, tmp_path, name, "documents", "benchmark")
        plain = lambda rows: [tuple(round(x, 6) if isinstance(x, float) else x for x in row) for row in rows]
        assert plain(found) == plain(want), name


def test_postings_are_dealt_out_as_texts_only(spark):
    """The texts are shuffled, not their terms: neither to count them nor to score them for few questions."""
    from quillon.operators import retrieval as R

    docs = spark.createDataFrame(ODD, "id long, text string")
    index = R.postings(docs, "id", "text")
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    assert plan(index).count("Exchange hashpartitioning") == 1 and "Window" not in plan(index)
    terms = R.query_terms(spark.createDataFrame([(1, "zeta model")], "query long, text string"), "query", "text")
    stats = R.statistics(index, terms)
    stats.count()
    main = plan(R.matched(index, terms, stats))
    assert not re.search(r"hashpartitioning\((query#\w+, doc|doc#\w+, (term|query))", main) and "SortMergeJoin" not in main and "Window" not in main
    small = R.postings(docs, "id", "text", only=R.listed(terms))
    found = [sorted(map(tuple, R.bm25(i, terms).collect())) for i in (index, small)]
    assert found[0] == found[1] and found[0]


def test_python_objects_of_few_rows_exist_at_once(spark):
    """Whatever a batch holds: the slices written are those read, in order, with nulls and nested values."""
    from pyspark.sql import functions as F

    from quillon.operators import language
    from quillon.sharing import ROWS, by_rows
    from quillon.sources import html

    rows = spark.range(500, numPartitions=1).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("Word "), "id")).alias("t"))
    found = rows.select("id", by_rows(lambda i, t: {"n": i, "parts": (t or "").split()}, "struct<n:bigint,parts:array<string>>")("id", "t").alias("x")).collect()
    assert [(r.id, list(r.x.parts)) for r in found] == [(i, ["Word", str(i)] if i % 7 else []) for i in range(500)]
    assert ROWS <= 64
    import pyarrow as pa

    from quillon import sharing

    made = []
    held = sharing.F.arrow_udf
    sharing.F.arrow_udf = lambda f, schema: lambda *columns: made.append(f)
    try:
        language.embed("t"), language.chunked("t"), html.documents.__globals__["by_rows"](lambda h, u: html.parse(h, u), html.SCHEMA)("h", "u")
    finally:
        sharing.F.arrow_udf = held
    batch = pa.array(["<p>some text here</p>"] * 1000)
    for f, values in ((made[0], batch), (made[2], (batch, batch))):
        assert [len(x) for x in f(iter([values]))] == [ROWS] * (1000 // ROWS) + [1000 % ROWS]


def test_mentions_are_those_of_every_run():
    """Words that begin no name are passed over; the rest is as when each run is looked up."""
    import random

    from quillon.operators import language

    aliases = [("OpenAI, Inc.", "openai", "ORGANIZATION"), ("GPT-4", "gpt-4", "MODEL"), ("Llama 3.1", "llama", "MODEL"), ("Mixture of Experts", "moe", "TECHNOLOGY"), ("The", "the", "ORGANIZATION"), ("Co", "co", "ORGANIZATION"), ("The Alpha Company", "alpha", "ORGANIZATION"), ("beta inc gamma", "bg", "TECHNOLOGY")]
    names = language.Gazetteer(aliases)
    asked = []
    names.opens = lambda word, f=names.opens: asked.append(word) or f(word)
    r = random.Random(5)
    words = "OpenAI openai's OpenAI’s Inc. inc GPT-4 gpt 4 Llama 3.1 llama-3.1 mixture Mixture of-experts of experts the The the-alpha Alpha company Co co, beta Beta-inc gamma x-y, plain 3 .1 alpha-co".split()
    for _ in range(300):
        text = "".join(r.choice(words) + r.choice((" ", " ", "-", ", ", "  ")) for _ in range(r.randrange(25)))
        found = names.mentions(text)
        names.opens, held = lambda word: True, names.opens
        assert found == names.mentions(text), text
        names.opens = held
    assert asked and not language.Gazetteer(aliases).opens("plain")


def test_shingles_are_dealt_out_once_as_hashes(spark):
    """Pairs are those of all pairs, by hand; what is dealt out for them holds no shingle but of documents that met."""
    import random

    from quillon.operators import similarity

    r = random.Random(9)
    base = [[r.choice("abcdefgh") + r.choice("xyzuvw") * 3 for _ in range(40)] for _ in range(12)]
    rows = [(i, " ".join(b[:k] + ["qqq"] * (k < 40) + b[k + 1 :])) for i, (b, k) in enumerate((b, k) for b in base for k in (0, 1, 20, 39, 40, 40))] + [(900, None), (901, ""), (902, "one")]
    classes = similarity.shingle_classes(spark.createDataFrame(rows, "id int, text string"), "id", "text")
    sets = {x.doc: set(x.set) for x in classes.where("doc = rep").collect() if x.set is not None}
    want = {(a, b): round(len(x & y) / len(x | y), 6) for a, x in sets.items() for b, y in sets.items() if a < b and round(len(x & y) / len(x | y), 6) >= 0.8}
    pairs = similarity.similar_pairs(classes)
    assert {(x.a, x.b): x.jaccard for x in pairs.collect()} == want and want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((s|df)#", plan) and "hashpartitioning(h#" in plan
