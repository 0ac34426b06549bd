import corpus_pipeline
from quillon.llm import secrets
from tests.llm.conftest import PASSAGE

COLUMNS = "doc_id text lang source n_chars score fp root k t spans lang_pred _0".split()


def stages(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stage(spark, docs, folder)
    return out


def test_stages_take_effect(spark, messy):
    out = stages(spark, messy)
    for name in ("languages", "near_duplicates", "decontamination", "secrets"):
        assert out[name].columns == COLUMNS
    ids = lambda name: sorted((r.doc_id for r in out[name].collect()), key=lambda x: (x is None, x))
    assert not {2, 3, 4, 5} & set(ids("languages"))
    assert ids("near_duplicates").count(1) <= 1
    assert 1 not in ids("decontamination") and 8 in ids("decontamination")
    masked = {r.doc_id: r for r in out["secrets"].collect()}[8]
    assert secrets.scan(masked.text) == [] and masked.n_chars == len(masked.text)
    assert PASSAGE not in {r.text for r in out["secrets"].collect()}


def test_texts_go_to_the_workers_once(spark, messy):
    """A stage that carries the text beside its result sends one copy of it."""
    docs = spark.read.parquet(f"{messy}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        if name in ("languages", "decontamination", "secrets"):
            plan = stage(spark, docs, messy)._jdf.queryExecution().optimizedPlan()
            while plan.nodeName() != "MapInArrow":
                plan = plan.children().head()
            assert plan.children().head().output().size() == len(COLUMNS), name


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_clean_documents_stay(spark):
    folder = "/root/testdata/sf0.001"
    out = stages(spark, folder)
    n = {k: v.count() for k, v in out.items()}
    assert n["languages"] >= 195 and n["secrets"] == n["decontamination"]
    kept = {r.doc_id for r in out["packing"].collect()}
    assert kept == {r.doc_id for r in out["secrets"].collect()}
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == kept
