import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage on the small tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_stages_keep_the_columns_and_only_drop_rows(stages):
    for before, after in zip(stages[:-1], stages[1:-1]):
        assert after.columns == before.columns and after.dtypes == before.dtypes
        assert after.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert stages[-1].columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert stages[-1].count() == stages[-2].count()


def test_quality_stage_keeps_good_documents(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = stages[1].join(labels, "doc_id").groupBy("quality").count().rdd.collectAsMap()
    given = labels.groupBy("quality").count().rdd.collectAsMap()
    assert kept[1] >= 0.97 * given[1] and kept.get(0, 0) <= 0.2 * given[0]


def test_one_document_of_each_copy_stays(stages):
    texts = stages[2].groupBy("text").count()
    assert texts.where("count > 1").count() == 0
    assert stages[2].select("text").distinct().count() <= stages[1].select("text").distinct().count()
    assert stages[2].count() < stages[1].count()


def test_benchmark_passages_and_secrets_are_gone(spark, stages):
    from groundcover.llm import decontaminate

    found = decontaminate.contamination(stages[2], spark.read.parquet(f"{SF}/benchmark.parquet"))
    bad = {r["doc_id"] for r in found.where("contaminated").collect()}
    before, after = ({r["doc_id"] for r in s.select("doc_id").collect()} for s in stages[2:4])
    assert before - after == bad
    assert stages[4].where(r"text RLIKE 'AKIA[A-Z0-9]{16}|[0-9a-f]{24}'").count() == 0
    assert stages[4].where("n_chars <> length(text)").count() == 0


def test_run_is_the_stages_in_order(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in stages[-1].collect())


def test_odd_documents_pass_every_stage(spark, odd_docs, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs, SF).count() <= odd_docs.count()
        assert stage(spark, no_docs, SF).count() == 0
