import corpus_pipeline
from loomwell.llm import pii, quality_rules, simhash
from loomwell.llm.common import stored, table


def test_stages(spark, data):
    df = table(spark, data, "documents")
    columns = df.columns
    seen = [df]
    for name, stage in corpus_pipeline.STAGES:
        df = stored(stage(spark, df, data), f"t-{name}")
        assert df.columns == columns or name == "packing"
        seen.append(df)
    raw, good, alone, clean, mixed, packed = seen
    kept = {r["doc_id"] for r in quality_rules.judge(raw).filter("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept
    roots = {r["component_id"] for r in simhash.dedup(good).collect()}
    assert sorted(r["doc_id"] for r in alone.collect()) == sorted(roots)
    assert clean.count() == alone.count() and pii.find(clean, weights=[-9.0] + [0.0] * 7).filter("size(spans) > 0").count() == 0
    ids = [r["doc_id"] for r in mixed.collect()]
    assert set(ids) <= roots and max(ids.count(i) for i in set(ids)) <= 2
    assert packed.filter("piece = 0").count() == len(ids)
    assert corpus_pipeline.ORACLE_SQL is None


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert set(out.columns) >= {"doc_id", "piece", "sequence_id", "offset"} and out.count() > 0
