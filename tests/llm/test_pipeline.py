import corpus_pipeline
from cellgauge.session import stage
from tests.conftest import SF


def test_stages_take_effect(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    counts = [docs.count()]
    for name, step in corpus_pipeline.STAGES:
        after = stage(step(spark, docs, SF), name)
        if name != "mix":
            assert after.columns == docs.columns and after.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
            counts.append(after.count())
        docs = after
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > counts[2]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(str, rows)) == sorted(map(str, docs.collect()))
    kept = {r.doc_id: r.text for r in rows}
    assert len(set(kept.values())) == len(kept)
