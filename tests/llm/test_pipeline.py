import corpus_pipeline as P
import pytest
from test_jaccard import brute
from test_small_operators import base_of, base_spans, brute_hits
from texts import awkward, frame

from attesta.llm.shared import table, written

SF = "/root/testdata/sf0.001"


def test_each_stage_takes_effect(spark):
    docs = table(spark, SF, "documents")
    items = [tuple(x) for x in table(spark, SF, "benchmark").collect()]
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = written(stage(spark, docs, SF), name)
        if k < 4:
            assert docs.columns == columns
        after = docs.collect()
        ids = [r.doc_id for r in after]
        if k == 0:
            bad = {d for d, t in before.items() if (b := base_of(t))[0] < 50 or 100 * b[4] > 50 * b[0]}
            assert not bad & set(ids) and len(ids) >= 0.95 * (len(before) - len(bad))
        if k == 1:
            assert sorted(ids) == sorted({int(c) for _, _, c in brute(list(before.items()))})
        if k == 2:
            assert sorted(ids) == sorted(d for d, t in before.items() if not brute_hits(t, items)[1])
        if k == 3:
            assert sorted(ids) == sorted(before)
            assert all((r.text == before[r.doc_id]) == (not base_spans(before[r.doc_id])) for r in after) and not any(base_spans(r.text) for r in after)
            assert all(r.n_chars == len(r.text) for r in after if r.text != before[r.doc_id])
        if k == 4:
            assert set(ids) == set(before)


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_rows_go_through(spark, extra, tmp_path):
    spark.createDataFrame([(1, "none of it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, awkward(), extra)
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
    assert docs.count() > 0


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
