from llm_specs import SF, groups_spec, removal_spec

import corpus_pipeline as pipeline


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        if k < 4:
            assert after.columns == docs.columns
            kept = {r.doc_id: r.text for r in after.collect()}
        if k == 0:
            good = [i for i, _ in rows if i in labels and labels[i].quality == 1]
            assert len([i for i in good if i in kept]) >= 0.95 * len(good)
        elif k == 1:
            clean = [i for i, _ in rows if i in labels and labels[i].toxic == 0]
            assert len([i for i in clean if i in kept]) >= 0.9 * len(clean)
        elif k == 2:
            sets, comp = groups_spec(rows)
            first: dict[int, int] = {}
            for (i, _), c in zip(rows, comp, strict=True):
                first[c] = min(first.get(c, i), i)
            assert set(kept) == {*(first[c] for s, c in zip(sets, comp, strict=True) if s), *(i for (i, _), s in zip(rows, sets, strict=True) if not s)}
        elif k == 3:
            want = {i: gone for i, _, gone, _ in removal_spec(rows, 35)}
            assert set(kept) == set(want)
            assert all(len(kept[i].split()) == len(t.split()) - want[i] for i, t in rows)
        else:
            assert {r.doc_id for r in after.collect()} == {i for i, _ in rows}
        docs = after


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 0
