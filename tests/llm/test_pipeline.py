"""The pipeline's stages take effect and keep clean documents."""

import corpus_pipeline
from opinara.llm import jaccard, textkit


def test_stages(spark, sf_dir, duck):
    docs = textkit.documents(spark, sf_dir)
    columns = docs.columns
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = textkit.stored(stage(spark, docs, sf_dir))
        assert docs.columns == columns, name
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.6 * seen[0]
    assert jaccard.join(docs).where("doc_id <> component_id").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert out.count() == seen[-1] and out.where("n_tokens < 1").count() == 0


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
