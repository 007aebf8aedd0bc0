import corpus_pipeline
from brute import near_components
from shelfcast.llm.common import materialize, table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], sf_dir), name.replace(" ", "-")))
    assert all(df.columns == columns for df in kept[1:-1])
    sizes = [df.count() for df in kept]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    labels = table(spark, sf_dir, "labels")
    good = labels.where("quality = 1").join(docs, "doc_id").count()
    assert kept[1].join(labels.where("quality = 1"), "doc_id").count() >= 0.97 * good
    before = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    roots = near_components(list(before.items()), 5)
    assert {r["doc_id"] for r in kept[3].collect()} == set(roots.values())
    words = {r["doc_id"]: (r["size"], r["taken"]) for r in kept[-1].collect()}
    assert all(0 < taken <= 3 * size for size, taken in words.values())
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, kept[-1].collect()))


def test_empty_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "empty")
    assert docs.count() == 0
