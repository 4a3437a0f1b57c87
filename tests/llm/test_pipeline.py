"""The corpus pipeline on a small table with planted cases."""

import numpy as np


def test_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"w{int(rng.integers(3000))}" for _ in range(n))
    texts = [text(60) for _ in range(120)]
    for i in range(0, 120, 4):
        texts[i] += " nastyword vilifying nastyword"
    texts[50] = texts[49]
    texts[99] = texts[97] + " extra"
    rows = [(i, t, "en", f"src{i % 2}", len(t)) for i, t in enumerate(texts)]
    sf = str(tmp_path)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, sf)
        if k < 4:
            assert out.columns == d.columns, name
        out.write.parquet(f"{sf}/out{k}")
        d = spark.read.parquet(f"{sf}/out{k}")
        ids = {r["doc_id"] for r in d.select("doc_id").collect()}
        if k == 0:
            assert ids == {i for i in range(120) if i % 4}
        if k == 2:
            assert 50 not in ids and 99 not in ids and {1, 49, 97} <= ids
    assert d.count() > 0 and corpus_pipeline.run(spark, sf).count() == d.count()
