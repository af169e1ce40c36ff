"""The pipeline's stages one after another, each judged on its own input."""

import corpus_pipeline
from sparkquire.llm import chosen_path, decontam, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before = docs.cache()
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        if name == "packing":
            assert ids(after.select("doc_id").distinct()) == ids(before)
            break
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        if name == "toxicity":
            want = ids(toxicity.toxicity_scores(before, labels).where("predicted = 0"))
        elif name == "jaccard_join":
            want = ids(chosen_path.jaccard_groups(before).where("kept"))
        elif name == "suffix_dedup":
            want = ids(before)
            left = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.removed_spans(before).collect()}
            assert all(left[r.doc_id] - 6 * 20 <= len(r.text.encode()) <= left[r.doc_id] and r.n_chars == len(r.text) for r in after.collect())
        else:
            bad = {r.doc_id for r in decontam.contaminated_pairs(before, bench).collect()}
            want = [i for i in ids(before) if i not in bad]
        assert ids(after) == want and want
        before = after


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows and ids, and columns whose names the operators use, through every stage."""
    a = " ".join(f"w{k}" for k in range(60))
    rows = [(1, a), (1, a), (1, a + " more"), (2, a + " last"), (3, None), (3, None), (4, ""), (None, a), (5, "short text"), (6, " ".join(f"v{k}" for k in range(50)))]
    names = "score predicted held_out contaminated spans mark doc n quire_text row".split()
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    spark.createDataFrame([(6, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(9, " ".join(f"v{k}" for k in range(10, 40))), (None, a), (8, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {"toxicity": 10, "jaccard_join": 7, "suffix_dedup": 7, "decontamination": 6}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [tuple(r)[2:] for r in out.collect()] == [tuple(range(len(names)))] * want[name]
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert sorted(str(r.doc_id) for r in packed.collect()) == ["1", "3", "3", "4", "5", "None"]
