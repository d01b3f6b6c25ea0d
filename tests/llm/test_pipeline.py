import corpus_pipeline
from retainspark.llm import decontaminate, langid, secret_scan, sentencepiece, simhash


def test_stages_in_order_take_effect(spark, sf_small):
    assert [f for _, f in corpus_pipeline.STAGES] == [langid.langid_stage, simhash.simhash_stage, decontaminate.decontaminate_stage, secret_scan.secret_stage,
                                                      sentencepiece.sentencepiece_stage]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_small).collect()}
    docs = corpus_pipeline.table(spark, sf_small, "documents")
    # each stage by its operator's findings on what the one before kept
    rows = {r.doc_id: r for r in langid.identify(docs).collect()}
    keep = {i for i, r in rows.items() if r.lang_pred != "und" and r.score >= langid.MIN_SCORE}
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id in keep}
    fps = {i: simhash.simhash(t.encode()) for i, t in text.items()}
    group = {i: i for i in fps}
    changed = True
    while changed:  # smallest id over links of three bits
        changed = False
        for a in fps:
            low = min(group[b] for b in fps if (fps[a] ^ fps[b]).bit_count() <= 3)
            if low < group[a]:
                group[a], changed = low, True
    text = {i: t for i, t in text.items() if group[i] == i}
    leaked = {r.doc_id for r in decontaminate.op4_decontaminate(spark, sf_small).collect()}
    text = {i: t for i, t in text.items() if i not in leaked}
    assert got.keys() == text.keys() and leaked and len(text) > 0.8 * len(rows)
    model = sentencepiece.Pieces.load()
    for i, r in got.items():
        said = sentencepiece.decode(r.token_ids, model)
        assert not [x for x in secret_scan.base_spans(said)] and r.exact
        if not secret_scan.base_spans(text[i]):
            assert said == text[i] or "[SECRET]" in said


def test_empty_documents(spark, tmp_path):
    import shutil
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    target = tmp_path / "empty"
    target.mkdir()
    docs.write.parquet(str(target / "documents.parquet"))
    shutil.copyfile(f"{small}/benchmark.parquet", target / "benchmark.parquet")
    assert corpus_pipeline.run(spark, str(target)).collect() == []


def rows_with_shared_ids(prose):
    """One id on different texts, null ids, repeated rows."""
    clean = [(7, prose(1, 120)), (7, prose(2, 120)), (8, prose(3, 120)), (8, prose(4, 120)), (None, prose(5, 120)), (9, prose(6, 120)), (9, prose(6, 120))]
    return clean + [(20 + i, prose(100 + i, 60)) for i in range(20)] + [(60 + i, "ñó ción él está " * 30, "es") for i in range(20)]


def test_no_clean_row_is_lost_to_its_id(spark, make_docs, prose):
    rows = rows_with_shared_ids(prose)
    bad = "12345 67890 !!! " * 10
    docs = make_docs([*rows, (7, bad), (None, bad), (9, None)], clashes=True)
    kept = [(r.doc_id, r.text) for r in langid.langid_stage(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([r[:2] for r in rows], key=str)
    said = prose(50, 40)
    leaky = f"{prose(51, 60)} {said} {prose(52, 60)}"
    bench = spark.createDataFrame([(1, said)], "item_id long, text string")
    docs = make_docs([*rows, (7, leaky), (None, leaky)], clashes=True)
    import pytest
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(decontaminate, "table", lambda *a: bench)
        kept = [(r.doc_id, r.text) for r in decontaminate.decontaminate_stage(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([r[:2] for r in rows], key=str)


def test_each_group_keeps_one_row_whatever_the_ids(spark, make_docs, prose):
    rows = rows_with_shared_ids(prose)
    docs = make_docs([*rows, (8, prose(1, 120)), (99, prose(2, 120))], clashes=True)  # copies of the two texts of id 7
    kept = [(r.doc_id, r.text) for r in simhash.simhash_stage(spark, docs, "").collect()]
    want = {(7, prose(1, 120)), (7, prose(2, 120)), (8, prose(3, 120)), (8, prose(4, 120)), (None, prose(5, 120)), (9, prose(6, 120)), (60, "ñó ción él está " * 30)}
    want |= {(20 + i, prose(100 + i, 60)) for i in range(20)}
    assert len(kept) == len(set(kept)) and set(kept) == want


def test_hard_rows_through_all_stages(spark, make_docs, hard, prose, tmp_path):
    import shutil
    rows = [*hard, *rows_with_shared_ids(prose)]
    target = tmp_path / "hard"
    target.mkdir()
    make_docs(rows, clashes=True).write.parquet(str(target / "documents.parquet"))
    shutil.copyfile("/root/testdata/sf0.001/benchmark.parquet", target / "benchmark.parquet")
    got = corpus_pipeline.run(spark, str(target)).collect()
    model = sentencepiece.Pieces.load()
    assert all(r.exact for r in got)
    assert {7, 8, 9, 20, None} <= {r.doc_id for r in got} and sum(r.doc_id == 7 for r in got) >= 2
    assert {prose(5, 120), prose(1, 120)} <= {sentencepiece.decode(r.token_ids, model) for r in got}
