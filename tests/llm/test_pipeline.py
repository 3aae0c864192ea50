import re

import corpus_pipeline
from test_decontamination import brute as brute_hits
from test_packing import check as check_pieces
from test_near_copies import brute_kept

from tracequarry.llm.toxicity import toxicity


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]

    docs = corpus_pipeline.drop_toxic(spark, docs, sf_dir).cache()
    assert docs.columns == list(corpus_pipeline.COLUMNS)
    scored = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    left = {r.doc_id: r for r in docs.collect()}
    assert left.keys() == {r.doc_id for r in scored if r.score < 0.3}
    assert all(before[i] == r for i, r in left.items())

    docs = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).cache()
    after = {r.doc_id: r for r in docs.collect()}
    assert after.keys() == brute_kept([(i, r.text) for i, r in left.items()])[0] and all(left[i] == r for i, r in after.items())

    docs = corpus_pipeline.drop_contaminated(spark, docs, sf_dir).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    short = [(i, r.text) for i, r in after.items() if len(r.text) < 6000]
    clean = {h[0] for h in brute_hits(short, items) if not h[-1]}
    left = {r.doc_id: r for r in docs.collect()}
    assert clean == left.keys() & {i for i, _ in short} and left.keys() <= after.keys()

    docs = corpus_pipeline.replace_private(spark, docs, sf_dir).cache()
    after = {r.doc_id: r for r in docs.collect()}
    assert after.keys() == left.keys() and docs.columns == list(corpus_pipeline.COLUMNS)
    private = re.compile(r"[\w.+-]+@mail\d+\.example\.com|\+1 \(\d{3}\) 555-\d{4}|\b\d{16}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b")
    for i, r in left.items():
        if private.search(r.text):
            assert not set(private.findall(r.text)) & set(private.findall(after[i].text)) and after[i].n_chars == len(after[i].text)
        else:
            assert after[i] == r

    check_pieces(docs, corpus_pipeline.pack(spark, docs, sf_dir), 4096)


def test_run_and_odd_rows(spark, sf_dir, odd_docs, no_docs):
    assert corpus_pipeline.run(spark, sf_dir).filter("length > 0").count() > 0
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir).cache()
            docs.count()
