"""The corpus pipeline: every stage on its own input, and the whole against its stages."""

from __future__ import annotations

import corpus_pipeline
from gridstone.llm import quality_bayes, quality_rules, secrets, simhash

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    all_docs = docs
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["classify", "apply_rules", "drop_near_copies", "mask_secrets", "pack_sequences"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == before.columns and dict(docs.dtypes) == dict(before.dtypes)
        kept[name] = {r.doc_id for r in docs.collect()}
        assert kept[name] <= {r.doc_id for r in before.collect()}
    bayes = {r.doc_id for r in quality_bayes.quality_bayes(all_docs, labels).where("kept").collect()}
    assert kept["quality_classifier"] == bayes
    rules = {r.doc_id for r in quality_rules.quality_rules(all_docs, labels).where("kept").collect()}
    assert kept["quality_rules"] == bayes & rules
    good = all_docs.where(all_docs.doc_id.isin(sorted(kept["quality_rules"])))
    firsts = good.join(simhash.similar_components(good), "doc_id").groupBy("root").agg({"doc_id": "min"}).collect()
    assert kept["simhash_near_dedup"] == {r[1] for r in firsts} < kept["quality_rules"]  # held against brute force in test_corpus_operators
    assert kept["secret_scan"] == kept["simhash_near_dedup"]
    assert secrets.secret_scan(docs).where("exists(spans, s -> s.kind in ('assign', 'hex', 'access'))").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in pieces} == kept["secret_scan"]
    whole = corpus_pipeline.run(spark, SMALL).collect()
    strip = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in rows)
    assert strip(whole) == strip(pieces)


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, empty and very long texts, columns with clashing names."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, bucket string, fp string, root string, _x string"
    prose = " ".join(f"word{k} of" for k in range(60)) + "."
    rows = [(1, None), (2, ""), (3, prose), (3, prose), (None, prose + " more"), (None, None), (4, "long " * 300_000), (5, prose.replace("word7 ", "")), (6, f"{prose} token=abcdefghij1234")]
    odd = spark.createDataFrame([(i, t, None if i == 3 else "en", None, None, None, "b", "f", None, "x") for i, t in rows], columns)
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(3, 1, 0), (2, 0, 0), (None, 1, None), (4, 0, None), (6, None, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == odd.columns and docs.count() <= len(before)
        if name != "secret_scan":
            assert all(r in before for r in docs.collect())
    ids = [r.doc_id for r in docs.collect()]
    assert len(ids) == len(set(ids)) and all("token=" not in (r.text or "") for r in docs.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= len(ids)


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
