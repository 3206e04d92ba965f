"""The pipeline's stages, each against a plain version on its own input."""

import corpus_pipeline as pipeline
from concordia.llm import secrets
from concordia.llm.common import DOC_COLUMNS, written
from tests.llm.corpus import SMALL, small
from tests.llm.test_near_dup import brute
from tests.llm.test_secrets import brute as spans


def test_stages(spark):
    docs = small(spark)
    first = written(pipeline.drop_toxic(spark, docs, SMALL), "test-pipeline")
    assert first.columns == list(DOC_COLUMNS) and first.join(docs, list(DOC_COLUMNS), "left_anti").count() == 0
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r.doc_id for r in first.collect()}
    clean = [d for d, t in labels.items() if t == 0]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)
    second = written(pipeline.drop_near_duplicates(spark, first, SMALL), "test-pipeline")
    want = brute([(r.doc_id, r.text) for r in first.collect()], 5, 80)
    assert sorted(r.doc_id for r in second.collect()) == sorted(d for d, _, c in want if d == c)
    third = written(pipeline.blot_secrets(spark, second, SMALL), "test-pipeline")
    text = {r.doc_id: r.text for r in second.collect()}
    for r in third.collect():
        out, at = "", 0
        for a, _, b, _ in spans(text[r.doc_id]):
            if a >= at:
                out += text[r.doc_id][at:a] + "[SECRET]"
            at = max(at, b)
        assert r.text == out + text[r.doc_id][at:] and r.n_chars == len(r.text)
    assert secrets.RULES[: len(secrets.BASE)] == secrets.BASE
    assert {r.doc_id for r in pipeline.pack_sequences(spark, third, SMALL).select("doc_id").distinct().collect()} == {r.doc_id for r in third.collect()}


def test_names_and_order():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "packing"] and pipeline.ORACLE_SQL is None


def test_odd_rows(spark):
    """Nulls, empty and repeated rows, a null id, long texts and columns of other names go through every stage."""
    from tests.llm.corpus import edge_documents

    docs = edge_documents(spark).withColumn("score", secrets.F.lit(1)).withColumn("__spans", secrets.F.lit(2))
    for rows, empty in ((docs, False), (docs.limit(0), True)):
        for name, stage in pipeline.STAGES:
            before, rows = rows, written(stage(spark, rows, SMALL), "test-pipeline")
            if name != "packing":
                assert rows.columns == list(DOC_COLUMNS)
            assert rows.isEmpty() == empty
            if name == "near_duplicates":
                assert rows.where("text IS NULL OR trim(text) = ''").count() == before.where("text IS NULL OR trim(text) = ''").count()
                assert rows.where("text = 'the cat sat on the mat'").count() == (0 if empty else 1)


def test_workers_give_caches_back(spark):
    """What packing keeps in a worker for its own tasks is dropped where another operator's task begins there."""
    import pyarrow as pa

    from concordia.llm import near_dup, packing, toxicity
    from concordia.llm.common import tokenizer_path

    def held(batches):
        import time

        from concordia.llm import near_dup, pretokens

        for b in batches:
            time.sleep(0.05)
            yield pa.RecordBatch.from_arrays([pa.array([len(pretokens._ENCODERS)]), pa.array([len(near_dup._WORDS)])], ["encoders", "words"])

    def seen():
        return spark.range(0, 64, 1, 32).mapInArrow(held, "encoders long, words long").collect()

    docs = small(spark).repartition(32)
    packing.pieces_of(docs, tokenizer_path("byte_bpe_50k.json")).count()
    assert sum(r.encoders for r in seen()) > 0
    near_dup.NearDuplicates(docs).documents().count()
    after = seen()
    assert sum(r.encoders for r in after) == 0 and sum(r.words for r in after) > 0
    toxicity.score(docs, toxicity.Classifier(toxicity.np.zeros(1 << toxicity.BITS), 0.0)).count()
    assert sum(r.encoders + r.words for r in seen()) == 0
