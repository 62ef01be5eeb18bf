"""Empty tables through the pipeline, and texts of several MB through every operator."""

import random

import corpus_pipeline
from tests.llm import cases
from tracelight.llm import ctw, decontam, jaccard, langid, packing, pii, quality, substring, suffix
from tracelight.llm.queries import tokenizer_path


def test_empty_tables_pass_every_stage(spark):
    docs = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, cases.SF)
        assert docs.columns == cases.empty(spark).columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, cases.SF).count() == 0


def test_texts_of_several_megabytes(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(5000)]
    long = " ".join(rng.choices(words, k=400_000)) + " mail a@b.org "
    rows = [(1, long, "en"), (2, long, "en"), (3, "short " + long[:400], "en"), (4, long[::-1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    n = len(long.encode())
    assert n > 2_000_000
    by = lambda df: {r.doc_id: r for r in df.collect()}
    bytes_ = by(suffix.remove_repeats(docs))
    assert [bytes_[i].n_removed for i in (1, 2)] == [0, n] and 390 <= bytes_[3].n_removed <= 400
    gone = by(substring.remove_repeats(docs))
    assert [gone[i].n_removed for i in (1, 2)] == [0, len(long.split())] and gone[3].n_removed > 60
    near = by(jaccard.near_duplicates(docs))
    assert [near[i].class_id for i in (1, 2, 3)] == [1, 1, 3]
    scores = by(ctw.score_documents(docs))
    assert scores[1].n_coded == n + 1 and scores[1].score == scores[2].score
    assert {r.lang_pred for r in langid.language_of(docs).collect()} == {"en"}
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    judged = by(quality.quality_of(docs, labels))
    assert judged[1].score == judged[2].score
    assert by(pii.digest(docs))[1].n_email == 1
    item = spark.createDataFrame([(1, " ".join(long.split()[-40:]))], "item_id long, text string")
    assert set(by(decontam.contaminated(docs, item))) == {1, 2}
    pieces = packing.pack_documents(docs, tokenizer_path()).filter("doc_id = 1").collect()
    assert sum(r.length for r in pieces) > 400_000 and all(r.length == 1024 for r in pieces if r.piece)
