"""Texts that are longer than all that a model may learn from."""

import pytest
from pyspark.sql import functions as F

from tracelight.llm import langid
from tracelight.llm.common import that_fit

LONG = 5_000


def test_that_fit():
    assert that_fit([], 10) == 0 and that_fit([3, 1], 10) == 2 and that_fit([2, 3, 5], 10) == 3
    assert that_fit([1, 2, 100], 10) == 2 and that_fit([100, 100], 11) == 0 and that_fit([9] * 20, 20) == 2


def test_a_label_of_free_text_is_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    docs = spark.createDataFrame([(k, f"l{k}", "text") for k in range(4)], "key long, lang string, text string")
    assert len(langid.learn(docs.filter("key < 3"))) == 3
    with pytest.raises(ValueError):
        langid.learn(docs)


def test_language_sample_stands_giants(spark):
    """A language's tree learns from all its documents, wherever a giant text comes up."""
    texts = [f"document number {i} of the ordinary ones" for i in range(20)]
    for place in (0, 1, 19):
        rows = [(k, "en", "z" * LONG if k == place else t) for k, t in enumerate(texts)]
        docs = spark.createDataFrame(rows, "key long, lang string, text string")
        tree = langid.learn(docs, sample_docs=20, sample_bytes=2_000)["en"]
        total = int(tree.levels[-1][4].sum())
        assert total == sum(len(t) for k, t in enumerate(texts) if k != place)  # the giant teaches nothing
        counts = dict(zip(tree.levels[-1][1].tolist(), tree.levels[-1][2].tolist(), strict=True))
        assert counts[ord("f")] == 19  # once in each ordinary text
        whole = langid.learn(docs.filter(F.length("text") < LONG), sample_docs=20, sample_bytes=2_000)["en"]
        assert int(whole.levels[-1][4].sum()) == sum(len(t) for k, t in enumerate(texts) if k != place)
