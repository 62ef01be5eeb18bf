"""What the pipeline writes on its way is gone at its end, but for what the last stage reads."""

import os

import corpus_pipeline
from tracelight.llm.common import shared_dir
from tests.llm.cases import SF


def folders(spark):
    root = shared_dir(spark).removeprefix("file://")
    return {f.rsplit("-", 1)[0] for f in os.listdir(root) if "-" in f}, set(os.listdir(root))


def test_tables_of_finished_stages_go(spark):
    before = folders(spark)[1]
    found = corpus_pipeline.run(spark, SF)
    left = {f.rsplit("-", 1)[0] for f in folders(spark)[1] - before}
    assert found.count() > 0
    assert "personal_data" in left and not {"language", "near_copies", "decontaminate", "texts", "contaminated"} & left
