"""Corpus preparation: language, near copies, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result
as Parquet in the shared folder and reads it again as the next stage's docs. All stages but the
last return the columns of docs, whatever further ones those have. Null texts count as empty and
go in the first stage, with all that hold no letter. Rows without an id are judged by their texts;
only near_copies, which needs ids to choose by, keeps them all. Repeated rows are copies of one
document. Texts are read whole, however long. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelight.llm import decontam, jaccard, langid, packing, pii
from tracelight.llm.common import discard, exists, materialize, step, whole_text
from tracelight.llm.queries import tokenizer_path


DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _held(docs: DataFrame) -> DataFrame:
    """docs with its further columns, whatever their names, put away in one."""
    extra = [F.col(f"`{c}`") for c in docs.columns if c not in DOCUMENT_COLUMNS]
    return docs.select(*DOCUMENT_COLUMNS, F.struct(*extra).alias("__extra") if extra else F.lit(0).alias("__extra"))


def _freed(held: DataFrame, columns: list[str]) -> DataFrame:
    return held.select([F.col(c) if c in DOCUMENT_COLUMNS else F.col(f"__extra.`{c}`").alias(c) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null texts, texts without a letter) go. A label that is
    null is filled with the prediction; given labels stay."""
    held, columns = _held(docs), docs.columns
    found = langid.identify(held, langid.learn(langid.training_rows(held))).filter("lang_pred <> 'und'")
    return _freed(found.withColumn("lang", F.coalesce("lang", "lang_pred")), columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that similarity links connect, the one with the least id stays, in
    one row. Rows that share an id but neither text nor links are groups of their own."""
    held, columns = _held(docs), docs.columns
    kept = jaccard.first_texts(held).withColumnRenamed("node", "__node")
    one = F.row_number().over(Window.partitionBy("doc_id", "__node").orderBy("text", "lang", "source", "n_chars"))
    with_id = held.withColumn("__node", jaccard.class_name(whole_text())).join(kept, ["doc_id", "__node"], "left_semi").withColumn("__one", one).filter("__one = 1")
    return _freed(with_id, columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, whether or not they have an id: texts
    are judged, by their names."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    held, columns = _held(docs).withColumn("__node", jaccard.class_name(whole_text())), docs.columns
    # written, so that the join below knows its size
    found = materialize(decontam.contaminated(held, benchmark, id_col="__node").select("__node"), "contaminated")
    return _freed(held.join(found, "__node", "left_anti"), columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the new text."""
    held, columns = _held(docs), docs.columns
    return _freed(pii.redact_pii(held).withColumn("n_chars", F.length("text").cast("long")), columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("pack", pack),
]

#: SQL cannot express the learned language models or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; the tables of a stage, and its predecessor's result, are deleted once its own
    result is written. What remains is the last stage's."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with step() as tables:
            docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*done, *[t for t in tables if t is not docs and exists(t)])
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
