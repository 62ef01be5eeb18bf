"""Files of a row each: written, listed and read by tasks, however many they are."""

import hashlib
import time

from pyspark.sql import functions as F

from tracelight.plans import catalog
from tracelight.sources import files


def test_a_file_for_each_row(spark, tmp_path):
    rows = [("a.txt", b"one"), ("d/e é/f=1.bin", b"\x00\xff"), ("d/none", None), ("d/empty", b""), ("d/big", b"y" * 9_000_000), ("cases/left", b"x"), ("d/.git/left", b"x"), ("d/_left", b"x"), ("d/_f=2", b"z")]
    root = f"file://{tmp_path}/out"
    assert files.write_files(spark.createDataFrame(rows, "path string, content binary").repartition(3), root) == len(rows)
    assert (tmp_path / "out" / "d" / "none").read_bytes() == b""
    got = {r.path: (r.length, r.sha256, r.content) for r in files.file_inventory(spark, root).collect()}
    want = {p: c or b"" for p, c in rows if "left" not in p}
    assert got == {p: (len(c), hashlib.sha256(c).hexdigest(), bytearray(c)) for p, c in want.items()}
    # again, as a task does that is run a second time
    assert files.write_files(spark.createDataFrame(rows[:2], "path string, content binary"), root) == 2
    assert files.list_files(spark, root).count() == len(want)
    assert files.write_files(spark.createDataFrame(rows[:0], "path string, content binary"), root) == 0


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    assert files.file_inventory(spark, f"file://{tmp_path}").collect() == []


def test_thousands_of_files(spark, tmp_path):
    """6,667 documents: 18 to 32 ms a file before, when Spark wrote a folder for each (three minutes here)."""
    docs = spark.range(7500).select(F.col("id").alias("doc_id"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("text"))
    docs.unionByName(docs.limit(3)).write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    got = catalog.queries()["src1_file_inventory"](spark, str(tmp_path)).collect()
    assert time.time() - began < 60
    want = [(i, len(f"é{i}\n".encode()), hashlib.sha256(f"é{i}\n".encode()).hexdigest()) for i in [*range(7500), 0, 1, 2] if i % 9]
    assert sorted((r.doc_id, r.length, r.sha256) for r in got) == sorted(want)


def test_thousands_of_expectations(spark, tmp_path):
    spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    got = catalog.queries()["src5_load_expectations"](spark, str(tmp_path)).collect()
    assert time.time() - began < 30
    assert len(got) == 3200 and {(r.case_id % 4, r.status, r.required, r.forbidden) for r in got} == {(0, "ok", 1, 1), (1, "ok", 2, 0), (2, "blocked", 0, 0), (3, "blocked", 0, 0)}
