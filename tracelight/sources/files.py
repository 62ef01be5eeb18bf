"""File inventories, text files, expectations, session stores, sinks."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tracelight.functions import patterns as P


def scratch_dir(spark: SparkSession) -> str:
    """A new folder's path in the one that the cluster shares: spark.checkpoint.dir, or the
    warehouse where that is unset. A warehouse on a machine's own disk is refused once there is
    more than one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    if not named and (root.startswith("/") or root.startswith("file:")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {root} is local")
    return f"{root}/{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a file that are read at a time; files of more than the second have no content column.
STRETCH, CONTENT_BYTES = 8 << 20, 64 << 20
#: Folders, and rows of files, that one task or batch of a listing takes.
FOLDERS, ROWS = 200, 10_000


def _store(uri: str):
    """The store of a file or folder, and its path in there."""
    import re

    from pyarrow import fs

    return (fs.LocalFileSystem(), re.sub("^file:/+", "/", uri)) if uri.startswith("file:/") else fs.FileSystem.from_uri(uri)


def _whole(spark: SparkSession, path: str) -> str:
    """A path with its scheme, which tasks can do with alone."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/")


def write_files(df: DataFrame, root: str) -> int:
    """Write each row of df (path, content) as a file of its own, and return their number. path is
    relative to root, and no two rows have the same. The tasks that hold the rows write them, each
    in one go: nothing of a file is sent on, sorted, or moved by the driver once all are done, as
    Spark's writers do for a folder of each value. A file has its name once it is whole, so a task
    that runs again does no harm. Binary content is written as it is; null content is empty."""
    base = _whole(df.sparkSession, root)

    def rows(batches):
        import uuid

        import pyarrow as pa

        store, top = _store(base)
        made = set()
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                folder, _, name = f"{top}/{path}".rpartition("/")
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                aside = f"{folder}/_{uuid.uuid4().hex}"  # listings leave such a name out
                with store.open_output_stream(aside, compression=None) as out:
                    if content.is_valid:
                        out.write(content.as_buffer())
                store.move(aside, f"{folder}/{name}")
            yield pa.record_batch([pa.array([batch.num_rows])], names=["n"])

    return df.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(rows, "n long").agg(F.sum("n")).first()[0] or 0


def _listed(batches):
    """What folders (path, uri) hold: (path, uri, length, modified, folder), a batch at a time."""
    from itertools import batched

    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        for path, uri in zip(batch["path"].to_pylist(), batch["uri"].to_pylist(), strict=True):
            store, place = _store(uri)
            found = (x for x in store.get_file_info(fs.FileSelector(place)) if not x.base_name.startswith(("_", ".")) or x.base_name.startswith("_") and "=" in x.base_name)
            for some in batched((x for x in found if x.type in (fs.FileType.File, fs.FileType.Directory)), ROWS):
                yield pa.record_batch([
                    pa.array([path + x.base_name for x in some], pa.string()), pa.array([f"{uri}/{x.base_name}" for x in some], pa.string()), pa.array([x.size for x in some], pa.int64()),
                    pa.array([x.mtime_ns // 1_000_000 * 1000 for x in some], pa.timestamp("us", "UTC")), pa.array([x.type == fs.FileType.Directory for x in some])], names=["path", "uri", "length", "modified", "folder"])


def list_files(spark: SparkSession, root: str, ignored_names: tuple[str, ...] = P.IGNORED_NAMES, ignored_paths: tuple[str, ...] = P.IGNORED_PATHS) -> DataFrame:
    """(path, uri, length, modified) of the files under root, paths relative to it; no file is
    opened. Folders of an ignored name, those whose name begins with .git, and ignored relative
    folders are left out, whole; so are names that Spark's readers pass over, with _ or . ahead.

    Folders are listed by tasks, a level after the other, and what they hold is written: the
    driver holds no list, and ignored folders are not entered. One folder's list is one task's."""
    bad = F.col("name").isin(*ignored_names) | F.startswith("name", F.lit(".git"))
    for p in ignored_paths:
        bad = bad | F.startswith("at", F.lit(p + "/"))
    schema = "path string, uri string, length long, modified timestamp, folder boolean"
    folders, levels, n = spark.createDataFrame([("", _whole(spark, root))], "path string, uri string"), [], 1
    while n:
        dealt = folders.repartition(min(-(-n // FOLDERS) + spark.sparkContext.defaultParallelism, n))
        level = stored(spark, dealt.mapInArrow(_listed, schema).withColumns({"at": F.concat("path", F.lit("/")), "name": F.substring_index("path", "/", -1)}).filter(~(F.col("folder") & bad)).drop("at", "name"))
        levels.append(level.filter("NOT folder").drop("folder"))
        folders = level.filter("folder").select(F.concat("path", F.lit("/")).alias("path"), "uri")
        n = folders.count()
    # levels are as many as folders stand in each other
    return functools.reduce(DataFrame.unionByName, levels)


def _read(most: int, columns: list[str]):
    """Hash files in stretches; keep the content of those of at most `most` bytes."""

    def rows(batches):
        import hashlib

        import pyarrow as pa

        def told(batch, at, shas, bodies):
            return pa.record_batch([*[batch[c].slice(at, len(shas)) for c in columns], pa.array(shas), pa.array(bodies, pa.binary())], names=[*columns, "sha256", "content"])

        for batch in batches:
            at, held, shas, bodies = 0, 0, [], []
            for i in range(batch.num_rows):
                uri, length = batch["uri"][i].as_py(), batch["length"][i].as_py()
                # small files come back together; a task holds a stretch of them, or one large file's content
                if shas and held + min(length, most) > STRETCH:
                    yield told(batch, at, shas, bodies)
                    at, held, shas, bodies = i, 0, [], []
                store, place = _store(uri)
                sha, body = hashlib.sha256(), []
                with store.open_input_stream(place, compression=None) as stream:
                    while part := stream.read(STRETCH):
                        sha.update(part)
                        if length <= most:
                            body.append(part)
                held += sum(map(len, body))
                shas.append(sha.hexdigest())
                bodies.append(b"".join(body) if length <= most else None)
            if shas:
                yield told(batch, at, shas, bodies)

    return rows


def file_inventory(spark: SparkSession, root: str, ignored_names: tuple[str, ...] = P.IGNORED_NAMES, ignored_paths: tuple[str, ...] = P.IGNORED_PATHS, content_bytes: int = CONTENT_BYTES) -> DataFrame:
    """(path, length, modified, sha256, content) of what list_files() finds. Only files that are
    kept are opened. Files of any size are hashed, in stretches; content is null for those of more
    than content_bytes. This is the one operator that needs Python on executors: Spark's reader of
    binary files takes no file beyond 2 GB, and reads before it filters by path."""
    listed = list_files(spark, root, ignored_names, ignored_paths)
    columns = ["path", "length", "modified"]
    # files are dealt anew, as listings put many of them in one task
    dealt = listed.repartition(spark.sparkContext.defaultParallelism * 4, "path")
    return dealt.mapInArrow(_read(content_bytes, columns), "path string, length long, modified timestamp, sha256 string, content binary")


def text_files(inventory: DataFrame, keep_bad_bytes: bool = False) -> DataFrame:
    """Files without a zero byte in their first 1,024, as text. Bytes that are no UTF-8 become
    U+FFFD, or go."""
    head = F.substring("content", 1, 1024)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    text = text if keep_bad_bytes else F.replace(text, F.lit("�"), F.lit(""))
    return inventory.filter(~F.contains(head, F.lit(b"\x00"))).withColumn("text", text).drop("content")


def load_expectations(spark: SparkSession, path: str) -> DataFrame:
    """Expectation files; one that cannot be read has status blocked."""
    schema = "required_substrings array<string>, forbidden_substrings array<string>, broken string"
    df = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), "required_substrings", "forbidden_substrings", F.when(F.col("broken").isNotNull(), "blocked").otherwise("ok").alias("status"))


def read_session_store(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The three tables of a session store, as Parquet."""
    return {name: spark.read.parquet(f"{root}/{name}") for name in ("session", "message", "part")}


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> dict:
    """Write df; return a status record of path, format and rows, counted as they are written."""
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("row_count"))
    if fmt not in ("parquet", "json", "csv"):
        raise ValueError(f"unknown format: {fmt}")
    getattr(out.write.mode("errorifexists"), fmt)(path)
    return {"path": path, "format": fmt, "row_count": seen.get["row_count"], "status": "ok"}


STATUS = "source string, path string, format string, row_count long, status string, reason string"


def write_logged(df: DataFrame, path: str, log: str, source: str, fmt: str = "parquet") -> dict:
    """write_result(), with one row more in the table of status records at log: also for a source
    that is empty, and for one that could not be written, whose error is raised again. Rows are
    appended as files of their own, so writers do not disturb each other."""
    spark = df.sparkSession
    keep = lambda record: spark.createDataFrame([record], STATUS).coalesce(1).write.mode("append").parquet(log)
    try:
        done = write_result(df, path, fmt)
    except Exception as error:
        keep((source, path, fmt, None, "failed", type(error).__name__))
        raise
    keep((source, path, fmt, done["row_count"], done["status"], "rows found" if done["row_count"] else "no rows"))
    return done


def status_log(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(STATUS).parquet(log)


def bounded_preview(df: DataFrame, text_cols: tuple[str, ...], order_by: str, n: int = 20, max_chars: int = 1200) -> DataFrame:
    """The first n rows, their texts cut."""
    return df.orderBy(order_by).limit(n).withColumns({c: F.substring(c, 1, max_chars) for c in text_cols})


def write_with_preview(df: DataFrame, path: str, text_cols: tuple[str, ...], order_by: str, n: int = 20, max_chars: int = 1200) -> DataFrame:
    """Write df whole; what is shown of it is the path, the row count and a bounded preview."""
    status = write_result(df, path)
    shown = bounded_preview(df.sparkSession.read.parquet(path), text_cols, order_by, n, max_chars)
    return shown.withColumns({"path": F.lit(path), "row_count": F.lit(status["row_count"]).cast("long")})
