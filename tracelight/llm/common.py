"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one Python group holds at a time.
CHUNK_BYTES = 6_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the warehouse where that is
    unset. A warehouse on a machine's own disk is no such folder once there is more than one
    machine; it is refused there."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    found = (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    if not named and (found.startswith("/") or found.startswith("file:")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {found} is local")
    return found


#: Lists that tables are entered in while a step() runs.
_STEPS: list[list[DataFrame]] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and return a scan of it, so that lost
    executors cost a re-read and not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    for tables in _STEPS:
        tables.append(out)
    return out


@contextmanager
def step():
    """The tables that are written while this runs, as a list to discard() once what is made of
    them is written itself."""
    tables: list[DataFrame] = []
    _STEPS.append(tables)
    try:
        yield tables
    finally:
        _STEPS.pop()


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(table: DataFrame) -> bool:
    """Is a table that materialize() wrote still there?"""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def doc_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def chunk_count(df: DataFrame, column: str = "text", chunk_bytes: int = CHUNK_BYTES) -> int:
    """Number of chunks of about chunk_bytes of text; grows with the table."""
    total = df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0
    return max(1, math.ceil(total / chunk_bytes))


def chunk_of(n: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*(columns or ("doc_id",))), F.lit(n)).cast("int")


def flat_text(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls and the n + 1 offsets of its rows."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    large = array.cast(pa.large_binary())
    _, offsets, data = large.buffers()
    offsets = np.frombuffer(offsets, np.int64)[large.offset : large.offset + len(large) + 1] if len(large) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def that_fit(lengths: list[int], room: int) -> int:
    """How many texts of these lengths, from the first on, fit whole in `room` bytes together."""
    return int(np.searchsorted(np.cumsum(np.asarray(lengths, np.int64)), room, "right"))


def stretches(offsets: np.ndarray, size: int):
    """(first, end) of runs of rows of about `size` bytes, one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1))
        yield at, end
        at = end


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each row's values, added up row by row, so that a sum does not depend on other rows."""
    out = np.zeros(len(bounds) - 1)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, bounds[:-1][full])
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes that part words: space, and tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are hashed at a time.
HASHED = 1_000_000


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of every row, and each row's first word number (n + 1)."""
    solid = ~SPACES[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    start[inner] = solid[inner]
    before = inner[inner > 0] - 1
    end[before] = solid[before]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_POWERS: dict[int, np.ndarray] = {}
BASE = 0x5851F42D4C957F2D


def _table(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(size, np.uint64)
        filled = 1
        with np.errstate(over="ignore"):
            while filled < size:
                step = min(filled, size - filled)
                have[filled : filled + step] = have[:step] * np.uint64(pow(base, filled, 1 << 64))
                filled += step
        _POWERS[base] = have
    return have


def _powers(n: int) -> np.ndarray:
    return _table(BASE, n)


def _inverse_powers(n: int) -> np.ndarray:
    return _table(pow(BASE, -1, 1 << 64), n)


#: Places in a word whose values for each byte come from a table.
TABLED = 64


def _place_values(place: np.ndarray, byte: np.ndarray, salt: int) -> np.ndarray:
    """A scrambled number for each byte at its place in its word."""
    near = np.minimum(place, TABLED - 1) << 8 | byte
    value = _values(salt)[near]
    far = np.flatnonzero(place >= TABLED)
    if len(far):
        value[far] = _scrambled(place[far] << 8 | byte[far], salt)
    return value


def _scrambled(code: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(code.astype(np.uint64) + np.uint64(salt) * np.uint64(BASE)) + ODD)


_VALUES: dict[int, np.ndarray] = {}


def _values(salt: int) -> np.ndarray:
    if salt not in _VALUES:
        _VALUES[salt] = _scrambled(np.arange(TABLED << 8), salt)
    return _VALUES[salt]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes: the sum of a scrambled number for each byte at its
    place, scrambled with the length. Words differ in it but for chance, which no structure of
    their bytes helps; another salt gives an independent hash."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        # a stretch of whole words, so that the sums stay small
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + HASHED, "right")))
        length = ends[at:end] - starts[at:end]
        stop = np.cumsum(length)
        begin = stop - length
        place = np.arange(stop[-1]) - np.repeat(begin, length)
        byte = data[place + np.repeat(starts[at:end], length)].astype(np.int64)
        with np.errstate(over="ignore"):
            total = np.add.reduceat(_place_values(place, byte, salt), begin)
            out[at:end] = mix64(total + length.astype(np.uint64) * ODD)
        at = end
    return out


def roll(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of `size` consecutive items; len(words) - size + 1 values."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        base = np.uint64((BASE + 2 * salt * int(ODD)) % (1 << 64))  # odd, another one for each salt
        out = np.full(n, np.uint64(size))
        for i in range(size):
            out = out * base + words[i : i + n]
        return mix64(out)
