"""Exact top-k inner products through vector-approximation files.

Vectors are dealt into blocks. In each block every dimension is cut into 16 equal cells, and the
file of cell numbers is all that a scan reads: one product of a query with the numbers gives every
vector's score but for a rest, which the query and the cells' widths bound from both sides. Exact
vectors are then read in order of their upper bounds until no unread one can reach the k-th score;
read_share tells how many that were. A window over the blocks' short lists gives the k best of all.

Null vectors, empty ones, ones that hold null or non-finite components, and rows without an id
take no part. Rows that repeat an id are rows of their own: each is a candidate for all but
itself, and each that asks gets an answer. Vectors of other lengths than the query's are no
candidates; vectors are of any length. Ties go to the smaller id. Empty tables give an empty
result. Other input columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelight.llm.common import materialize

#: Rows of a block of vectors and of a block of queries, cells for each dimension.
BLOCK_ROWS, QUERY_ROWS, CELLS = 8192, 8192, 16
#: Products beyond this would not be exact as doubles.
EXACT = 2**53
#: Scores of a scan, and exact vectors that are read at a time.
SCANNED, READ = 2_000_000, 128


def quantised(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(uid, id, v, dim): the vectors that take part, each component x as floor(scale * x). uid
    tells rows apart; the table is written, so that it stays the same wherever it is read."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    usable = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(vec_col) > 0)
    found = df.filter(usable).filter(fine).select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"), F.size(vec_col).alias("dim"))
    return materialize(found, "vectors")


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids and integer vectors, ordered by id and row number."""
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
    uid, ids = table["uid"].to_numpy(), table["id"].to_numpy()
    flat = table["v"].combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.Array) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    x = flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), -1)
    order = np.lexsort((uid, ids))
    return uid[order], ids[order], x[order]


def cells(x: np.ndarray, n: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The approximation file: a cell number for each component, and by dimension the least value
    and the cells' width. A component is low + width * cell + rest with 0 <= rest < width."""
    low, high = x.min(0), x.max(0)
    width = np.maximum(1, -(-(high - low + 1) // n))
    return ((x - low) // width).astype(np.uint8), low, width


def bounds(code: np.ndarray, low: np.ndarray, width: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds of the scores of queries with the vectors of a file, and for each query how far
    the lower bound lies below the upper one."""
    rest = (width - 1).astype(float)
    wide = q.astype(float)
    upper = (wide * width) @ code.T + (wide @ low.astype(float) + np.maximum(wide, 0) @ rest)[:, None]
    return upper, np.abs(wide) @ rest


def block_top_k(uid: np.ndarray, ids: np.ndarray, x: np.ndarray, query_uid: np.ndarray, q: np.ndarray, k: int, n_cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each query the k best of one block (the query's own row left out): number of the query,
    id, score, and of how many in a thousand the exact vector was read."""
    out_q, out_v, out_s, out_r = [], [], [], []
    if not len(ids) or not len(query_uid):
        return (np.zeros(0, np.int64),) * 4
    # beyond this doubles bound nothing, and every vector is read
    exact = float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] < EXACT
    code, low, width = cells(x, n_cells)
    code = code.astype(float)
    place = {u: i for i, u in enumerate(uid.tolist())}
    step = max(1, SCANNED // len(ids))
    for at in range(0, len(query_uid), step):
        part = q[at : at + step]
        upper, slack = bounds(code, low, width, part) if exact else (np.full((len(part), len(ids)), np.inf), np.full(len(part), np.inf))
        for i, asked in enumerate(query_uid[at : at + step].tolist()):
            u, own = upper[i], place.get(asked)
            if own is not None:
                u[own] = -np.inf
            # the k-th lower bound, less than which no upper bound may be
            certain = np.partition(u, len(u) - k)[len(u) - k] - slack[i] if exact and len(u) > k else -np.inf
            left = np.flatnonzero((u >= certain) & (u > -np.inf))
            left = left[np.argsort(-u[left], kind="stable")]
            best_s, best_i, read = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
            for j in range(0, len(left), READ):
                if exact and len(best_s) >= k and u[left[j]] < best_s[k - 1]:
                    break  # nothing unread can reach the k-th score
                rows = left[j : j + READ]
                read += len(rows)
                best_s, best_i = np.r_[best_s, x[rows] @ part[i]], np.r_[best_i, rows]
                top = np.lexsort((best_i, -best_s))[:k]
                best_s, best_i = best_s[top], best_i[top]
            out_q.append(np.full(len(best_i), asked)), out_v.append(ids[best_i]), out_s.append(best_s), out_r.append(np.full(len(best_i), 1000 * read // len(ids)))
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in (out_q, out_v, out_s, out_r))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score, read_share) for frames of (uid, id, v, dim) as quantised() makes them.

    Each pair of a vector block and a query block is one group: bounded, whatever the table's
    size, and its result holds at most k rows for each query. A vector travels once for each block
    of queries."""
    n, m = vectors.count(), queries.count()
    blocks, stripes = max(1, math.ceil(n / block_rows)), max(1, math.ceil(m / query_rows))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda count: F.pmod(F.xxhash64("uid"), F.lit(count)).cast("int")
    left = vectors.withColumn("block", dealt(blocks)).withColumn("stripe", every(stripes))
    # under new names, as both sides may stem from one table
    names = [*queries.columns, "stripe", "block"]
    right = queries.withColumn("stripe", dealt(stripes)).withColumn("block", every(blocks)).toDF(*[f"asked_{c}" for c in names])

    def pair(key, own: pa.Table, asked: pa.Table) -> pa.Table:
        asked = asked.rename_columns(names)
        (uid, ids, x), (query_uid, query_ids, q) = _matrix(own), _matrix(asked)
        found = block_top_k(uid, ids, x, query_uid, q, k)
        id_of = dict(zip(query_uid.tolist(), query_ids.tolist(), strict=True))
        return pa.table({"query_uid": pa.array(found[0], pa.int64()), "query_id": pa.array([id_of[u] for u in found[0].tolist()], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64()), "permille": pa.array(found[3], pa.int64())})

    keys = ["block", "stripe", "dim"]
    short = left.groupBy(*keys).cogroup(right.groupBy(*[f"asked_{c}" for c in keys])).applyInArrow(pair, "query_uid long, query_id long, vec_id long, score long, permille long")
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id")
    return short.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", (F.col("permille") / 1000).alias("read_share"))
