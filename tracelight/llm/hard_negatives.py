"""Hard negatives by a vertical scan of vectors (BOND).

Vectors are dealt into blocks and kept by column. For an anchor a block's columns are read in the
descending order of the anchor's own components. After every few columns the least and greatest
that the block's remaining columns can still add, from each column's own minimum and maximum,
bound every candidate's score from both sides, and a bitmap keeps those that may still count. Few
candidates are left when the last columns are read, and their sums are then exact scores.

Positives come first: candidates of the anchor's label, of which the bitmap drops those whose
upper bound is below the k-th greatest lower bound. Their scores fix the windows of negatives:
candidates of other labels, of which the bitmap drops those that no window can hold any more, or
that can no longer be among the first of any window that still could. A window over the blocks'
short lists gives the first of all blocks, so no anchor, label or window is ever gathered whole.

Rows with a null id, label or vector, an empty vector, or any null or non-finite component take no
part. Rows that repeat an id are rows of their own: candidates for all but themselves, and each
anchors its own lists. Vectors of other lengths than the anchor's are no candidates. Ties go to the
smaller id. A positive whose score is negative has an empty window. Scores beyond the range of long
are cut to it, for vectors so large that doubles cannot hold sums exactly all columns are read.
Empty tables give an empty result. Other input columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelight.llm.common import materialize

#: Rows of a block of vectors and of a block of anchors, columns read between two looks at the bounds.
BLOCK_ROWS, ANCHOR_ROWS, COLUMNS = 8192, 4096, 8
#: Sums beyond this would not be exact as doubles.
EXACT = 2**53
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def labelled(df: DataFrame, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(uid, id, label, v, dim): the rows that take part, each component x as floor(scale * x). uid
    tells rows apart; the table is written, so that it stays the same wherever it is read."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    usable = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & label.isNotNull() & (F.size(vec_col) > 0)
    found = df.filter(usable).filter(fine).select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"), F.size(vec_col).alias("dim"))
    return materialize(found, "labelled-vectors")


class Block:
    """The vectors of a block, ordered by id, by column."""

    def __init__(self, table: pa.Table):
        order = np.lexsort((table["uid"].to_numpy(), table["id"].to_numpy()))
        self.uid, self.id, self.label = (table[c].to_numpy()[order] for c in ("uid", "id", "label"))
        self.columns = np.ascontiguousarray(_vectors(table)[order].T)
        self.low, self.high = self.columns.min(1).astype(float), self.columns.max(1).astype(float)
        self.greatest = float(np.abs(self.columns.astype(float)).max())
        self.wide = self.columns.astype(float)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, shrink) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows of alive that are left when all columns are read, their exact scores, and the
        number of components read. shrink(low, high, rows) marks the rows that may still count."""
        rows, d = np.flatnonzero(alive), len(anchor)
        a = anchor.astype(float)
        if self.greatest * float(np.abs(a).sum()) >= EXACT:
            exact = [sum(x * y for x, y in zip(c, anchor.tolist(), strict=True)) for c in self.columns[:, rows].T.tolist()]
            return rows, np.array([min(max(s, LEAST), MOST) for s in exact], np.int64), len(rows) * d
        order = np.argsort(-np.abs(a), kind="stable")
        ends = np.stack([a * self.low, a * self.high])[:, order]
        # what the columns from each place on can add at least and at most
        least, most = (np.r_[np.cumsum(e[::-1])[::-1], 0.0] for e in (ends.min(0), ends.max(0)))
        score, read = np.zeros(len(rows)), 0
        for at in range(0, d, COLUMNS):
            for c in order[at : at + COLUMNS]:
                score += a[c] * self.wide[c][rows]
            read += len(rows) * len(order[at : at + COLUMNS])
            end = min(d, at + COLUMNS)
            keep = shrink(score + least[end], score + most[end], rows)
            if not keep.all():
                rows, score = rows[keep], score[keep]
            if not len(rows):
                break
        return rows, score.astype(np.int64), read


def _vectors(table: pa.Table, column: str = "v") -> np.ndarray:
    flat = table[column].combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.Array) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(table.num_rows, -1)


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th greatest, or less than any where there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _first(rows: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best; rows are numbered in order of id."""
    return np.lexsort((rows, -score))[:k]


def block_positives(block: Block, anchor: np.ndarray, uid: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    alive = (block.label == label) & (block.uid != uid)
    rows, score, read = block.scan(anchor, alive, lambda low, high, rows: high >= _kth(low, k))
    top = _first(rows, score, k)
    return rows[top], score[top], read


def block_negatives(block: Block, anchor: np.ndarray, label: int, positives: list[int], k: int, low_pct: int, high_pct: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], int]:
    """For each positive's score the first k of its window: (place of the positive, rows, scores)."""
    windows = [(-(-low_pct * p // 100), high_pct * p // 100) for p in positives]

    def shrink(low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(low), bool)
        for first, last in windows:
            inside = (low >= first) & (high <= last)
            keep |= (high >= max(first, _kth(low[inside], k))) & (low <= last)
        return keep

    rows, score, read = block.scan(anchor, block.label != label, shrink)
    out = []
    for i, (first, last) in enumerate(windows):
        held = (score >= first) & (score <= last)
        top = _first(rows[held], score[held], k)
        out.append((i, rows[held][top], score[held][top]))
    return out, read


def _grid(vectors: DataFrame, anchors: DataFrame, n: int, m: int, block_rows: int, anchor_rows: int):
    """Both sides dealt to the pairs of a block and a stripe of anchors, each pair a bounded group."""
    blocks, stripes = max(1, math.ceil(n / block_rows)), max(1, math.ceil(m / anchor_rows))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda count: F.pmod(F.xxhash64("uid"), F.lit(count)).cast("int")
    left = vectors.withColumn("block", dealt(blocks)).withColumn("stripe", every(stripes))
    # under new names, as both sides may stem from one table
    right = anchors.withColumn("stripe", dealt(stripes)).withColumn("block", every(blocks)).toDF(*[f"asked_{c}" for c in [*anchors.columns, "stripe", "block"]])
    keys = ["block", "stripe", "dim"]
    return left.groupBy(*keys).cogroup(right.groupBy(*[f"asked_{c}" for c in keys]))


def _table(rows: list[tuple], names: str) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(names.split())
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names.split(), columns, strict=True)})


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low_pct: int = 80, high_pct: int = 100, block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, read_share) for
    frames as labelled() makes them. A negative lies between low_pct and high_pct percent of the
    positive's score. read_share: components that the scan for negatives read in the negative's
    block, of those that its candidates have."""
    n, m = vectors.count(), anchors.count()

    def near(key, own: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if own.num_rows and asked.num_rows:
            block = Block(own)
            for uid, ident, label, v in zip(asked["asked_uid"].to_pylist(), asked["asked_id"].to_pylist(), asked["asked_label"].to_pylist(), _vectors(asked, "asked_v"), strict=True):
                rows, score, _ = block_positives(block, v, uid, label, positives)
                out += [(uid, ident, p, i, s) for p, i, s in zip(block.uid[rows].tolist(), block.id[rows].tolist(), score.tolist(), strict=True)]
        return _table(out, "uid anchor_id positive_uid positive_id positive_score")

    short = _grid(vectors, anchors, n, m, block_rows, anchor_rows).applyInArrow(near, "uid long, anchor_id long, positive_uid long, positive_id long, positive_score long")
    order = Window.partitionBy("uid").orderBy(F.desc("positive_score"), "positive_id", "positive_uid")
    chosen = short.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    # at most `positives` of each anchor
    chosen = chosen.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("chosen"))
    asked = materialize(anchors.join(chosen, "uid"), "anchors")

    def far(key, own: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if own.num_rows and asked.num_rows:
            block = Block(own)
            for uid, ident, label, chosen, v in zip(asked["asked_uid"].to_pylist(), asked["asked_id"].to_pylist(), asked["asked_label"].to_pylist(), asked["asked_chosen"].to_pylist(), _vectors(asked, "asked_v"), strict=True):
                found, read = block_negatives(block, v, label, [c["positive_score"] for c in chosen], negatives, low_pct, high_pct)
                share = 1000 * read // max(1, len(v) * int((block.label != label).sum()))
                for i, rows, score in found:
                    own_rows = zip(block.id[rows].tolist(), score.tolist(), strict=True)
                    out += [(uid, ident, chosen[i]["place"], chosen[i]["positive_id"], chosen[i]["positive_score"], j, s, share) for j, s in own_rows]
        return _table(out, "uid anchor_id place positive_id positive_score negative_id negative_score permille")

    schema = ", ".join(f"{c} long" for c in "uid anchor_id place positive_id positive_score negative_id negative_score permille".split())
    lists = _grid(vectors, asked, n, m, block_rows, anchor_rows).applyInArrow(far, schema)
    order = Window.partitionBy("uid", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", (F.col("permille") / 1000).alias("read_share"))
