"""Near-duplicate join on word n-grams: MinHash banding, exact verification.

Texts that are equal form one class and are represented once. Each class gets minima of its
5-word shingles under many hash functions; band and row counts follow from the target recall.
Classes that share a band hash are linked to the bucket's first one only, and components of
these links gather the candidates. A link is a pair that shares a band and whose full shingle
sets reach the threshold, in components of every size. Sets are compared block by block, as
products of 0/1 matrices, so no list of pairs is ever made; what leaves a block is one row for
each class. Shingles are 64-bit hashes of their words, whose values no structure of the bytes
brings together. Blocks are bounded in classes and in bytes. The counts of links are exact, so a group
of m similar texts costs m * m / 2 comparisons, in m / BLOCK copies of its shingle sets.

Null text counts as empty. Texts are read whole, however long. Texts of fewer than five words
have one shingle, all their words; texts without words are linked to nothing but their copies.
Rows without an id link to nothing and come back with no class. Repeated rows are copies. A pair
at the threshold exactly is linked; of equal ids the least text name decides. An empty table gives
an empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import discard, flat_text, materialize, mix64, roll, stretches, whole_text, word_hashes, word_spans

SHINGLE, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9999, 4
#: Classes, and bytes of their shingle sets, that one block compares with each other.
BLOCK, BLOCK_BYTES = 2000, 8_000_000


#: Rows of a grouping that one task writes; a task and a file cost more than the rows of a small table.
TASK_ROWS = 100_000


def fewer(df: DataFrame, rows: int) -> DataFrame:
    """df, which ends in a grouping of at most so many rows, in as many tasks as these are worth, if its
    shuffle has more. Keys of a grouping are dealt evenly, so tasks that take several parts are even."""
    return df.coalesce(max(math.ceil(rows / TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism))


def band_count(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands of `rows` minima that find a pair at the threshold with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles in order, and the texts' bounds in them."""
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    runs = roll(words, size)
    inside = doc[: len(runs)] == doc[size - 1 :] if len(runs) else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < size))
    own, key = doc[: len(runs)][inside], runs[inside]
    if len(short):
        whole = np.array([roll(words[first[i] : first[i + 1]], int(count[i]))[0] for i in short], np.uint64)
        own, key = np.r_[own, short], np.r_[key, whole]
        order = np.argsort(own, kind="stable")
        own, key = own[order], key[order]
    return key, np.searchsorted(own, np.arange(len(count) + 1))


def band_hashes(data: np.ndarray, offsets: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """One row of band hashes for each text that has shingles; texts without get zeros."""
    key, bounds = shingles(data, offsets)
    n = len(offsets) - 1
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((n, bands), np.uint64)
    if not len(full):
        return out
    random = np.random.default_rng(20240501)
    with np.errstate(over="ignore"):
        for b in range(bands):
            band = np.full(len(full), np.uint64(b + 1))
            for _ in range(rows):
                a, c = (np.uint64(x) for x in random.integers(1, 2**63, 2))
                x = key * (a | np.uint64(1)) + c
                x ^= x >> np.uint64(32)
                x *= np.uint64(0xD6E8FEB86659FD93)
                least = np.minimum.reduceat(x, bounds[full])
                band = mix64(band * np.uint64(0x9E3779B97F4A7C15) + least)
            out[full, b] = band
    return out


def class_name(text: Column | str = "text") -> Column:
    """The name of a text's class: equal texts have equal SHA-256."""
    return F.unhex(F.sha2(text, 256))


def signatures(docs: DataFrame, bands: int) -> DataFrame:
    """(doc_id, node, some, bands): node names the text's class, some tells that it has shingles."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("node", class_name())

    def rows(batches):
        for batch in batches:
            data, offsets = flat_text(batch["text"])
            for at, end in stretches(offsets, 1_000_000):
                hashes = band_hashes(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], bands)
                some = hashes.any(1)
                lists = pa.ListArray.from_arrays(np.arange(0, hashes.size + 1, bands, dtype=np.int32), pa.array(hashes.view(np.int64).reshape(-1)))
                yield pa.record_batch([batch["doc_id"].slice(at, end - at), batch["node"].slice(at, end - at), pa.array(some), lists], names=["doc_id", "node", "some", "bands"])

    return source.mapInArrow(rows, "doc_id long, node binary, some boolean, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), root being the least node it is connected
    with. Alternates large-star and small-star steps, each a grouping and a join, until the
    edges stay the same. Edges and groupings are written to the shared folder, so that a join
    meets plain tables and a node with very many edges is split over tasks."""
    rows = edges.count()
    least = lambda e: materialize(fewer(e.groupBy("u").agg(F.min("v").alias("m")), rows), "least")
    now = materialize(fewer(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), rows), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = least(both)
        low = wide.withColumn("m", F.least("u", "m"))
        large = materialize(fewer(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), rows), "edges")
        low = least(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(fewer(small, rows), "edges")
        discard(now, wide, large, low)
        now = new
        told = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if told == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = told


def _linked(x_key, x_bounds, y_key, y_bounds, threshold: float) -> np.ndarray:
    """Which of the x sets and y sets (distinct shingles by bounds) reach the threshold."""
    n, m = len(x_bounds) - 1, len(y_bounds) - 1
    size_x, size_y = np.diff(x_bounds), np.diff(y_bounds)
    both = np.zeros((n, m), np.float32)
    shared = np.intersect1d(x_key, y_key)
    for at in range(0, len(shared), 1024):
        part = shared[at : at + 1024]
        left, right = (_indicator(k, b, part) for k, b in ((x_key, x_bounds), (y_key, y_bounds)))
        both += left @ right.T
    union = size_x[:, None] + size_y[None, :] - both
    return (both >= threshold * union - 1e-6) & (both > 0)


def _indicator(key: np.ndarray, bounds: np.ndarray, part: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bounds) - 1, len(part)), np.float32)
    at = np.minimum(np.searchsorted(part, key), len(part) - 1)
    hit = part[at] == key
    out[np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[hit], at[hit]] = 1
    return out


def shingle_sets(texts: DataFrame) -> DataFrame:
    """texts with `keys`, each text's distinct shingles in order, as packed 64-bit numbers; they
    are worked out once, and blocks of texts are compared by them."""

    @F.arrow_udf("binary")
    def packed(column: pa.Array) -> pa.Array:
        data, offsets = flat_text(column)
        out = []
        for a, b in stretches(offsets, 1_000_000):
            key, bounds = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out += [np.unique(key[lo:hi]).tobytes() for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return pa.array(out, pa.binary())

    return texts.withColumn("keys", packed("text"))


def _pick(key: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = bounds[rows + 1] - bounds[rows]
    out = np.r_[0, np.cumsum(sizes)]
    at = np.repeat(bounds[rows] - out[:-1], sizes) + np.arange(out[-1])
    return key[at], out


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least row number that each row of a symmetric link matrix is connected with."""
    root = np.arange(len(linked))
    while True:
        least = np.where(linked, root[None, :], len(root)).min(1, initial=len(root))
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _banded(x_bands: np.ndarray, y_bands: np.ndarray, band: int) -> np.ndarray:
    """Which pairs share a band; in the block of one band's bucket, which share none before it."""
    if band < 0:
        shared = np.zeros((len(x_bands), len(y_bands)), bool)
        for b in range(x_bands.shape[1]):
            shared |= x_bands[:, b][:, None] == y_bands[:, b][None, :]
        return shared
    apart = np.ones((len(x_bands), len(y_bands)), bool)
    for b in range(band):
        apart &= x_bands[:, b][:, None] != y_bands[:, b][None, :]
    return apart


#: The side of rows that are compared among themselves; the band of rows of whole components.
WITHIN, ALL = 2, -1
OUT = "node binary, texts long, documents long, root binary"


def _compare(threshold: float):
    """Verify one part: rows (part, label, band, side, node, copies, bands, keys). Rows of one
    label are compared with each other; where sides differ, side 0 with side 1."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("side", "ascending"), ("node", "ascending")])
        node = np.array(table["node"].to_pylist(), object)
        label = table["label"].to_pylist()
        side, copies, band = (table[c].to_numpy() for c in ("side", "copies", "band"))
        flat = table["bands"].combine_chunks()
        bands = (flat.flatten() if isinstance(flat, pa.Array) else pa.concat_arrays([c.flatten() for c in flat.chunks])).to_numpy().reshape(len(node), -1)
        packed, bounds = flat_text(table["keys"])
        key, bounds = packed.view(np.uint64) if len(packed) else np.zeros(0, np.uint64), bounds // 8
        cut = [0, *[i for i in range(1, len(label)) if label[i] != label[i - 1]], len(label)]
        out = ([], [], [], [])
        for lo, hi in zip(cut, cut[1:], strict=False):
            rows = np.arange(lo, hi)
            two = side[lo] != WITHIN
            x, y = (rows[side[rows] == 0], rows[side[rows] == 1]) if two else (rows, rows)
            if len(rows) < 2 or not len(x) or not len(y):
                continue
            hit = _linked(*_pick(key, bounds, x), *_pick(key, bounds, y), threshold)
            hit &= _banded(bands[x], bands[y], int(band[lo]))
            if two:
                square = np.zeros((len(rows), len(rows)), bool)
                square[: len(x), len(x) :] = hit
                square[len(x) :, : len(x)] = hit.T
                hit, rows = square, np.r_[x, y]
            else:
                np.fill_diagonal(hit, False)
            some = hit.any(1)
            root = _roots(hit)
            out[0].extend(node[rows[some]])
            out[1].extend(hit.sum(1)[some].tolist())
            out[2].extend((hit @ copies[rows])[some].tolist())
            out[3].extend(node[rows[root[some]]])
        return pa.table({"node": pa.array(out[0], pa.binary()), "texts": pa.array(out[1], pa.int64()), "documents": pa.array(out[2], pa.int64()), "root": pa.array(out[3], pa.binary())})

    return run


def _parts(member: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """The rows of _compare() for the members of candidate components (root, node, copies, bands,
    keys). Whatever the path, a pair is compared once if it shares a band, and not otherwise.

    Components that fit in a block are compared whole, several in a part. Larger ones are cut
    into blocks, and each pair of blocks is a part: of the component, or of its buckets, a band
    after the other, where those together have fewer pairs (members in a chain share no band)."""
    size = F.octet_length("keys").cast("long")
    sizes = member.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum(size).alias("volume"))
    blocks = F.ceil(F.greatest(F.col("members") / block, F.col("volume") / block_bytes)).cast("int")
    sizes = materialize(sizes.withColumn("blocks", blocks), "sizes")
    # a component beyond a block for each row: written, so that a short list is broadcast
    big = materialize(sizes.filter("blocks > 1"), "big")
    told = sizes.filter("blocks <= 1").agg(F.sum("members"), F.sum("volume")).first()
    n_small = max(1, math.ceil((told[0] or 0) / block), math.ceil((told[1] or 0) / block_bytes))
    columns = ["node", "copies", "bands", "keys"]
    part = F.concat(F.lit("c"), F.pmod(F.xxhash64("root"), F.lit(n_small)).cast("string"))
    small = member.join(big, "root", "left_anti").select(*columns, part.alias("part"), F.hex("root").alias("label"), F.lit(ALL).alias("band"), F.lit(WITHIN).alias("side"))
    if big.isEmpty():
        return small
    large = member.join(big.select("root", "blocks"), "root")
    spread = large.select("root", "node", F.posexplode("bands").alias("band", "hash"), size.alias("bytes"))
    buckets = materialize(spread.groupBy("root", "band", "hash").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("volume")).filter("n > 1"), "buckets")
    pairs = buckets.groupBy("root").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("in_buckets"))
    whole = big.join(pairs, "root").withColumn("whole", F.col("members").cast("double") * F.col("members") <= F.col("in_buckets")).select("root", "whole")
    large = large.join(whole, "root")
    cut = F.ceil(F.greatest(F.col("n") / block, F.col("volume") / block_bytes)).cast("int")
    own = spread.select("root", "node", "band", "hash").join(whole.filter("not whole"), "root").join(buckets.select("root", "band", "hash", cut.alias("blocks")), ["root", "band", "hash"])
    # the units' rows without their sets, which follow once the blocks are known
    units = large.filter("whole").select("node", F.hex("root").alias("unit"), F.lit(ALL).alias("band"), "blocks").unionByName(
        own.select("node", F.concat_ws("-", F.hex("root"), F.col("band").cast("string"), F.col("hash").cast("string")).alias("unit"), "band", "blocks"))
    units = units.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    label = F.concat_ws("-", "unit", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string"))
    side = F.when(F.col("own") == F.col("other"), WITHIN).when(F.col("own") > F.col("other"), 1).otherwise(0)
    paired = units.select("node", label.alias("part"), label.alias("label"), "band", side.alias("side")).join(member.select(*columns), "node")
    return small.unionByName(paired.select(small.columns))


def linked_texts(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """The rows' signatures, and one row for each different text of rows with an id: node, root
    (a node that names all texts it is connected with), text_id, copies, texts, documents."""
    bands = band_count(threshold, ROWS, recall)
    signed = materialize(signatures(docs, bands), "signatures")
    n = signed.count()
    classes = signed.filter(F.col("doc_id").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("text_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("some").alias("some"))
    classes = materialize(fewer(classes, n), "classes")
    spread = classes.filter("some").select("node", F.posexplode("bands").alias("band", "hash"))
    # written, so that the join below meets two plain tables and can split a hot bucket
    buckets = materialize(fewer(spread.groupBy("band", "hash").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("members")), n * bands).filter("members > 1"), "buckets")
    star = materialize(fewer(spread.join(buckets, ["band", "hash"]).filter("node != first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct(), n * bands), "star")
    candidates = components(star)
    text = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("text_id"), whole_text().alias("text")).withColumn("node", class_name())
    named = candidates.join(classes.select("node", "text_id", "copies", "bands"), "node")
    once = text.join(named, ["node", "text_id"]).dropDuplicates(["node", "text_id"])
    member = materialize(shingle_sets(once).select("node", "root", "copies", "bands", "keys"), "sets")
    verified = materialize(_parts(member, block, block_bytes).groupBy("part").applyInArrow(_compare(threshold), OUT), "verified")
    links = verified.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    roots = components(verified.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    return signed, classes.select("node", "text_id", "copies").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def first_texts(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, node): of all texts that are connected, the one of the least id, and of those the
    least node. An id that stands for several unrelated texts comes once for each that is first."""
    _, linked = linked_texts(docs, **options)
    first = linked.groupBy("root").agg(F.min(F.struct("text_id", "node")).alias("first"))
    return first.select(F.col("first.text_id").alias("doc_id"), "first.node")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, recall: float = RECALL) -> DataFrame:
    """One row per row of docs: doc_id, class_id (least id among the documents that its text is
    connected with), text_id (least id with an equal text), n_links (other documents that are
    equal or similar to it), n_text_links (different texts similar to its own)."""
    signed, linked = linked_texts(docs, threshold, block, block_bytes, recall)
    # written, so that the joins below meet plain tables and a hot component or text is split
    linked = materialize(linked, "linked")
    heads = materialize(fewer(linked.groupBy("root").agg(F.min("text_id").alias("class_id")), linked.count()), "heads")
    links, texts = F.col("copies") - 1 + F.coalesce("documents", F.lit(0)), F.coalesce("texts", F.lit(0))
    linked = materialize(linked.join(heads, "root").select("node", "class_id", "text_id", links.alias("n_links"), texts.alias("n_text_links")), "told")
    with_id = signed.filter(F.col("doc_id").isNotNull()).select("doc_id", "node").join(linked, "node").drop("node")
    without = signed.filter(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("text_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_text_links"))
    return with_id.select("doc_id", "class_id", "text_id", "n_links", "n_text_links").unionByName(without)
