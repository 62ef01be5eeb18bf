"""Repeated word sequences, found through fixed blocks and removed from all but the first text.

Each document is cut into non-overlapping blocks of 7 words, the index; its rolling 7-word
windows are the probes. Any 13 words hold a whole block of their own document, so a sequence of
13 that two documents share holds a block of one that is a probe of the other. Fingerprints of
blocks and probes meet by hash range; probes that hit come back to their documents, where they
extend in both directions to all 13-word windows that hold them: the windows of a maximal repeat
follow each other, and together cover it. Windows meet by range once more for the
least document of each, and what covers a later document's words is removed. Windows are told
apart by 96 bits, made from two hashes of their words that are independent of each other; words
are not compared.

Documents travel as chunks of a few MB by a hash of their id; fingerprints travel packed, a row
for each gathering of chunks and range that share any, so never more rows than fingerprints. A
fingerprint and a window that many documents share travel once for each chunk.

Null text has no words; texts are read whole, however long, each in one chunk. Ids that are null
count as the greatest: such rows lose words to others and others never lose to them. Rows of equal
id, repeated ones among them, count as no earlier than each other. An empty table gives an empty
result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import CHUNK_BYTES, chunk_count, chunk_of, flat_text, materialize, roll, stretches, whole_text, word_hashes, word_spans

WINDOW, BLOCK = 13, 7
#: Fingerprints of a range, windows that a task gathers before it sends them off.
RANGE_KEYS, GATHERED = 3_000_000, 4_000_000
LAST = np.iinfo(np.int64).max


def _blobs(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, and how many each row has."""
    data, offsets = flat_text(column)
    return np.frombuffer(data.tobytes(), kind), np.diff(offsets) // np.dtype(kind).itemsize


def _packed(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """A binary array whose rows are values between consecutive cuts."""
    return pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(np.ascontiguousarray(cut * values.itemsize, np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def by_range(part: np.ndarray, chunk: np.ndarray, key: np.ndarray, **marks: np.ndarray) -> pa.RecordBatch:
    """One row for each range: its keys with their chunks, in order of chunk, and for each mark the
    keys that have it."""
    order = np.argsort(part << 32 | chunk, kind="stable")
    part, chunk, key = part[order], chunk[order].astype(np.uint32), key[order]
    cut = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)] if len(part) else np.zeros(1, np.int64)
    columns = {"range": pa.array(part[cut[:-1]], pa.int32()), "chunks": _packed(chunk, cut), "probes": _packed(key, cut)}
    for name, mark in marks.items():
        mark = mark[order]
        columns[name] = _packed(key[mark], np.r_[0, np.cumsum(mark)][cut])
    return pa.record_batch(list(columns.values()), names=list(columns))


class Words:
    """Words, rolling hashes and bounds of a stretch of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.first = word_spans(data, offsets)
        self.hashes = word_hashes(data, self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def windows(self, size: int, salt: int = 0) -> np.ndarray:
        """A hash of each run of words; those of another salt share nothing with it."""
        return roll(word_hashes(self.data, self.starts, self.ends, salt) if salt else self.hashes, size, salt)

    def whole(self, size: int) -> np.ndarray:
        """Which windows lie in one document."""
        n = len(self.doc) - size + 1
        return self.doc[:n] == self.doc[size - 1 :] if n > 0 else np.zeros(0, bool)


def fingerprints(docs: DataFrame, bits: int) -> DataFrame:
    """(range, chunks, probes, blocks, twice) from docs (chunk, text): the top `bits` bits of a hash
    are its range, the next 32 its fingerprint. A chunk sends each of its fingerprints once, with a
    mark if it has it twice, so that what every document holds is sent for every chunk only."""

    def distinct(chunk, own):
        key, aligned = (np.concatenate(x) for x in zip(*own, strict=True))
        key, count = np.unique(key, return_counts=True)
        return np.full(len(key), chunk, np.int64), key, np.isin(key, np.concatenate([k[a] for k, a in own])), count > 1

    def send(held):
        chunk, key, block, twice = (np.concatenate(x) for x in zip(*held, strict=True))
        return by_range((key >> np.uint64(32)).astype(np.int64), chunk, (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), blocks=block, twice=twice)

    def rows(batches):
        held, size, own, current = [], 0, [], None
        for batch in batches:
            data, offsets = flat_text(batch["text"])
            chunk = batch["chunk"].to_numpy()
            bounds = np.r_[np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]), len(chunk)] if len(chunk) else np.zeros(1, np.int64)
            for first, last in zip(bounds, bounds[1:], strict=False):
                if chunk[first] != current and own:
                    held.append(distinct(current, own))
                    size, own = size + len(held[-1][0]), []
                    if size > GATHERED:
                        yield send(held)
                        held, size = [], 0
                current = chunk[first]
                for lo, hi in stretches(offsets[first : last + 1], 2_000_000):
                    lo, hi = first + lo, first + hi
                    words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    inside = words.whole(BLOCK)
                    place = np.arange(len(inside)) - words.first[words.doc[: len(inside)]]
                    own.append((words.windows(BLOCK)[inside] >> np.uint64(32 - bits), place[inside] % BLOCK == 0))
        if own:
            held.append(distinct(current, own))
        if held:
            yield send(held)

    ordered = docs.select("chunk", "text").repartition("chunk").sortWithinPartitions("chunk")
    return ordered.mapInArrow(rows, "range int, chunks binary, probes binary, blocks binary, twice binary")


def _hits(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of one range, the fingerprints that are a block and occur more than once, by chunk."""
    probe, chunk, block, twice = (_blobs(table[c], "<u4")[0] for c in ("probes", "chunks", "blocks", "twice"))
    both = np.sort(probe.astype(np.uint64) << np.uint64(32) | chunk.astype(np.uint64))
    own = both >> np.uint64(32)
    first = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, bool)
    run = np.cumsum(first) - 1
    often = (np.bincount(run)[run] > 1) | np.isin(own, twice.astype(np.uint64)) if len(own) else first
    both = both[often]
    both = both[np.isin(both >> np.uint64(32), block.astype(np.uint64))]
    chunk, own = (both & np.uint64(0xFFFFFFFF)).astype(np.int64), (both >> np.uint64(32)).astype(np.uint32)
    order = np.argsort(chunk, kind="stable")
    chunk, own = chunk[order], own[order]
    cut = np.r_[np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]), len(chunk)] if len(chunk) else np.zeros(1, np.int64)
    return pa.table({"chunk": pa.array(chunk[cut[:-1]], pa.int32()), "range": pa.array(np.full(len(cut) - 1, key[0].as_py()), pa.int32()), "body": _packed(own, cut)})


class Candidates:
    """A chunk's documents in a fixed order and their windows of 13 around the hits."""

    def __init__(self, table: pa.Table, hits: pa.Table, bits: int):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = table["doc_id"].fill_null(int(LAST)).to_numpy()
        self.raw = table["doc_id"].combine_chunks()
        self.words = w = Words(*flat_text(table["text"]))
        body, lens = _blobs(hits["body"], "<u4")
        known = np.sort(np.repeat(hits["range"].to_numpy().astype(np.uint64), lens) << np.uint64(32) | body)
        probe = w.windows(BLOCK) >> np.uint64(32 - bits)
        hit = np.zeros(len(probe), bool)
        if len(known):
            hit = known[np.minimum(np.searchsorted(known, probe), len(known) - 1)] == probe
        hit &= w.whole(BLOCK)
        whole = w.whole(WINDOW)
        reach = WINDOW - BLOCK + 1
        total = np.r_[0, np.cumsum(hit)]
        near = total[reach : reach + len(whole)] > total[: len(whole)] if len(whole) else whole
        place = np.flatnonzero(whole & near)
        key, more = w.windows(WINDOW)[place], w.windows(WINDOW, 1)[place].astype(np.uint32)
        # documents are in order of id, so of equal windows the first is of the least document
        order = np.argsort(key, kind="stable")
        self.place, self.key, self.more = place[order], key[order], more[order]
        same = (self.key[1:] == self.key[:-1]) & (self.more[1:] == self.more[:-1])
        self.first = np.flatnonzero(np.r_[True, ~same]) if len(order) else np.zeros(0, np.int64)
        self.number = np.diff(np.r_[self.first, len(order)])
        self.doc = self.ids[w.doc[self.place]]
        self.least = self.doc[self.first]
        self.range = (self.key[self.first] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.first), np.int64)


def _extend(bits: int):
    """Send a chunk's distinct candidate windows off by range, each with its least document, so
    that a window that very many documents share is sent once for each chunk."""

    def run(key, table: pa.Table, hits: pa.Table) -> pa.Table:
        c = Candidates(table, hits, bits)
        part = c.range
        cut = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)] if len(part) else np.zeros(1, np.int64)
        return pa.table({
            "chunk": pa.array(np.full(len(cut) - 1, key[0].as_py()), pa.int32()), "range": pa.array(part[cut[:-1]], pa.int32()),
            "hash": _packed(c.key[c.first], cut), "more": _packed(c.more[c.first], cut), "docs": _packed(c.least, cut)})

    return run


SENT = "chunk int, range int, hash binary, more binary, docs binary"


def _later(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of one range, a bit for each window sent: has another chunk a smaller document with it?"""
    one, lens = _blobs(table["hash"], "<u8")
    two, _ = _blobs(table["more"], "<u4")
    doc, _ = _blobs(table["docs"], "<i8")
    order = np.lexsort((doc, two, one))
    a, b = one[order], two[order]
    first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    least = doc[order][first][np.cumsum(first) - 1] if len(a) else doc
    later = np.zeros(len(doc), bool)
    later[order] = doc[order] > least
    at = np.r_[0, np.cumsum(lens)]
    return pa.table({"chunk": table["chunk"], "range": table["range"], "body": pa.array([np.packbits(later[lo:hi]).tobytes() for lo, hi in zip(at, at[1:], strict=False)], pa.binary())})


def _remove(bits: int):
    def run(key, table: pa.Table, side: pa.Table) -> pa.Table:
        kind = side["kind"].to_numpy()
        c = Candidates(table, side.filter(pa.array(kind == 0)), bits)
        told = side.filter(pa.array(kind == 1)).sort_by("range")
        count = np.bincount(c.range, minlength=(1 << bits)) if len(c.range) else np.zeros(1 << bits, np.int64)
        bodies = [np.unpackbits(np.frombuffer(body, np.uint8), count=int(count[part])) for part, body in zip(told["range"].to_pylist(), told["body"].to_pylist(), strict=True)]
        elsewhere = np.concatenate(bodies).astype(bool) if bodies else np.zeros(0, bool)
        later = np.repeat(elsewhere, c.number) | (c.doc > np.repeat(c.least, c.number))
        w = c.words
        change = np.zeros(len(w.starts) + 1, np.int64)
        np.add.at(change, c.place[later], 1)
        np.add.at(change, c.place[later] + WINDOW, -1)
        gone = np.cumsum(change[:-1]) > 0
        total = np.r_[0, np.cumsum(gone)]
        removed = total[w.first[1:]] - total[w.first[:-1]]
        sha, text = [], w.data.tobytes()
        for i in range(len(c.ids)):
            lo, hi = w.first[i], w.first[i + 1]
            body = text[w.offsets[i] : w.offsets[i + 1]].split()
            if removed[i]:
                body = [x for x, g in zip(body, gone[lo:hi].tolist(), strict=True) if not g]
            sha.append(hashlib.sha256(b" ".join(body)).hexdigest())
        return pa.table({"doc_id": c.raw, "n_words": pa.array(np.diff(w.first), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return run


def remove_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, range_keys: int = RANGE_KEYS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (of the words that stay,
    joined by one space)."""
    n = chunk_count(docs, "text", chunk_bytes)
    bits = 0
    while (1 << bits) * range_keys * 6 < n * chunk_bytes:
        bits += 1
    chunks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), chunk_of(n).alias("chunk"))
    hits = materialize(fingerprints(chunks, bits).groupBy("range").applyInArrow(_hits, "chunk int, range int, body binary"), "hits")
    by_chunk = chunks.groupBy("chunk")
    sent = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(_extend(bits), SENT)
    later = sent.groupBy("range").applyInArrow(_later, "chunk int, range int, body binary")
    side = hits.withColumn("kind", F.lit(0)).unionByName(later.withColumn("kind", F.lit(1)))
    return by_chunk.cogroup(side.groupBy("chunk")).applyInArrow(_remove(bits), "doc_id long, n_words long, n_removed long, kept_sha256 string")
