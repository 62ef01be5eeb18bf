"""Repeated 100-byte strings, found with suffix arrays and removed from all but the first place.

Every 100-byte window is named by its anchor: the least hash among its 32-byte strings. Equal
windows have equal anchors, so only stretches whose anchor occurs again can hold a repeat; they
alone leave their document, dealt to shards by anchor. A stretch that several documents share
travels once for each chunk of documents and is sorted once. Each shard sorts its suffixes by
Larsson-Sadakane refinement in numpy and takes common prefixes as Kasai does, many lanes at a
time. Suffixes with 100 bytes in common form a run, whose least place
keeps its bytes.

Shards by anchor never share a window, so no shard's array is searched for another's suffixes:
dealing by anchor takes the place of a merge across all shards, which would have to send the 100
bytes of every window. A shard that is too long for one array is cut into blocks with an array
each, and blocks are merged by binary search of each one's runs among the others'. Anchors that
very many stretches share are dealt window by window; where a window is judged does not change
what becomes of it.

Rows travel packed, one for each chunk and shard that share any, so never more than anchors.

Null text counts as empty; texts are read whole, however long, each in one chunk. Ids that are
null count as the greatest. Rows of equal id, repeated ones among them, count as one document:
equal places are not earlier than each other. An empty table gives an empty result. Other columns
are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import CHUNK_BYTES, _inverse_powers, _powers, chunk_count, chunk_of, flat_text, materialize, mix64, stretches, whole_text
from tracelight.llm.substring import LAST, _blobs, _packed, by_range

WINDOW, ANCHOR = 100, 32
#: Text bytes whose repeats a shard gets, bytes of one suffix array, stretches that make an anchor hot.
SHARD_TEXT, BLOCK_BYTES, HOT = 2_000_000, 2_000_000, 100_000


def string_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each place that has as many."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data))[: len(data)], out=prefix[1:])
        return mix64((prefix[size:] - prefix[:n]) * _inverse_powers(n)[:n])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[: len(values) - have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one anchor: document, first window, number of windows, anchor, and
    whether the run has its anchor in more than one place."""
    out = []
    for lo, hi in stretches(offsets, 1_000_000):
        part = data[offsets[lo] : offsets[hi]]
        if len(part) < WINDOW:
            continue
        hashes = string_hashes(part, ANCHOR)
        least = _least(hashes, WINDOW - ANCHOR + 1)
        bounds = offsets[lo : hi + 1] - offsets[lo]
        doc = np.repeat(np.arange(lo, hi), np.diff(bounds))[: len(least)]
        valid = np.arange(len(least)) + WINDOW <= bounds[doc - lo + 1]
        new = np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]
        at = np.flatnonzero(valid & (new | np.r_[True, ~valid[:-1]]))
        end = np.flatnonzero(valid & np.r_[new[1:] | ~valid[1:], True]) + 1
        if not len(at):
            continue
        span = end - at + WINDOW - ANCHOR
        begin = np.r_[0, np.cumsum(span)][:-1]
        inside = np.repeat(at - begin, span) + np.arange(span.sum())
        places = np.add.reduceat((hashes[inside] == np.repeat(least[at], span)).astype(np.int32), begin)
        out.append((doc[at], at + offsets[lo], end - at, mix64(least[at]), places > 1))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _fingerprints(docs: DataFrame, bits: int) -> DataFrame:
    """(range, chunks, probes): packed fingerprints of anchors and their chunks. A run that holds its anchor in two
    places, and so may repeat within itself, sends it twice."""

    def rows(batches):
        for batch in batches:
            data, offsets = flat_text(batch["text"])
            doc, _, _, anchor, again = anchored(data, offsets)
            chunk = batch["chunk"].to_numpy().astype(np.int64)[np.r_[doc, doc[again]]]
            anchor = np.r_[anchor, anchor[again]]
            part = (anchor >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(anchor), np.int64)
            yield by_range(part, chunk, (anchor >> np.uint64(32 - bits)).astype(np.uint32))

    return docs.select("chunk", "text").mapInArrow(rows, "range int, chunks binary, probes binary")


def _repeated(hot: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Of one range, the fingerprints that occur again, by chunk, each with a mark if hot."""
        probe, chunk = (_blobs(table[c], "<u4")[0] for c in ("probes", "chunks"))
        both = np.sort(probe.astype(np.uint64) << np.uint64(32) | chunk.astype(np.uint64))
        if not len(both):
            return pa.table({"chunk": pa.array([], pa.int32()), "range": pa.array([], pa.int32()), "body": pa.array([], pa.binary()), "hot": pa.array([], pa.binary())})
        own = both >> np.uint64(32)
        run = np.cumsum(np.r_[True, own[1:] != own[:-1]]) - 1
        number = np.bincount(run)[run]
        keep = (number > 1) & np.r_[True, both[1:] != both[:-1]]
        chunk, own, mark = (both[keep] & np.uint64(0xFFFFFFFF)).astype(np.int64), own[keep].astype(np.uint32), (number[keep] > hot).astype(np.uint8)
        order = np.argsort(chunk, kind="stable")
        chunk, own, mark = chunk[order], own[order], mark[order]
        cut = np.r_[np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]), len(chunk)] if len(chunk) else np.zeros(1, np.int64)
        return pa.table({"chunk": pa.array(chunk[cut[:-1]], pa.int32()), "range": pa.array(np.full(len(cut) - 1, key[0].as_py()), pa.int32()), "body": _packed(own, cut), "hot": _packed(mark, cut)})

    return run


class Stretches:
    """A chunk's documents in a fixed order and the distinct texts of its repeated stretches,
    ordered by shard; each with the least place it has in the chunk."""

    def __init__(self, table: pa.Table, hits: pa.Table, bits: int):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = table["doc_id"].fill_null(int(LAST)).to_numpy()
        self.raw = table["doc_id"].combine_chunks()
        self.data, self.offsets = flat_text(table["text"])
        doc, at, number, anchor, _ = anchored(self.data, self.offsets)
        body, lens = _blobs(hits["body"], "<u4")
        mark, _ = _blobs(hits["hot"], "u1")
        known = np.repeat(hits["range"].to_numpy().astype(np.uint64), lens) << np.uint64(32) | body
        order = np.argsort(known)
        known, mark = known[order], mark[order]
        probe = anchor >> np.uint64(32 - bits)
        where = np.minimum(np.searchsorted(known, probe), len(known) - 1) if len(known) else np.zeros(len(probe), np.int64)
        hit = known[where] == probe if len(known) else np.zeros(len(probe), bool)
        doc, at, number, anchor = doc[hit], at[hit], number[hit], anchor[hit]
        hot = mark[where[hit]].astype(bool) if len(known) else np.zeros(0, bool)
        if hot.any():
            # window by window, each dealt by its own hash
            times = np.where(hot, number, 1)
            first = np.r_[0, np.cumsum(times)][:-1]
            step = np.arange(times.sum()) - np.repeat(first, times)
            single = np.repeat(hot, times)
            doc, number, at = np.repeat(doc, times), np.where(single, 1, np.repeat(number, times)), np.repeat(at, times) + np.where(single, step, 0)
            whole = string_hashes(self.data, WINDOW)
            anchor = np.where(single, whole[at], np.repeat(anchor, times))
        shard = (anchor >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(anchor), np.int64)
        order = np.argsort(shard, kind="stable")
        self.doc, self.at, self.number, self.shard = doc[order], at[order], number[order], shard[order]
        text, known_as = self.data.tobytes(), {}
        self.kind = np.fromiter((known_as.setdefault((s, text[a : a + n + WINDOW - 1]), len(known_as)) for s, a, n in zip(self.shard.tolist(), self.at.tolist(), self.number.tolist(), strict=True)), np.int64, len(order))
        self.texts = [t for _, t in known_as]
        self.local = self.at - self.offsets[self.doc]
        # documents are in order of id, and stretches in order of place within a shard
        self.first = np.unique(self.kind, return_index=True)[1]


def _send(bits: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, hits: pa.Table) -> pa.Table:
        s = Stretches(table, hits, bits)
        shard = s.shard[s.first]
        cut = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)] if len(shard) else np.zeros(1, np.int64)
        lens = np.array([len(t) for t in s.texts], np.uint32)
        body = np.frombuffer(b"".join(s.texts), np.uint8)
        upto = np.r_[0, np.cumsum(lens, dtype=np.int64)]
        return pa.table({
            "chunk": pa.array(np.full(len(cut) - 1, key[0].as_py()), pa.int32()), "range": pa.array(shard[cut[:-1]], pa.int32()), "body": _packed(body, upto[cut]),
            "lens": _packed(lens, cut), "docs": _packed(s.ids[s.doc[s.first]], cut), "places": _packed(s.local[s.first].astype(np.uint32), cut)})

    return run


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of text in order.

    Sorted by 5 bytes first; then groups that are still equal are sorted by the rank of what
    follows, twice as far each time, and groups of one are left alone."""
    n = len(text)
    padded = np.r_[text, np.zeros(5, np.uint8)]
    key = np.zeros(n, np.uint64)
    for i in range(5):
        key = (key << np.uint64(8)) | padded[i : i + n]
    order = _in_order(key, 40)
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    have = 5
    rank = np.zeros(n + 1, np.int64)  # 0: past the end
    width = n.bit_length()
    while True:
        group = np.flatnonzero(new)[np.cumsum(new) - 1]  # each group is known by its first place in the order
        rank[order] = group + 1
        alone = new & np.r_[new[1:], True]
        left = np.flatnonzero(~alone)
        if not len(left):
            return order
        where = order[left]
        after = rank[np.minimum(where + have, n)]
        g = np.cumsum(new[left])
        sub = _in_order(g.astype(np.uint64) << np.uint64(width) | after.astype(np.uint64), width + int(g[-1]).bit_length())
        order[left] = where[sub]
        a = after[sub]
        new[left] = np.r_[True, (g[1:] != g[:-1]) | (a[1:] != a[:-1])]
        have *= 2


def _in_order(key: np.ndarray, width: int) -> np.ndarray:
    """Places of keys of `width` bits in stable order. Where the place fits in beside the key, the
    two are sorted as one number."""
    bits = len(key).bit_length()
    if width + bits > 64:
        return np.argsort(key, kind="stable")
    return (np.sort(key << np.uint64(bits) | np.arange(len(key), dtype=np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int = WINDOW, lane: int = 64) -> np.ndarray:
    """Length, `cap` at most, that each suffix in the order shares with the one before it.

    Kasai's walk over the text: what a suffix shares with the one before it, less one byte, the
    next suffix shares at least. Lanes of 64 places are walked side by side."""
    n = len(text)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.r_[text, np.zeros(cap + 1, np.uint8)]
    out = np.zeros(n, np.int64)
    at = np.arange(0, n, lane)
    have = np.zeros(len(at), np.int64)
    for _ in range(lane):
        inside = at < n
        at, have = at[inside], have[inside]
        other = before[at]
        have = np.where(other < 0, 0, np.maximum(have - 1, 0))
        going = np.flatnonzero(other >= 0)
        while len(going):
            a, b = at[going] + have[going], other[going] + have[going]
            same = (have[going] < cap) & (a < n) & (b < n) & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])
            going = going[same]
            have[going] += 1
        out[at] = have
        at = at + 1
    return out[order]


def _block_runs(texts: list[bytes], doc: np.ndarray, place: np.ndarray):
    """Windows of one block in suffix order: text, offset, run number, and whether the window
    also starts earlier in the block; and the runs' least places."""
    text = np.frombuffer(b"".join(texts), np.uint8)
    lens = np.array([len(t) for t in texts])
    order = suffix_array(text)
    run = np.cumsum(common_prefixes(text, order) < WINDOW)
    owner = np.repeat(np.arange(len(texts)), lens)
    offset = np.arange(len(text)) - np.repeat(np.r_[0, np.cumsum(lens)][:-1], lens)
    window = (offset + WINDOW <= lens[owner])[order]
    order, run = order[window], run[window]
    who, off = owner[order], offset[order]
    first = np.r_[True, run[1:] != run[:-1]]
    run = np.cumsum(first) - 1
    d, p = doc[who], place[who] + off
    best = np.lexsort((p, d, run))
    head = best[first]  # groups keep their bounds
    return who, off, run, d, p, head, order


def _judge(table: pa.Table, block_bytes: int) -> list[np.ndarray]:
    """For each sent stretch, which of its windows also start earlier."""
    lens, per_row = _blobs(table["lens"], "<u4")
    docs, _ = _blobs(table["docs"], "<i8")
    places, _ = _blobs(table["places"], "<u4")
    data, _ = flat_text(table["body"])
    raw, upto = data.tobytes(), np.r_[0, np.cumsum(lens, dtype=np.int64)]
    places = places.astype(np.int64)
    # equal stretches: the least place stands for all, the others are repeats throughout
    known: dict[bytes, int] = {}
    kind = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)), np.int64, len(lens))
    texts = list(known)
    order = np.lexsort((places, docs, kind))
    first = order[np.r_[True, kind[order][1:] != kind[order][:-1]]] if len(order) else order
    doc, place = docs[first], places[first]
    size = np.array([len(t) for t in texts], np.int64)
    later = [np.zeros(n - WINDOW + 1, bool) for n in size.tolist()]
    block = (np.cumsum(size) - size) // block_bytes if len(size) else size
    blocks = []
    for b in np.unique(block):
        rows = np.flatnonzero(block == b)
        blocks.append((rows, *_block_runs([texts[i] for i in rows], doc[rows], place[rows])))
    least = _merged([(rows, who, off, d[head], p[head], head) for rows, who, off, run, d, p, head, _ in blocks], texts)
    for (rows, who, off, run, d, p, head, _), (best_d, best_p) in zip(blocks, least, strict=True):
        flag = (d > best_d[run]) | (d == best_d[run]) & (p > best_p[run])
        for i, o in zip(rows[who[flag]].tolist(), off[flag].tolist(), strict=True):
            later[i][o] = True
    lead = np.zeros(len(lens), bool)
    for i in range(len(lens)):
        k = kind[i]
        lead[i] = docs[i] == doc[k] and places[i] == place[k]
    return [later[k] if own else np.ones(int(n) - WINDOW + 1, bool) for k, own, n in zip(kind.tolist(), lead.tolist(), lens.tolist(), strict=True)]


def _heads(texts: list[bytes], rows: np.ndarray, who: np.ndarray, off: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The windows that runs begin with, in the order of the runs. All are of one length, so that
    fixed strings compare as the bytes do."""
    return np.array([texts[rows[w]][o : o + WINDOW] for w, o in zip(who[head].tolist(), off[head].tolist(), strict=True)], f"S{WINDOW}")


def _merged(blocks, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each run's least place in any block. Every block's runs are in order, so those of one are
    looked up in each other's by binary search, all at once."""
    if len(blocks) == 1:
        return [(d, p) for _, _, _, d, p, _ in blocks]
    heads = [_heads(texts, rows, who, off, head) for rows, who, off, _, _, head in blocks]
    out = []
    for i, (_, _, _, d, p, _) in enumerate(blocks):
        d, p = d.copy(), p.copy()
        for j, (_, _, _, other_d, other_p, _) in enumerate(blocks):
            if i != j:
                at = np.minimum(np.searchsorted(heads[j], heads[i]), len(heads[j]) - 1)
                own = np.flatnonzero(heads[j][at] == heads[i])
                at = at[own]
                less = (other_d[at] < d[own]) | (other_d[at] == d[own]) & (other_p[at] < p[own])
                d[own[less]], p[own[less]] = other_d[at[less]], other_p[at[less]]
        out.append((d, p))
    return out


def _shard(block_bytes: int):
    def run(table: pa.Table) -> pa.Table:
        flags = _judge(table, block_bytes)
        number = _blobs(table["lens"], "<u4")[1]
        cut = np.r_[0, np.cumsum(number)]
        body = [np.packbits(np.concatenate(flags[a:b])).tobytes() if b > a else b"" for a, b in zip(cut, cut[1:], strict=False)]
        return pa.table({"chunk": table["chunk"], "range": table["range"], "body": pa.array(body, pa.binary())})

    return run


def _remove(bits: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, side: pa.Table) -> pa.Table:
        kind = side["kind"].to_numpy()
        s = Stretches(table, side.filter(pa.array(kind == 0)), bits)
        told = side.filter(pa.array(kind == 1)).sort_by("range")
        windows = s.number[s.first]
        shard = s.shard[s.first]
        bits_of: list[np.ndarray] = []
        for part, body in zip(told["range"].to_pylist(), told["body"].to_pylist(), strict=True):
            bits_of.append(np.unpackbits(np.frombuffer(body, np.uint8), count=int(windows[shard == part].sum())).astype(bool))
        flags = np.concatenate(bits_of) if bits_of else np.zeros(0, bool)
        begin = np.r_[0, np.cumsum(windows)]
        change = np.zeros(len(s.data) + 1, np.int64)
        if len(s.kind):
            lead = s.first[s.kind]
            # a later place of a stretch that the chunk has twice is a repeat throughout
            repeat = (s.ids[s.doc] > s.ids[s.doc[lead]]) | (s.ids[s.doc] == s.ids[s.doc[lead]]) & (s.local > s.local[lead])
            total = s.number.sum()
            row = np.repeat(np.arange(len(s.kind)), s.number)
            step = np.arange(total) - np.repeat(np.r_[0, np.cumsum(s.number)][:-1], s.number)
            gone = repeat[row] | flags[begin[s.kind[row]] + step]
            at = (s.at[row] + step)[gone]
            np.add.at(change, at, 1)
            np.add.at(change, at + WINDOW, -1)
        removed = np.cumsum(change[:-1]) > 0
        total = np.r_[0, np.cumsum(removed)]
        start = removed.copy()
        start[1:] &= ~removed[:-1]
        inner = s.offsets[:-1][s.offsets[:-1] < len(removed)]
        start[inner] = removed[inner]
        spans = np.r_[0, np.cumsum(start)]
        lo, hi = s.offsets[:-1], s.offsets[1:]
        sha = [hashlib.sha256(s.data[a:b][~removed[a:b]].tobytes()).hexdigest() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        return pa.table({"doc_id": s.raw, "n_bytes": pa.array(hi - lo, pa.int64()), "n_removed": pa.array(total[hi] - total[lo], pa.int64()), "n_spans": pa.array(spans[hi] - spans[lo], pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return run


def remove_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, shard_text: int = SHARD_TEXT, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    n = chunk_count(docs, "text", chunk_bytes)
    bits = 0
    while (1 << bits) * shard_text < n * chunk_bytes:
        bits += 1
    chunks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), chunk_of(n).alias("chunk"))
    hits = materialize(_fingerprints(chunks, bits).groupBy("range").applyInArrow(_repeated(hot), "chunk int, range int, body binary, hot binary"), "anchors")
    by_chunk = chunks.groupBy("chunk")
    sent = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(_send(bits), "chunk int, range int, body binary, lens binary, docs binary, places binary")
    told = sent.groupBy("range").applyInArrow(_shard(block_bytes), "chunk int, range int, body binary")
    side = hits.withColumn("kind", F.lit(0)).unionByName(told.withColumn("hot", F.lit(None).cast("binary")).withColumn("kind", F.lit(1)))
    return by_chunk.cogroup(side.groupBy("chunk")).applyInArrow(_remove(bits), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
