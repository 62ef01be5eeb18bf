"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised whole; those longer than a sequence are cut, the odd piece first. Full
pieces fill sequences of their own. The rest is dealt evenly into groups, each packed by
best-fit decreasing. Dual-feasible functions bound from below how many sequences a group needs;
a group that meets its bound is done. Groups with gaps pool or exchange their documents two by
two and run best-fit decreasing again, as long as that can save a sequence; a new packing counts
where it takes fewer.

Null text counts as empty; its document is the single end id. Texts are tokenised whole, however
long. Of pieces of one length the one of the lower row number is placed first, in the fullest
sequence that holds it. Repeated rows, null ids and clashing names are no matter: pieces are told
apart by a row number of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelight.llm.common import materialize

CAPACITY, END_ID = 1024, 2
#: Pieces of a group, groups that a pool grows to, cached words of a worker.
GROUP_PIECES, POOL_GROUPS, CACHE_WORDS = 250_000, 8, 250_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_json(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def byte_letters() -> dict[int, int]:
    """The letters by which a byte-level BPE writes bytes: visible Latin-1 characters stand for
    themselves, the other bytes take the code points from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in visible)
    return {b: b for b in visible} | {b: 256 + i for i, b in enumerate(others)}


class WordCache:
    """Token ids of whole texts, word by word: no token of a byte-level BPE spans the place
    before a blank that a visible character follows, so words are encoded once and joined. A new
    word is put together from its letters, digits and marks, which the tokenizer's own pattern
    parts and which are encoded once as well. Of two generations of words, the older goes when
    the newer is full."""

    ODD = re.compile(r" \s| $")
    CUT = re.compile(r" (?=\S)")
    MARKS = ".,;:!?"
    #: Fixed value: the pattern by which a byte-level BPE parts a text.
    PARTS = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    #: Up to here all versions of the character tables agree on letters and digits.
    LATIN = "\u024f"

    def __init__(self, json: str, most: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel work
        self.tokenizer = Tokenizer.from_str(json)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: array("I", [n]).tobytes() for n, t in added.items()}
        # the tokenizer parts a text at these before all else; the longest goes first
        self.parted = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.most, self.new, self.old, self.marks = most, {}, {}, {}

    def _model(self, part: str) -> bytes:
        """Ids of a part that the pattern leaves whole."""
        return array("I", [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def _part(self, part: str) -> bytes:
        """The same, kept: parts after a blank among the words."""
        kept, key = (self.new, part[1:]) if part[0] == " " and len(part) > 1 else (self.marks, part)
        own = kept.get(key)
        if own is None:
            own = kept[key] = self._model(part)
        return own

    def _whole(self, unit: str) -> bytes:
        return array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()

    def _ids(self, word: str) -> bytes:
        """Ids of a blank and the word that follows it."""
        core = word.rstrip(self.MARKS)
        if core.isalpha():
            return self._model(" " + word) if len(core) == len(word) else self._part(" " + core) + self._part(word[len(core) :])
        if word and max(word) <= self.LATIN:
            return b"".join(map(self._part, self.PARTS.findall(" " + word)))
        return self._whole(" " + word)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit words."""
        return [self._parted(t) if self.parted and self.parted.search(t) else self._plain([t])[0] for t in texts]

    def _parted(self, text: str) -> bytes:
        """Ids of a text that holds tokens added to the model: what lies between them is encoded
        apart."""
        pieces = self.parted.split(text)
        return b"".join(self.added[x] if i % 2 else self._plain([x])[0] for i, x in enumerate(pieces) if x)

    def _plain(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if len(self.new) > self.most:
                self.new, self.old = {}, self.new
            if len(self.marks) > self.most:
                self.marks = {}
            head, *words = self.CUT.split(text) if self.ODD.search(text) else text.split(" ")
            new, old = self.new, self.old
            for word in set(words).difference(new):
                own = old.get(word)
                new[word] = self._ids(word) if own is None else own
            out.append((self._whole(head) if head else b"") + b"".join(map(new.__getitem__, words)))
        return out


_CACHE: dict[int, WordCache] = {}


def _cache(json: str) -> WordCache:
    key = hash(json)
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = WordCache(json)
    return _CACHE[key]


def cut_pieces(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: only the first may be shorter."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(at, capacity) for at in range(head, n, capacity)]


def tokenise_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer_path))  # a file of fixed size
    end = array("I", [end_id]).tobytes()

    def rows(batches):
        words = _cache(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for doc, ids in zip(part["doc_id"].to_pylist(), words.encode([t or "" for t in part["text"].to_pylist()]), strict=True):
                    ids += end
                    for k, (start, length) in enumerate(cut_pieces(len(ids) // 4, capacity)):
                        out.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                doc, k, start, length, crc = zip(*out, strict=True)
                yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, PIECES)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Sequences that pieces of these sizes need at least: the best of two families of
    dual-feasible functions. The first counts sizes over capacity - a whole and those under a
    not at all, the second rounds (k + 1) x / capacity down to k-ths."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    number, weight = np.cumsum(count), np.cumsum(count * size)
    a = np.arange(0, capacity // 2 + 1)
    middle = weight[capacity - a] - np.where(a > 0, weight[np.maximum(a - 1, 0)], 0)
    best = int((number[-1] - number[capacity - a] - (-middle // capacity)).max())
    for k in range(1, 40):
        scaled = (k + 1) * size
        # in units of 1 / (k * capacity)
        value = np.where(scaled % capacity == 0, k * size, (scaled // capacity) * capacity)
        best = max(best, int(-(-(value * count).sum() // (k * capacity))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size, and the bins' loads. Bins are kept by their free space; a
    bit mask over the spaces finds the tightest one that holds the next piece."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    loads: list[int] = []
    mask = 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = mask >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            at = free[space].pop()
            if not free[space]:
                mask ^= 1 << space
        else:
            space, at = capacity, len(loads)
            loads.append(0)
        bins[i], offsets[i] = at, loads[at]
        loads[at] += size
        if space > size:
            free[space - size].append(at)
            mask |= 1 << (space - size)
    return bins, offsets, np.array(loads, np.int64)


PLACED = "uid long, length long, grp long, seq long, offset long, gap long, saved long"


def _pack_group(capacity: int, stage: int):
    """Pack one group anew, unless its pieces already have places in as few sequences. gap: the
    sequences above the bound; saved: the sequences that this packing took away."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", kind="stable")
        sizes, seq, offsets = (pdf[c].to_numpy() for c in ("length", "seq", "offset"))
        bins, at, loads = best_fit_decreasing(sizes, capacity)
        before = len(np.unique(seq)) if (seq >= 0).all() else len(sizes) + 1
        if len(loads) < before:
            seq, offsets = (stage << 56 | int(pdf["grp"].iloc[0]) << 28) + bins, at
        gap = min(len(loads), before) - lower_bound(sizes, capacity)
        saved = max(0, before - len(loads)) if before <= len(sizes) else 0
        return pd.DataFrame({"uid": pdf["uid"].to_numpy(), "length": sizes, "grp": pdf["grp"].to_numpy(), "seq": seq, "offset": offsets, "gap": gap, "saved": saved})

    return pack


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, pool_groups: int = POOL_GROUPS) -> DataFrame:
    """Places for the rows of pieces (uid, length <= capacity): (uid, sequence_id, offset).

    Groups that meet their bound are done. Those with gaps are numbered anew, so that each has a
    neighbour, and two neighbours pool their documents; pools grow to pool_groups groups. Beyond
    that, neighbours exchange sequences instead, half of each one's going over by a hash. Rounds
    go on until no group, or a last one without a neighbour, has a gap, or until an exchange
    between full pools saves nothing."""
    full = pieces.filter(F.col("length") == capacity).select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity).select("uid", "length")
    groups = max(1, math.ceil(rest.count() / group_pieces))
    none = F.lit(-1).cast("long")
    rest = rest.withColumns({"grp": F.pmod(F.xxhash64("uid"), F.lit(groups)), "seq": none, "offset": none})
    placed, size, stage, exchanged = [full], 1, 0, False
    while True:
        packed = materialize(rest.groupBy("grp").applyInPandas(_pack_group(capacity, stage), PLACED), "packed")
        told = materialize(packed.groupBy("grp").agg(F.first("gap").alias("gap"), F.first("saved").alias("saved")), "groups")  # one row for each group
        gaps, saved = told.agg(F.count_if(F.col("gap") > 0), F.sum("saved")).first()
        last = gaps < 2 or (exchanged and not saved)
        done = packed if last else packed.filter("gap = 0")
        placed.append(done.select("uid", F.col("seq").alias("sequence_id"), "offset"))
        if last:
            break
        number = told.filter("gap > 0").select("grp", (F.row_number().over(Window.orderBy("grp")) - 1).cast("long").alias("number"))  # one row for each group with a gap
        exchanged = size >= pool_groups
        pair = F.floor(F.col("number") / 2)
        grp = 2 * pair + F.pmod(F.xxhash64("seq", F.lit(stage)), F.lit(2)) if exchanged else pair
        rest = packed.filter("gap > 0").join(number, "grp").select("uid", "length", grp.cast("long").alias("grp"), "seq", "offset")
        size, stage = size if exchanged else 2 * size, stage + 1
    out = placed[0]
    for part in placed[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(tokenise_pieces(docs, tokenizer_path, capacity).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces.select("uid", "length"), capacity), "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
