"""A byte-level language model by context-tree weighting.

Each byte is eight binary decisions. A decision's node (the bits of the byte so far) has, for
every depth d up to the model's order, a Krichevsky-Trofimov estimator under the d bytes before
it. Each estimator is weighed against the mixture of the deeper ones by what both would have
coded the whole training text with, so the probability of a bit mixes all depths.

Counts come from every training document. Texts travel as chunks by a hash of their id; each
chunk sends its distinct grams (a context and its byte) once, packed, to shards by the context's
nearest bytes; rows of many chunks are combined on the way, so that a common context's shard
reads each gram a few times only. A shard builds its subtrees bottom-up in numpy. The levels
above the split are summed by grouping, by nearest byte, and one task sees the levels of one byte
and of none. The answer, a log probability for each distinct gram, returns to the chunk in the
order sent. Word counts for the unigram base go and return likewise. Nothing is broadcast and no
statistic is capped.

Null text counts as empty: one end token, no bytes. Texts are read whole, however long, each in
one chunk. The end of a text is a byte of its own (a zero byte; zero bytes in a text count as ends
too). Null ids count as empty text where they are hashed. Repeated rows are documents of their
own, and equal texts get equal scores. An empty table gives an empty result. Other columns are
ignored, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import chunk_count, chunk_of, doc_crc, flat_text, mix64, stretches, whole_text
from tracelight.llm.substring import _blobs, _packed

#: Bytes of context, bytes of context that decide the shard, text bytes of a chunk, of a shard's share.
ORDER, SPLIT, CHUNK, SHARD_TEXT = 5, 3, 12_000_000, 12_000_000
#: Chunks whose rows a shard reads at once.
FAN = 256
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_LOG_GAMMA = np.r_[0.0, np.cumsum(np.log(np.arange(4096) + 0.5))]


def _log_half(n: np.ndarray) -> np.ndarray:
    """log of (1/2)(3/2)...(n - 1/2)."""
    big = np.maximum(n, 1) + 0.5
    stirling = (big - 0.5) * np.log(big) - big + 1 / (12 * big) - 1 / (360 * big**3) + 0.5 * np.log(2.0)
    return np.where(n <= 4096, _LOG_GAMMA[np.minimum(n, 4096).astype(np.int64)], stirling)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    big = n + 1.0
    return np.where(n < 2, 0.0, (big - 0.5) * np.log(big) - big + 1 / (12 * big) - 1 / (360 * big**3) + 0.5 * np.log(2 * np.pi))


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability of n0 zeros and n1 ones under the Krichevsky-Trofimov estimator."""
    return _log_half(n0) + _log_half(n1) - _log_factorial(n0 + n1)


def gram_codes(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Each byte and its context, nearest byte first, as one number: zero bytes stand before a
    text. data ends every text with a zero byte, offsets count it."""
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    code = data.astype(np.uint64)
    for back in range(1, order + 1):
        shifted = np.zeros(len(data), np.uint64)
        shifted[back:] = data[: max(0, len(data) - back)]
        shifted[place < back] = 0
        code |= shifted << np.uint64(8 * (order + 1 - back))
    return code


def with_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with a zero byte after each text."""
    return np.insert(LOWER[data], offsets[1:], 0), offsets + np.arange(len(offsets))


def leaves(code: np.ndarray, count: np.ndarray, order: int):
    """Nodes of the deepest level, for grams in the rows of code: keys (context << 8 | bits so
    far), n0, n1, and for each gram and bit the node's number."""
    byte = (code & np.uint64(255)).astype(np.int64)
    context = code & ~np.uint64(255)
    keys = np.stack([context | ((1 << j) | (byte >> (8 - j))).astype(np.uint64) for j in range(8)], 1)
    bit = np.stack([(byte >> (7 - j)) & 1 for j in range(8)], 1)
    node, at = np.unique(keys, return_inverse=True)
    at = at.reshape(keys.shape)
    ones = np.bincount(at.ravel(), weights=(bit * count[:, None]).ravel(), minlength=len(node))
    both = np.bincount(at.ravel(), weights=np.repeat(count, 8), minlength=len(node))
    return node, both - ones, ones, at, bit


def lift(node: np.ndarray, n0: np.ndarray, n1: np.ndarray, weighted: np.ndarray):
    """One level up: parents' keys, counts, the sum of their children's log probabilities, and
    each child's parent. A key's lowest byte is the node, the one above it the farthest byte."""
    up, at = np.unique((node >> np.uint64(16)) << np.uint64(8) | (node & np.uint64(255)), return_inverse=True)
    add = lambda w: np.bincount(at, weights=w, minlength=len(up))
    return up, add(n0), add(n1), add(weighted), at


def weigh(n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of a weighted node, and how much its own estimator weighs against one."""
    own = log_kt(n0, n1)
    return np.logaddexp(own, below) - np.log(2.0), np.exp(np.clip(own - below, -60, 60))


class Subtree:
    """The levels from `order` down to `split` over one shard's grams."""

    def __init__(self, code: np.ndarray, count: np.ndarray, order: int, split: int):
        node, n0, n1, self.at, self.bit = leaves(code, count, order)
        weighted = log_kt(n0, n1)
        self.levels = [((n1 + 0.5) / (n0 + n1 + 1), None, None)]
        for _ in range(order - split):
            node, n0, n1, below, up = lift(node, n0, n1, weighted)
            weighted, ratio = weigh(n0, n1, below)
            self.levels.append(((n1 + 0.5) / (n0 + n1 + 1), ratio, up))
        self.top, self.n0, self.n1, self.weighted = node, n0, n1, weighted

    def one(self) -> tuple[np.ndarray, np.ndarray]:
        """For each gram and bit, the probability of a one, and the node at the split."""
        at = self.at
        p = self.levels[0][0][at]
        for own, ratio, up in self.levels[1:]:
            at = up[at]
            p = (ratio[at] * own[at] + p) / (ratio[at] + 1)
        return p, at


def _distinct(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """All grams of the texts, each once, in order."""
    return np.unique(np.concatenate([np.unique(gram_codes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], order)) for a, b in stretches(offsets, 2_000_000)] or [np.zeros(0, np.uint64)]))


def _finder(code: np.ndarray):
    """A function from codes to their places in code, which is in order and holds them all.
    Most are found at once under a short hash; those that share it with another are searched."""
    bits = max(8, len(code).bit_length() + 2)
    short = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    table = np.zeros(1 << bits, np.int32)
    table[short(code)] = np.arange(len(code))

    def find(own: np.ndarray) -> np.ndarray:
        at = table[short(own)]
        other = np.flatnonzero(code[at] != own)
        at[other] = np.searchsorted(code, own[other])
        return at

    return find


def _gram_shards(code: np.ndarray, order: int, split: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of grams by shard, and their shards in that order."""
    shard = (mix64(code >> np.uint64(8 * (order + 1 - split))) % np.uint64(shards)).astype(np.int64)
    by = np.argsort(shard, kind="stable")
    return by, shard[by]


def _word_shards(words: dict, shards: int) -> dict[int, list[bytes]]:
    """Words by shard, in order; word shards are numbered from -1 down."""
    out: dict[int, list[bytes]] = {}
    for word in sorted(words):
        out.setdefault(-1 - zlib.crc32(word) % shards, []).append(word)
    return out


#: The end of a text among words: no word holds white space.
END = b"\n"
SENT = "chunk int, shard int, body binary, counts binary"


def _dictionary(order: int, split: int, shards: int, word_shards: int):
    """A chunk's distinct grams and words with their counts in its training documents."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        data, offsets = flat_text(table["text"])
        train = ~table["held_out"].to_numpy().astype(bool)
        ended, bounds = with_ends(data, offsets)
        learned = np.repeat(train, np.diff(bounds))
        codes, counts = [], []
        for a, b in stretches(bounds, 2_000_000):
            own, taught = gram_codes(ended[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], order), learned[bounds[a] : bounds[b]]
            seen, n = np.unique(own[taught], return_counts=True)
            rest = np.unique(own[~taught])
            codes += [seen, rest]
            counts += [n, np.zeros(len(rest), np.int64)]
        code, at = np.unique(np.concatenate(codes), return_inverse=True)
        count = np.bincount(at, weights=np.concatenate(counts), minlength=len(code)).astype(np.int64)
        by, shard = _gram_shards(code, order, split, shards)
        cut = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)]
        text = data.tobytes().lower()
        words: dict[bytes, int] = {END: int(train.sum())}
        taught: Counter = Counter()
        for i, t in enumerate(train.tolist()):
            own = text[offsets[i] : offsets[i + 1]].split()
            if t:
                taught.update(own)
            else:
                words.update(dict.fromkeys(own, 0))
        words.update(taught)
        words[END] = int(train.sum())
        by_shard = _word_shards(words, word_shards)
        here = key[0].as_py()
        bodies = [b" ".join(w) for w in by_shard.values()]
        counts = [np.array([words[x] for x in w], "<u8").tobytes() for w in by_shard.values()]
        grams = pa.table({"chunk": pa.array(np.full(len(cut) - 1, here), pa.int32()), "shard": pa.array(shard[cut[:-1]], pa.int32()), "body": _packed(code[by], cut), "counts": _packed(count[by].astype(np.uint64), cut)})
        named = pa.table({"chunk": pa.array([here] * len(bodies), pa.int32()), "shard": pa.array(list(by_shard), pa.int32()), "body": pa.array(bodies, pa.binary()), "counts": pa.array(counts, pa.binary())})
        return pa.concat_tables([grams, named])

    return run


def _total(table: pa.Table) -> tuple[np.ndarray, ...]:
    """A gram shard's sent codes, how many each row has, the distinct codes with their counts,
    and the place of each sent code among them."""
    sent, lens = _blobs(table["body"], "<u8")
    number, _ = _blobs(table["counts"], "<u8")
    code, at = np.unique(sent, return_inverse=True)
    return sent, lens, code, np.bincount(at, weights=number, minlength=len(code)), at


def _word_total(table: pa.Table) -> Counter:
    total: Counter = Counter()
    for body, counts in zip(table["body"].to_pylist(), table["counts"].to_pylist(), strict=True):
        for word, n in zip(body.split(b" "), np.frombuffer(counts, "<u8").tolist(), strict=True):
            total[word] += n
    return total


#: The key of the row that holds the number of training tokens and of distinct ones.
TOTALS = -1


def _tops(order: int, split: int):
    """Of a gram shard: its nodes one level above the split, as sums to add up with those of
    other shards. Of a word shard: its tokens and distinct tokens in training."""

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        if shard < 0:
            total = _word_total(table)
            node, n0, n1, below = [TOTALS], [float(sum(total.values()))], [float(sum(n > 0 for n in total.values()))], [0.0]
        else:
            _, _, code, count, _ = _total(table)
            t = Subtree(code, count, order, split)
            node, n0, n1, below, _ = lift(t.top, t.n0, t.n1, t.weighted)
            node = node.astype(np.int64)
        return pa.table({"shard": pa.array([shard] * len(node), pa.int32()), "node": pa.array(node, pa.int64()), "n0": pa.array(n0, pa.float64()), "n1": pa.array(n1, pa.float64()), "below": pa.array(below, pa.float64())})

    return run


def _climb(key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray, top: int, bottom: int):
    """From nodes of level top through level bottom: a and b for each node, so that the mixture of
    these levels makes a + b x of a probability x from below; then, one level up, each node's
    place and the keys, counts and sums there."""
    a, b, at = np.zeros(len(key)), np.ones(len(key)), np.arange(len(key))
    for level in range(top, bottom - 1, -1):
        weighted, ratio = weigh(n0, n1, below)
        a, b = (ratio[at] * ((n1 + 0.5) / (n0 + n1 + 1))[at] + a) / (ratio[at] + 1), b / (ratio[at] + 1)
        if level:
            key, n0, n1, below, up = lift(key, n0, n1, weighted)
            at = up[at]
    return a, b, at, (key, n0, n1, below)


def _columns(table: pa.Table) -> list[np.ndarray]:
    return [table["node"].to_numpy().astype(np.uint64), *(table[c].to_numpy() for c in ("n0", "n1", "below"))]


def _ribs(split: int):
    """The nodes one byte below the root of all that one nearest byte's nodes hold, 255 at most."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() == TOTALS:
            node, n0, n1, below = np.array([TOTALS]), *(np.array([table[c].to_numpy().sum()]) for c in ("n0", "n1", "below"))
        else:
            node, n0, n1, below = _climb(*_columns(table), split - 1, 2)[3]
        return pa.table({"rib": pa.array([key[0].as_py()] * len(node), pa.int64()), "node": pa.array(node.astype(np.int64)), "n0": n0, "n1": n1, "below": below})

    return run


def _roof(table: pa.Table) -> pa.Table:
    """The levels of one byte and of none, 255 * 256 nodes at most: a and b for each node of one
    byte, one row for each nearest byte, with the totals of words."""
    table = table.sort_by("node")
    node, rib = table["node"].to_numpy(), table["rib"].to_numpy()
    real = node != TOTALS
    totals = table.filter(pa.array(~real))
    a, b = np.zeros(len(node)), np.zeros(len(node))
    a[real], b[real] = _climb(*_columns(table.filter(pa.array(real))), 1, 0)[:2]
    cut = np.r_[np.flatnonzero(np.r_[True, rib[1:] != rib[:-1]]), len(rib)]
    n = len(cut) - 1
    tokens, distinct = (float(totals[c].to_numpy().sum()) for c in ("n0", "n1"))
    return pa.table({"rib": pa.array(rib[cut[:-1]]), "node": _packed(node, cut), "a": _packed(a, cut), "b": _packed(b, cut), "tokens": pa.array([tokens] * n), "distinct": pa.array([distinct] * n)})


def _rafters(split: int):
    """For each shard that wants nodes of one nearest byte: those nodes, with a and b of all the
    levels above them, and the totals of words."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, roof: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        shards = table["shards"].combine_chunks()
        owner, length = shards.flatten().to_numpy(), np.diff(shards.offsets.to_numpy())
        node = table["node"].to_numpy()
        if key[0].as_py() == TOTALS:
            a, b = np.zeros(len(node)), np.zeros(len(node))
        else:
            (one,), (two,) = ([np.frombuffer(roof[c][0].as_py(), "<f8")] for c in ("a", "b"))
            own_a, own_b, at, _ = _climb(*_columns(table), split - 1, 2)
            a, b = one[at] + two[at] * own_a, two[at] * own_b
        row = np.repeat(np.arange(len(node)), length)
        order = np.lexsort((row, owner))
        owner, row = owner[order], row[order]
        cut = np.r_[np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), len(owner)]
        n = len(cut) - 1
        told = [pa.array([roof[c][0].as_py()] * n) for c in ("tokens", "distinct")]
        return pa.table({"shard": pa.array(owner[cut[:-1]], pa.int32()), "rib": pa.array([key[0].as_py()] * n, pa.int64()), "node": _packed(node[row], cut), "a": _packed(a[row], cut), "b": _packed(b[row], cut), "tokens": told[0], "distinct": told[1]})

    return run


def _combine(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The rows that a group of chunks sends to one shard as one row: what they hold, once."""
    shard, group = key[0].as_py(), key[1].as_py()
    if shard < 0:
        total = sorted(_word_total(table).items())
        body, counts = b" ".join(w for w, _ in total), np.array([n for _, n in total], "<u8").tobytes()
    else:
        _, _, code, count, _ = _total(table)
        body, counts = code.tobytes(), count.astype("<u8").tobytes()
    return pa.table({"chunk": pa.array([group], pa.int32()), "shard": pa.array([shard], pa.int32()), "body": pa.array([body], pa.binary()), "counts": pa.array([counts], pa.binary())})


def _share_out(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
    """The answer to a combined row, for each row that it was made of."""
    shard, n = key[0].as_py(), table.num_rows
    body = told["body"][0].as_py()
    if shard < 0:
        count = dict(zip(sorted(_word_total(table)), np.frombuffer(body, "<i8").tolist(), strict=True))
        bodies = pa.array([np.array([count[w] for w in b.split(b" ")], "<i8").tobytes() for b in table["body"].to_pylist()], pa.binary())
    else:
        _, lens, _, _, at = _total(table)
        bodies = _packed(np.frombuffer(body, "<f4")[at], np.r_[0, np.cumsum(lens)])
    return pa.table({"chunk": table["chunk"], "shard": table["shard"], "body": bodies, "tokens": pa.array([told["tokens"][0].as_py()] * n), "distinct": pa.array([told["distinct"][0].as_py()] * n)})


ANSWER = "chunk int, shard int, body binary, tokens double, distinct double"


def _answers(order: int, split: int):
    """For each row sent to a shard: log10 probabilities of its grams, or counts of its words."""

    def run(table: pa.Table, roof: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"chunk": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "body": pa.array([], pa.binary()), "tokens": pa.array([], pa.float64()), "distinct": pa.array([], pa.float64())})
        if table["shard"][0].as_py() < 0:
            total = _word_total(table)
            body = pa.array([np.array([total[w] for w in b.split(b" ")], "<i8").tobytes() for b in table["body"].to_pylist()], pa.binary())
        else:
            _, lens, code, count, at = _total(table)
            t = Subtree(code, count, order, split)
            p, node = t.one()
            roof = roof.sort_by("rib")
            above = (t.top >> np.uint64(16)) << np.uint64(8) | (t.top & np.uint64(255))
            known, a, b = (_blobs(roof[c], k)[0] for c, k in (("node", "<i8"), ("a", "<f8"), ("b", "<f8")))
            where = np.searchsorted(known, above.astype(np.int64))[node]
            p = a[where] + b[where] * p
            logs = np.log10(np.where(t.bit == 1, p, 1 - p)).sum(1).astype(np.float32)
            body = _packed(logs[at], np.r_[0, np.cumsum(lens)])
        tokens, distinct = roof["tokens"][0].as_py(), roof["distinct"][0].as_py()
        n = table.num_rows
        return pa.table({"chunk": table["chunk"], "shard": table["shard"], "body": body, "tokens": pa.array([tokens] * n), "distinct": pa.array([distinct] * n)})

    return run


def _scores(order: int, split: int, shards: int, word_shards: int):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        data, offsets = flat_text(table["text"])
        ended, bounds = with_ends(data, offsets)
        code = _distinct(ended, bounds, order)
        by, shard = _gram_shards(code, order, split, shards)
        rows = dict(zip(told["shard"].to_pylist(), told["body"].to_pylist(), strict=True))
        logs = np.zeros(len(code), np.float32)
        logs[by] = np.concatenate([np.frombuffer(rows[s], "<f4") for s in np.unique(shard).tolist()])
        score, find = np.zeros(table.num_rows), _finder(code)
        for a, b in stretches(bounds, 2_000_000):
            at = find(gram_codes(ended[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], order))
            score[a:b] = np.add.reduceat(logs[at].astype(float), bounds[a:b] - bounds[a])
        text = data.tobytes().lower()
        docs = [text[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        words = dict.fromkeys(w for d in docs for w in d)
        words[END] = None
        count: dict[bytes, int] = {}
        for s, own in _word_shards(words, word_shards).items():
            count.update(zip(own, np.frombuffer(rows[s], "<i8").tolist(), strict=True))
        tokens, distinct = told["tokens"][0].as_py(), told["distinct"][0].as_py()
        seen = [np.array([count[w] for w in d] + [count[END]], float) for d in docs]
        base = [float(np.log10((c + 1) / (tokens + distinct + 1)).sum()) for c in seen]
        return pa.table({
            "doc_id": table["doc_id"], "held_out": table["held_out"], "n_tokens": pa.array([len(c) for c in seen], pa.int64()), "n_known": pa.array([int((c > 0).sum()) for c in seen], pa.int64()),
            "train_tokens": pa.array([int(tokens)] * len(seen), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64()), "n_coded": pa.array(np.diff(bounds), pa.int64())})

    return run


def _ask(sent: DataFrame, chunks: int, order: int, split: int, fan: int) -> DataFrame:
    """The shards' answers to the rows that so many chunks sent. A shard reads rows of at most
    `fan` chunks: beyond that, groups of chunks are combined first, in as many steps as it takes,
    and answers come back the same way."""
    if chunks > fan:
        grouped = sent.withColumn("group", F.floor(F.col("chunk") / fan).cast("int"))
        combined = grouped.groupBy("shard", "group").applyInArrow(_combine, SENT)
        told = _ask(combined, -(-chunks // fan), order, split, fan).withColumnRenamed("chunk", "group")
        return grouped.groupBy("shard", "group").cogroup(told.groupBy("shard", "group")).applyInArrow(_share_out, ANSWER)
    by_shard = sent.groupBy("shard")
    tops = by_shard.applyInArrow(_tops(order, split), "shard int, node long, n0 double, n1 double, below double")
    merged = tops.groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below"), F.collect_set("shard").alias("shards"))
    merged = merged.withColumn("rib", F.when(F.col("node") == TOTALS, TOTALS).otherwise(F.shiftright("node", 8 * (split - 1))).cast("long"))
    by_rib = merged.groupBy("rib")
    ribs = by_rib.applyInArrow(_ribs(split), "rib long, node long, n0 double, n1 double, below double")
    roof = ribs.groupBy(F.lit(0).alias("all")).applyInArrow(_roof, "rib long, node binary, a binary, b binary, tokens double, distinct double")
    above = by_rib.cogroup(roof.groupBy("rib")).applyInArrow(_rafters(split), "shard int, rib long, node binary, a binary, b binary, tokens double, distinct double")
    return by_shard.cogroup(above.groupBy("shard")).applyInArrow(_answers(order, split), ANSWER)


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2, order: int = ORDER, split: int = SPLIT, chunk_bytes: int = CHUNK, shard_text: int = SHARD_TEXT, fan: int = FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_coded (bytes
    and the end, so -score / n_coded is the code length of a byte) for each row of docs."""
    n = chunk_count(docs, "text", chunk_bytes)
    shards = max(1, n * chunk_bytes // shard_text)
    word_shards = max(1, shards // 4)
    chunks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), (doc_crc() % folds == held).alias("held_out"), chunk_of(n, "doc_id", "text").alias("chunk"))
    by_chunk = chunks.groupBy("chunk")
    sent = by_chunk.applyInArrow(_dictionary(order, split, shards, word_shards), SENT)
    told = _ask(sent, n, order, split, fan)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_coded long"
    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(_scores(order, split, shards, word_shards), schema)
