"""Quality rules: counts that fail a text at once, and a calibrated n-gram classifier for the rest.

The counts are exact: words, code points in words, symbols, lines that repeat an earlier line, and
words in three-word windows that occur twice or more. A text of too few words or of too many
repeated ones fails. What passes is judged by a logistic regression over hashed words, word pairs
and runs of 3 and 4 bytes, each family averaged over the text, beside four shares made from the
counts. It is learned by numpy gradient descent in one task from a bounded sample of labelled
rows. Labelled rows of a fold of their own, unseen in learning, calibrate it: a logistic curve turns
its output into a probability (Platt scaling). Rows are scored in Arrow batches with a model of
fixed size, against fixed thresholds; a score depends on its text alone.

Null text counts as empty and fails. Texts are read whole, however long; a labelled text of more
than SAMPLE_BYTES teaches nothing, but is scored. Rows without a label, or with conflicting labels,
teach nothing; repeated rows teach once and each get their row. Equal texts have equal scores.
Without any label every probability is 0.5, so the counts alone decide; without labels in the
calibration fold the curve is the plain logistic one. Rows without an id are scored. An empty
table gives an empty result. Only doc_id, text and quality are read, whatever other columns are
called.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import SPACES, doc_crc, flat_text, mix64, roll, row_sums, stretches, whole_text, word_hashes, word_spans

#: Fixed thresholds: least words, greatest share of repeated words in percent, least probability.
LEAST_WORDS, MOST_REPEATED, KEEP_AT = 50, 50, 0.5
#: Labelled rows that the model learns from at most, and bytes of a text that may be among them.
SAMPLE_DOCS, SAMPLE_BYTES = 4_000, 12_000
BITS, EPOCHS, RATE, BATCH, SEED = 17, 6, 0.3, 32, 11
#: Folds of crc32(doc_id as text): the first is held out, the second calibrates.
FOLDS = 5
SHARES = 1 << 40
#: Families of n-grams, and shares made from the counts.
FAMILIES, DENSE = 4, 4
STRETCH = 1_000_000

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_INNER = (np.arange(256) & 0xC0) == 0x80
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(numbers: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document its words in three-word windows that it holds twice or more. numbers
    tell words apart exactly, and so do the windows' keys."""
    if len(numbers) < 3:
        return np.zeros(n_docs, np.int64)
    a, b, c = numbers[:-2], numbers[1:-1], numbers[2:]
    if int(numbers.max()) < 1 << 21:
        key = a << 42 | b << 21 | c
    else:
        key = np.unique(a << 32 | b, return_inverse=True)[1].astype(np.int64) << 32 | c
    place = np.flatnonzero(doc[:-2] == doc[2:])
    key, own = key[place], doc[place]
    order = np.lexsort((key, own))
    key, own, place = key[order], own[order], place[order]
    same = (key[1:] == key[:-1]) & (own[1:] == own[:-1])
    often = np.r_[same, False] | np.r_[False, same] if len(place) else np.zeros(0, bool)
    change = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(change, place[often], 1)
    np.add.at(change, place[often] + 3, -1)
    return np.bincount(doc[np.cumsum(change[:-1]) > 0], minlength=n_docs)


def _dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    full = [x for x in lines if x and not x.isspace()]
    return len(full) - len(set(full))


class Texts:
    """Words, counts and n-grams of a stretch of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self.starts, self.ends, self.first = word_spans(data, offsets)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first))
        raw = data.tobytes()
        texts = [raw[offsets[i] : offsets[i + 1]] for i in range(self.n)]
        numbers = pa.array([w for t in texts for w in t.split()], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
        total = lambda mark: (lambda sums: sums[offsets[1:]] - sums[offsets[:-1]])(np.r_[0, np.cumsum(mark)])
        self.n_words = np.diff(self.first)
        self.word_chars = total(~SPACES[data] & ~_INNER[data])
        self.n_symbols = total(_SYMBOLS[data])
        self.n_dup_lines = np.array([_dup_lines(t) for t in texts], np.int64)
        self.n_repeat_words = _repeated(numbers, self.doc, self.n)
        self.n_lines = total(data == 10) + 1

    def failed(self) -> np.ndarray:
        return (self.n_words < LEAST_WORDS) | (100 * self.n_repeat_words > MOST_REPEATED * self.n_words)

    def grams(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(buckets, bounds of documents) of each family; no gram reaches into the next text."""
        hashes = word_hashes(self.data, self.starts, self.ends)
        top = lambda keys: (keys >> np.uint64(64 - BITS)).astype(np.int32)
        pairs = roll(hashes, 2)
        inside = self.doc[1:] == self.doc[:-1]
        bounds = np.r_[0, np.cumsum(np.maximum(self.n_words - 1, 0))]
        out = [(top(mix64(hashes)), self.first), (top(pairs[inside]), bounds)]
        left = np.repeat(self.offsets[1:], np.diff(self.offsets)) - np.arange(len(self.data))
        for size in (3, 4):
            code = np.zeros(len(self.data), np.uint64)
            for i in range(size):
                code[: len(code) - i] |= self.data[i:].astype(np.uint64) << np.uint64(8 * i)
            whole = left >= size
            bounds = np.r_[0, np.cumsum(np.maximum(np.diff(self.offsets) - size + 1, 0))]
            out.append((top(mix64(code[whole] << np.uint64(4) | np.uint64(size))), bounds))
        return out

    def shares(self) -> np.ndarray:
        """Of each document the shares of symbols, repeated lines, repeated words, and of words
        that equal the one before."""
        same = np.zeros(self.n)
        hashes = word_hashes(self.data, self.starts, self.ends)
        np.add.at(same, self.doc[1:][(hashes[1:] == hashes[:-1]) & (self.doc[1:] == self.doc[:-1])], 1)
        words = np.maximum(self.n_words, 1)
        return np.stack([self.n_symbols / np.maximum(self.word_chars, 1), self.n_dup_lines / self.n_lines, self.n_repeat_words / words, same / words], 1)


def logits(texts: Texts, model: dict) -> np.ndarray:
    out = model["bias"] + texts.shares() @ model["dense"]
    for (bucket, bounds), weight in zip(texts.grams(), model["weight"], strict=True):
        out += row_sums(weight[bucket].astype(float), bounds) / np.maximum(np.diff(bounds), 1)
    return out


def probability(value: np.ndarray, model: dict) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(model["slope"] * value + model["shift"], -60, 60)))


def _rows(data: np.ndarray, offsets: np.ndarray):
    """Of each text its distinct features with their values: buckets of all families in one range
    of numbers, the shares behind them."""
    for lo, hi in stretches(offsets, STRETCH):
        texts = Texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        families, shares = texts.grams(), texts.shares()
        for i in range(hi - lo):
            keys, values = [], []
            for f, (bucket, bounds) in enumerate(families):
                own, count = np.unique(bucket[bounds[i] : bounds[i + 1]], return_counts=True)
                keys.append(own.astype(np.int64) + (f << BITS))
                values.append(count / max(1, count.sum()))
            keys.append((FAMILIES << BITS) + np.arange(DENSE))
            values.append(shares[i])
            yield np.concatenate(keys).astype(np.int32), np.concatenate(values).astype(np.float32)


def fit(data: np.ndarray, offsets: np.ndarray, label: np.ndarray, calibrates: np.ndarray) -> dict:
    """Learn from the rows that do not calibrate, by gradient steps over small batches whose size
    each weight's own past gradients set; then calibrate."""
    rows = list(_rows(data, offsets))
    learns = np.flatnonzero(~calibrates)
    weight, past, bias = np.zeros((FAMILIES << BITS) + DENSE), np.full((FAMILIES << BITS) + DENSE, 1e-8), 0.0
    random = np.random.default_rng(SEED)
    for epoch in range(EPOCHS):
        order, rate = random.permutation(learns), RATE / (1 + epoch)
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            key = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part]).astype(float)
            row = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            z = bias + np.bincount(row, weight[key] * value, len(part))
            error = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - label[part]
            own, place = np.unique(key, return_inverse=True)
            slope = np.bincount(place, error[row] * value) / len(part)
            past[own] += slope * slope
            weight[own] -= rate * slope / np.sqrt(past[own])
            bias -= rate * 0.1 * error.mean()
    model = {"weight": weight[: FAMILIES << BITS].reshape(FAMILIES, -1).astype(np.float32), "dense": weight[FAMILIES << BITS :], "bias": float(bias), "slope": 1.0, "shift": 0.0}
    asked = np.flatnonzero(calibrates)
    if len(asked) and len(set(label[asked].tolist())) == 2:
        model |= _calibrated(np.array([model["bias"] + weight[rows[i][0]] @ rows[i][1] for i in asked]), label[asked])
    return model


def _calibrated(z: np.ndarray, label: np.ndarray) -> dict:
    """Slope and shift of the logistic curve that fits the labels best, by Newton steps. Targets
    stand a little inside 0 and 1, so that rows told apart without error give a finite slope."""
    good = label.sum()
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (len(label) - good + 2))
    x, at = np.stack([z, np.ones(len(z))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -60, 60)))
        bend = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(bend, x.T @ (p - target))
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    # more evidence never makes a text worse
    return {"slope": float(max(at[0], 1e-3)), "shift": float(at[1])}


NONE = {"weight": np.zeros((FAMILIES, 1 << BITS), np.float32), "dense": np.zeros(DENSE), "bias": 0.0, "slope": 1.0, "shift": 0.0}


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict:
    """Fit on at most sample_docs labelled rows of at most sample_bytes, chosen by a hash of their
    ids, that are not held out."""
    fold = doc_crc() % FOLDS
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold != 0)).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("__most")).filter("label = __most").drop("__most")
    share = min(1.0, 2.0 * sample_docs / max(1, known.count()))
    few = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)) < math.ceil(share * SHARES)).orderBy(F.xxhash64("doc_id")).limit(2 * sample_docs)
    # at most 2 * sample_docs pairs of numbers
    texts = docs.select("doc_id", whole_text().alias("text")).filter(F.octet_length("text") <= sample_bytes)
    sample = texts.join(F.broadcast(few), "doc_id").distinct().withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "text").limit(sample_docs)
    sample = sample.select("rank", "text", "label", (fold == 1).alias("calibrates"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rank", "ascending"), ("text", "ascending")])
        model = fit(*flat_text(table["text"]), table["label"].to_numpy().astype(int), table["calibrates"].to_numpy())
        return pa.table({"weight": pa.array([model["weight"].astype("<f4").tobytes()]), "dense": pa.array([model["dense"].tolist()]), **{c: pa.array([model[c]]) for c in ("bias", "slope", "shift")}})

    found = sample.groupBy(F.lit(0).alias("all")).applyInArrow(run, "weight binary, dense array<double>, bias double, slope double, shift double").collect()
    if not found:
        return NONE
    r = found[0]
    return {"weight": np.frombuffer(r["weight"], "<f4").reshape(FAMILIES, -1), "dense": np.array(r["dense"]), **{c: r[c] for c in ("bias", "slope", "shift")}}


def judge(docs: DataFrame, model: dict, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, the counts, base_failed, probability and kept for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FAMILIES * 2**BITS numbers
    source = docs.select("doc_id", whole_text().alias("__text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, probability double, kept boolean"

    def rows(batches):
        for batch in batches:
            data, offsets = flat_text(batch["__text"])
            for at, end in stretches(offsets, STRETCH):
                texts = Texts(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
                p, failed = probability(logits(texts, shared.value), shared.value), texts.failed()
                columns = [batch["doc_id"].slice(at, end - at), *[pa.array(getattr(texts, c).astype(np.int64)) for c in COUNTS]]
                yield pa.record_batch([*columns, pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_at))], names=["doc_id", *COUNTS, "base_failed", "probability", "kept"])

    return source.mapInArrow(rows, schema)


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels, then judge every row of docs."""
    return judge(docs, learn(docs, labels))
