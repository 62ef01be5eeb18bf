"""A quality score from supervised subword embeddings.

Every word, every run of 3 and of 4 bytes, and a marker for each word or word triple that the
document has had before, owns a learned vector, found by hashing. A document is the mean of its
vectors; a softmax over two classes scores it. numpy stochastic gradient descent learns vectors
and weights in one task from a bounded sample of labelled rows, taken whole: as many as fit in
SAMPLE_BYTES, none of more than LONGEST bytes. Scoring needs
one number for each bucket, its vector's product with the weights, so the broadcast model has a
fixed size. A score depends on its text alone, wherever the row stands.

Null text counts as empty; an empty text gets the score of the prior alone. Texts are scored
whole, however long. Rows without a label, or with conflicting labels, teach nothing; repeated
rows teach once and are all scored. Without any label every score is 0.5; equal texts have equal
scores. An empty table gives an empty result. Only doc_id, text and quality are read, whatever
other columns are called.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import doc_crc, that_fit, flat_text, mix64, roll, row_sums, stretches, whole_text, word_hashes, word_spans

BUCKET_BITS, WIDTH, EPOCHS, RATE, SEED = 17, 8, 4, 0.5, 7
#: Labelled documents and bytes that the model learns from at most, and bytes of one of them.
SAMPLE_DOCS, SAMPLE_BYTES, LONGEST = 6_000, 20_000_000, 200_000
#: Parts of the hash range by which labelled rows are thinned.
SHARES = 1 << 40
#: The last two buckets are kept for the repeat markers.
WORD_AGAIN, TRIPLE_AGAIN = (1 << BUCKET_BITS) - 1, (1 << BUCKET_BITS) - 2


def _runs(data: np.ndarray, left: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the run of `size` bytes that starts at each place. left counts the bytes from a
    place to its document's end; zero bytes stand behind it, so that no run reads the next text."""
    code = np.zeros(len(data), np.uint32)
    for i in range(size):
        own = data[i:].astype(np.uint32)
        own[left[: len(own)] <= i] = 0
        code[: len(own)] |= own << np.uint32(8 * i)
    code *= np.uint32(0x9E3779B1)
    code ^= np.uint32(size) << np.uint32(27)
    return code >> np.uint32(32 - BUCKET_BITS)


def _again(keys: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """How many keys of each document it has had before."""
    if not len(keys):
        return np.zeros(n_docs, np.int64)
    marked = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (keys >> np.uint64(20)))
    first = np.r_[True, marked[1:] != marked[:-1]]
    own = (marked >> np.uint64(44)).astype(np.int64)
    return np.bincount(own, minlength=n_docs) - np.bincount(own[first], minlength=n_docs)


def _parts(data: np.ndarray, offsets: np.ndarray):
    """(buckets, document bounds) of the byte runs and of the words, and the marker counts."""
    n = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    doc = np.repeat(np.arange(n), np.diff(first))
    triple = roll(words, 3)
    inside = doc[: len(triple)] == doc[2:] if len(triple) else np.zeros(0, bool)
    buckets = (mix64(words) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    return [(_runs(data, left, 3), offsets), (_runs(data, left, 4), offsets), (buckets, first)], _again(words, doc, n), _again(triple[inside], doc[: len(triple)][inside], n)


def score_texts(data: np.ndarray, offsets: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    parts, word_again, triple_again = _parts(data, offsets)
    total = word_again * float(weight[WORD_AGAIN]) + triple_again * float(weight[TRIPLE_AGAIN])
    number = (word_again + triple_again).astype(float)
    for buckets, bounds in parts:
        total += row_sums(weight[buckets].astype(float), bounds)
        number += np.diff(bounds)
    logit = bias + total / np.maximum(number, 1)
    return 1.0 / (1.0 + np.exp(-np.clip(logit, -60, 60)))


def train(data: np.ndarray, offsets: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent, a document a step: the products (one for each bucket) and
    the bias of the learned classifier."""
    random = np.random.default_rng(SEED)
    vectors = random.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BUCKET_BITS, WIDTH))
    output, bias = np.zeros((WIDTH, 2)), np.zeros(2)
    features = []
    for lo, hi in stretches(offsets, 2_000_000):
        parts, word_again, triple_again = _parts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        for i in range(hi - lo):
            own = np.concatenate([b[bounds[i] : bounds[i + 1]].astype(np.int32) for b, bounds in parts])
            bucket, count = np.unique(own, return_counts=True)
            bucket, count = np.r_[bucket, WORD_AGAIN, TRIPLE_AGAIN], np.r_[count, word_again[i], triple_again[i]].astype(float)
            features.append((bucket.astype(np.int32), (count / max(1.0, count.sum())).astype(np.float32)))
    steps, done = EPOCHS * len(label), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(label)):
            rate = RATE * (1 - done / steps)
            done += 1
            bucket, share = features[i]
            hidden = share @ vectors[bucket]
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[i]] -= 1.0
            back = output @ p
            output -= rate * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            # a mean over many vectors moves each a little; the step is scaled up to match
            np.subtract.at(vectors, bucket, (rate * 40.0) * share[:, None] * back)
    return (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float]:
    """Fit on the labelled rows whose crc32(doc_id as text) is no multiple of folds."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (doc_crc() % folds != 0)).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("__most")).filter("label = __most").drop("__most")
    share = min(1.0, 1.5 * sample_docs / max(1, known.count()))
    few = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)) < math.ceil(share * SHARES)).orderBy(F.xxhash64("doc_id")).limit(sample_docs)
    # at most sample_docs pairs of numbers
    texts = docs.select("doc_id", whole_text().alias("text")).filter(F.octet_length("text") <= min(LONGEST, sample_bytes)).withColumn("print", F.xxhash64("text"))
    numbers = texts.select("doc_id", "print", F.octet_length("text").alias("bytes")).join(F.broadcast(few), "doc_id").distinct()
    chosen = numbers.withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "print").limit(sample_docs).select("doc_id", "print", "label", "bytes")
    rows = chosen.collect()  # sample_docs rows of numbers
    rows = rows[: that_fit([r["bytes"] for r in rows], sample_bytes)]
    taken = docs.sparkSession.createDataFrame([(*r, n) for n, r in enumerate(rows)], chosen.schema.add("n", "integer"))
    # the texts of the chosen rows that fit in sample_bytes together
    sample = texts.join(F.broadcast(taken), ["doc_id", "print"]).dropDuplicates(["n"]).select("n", "label", F.col("text").cast("binary").alias("text"))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        weight, bias = train(*flat_text(table["text"]), table["label"].to_numpy().astype(int))
        return pa.table({"weight": pa.array([weight.astype("<f4").tobytes()]), "bias": pa.array([bias])})

    found = sample.groupBy(F.lit(0).alias("all")).applyInArrow(fit, "weight binary, bias double").collect()
    return (np.frombuffer(found[0]["weight"], "<f4"), found[0]["bias"]) if found else (np.zeros(1 << BUCKET_BITS, np.float32), 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BUCKET_BITS numbers
    source = docs.select(*keep, whole_text().alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("__text").schema) + ", score double"

    def rows(batches):
        weight, bias = shared.value
        for batch in batches:
            data, offsets = flat_text(batch["__text"])
            for at, end in stretches(offsets, 2_000_000):
                values = score_texts(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], weight, bias)
                yield pa.record_batch([*[batch[c].slice(at, end - at) for c in keep], pa.array(values)], names=[*keep, "score"])

    return source.mapInArrow(rows, schema)


def quality_of(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    found = score(docs, learn(docs, labels, folds))
    return found.select("doc_id", (doc_crc() % folds == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
