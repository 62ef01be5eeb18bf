"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to order 3, learned from a bounded sample of its
documents, taken whole: as many as fit in SAMPLE_BYTES, none of more than LONGEST bytes. A text costs, under each tree, the exact code length of its bytes: at every byte the
longest known context predicts, or escapes to the next shorter one (escape method C), down to
256 equal chances. The trees are frozen: scoring changes no count. The shortest code wins.

Null text and text without a letter get `und`; a text is read whole, however long. Equal code
lengths go to the language that comes first by name. Labels that are null teach nothing; of
repeated rows each is scored, and those of one key teach once. With nothing learned every text is
`und`. An empty table gives an empty result. Only text, lang and doc_id are read for a prediction
or its sample; columns named like the results are replaced.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelight.llm.common import doc_crc, that_fit, flat_text, row_sums, stretches, whole_text

ORDER = 3
#: Documents and bytes that a language's tree learns from at most, and bytes of one document.
SAMPLE_DOCS, SAMPLE_BYTES, LONGEST = 600, 3_000_000, 100_000
#: Languages at most: each has a tree of about 1 MB in the broadcast.
MOST_LANGUAGES = 500
#: Distinct byte pairs up to which grams are found by direct addressing; grams kept by a worker.
DENSE_PAIRS, KEPT_GRAMS = 4096, 1_000_000


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte, that byte after the `order` ones before it in its document (zero bytes
    stand before a document) as one 32-bit number."""
    code = data.astype(np.uint32)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(1, order + 1):
        shifted = np.zeros(len(data), np.uint32)
        shifted[back:] = data[: max(0, len(data) - back)]
        shifted[place < back] = 0
        code |= shifted << np.uint32(8 * back)
    return code


class Tree:
    """Counts of one language by order: contexts with totals and distinct followers, and
    contexts with their follower."""

    def __init__(self, code: np.ndarray, count: np.ndarray, order: int = ORDER):
        self.levels = []
        for k in range(order, -1, -1):
            mask = np.uint32((1 << (8 * (k + 1))) - 1)
            gram, at = np.unique(code & mask, return_inverse=True)
            c = np.bincount(at, weights=count, minlength=len(gram)).astype(np.int64)
            context, at = np.unique(gram >> np.uint32(8), return_inverse=True)
            total = np.bincount(at, weights=c, minlength=len(context)).astype(np.int64)
            self.levels.append((mask, gram, c, context, total, np.bincount(at, minlength=len(context))))

    def nats(self, code: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte."""
        out = np.zeros(len(code))
        left = np.arange(len(code))
        for mask, gram, count, context, total, kinds in self.levels:
            own = code[left] & mask
            where = np.minimum(np.searchsorted(context, own >> np.uint32(8)), len(context) - 1)
            known = context[where] == own >> np.uint32(8)
            room = np.where(known, total[where] + kinds[where], 1)
            at = np.minimum(np.searchsorted(gram, own), len(gram) - 1)
            seen = gram[at] == own
            out[left] += np.where(seen, -np.log(count[at] / room), np.where(known, -np.log(kinds[where] / room), 0.0))
            left = left[~seen]
        out[left] += np.log(256.0)
        return out


class Scorer:
    """Code lengths of grams under all trees; each distinct gram is worked out once."""

    def __init__(self, trees: list[Tree]):
        self.trees = trees
        self.clear()

    def clear(self) -> None:
        self.pair = np.full(1 << 16, -1, np.int32)
        self.pairs, self.size = 0, 256
        self.row = np.full((self.size, self.size), -1, np.int32)
        self.cost = np.zeros((0, len(self.trees)))

    def costs(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers for the grams, and the table of costs that they point to."""
        if len(self.cost) > KEPT_GRAMS:
            self.clear()
        first, last = code >> np.uint32(16), code & np.uint32(0xFFFF)
        fresh = np.flatnonzero((np.bincount(first, minlength=1 << 16) + np.bincount(last, minlength=1 << 16) > 0) & (self.pair < 0))
        if self.pairs + len(fresh) > DENSE_PAIRS:
            known, at = np.unique(code, return_inverse=True)
            return at, np.stack([t.nats(known) for t in self.trees], 1)
        self.pair[fresh] = np.arange(self.pairs, self.pairs + len(fresh))
        self.pairs += len(fresh)
        if self.pairs > self.size:
            wider = -(-self.pairs // 512) * 512
            row = np.full((wider, wider), -1, np.int32)
            row[: self.size, : self.size] = self.row
            self.row, self.size = row, wider
        where = self.pair[first].astype(np.int64) * self.size + self.pair[last]
        flat = self.row.reshape(-1)
        rows = flat[where]
        if (rows < 0).any():
            new, at = np.unique(code[rows < 0], return_index=True)
            flat[where[np.flatnonzero(rows < 0)[at]]] = np.arange(len(self.cost), len(self.cost) + len(new))
            self.cost = np.concatenate([self.cost, np.stack([t.nats(new) for t in self.trees], 1)])
            rows = flat[where]
        return rows, self.cost


def learn(docs: DataFrame, lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, Tree]:
    """A tree for each language of docs (text, lang, key). key, a hash, decides the sample: the
    documents of the least keys, thinned before they are ranked so that no language's rows meet
    in one task, as many as fit in sample_bytes. Rows of more than LONGEST bytes are never among
    them. Ranks need numbers only; the texts of the chosen ones are fetched afterwards. Equal texts
    of one key teach once, empty ones nothing."""
    length = F.octet_length("text")
    named = docs.filter(F.col(lang_col).isNotNull() & (length > 0) & (length <= min(LONGEST, sample_bytes))).select(F.col(lang_col).alias("lang"), "text", "key", F.xxhash64("text").alias("print"))
    counts = named.groupBy("lang").count()
    if counts.limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values: it is no column of languages")
    share = F.least(F.lit(1.0), F.lit(3.0 * sample_docs) / F.col("count"))
    # one row for each label value, MOST_LANGUAGES at most
    few = named.join(F.broadcast(counts), "lang").filter(F.pmod("key", F.lit(1_000_000)) < share * 1_000_000)
    numbers = few.select("lang", "key", "print", F.octet_length("text").alias("bytes")).distinct()
    order = Window.partitionBy("lang").orderBy(F.pmod("key", F.lit(1_000_000)), "key", "print")
    chosen = numbers.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample_docs).orderBy("lang", "n").collect()  # sample_docs rows of numbers for each label value
    by_lang: dict[str, list] = {}
    for r in chosen:
        by_lang.setdefault(r["lang"], []).append(r)
    fitting = [r for own in by_lang.values() for r in own[: that_fit([r["bytes"] for r in own], sample_bytes)]]
    taken = docs.sparkSession.createDataFrame([(r["lang"], r["key"], r["print"]) for r in fitting], "lang string, key long, print long")
    sample = named.join(F.broadcast(taken), ["lang", "key", "print"]).dropDuplicates(["lang", "key", "print"])
    sample = sample.select("lang", F.col("text").cast("binary").alias("text"))

    def count(table: pa.Table) -> pa.Table:
        code, n = np.unique(grams(*flat_text(table["text"])), return_counts=True)
        return pa.table({"lang": pa.array([table["lang"][0].as_py()]), "code": pa.array([code.astype("<u4").tobytes()]), "count": pa.array([n.astype("<u4").tobytes()])})

    found = sample.groupBy("lang").applyInArrow(count, "lang string, code binary, count binary").collect()  # bounded by the sample
    return {r["lang"]: Tree(np.frombuffer(r["code"], "<u4"), np.frombuffer(r["count"], "<u4").astype(float)) for r in sorted(found, key=lambda r: r["lang"]) if len(r["code"])}


def identify(docs: DataFrame, trees: dict[str, Tree]) -> DataFrame:
    """docs with lang_pred, score (the winner's share if all languages are as likely) and
    bits_per_byte (of the winner's code; null for `und`). Only the texts go to Python; the other
    columns stay where they are."""
    names = list(trees)
    shared = docs.sparkSession.sparkContext.broadcast([trees[n] for n in names])  # bounded by the sample

    def score(data: np.ndarray, offsets: np.ndarray, letter: np.ndarray, scorer: Scorer) -> pa.Array:
        n = len(letter)
        nats = np.zeros((n, max(1, len(names))))
        if len(data) and names:
            at, table = scorer.costs(grams(data, offsets))
            for j in range(len(names)):
                nats[:, j] = row_sums(table[:, j][at], offsets)
        best = nats.argmin(1)
        least = nats[np.arange(n), best]
        ok = letter & bool(names)
        share = 1.0 / np.exp(np.minimum(0.0, least[:, None] - nats)).sum(1)
        lang = pa.array([names[b] if o else "und" for b, o in zip(best, ok, strict=True)], pa.string())
        bits = pa.array(least / np.log(2) / np.maximum(1, np.diff(offsets)), mask=~ok)
        return pa.StructArray.from_arrays([lang, pa.array(np.where(ok, share, 0.0)), bits], ["lang_pred", "score", "bits_per_byte"])

    @F.arrow_udf("lang_pred string, score double, bits_per_byte double")
    def told(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for text, lettered in batches:
            data, offsets = flat_text(text)
            letter = lettered.to_numpy(zero_copy_only=False).astype(bool)
            parts = [score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], letter[a:b], scorer) for a, b in stretches(offsets, 1_000_000)]
            yield pa.concat_arrays(parts) if parts else score(data, offsets, letter, scorer)

    # not to be run once for a filter and once for a column
    found = docs.withColumn("__told", told.asNondeterministic()(whole_text(), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))))
    return found.withColumns({c: F.col(f"__told.{c}") for c in ("lang_pred", "score", "bits_per_byte")}).drop("__told")


def training_rows(docs: DataFrame, folds: int = 5) -> DataFrame:
    """The rows that may teach: those whose crc32(doc_id as text) is no multiple of folds."""
    return docs.filter(doc_crc() % folds != 0).withColumn("key", F.xxhash64("doc_id"))


def language_of(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte for each row of docs."""
    found = identify(docs.select("doc_id", "text"), learn(training_rows(docs, folds)))
    return found.select("doc_id", (doc_crc() % folds == 0).alias("held_out"), "lang_pred", "score", "bits_per_byte")
