"""Benchmark passages in documents, found by spaced seeds, with Spark's own functions only.

An overlap is a window of 13 tokens, or of a whole item where that is shorter, that a document and
an item both hold with at least four tokens in five agreeing. Fixed masks over such a window ignore
all of its positions but two of four blocks (one of two, where only one token may differ), and leave
one mask clear whatever tokens are substituted. So a document's and an item's windows that overlap
share the hash of what a mask leaves, six tokens or more of 13; their tokens are then compared one
by one. An overlap is of five tokens at least, so an item of five must agree whole, and shorter ones
overlap with nothing.

Documents meet the benchmark's distinct seeds first, in a broadcast while those are few enough;
item tokens, and where seeds are many the documents' own, are fetched for the hits alone.

Tokens are lower-case words without punctuation. Null or empty texts hold no tokens; texts are
read whole, however long. Rows without an id, of either table, take no part. Repeated rows count
once; of several windows the one with most agreeing tokens counts. An empty table, of either kind,
gives an empty result. Columns of other names are ignored, and none is carried on.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import materialize

WINDOW, SHARE, LEAST_TOKENS = 13, 0.8, 5
#: Up to this many distinct seeds of a benchmark are broadcast (about 50 bytes each); more are shuffled.
BROADCAST_SEEDS = 1_000_000
PUNCTUATION = ".,;:!?\"'()[]{}<>*#%&$_-/\\|`~=+@^"
BLANKS = " \t\n\x0b\f\r"


def tokens_of(text: Column) -> Column:
    """Lower-case words, punctuation dropped."""
    plain = F.btrim(F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, ""), F.lit(BLANKS))
    return F.split(plain, r"[ \t\n\x0B\f\r]+")


def needed(width: int) -> int:
    """Tokens of a window that must agree."""
    return math.ceil(width * SHARE - 1e-9) if width > LEAST_TOKENS else width


def masks_of(width: int) -> list[tuple[int, ...]]:
    """The positions that each mask over a window keeps. As many tokens as may differ leave two of
    two more blocks whole, or, where only one may, one of one more."""
    differ = width - needed(width)
    kept = 2 if differ > 1 else 1
    blocks = differ + kept
    cut = [round(i * width / blocks) for i in range(blocks + 1)]
    return [tuple(p for b in chosen for p in range(cut[b], cut[b + 1])) for chosen in combinations(range(blocks), kept)]


def _seeds(df: DataFrame, id_col: str, text_col: str, widths: list[int]) -> DataFrame:
    """(id, tokens, place, seed): one row for each mask of each width at each place. Tokens are
    split once for a text, below explode; what follows is plain columns, made as the rows are. The
    outer form of explode keeps the optimiser from adding filters that would tokenise once more."""
    tokens = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), tokens_of(F.col(text_col)).alias("tokens"))
    places = tokens.select("id", "tokens", F.explode_outer(F.sequence(F.lit(0), F.size("tokens") - 1)).alias("place"))

    def seed(width: int, number: int, kept: tuple[int, ...]) -> Column:
        # a window that reaches beyond the end has no seed
        return F.when(F.col("place") + width <= F.size("tokens"), F.xxhash64(F.lit(100 * width + number), *[F.get("tokens", F.col("place") + i) for i in kept]))

    each = F.array(*[seed(width, number, kept) for width in widths for number, kept in enumerate(masks_of(width))])
    return places.select("id", "tokens", "place", F.explode_outer(each).alias("seed")).filter(F.col("seed").isNotNull())


def _window(place: Column | str) -> Column:
    """The 13 tokens from a place on, with nulls beyond the end."""
    at = F.col(place) if isinstance(place, str) else place
    return F.array(*[F.get("tokens", at + i) for i in range(WINDOW)])


def _found(docs: DataFrame, seeds: DataFrame, id_col: str, text_col: str, widths: list[int], few: bool) -> DataFrame:
    """(id, seed, own): the seeds of docs that are among seeds, with the tokens of their windows.

    A few seeds are broadcast, and all of this is one pass over the texts. Many are met by an
    exchange of places and seeds alone; what meets comes back to its text, each text once with the
    list of its places, so that neither way carries a text with each of its places."""
    if few:
        return _seeds(docs, id_col, text_col, widths).join(F.broadcast(seeds), "seed", "left_semi").select("id", "seed", _window("place").alias("own"))
    named = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.struct(F.col(id_col).alias("id"), named.alias("name")).alias("row"), F.col(text_col).alias("text")).dropDuplicates(["row"])
    met = _seeds(rows, "row", "text", widths).select(F.col("id").alias("row"), "place", "seed").join(seeds, "seed", "left_semi")
    met = met.groupBy("row").agg(F.collect_list(F.struct("place", "seed")).alias("met"))
    tokens = rows.join(met, "row").select("row", "met", tokens_of(F.col("text")).alias("tokens"))
    each = F.transform("met", lambda m: F.struct(m["seed"].alias("seed"), _window(m["place"]).alias("own")))
    return tokens.select(F.col("row.id").alias("id"), F.explode(each).alias("m")).select("id", "m.seed", "m.own")


def overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, item_id, agreeing, of): the best overlap of each document with each item."""
    size = F.size(tokens_of(F.col("text")))
    measured = benchmark.filter(F.col("item_id").isNotNull()).select("item_id", "text", F.least(size, F.lit(WINDOW)).alias("width")).filter(F.col("width") >= LEAST_TOKENS)
    widths = sorted(r[0] for r in measured.select("width").distinct().collect())  # nine numbers at most
    parts = []
    for width in widths or [WINDOW]:
        # a shorter item is a window itself: its seeds are those at its first token
        seeds = _seeds(measured.filter(F.col("width") == width), "item_id", "text", [width])
        parts.append(seeds.select("seed", F.col("id").alias("item_id"), F.lit(width).alias("of"), F.slice(_window("place"), 1, width).alias("theirs")))
    items = parts[0]
    for part in parts[1:]:
        items = items.unionByName(part)
    items = materialize(items.distinct(), "seeds")
    seeds = materialize(items.select("seed").distinct(), "distinct")
    found = _found(docs, seeds, id_col, text_col, widths or [WINDOW], seeds.count() <= BROADCAST_SEEDS)
    agreeing = F.aggregate(F.zip_with(F.slice("own", 1, F.col("of")), "theirs", lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda a, b: a + b)
    need = F
    for width in widths or [WINDOW]:
        need = need.when(F.col("of") == width, needed(width))
    stands = found.join(items, "seed").select("id", "item_id", "of", agreeing.alias("agreeing")).filter(F.col("agreeing") >= need)
    return stands.groupBy("id", "item_id").agg(F.max("agreeing").alias("agreeing"), F.max("of").alias("of")).withColumnRenamed("id", id_col)


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each document that overlaps an item: id_col, n_items, item_ids (ascending),
    agreeing (most agreeing tokens in a window)."""
    return overlaps(docs, benchmark, text_col, id_col).groupBy(id_col).agg(
        F.count("item_id").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.max("agreeing").cast("long").alias("agreeing"))
