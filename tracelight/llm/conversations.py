"""A prefix trie over conversations, with totals of each subtree by time-forward processing.

Turns become a digest and a word count at once, so texts are not shuffled (but those of turns that
tie). A range sort by conversation and place numbers them, so one conversation may fill many
partitions; what a partition starts with comes from one row for each conversation that crosses a
bound. A node is named by 128 bits of a SHA-256 chain over its turns. Chains are made in blocks of
BLOCK turns and linked by one row for each block. A trie node is then one row of a grouping, with
its members counted before the shuffle; its smallest member and its depth name it from there on.

Totals: nodes are dealt to shards by ranges of (conv_id, depth); in that order a parent always comes
before its children, and the nodes of which one conversation is the smallest member are
neighbours. Each shard is sorted by Spark, which spills, in reverse level order. A node takes
what its children have sent from a priority queue that spills sorted runs, and sends its own total
to its parent's place in the queue. What is sent to a parent in another shard leaves the shard;
such parents, each with what came from outside and with the next such parent above it, are a
smaller tree, whose totals are worked out in the same way, over as many levels as it takes. Then
each shard runs once more with the totals that enter it.

Conversations are ordered by turn, null first; turns that tie go by role and text, and equal ones
count as often as they occur. Null roles and texts are empty. Rows without a conv_id take no part.
Texts are read whole; conversations may be of any length. The decimal ids of one node's d-turn
members are hashed in their order, so a node with very many is one stream of its ids, in bounded
memory. An empty table gives an empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelight.llm.common import doc_crc, materialize, whole_text

#: Conversations that share the head of the first of them, and turns of a head at most.
FAMILY, HEAD = 20, 3
#: Turns of a chain's block; nodes of a shard; messages that a queue holds before it spills.
BLOCK, SHARD_NODES, QUEUE = 65_536, 50_000, 200_000
#: Turns of a range of the numbering.
RANGE_TURNS = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def _digest(*parts: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def turns_of(df: DataFrame) -> DataFrame:
    """(conv_id, turn, place, digest, words): place orders turns that tie."""
    role, text = whole_text("role"), whole_text()
    own = df.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"),
        _digest(F.length(role).cast("string"), F.lit(":"), role, text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    # written, as it is read several times below and texts are hashed once
    slim = materialize(own.select("conv_id", "turn", "digest", "words"), "turns")
    tied = materialize(slim.groupBy("conv_id", "turn").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("conv_id", "turn"), "tied")
    if tied.isEmpty():
        return slim.withColumn("place", F.lit(0))
    same = lambda a, b: (F.col(f"{a}.conv_id") == F.col(f"{b}.conv_id")) & F.col(f"{a}.turn").eqNullSafe(F.col(f"{b}.turn"))
    ranked = own.alias("o").join(tied.alias("t"), same("o", "t"), "left_semi").groupBy("conv_id", "turn", "digest").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    ranked = ranked.select("conv_id", "turn", "digest", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")).alias("place"))
    found = slim.alias("s").join(ranked.alias("r"), same("s", "r") & (F.col("s.digest") == F.col("r.digest")), "left")
    return found.select("s.conv_id", "s.turn", "s.digest", "words", F.coalesce("place", F.lit(0)).alias("place"))


def _cumulative(column: np.ndarray, fresh: np.ndarray, start: int) -> np.ndarray:
    """Running sums within runs that begin where fresh is set; the first run goes on from start."""
    total = np.cumsum(column) + start
    at = np.maximum.accumulate(np.where(fresh, np.arange(len(column)), 0))
    base = np.where(fresh[at], total[at] - column[at], 0)
    return total - base


def _number(batches):
    """(part, conv_id, own, at, heads, digest, words): place of each row in its conversation, and
    head rows up to it, as far as this partition shows."""
    conv, at, heads = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, own = batch["conv_id"].to_numpy(), batch["own"].to_numpy()
        fresh = np.r_[conv is None or ids[0] != conv, ids[1:] != ids[:-1]]
        ats, head = _cumulative(np.ones(len(ids), np.int64), fresh, at), _cumulative((own == 0).astype(np.int64), fresh, heads)
        conv, at, heads = ids[-1], int(ats[-1]), int(head[-1])
        yield pa.record_batch([batch["part"], batch["conv_id"], batch["own"], pa.array(ats), pa.array(head), batch["digest"], batch["words"]], names=["part", "conv_id", "own", "at", "heads", "digest", "words"])


def numbered(rows: DataFrame, parts: int) -> DataFrame:
    """rows (conv_id, own, turn, place, digest, words) with at, the place in the conversation from
    1, and heads, its rows with own = 0."""
    order = [F.col("conv_id"), F.col("own"), F.col("turn").asc_nulls_first(), F.col("place"), F.col("digest")]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    local = materialize(ranged.select("part", "conv_id", "own", "digest", "words").mapInArrow(_number, "part int, conv_id long, own int, at long, heads long, digest binary, words long"), "numbered")
    per = local.groupBy("conv_id", "part").agg(F.max("at").alias("rows"), F.max("heads").alias("heads"))
    along = Window.partitionBy("conv_id").orderBy("part")
    per = per.select("conv_id", "part", (F.sum("rows").over(along) - F.col("rows")).alias("before"), F.sum("heads").over(Window.partitionBy("conv_id")).alias("all_heads"), F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("parts"))
    # a conversation in two ranges crosses a bound between them: two rows for each bound at most
    crossing = per.filter("parts > 1").select("conv_id", "part", "before", "all_heads")
    found = local.join(F.broadcast(crossing), ["conv_id", "part"], "left")
    return found.select("conv_id", "own", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), F.coalesce("all_heads", "heads").alias("heads"), "digest", "words")


def rebuilt(df: DataFrame, range_turns: int = RANGE_TURNS) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): conv_id, also of those without a turn; and conv_id, pos from 1,
    digest, words. Each conversation begins with the first h turns of its family's first, followed
    by its own without their first h; h is crc32(conv_id as text) % 4."""
    own = turns_of(df)
    convs = own.select("conv_id").distinct()
    h = (doc_crc("conv_id") % (HEAD + 1)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    first = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "place", "digest")
    heads = own.filter(F.col("conv_id") % FAMILY == 0).withColumn("o", F.row_number().over(first)).filter(F.col("o") <= HEAD).select(F.col("conv_id").alias("base"), "o", "digest", "words")
    given = convs.filter(F.col("conv_id") % FAMILY != 0).select("conv_id", base.alias("base"), h.alias("h")).join(heads, "base").filter("o <= h")
    kind = own.schema["turn"].dataType
    given = given.select("conv_id", F.lit(0).alias("own"), F.lit(None).cast(kind).alias("turn"), F.col("o").cast("int").alias("place"), "digest", "words")
    rows = own.select("conv_id", F.lit(1).alias("own"), "turn", F.col("place").cast("int").alias("place"), "digest", "words").unionByName(given)
    found = numbered(rows, max(4, math.ceil(df.count() / range_turns)))
    skipped = F.when(F.col("conv_id") % FAMILY == 0, 0).otherwise(h)
    kept = found.filter((F.col("own") == 0) | (F.col("at") - F.col("heads") > skipped))
    return convs, kept.select("conv_id", F.when(F.col("own") == 0, F.col("at")).otherwise(F.col("at") - skipped).alias("pos"), "digest", "words")


def _chain(batches):
    """key of each turn and of the one before it, chained from the start of its block."""
    run, key = None, b""
    for batch in batches:
        keys, before = [], []
        for conv, block, digest in zip(batch["conv_id"].to_pylist(), batch["block"].to_pylist(), batch["digest"].to_pylist(), strict=True):
            if (conv, block) != run:
                run, key = (conv, block), b""
            before.append(key)
            key = hashlib.sha256(key + digest).digest()[:16]
            keys.append(key)
        yield pa.record_batch([batch["conv_id"], batch["block"], batch["pos"], pa.array(keys, pa.binary()), pa.array(before, pa.binary()), batch["words"]], names=["conv_id", "block", "pos", "key", "up", "words"])


def _link(batches):
    """The key with which each block but the first begins, from the last keys of the blocks."""
    conv, start = None, b""
    for batch in batches:
        out = []
        for own, last in zip(batch["conv_id"].to_pylist(), batch["last"].to_pylist(), strict=True):
            if own != conv:
                conv, start = own, b""
            out.append(start)
            start = hashlib.sha256(start + last).digest()[:16] if start else last
        yield pa.record_batch([batch["conv_id"], batch["block"], pa.array(out, pa.binary())], names=["conv_id", "block", "start"])


def keyed(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, pos, key, up, words): the names of the node of each turn and of its parent."""
    dealt = turns.withColumn("block", F.floor((F.col("pos") - 1) / block)).select("conv_id", "block", "pos", "digest", "words")
    dealt = dealt.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")
    local = materialize(dealt.mapInArrow(_chain, "conv_id long, block long, pos long, key binary, up binary, words long"), "chains")
    lasts = local.filter("block > 0").select("conv_id").distinct().join(local, "conv_id").groupBy("conv_id", "block").agg(F.max_by("key", "pos").alias("last"))
    starts = lasts.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_link, "conv_id long, block long, start binary").filter("block > 0")
    found = local.join(materialize(starts, "starts"), ["conv_id", "block"], "left")
    linked = lambda c: F.when(F.col("start").isNull(), F.col(c)).when(F.col(c) == F.lit(b""), F.col("start")).otherwise(_digest("start", c))
    return found.select("conv_id", "pos", linked("key").alias("key"), linked("up").alias("up"), "words")


def _hash_ends(batches):
    """SHA-256 of the ids of each key, in the order in which they come."""
    key, sha = None, None
    for batch in batches:
        keys, found = [], []
        for own, conv in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
            if own != key:
                if key is not None:
                    keys.append(key), found.append(sha.hexdigest())
                key, sha = own, hashlib.sha256(str(conv).encode())
            else:
                sha.update(b",%d" % conv)
        if keys:
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["key", "ends_sha256"])
    if key is not None:
        yield pa.record_batch([pa.array([key], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["key", "ends_sha256"])


def trie_nodes(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, words, ends_sha256), a row a node."""
    steps = materialize(steps, "steps")
    nodes = steps.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("pos").alias("depth"), F.first("up").alias("up"), F.count(F.lit(1)).alias("n_convs"), F.first("words").alias("words"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(F.lit(b"").alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("up"), "n_convs", F.lit(0).cast("long").alias("words"))
    nodes = materialize(nodes.unionByName(root), "nodes")
    ends = steps.groupBy("conv_id").agg(F.max_by("key", "pos").alias("key"))
    ends = convs.join(ends, "conv_id", "left").select("conv_id", F.coalesce("key", F.lit(b"")).alias("key"))
    ends = ends.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_hash_ends, "key binary, ends_sha256 string")
    kids = nodes.filter("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(kids, "key", "left").join(ends, "key", "left")
    parents = nodes.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    return full.join(parents, "up", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "words", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


class SpillingQueue:
    """Messages (level, conv, leaves, saved), taken out deepest level first, then by conv. Beyond
    `room` of them all that are held become a sorted run in a file without a name, which only this
    task can read and which is gone with it, as Spark's own spills are."""

    def __init__(self, room: int):
        self.room, self.held, self.runs, self.spilled = room, [], [], 0

    def push(self, level: int, conv: int, leaves: int, saved: int) -> None:
        heapq.heappush(self.held, (-level, conv, leaves, saved))
        if len(self.held) > self.room:
            file = tempfile.TemporaryFile()  # noqa: SIM115 - closed when its run is read
            np.array(sorted(self.held), np.int64).tofile(file)
            file.seek(0)
            self.held, self.spilled = [], self.spilled + 1
            run = self._read(file)
            heapq.heappush(self.runs, (next(run), self.spilled, run))

    @staticmethod
    def _read(file):
        with file:
            while body := file.read(32 * 4096):
                yield from map(tuple, np.frombuffer(body, np.int64).reshape(-1, 4).tolist())

    def head(self) -> tuple[int, int] | None:
        """(-level, conv) of the next message."""
        found = min([x[0][0] if x is self.runs else x[0] for x in (self.held, self.runs) if x], default=None)
        return found and found[:2]

    def pop(self) -> tuple[int, int, int, int]:
        if self.runs and (not self.held or self.runs[0][0] < self.held[0]):
            found, number, run = self.runs[0]
            following = next(run, None)
            heapq.heapreplace(self.runs, (following, number, run)) if following else heapq.heappop(self.runs)
            return found
        return heapq.heappop(self.held)


NODE = "shard int, conv_id long, depth long, parent_conv_id long, parent_depth long, leaves long, saved long, entering boolean"
TOTAL = "shard int, conv_id long, depth long, leaves long, saved long, leaving boolean"


def _upward(room: int):
    """Totals of the nodes of sorted shards, and messages to parents outside. Rows that are entering
    are messages from outside, and stand before their node."""

    def run(batches):
        shard, queue = None, SpillingQueue(room)
        names = [f.split()[0] for f in TOTAL.split(", ")]

        def batch_of(out):
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        def pass_to(out, place):
            """Messages for places that the shard does not have, before `place`, leave it."""
            while (at := queue.head()) is not None and (place is None or at < place):
                level, conv, leaves, saved = queue.pop()
                if out and out[-1][5] and out[-1][:3] == (shard, conv, -level):
                    leaves, saved = leaves + out[-1][3], saved + out[-1][4]
                    out.pop()
                out.append((shard, conv, -level, leaves, saved, True))

        for batch in batches:
            out = []
            for own, conv, depth, up_conv, up_depth, leaves, saved, entering in zip(*(batch[c].to_pylist() for c in batch.schema.names), strict=True):
                if own != shard:
                    pass_to(out, None)
                    shard = own
                pass_to(out, (-depth, conv))
                if entering:
                    queue.push(depth, conv, leaves, saved)
                    continue
                while queue.head() == (-depth, conv):
                    _, _, more, also = queue.pop()
                    leaves, saved = leaves + more, saved + also
                out.append((own, conv, depth, leaves, saved, False))
                if up_conv is not None:
                    queue.push(up_depth, up_conv, leaves, saved)
            if out:
                yield batch_of(out)
        out = []
        pass_to(out, None)
        if out:
            yield batch_of(out)

    return run


def _exits(batches):
    """For each node of sorted shards the nearest ancestor outside its shard. Holds the nodes of
    one shard at a time."""
    shard, exit_of = None, {}
    for batch in batches:
        out = []
        for own, conv, depth, up_conv, up_depth in zip(*(batch[c].to_pylist() for c in ("shard", "conv_id", "depth", "parent_conv_id", "parent_depth")), strict=True):
            if own != shard:
                shard, exit_of = own, {}
            found = (None, None) if up_conv is None else exit_of.get((up_conv, up_depth), (up_conv, up_depth))
            exit_of[conv, depth] = found
            out.append((own, conv, depth, *found))
        if out:
            kinds = (pa.int32(), *[pa.int64()] * 4)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["shard", "conv_id", "depth", "parent_conv_id", "parent_depth"])


def _swept(rows: DataFrame, room: int) -> DataFrame:
    rows = rows.select(*[f.split()[0] for f in NODE.split(", ")])
    ordered = rows.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "conv_id", F.desc("entering"))
    return ordered.mapInArrow(_upward(room), TOTAL)


def subtree_totals(tree: DataFrame, shard_nodes: int = SHARD_NODES, room: int = QUEUE, least_shards: int = 4) -> DataFrame:
    """(conv_id, depth, leaves, saved): sums over the subtree of each node of tree (conv_id, depth,
    parent_conv_id, parent_depth, leaves, saved). A parent is less deep than its children."""
    tree = materialize(tree, "tree")
    shards = max(least_shards, math.ceil(tree.count() / shard_nodes))
    placed = tree.repartitionByRange(shards, "conv_id", "depth").withColumns({"shard": F.spark_partition_id(), "entering": F.lit(False)})
    placed = materialize(placed, "shards") if shards > 1 else tree.withColumns({"shard": F.lit(0), "entering": F.lit(False)})
    once = materialize(_swept(placed, room), "sums")
    outside = once.filter("leaving").groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    outside = materialize(outside, "outside")
    if outside.isEmpty():
        return once.filter("NOT leaving").select("conv_id", "depth", "leaves", "saved")
    levels = placed.repartition("shard").sortWithinPartitions("shard", "depth", "conv_id")
    exits = levels.mapInArrow(_exits, "shard int, conv_id long, depth long, parent_conv_id long, parent_depth long")
    upper = materialize(outside.join(exits, ["conv_id", "depth"]), "upper")
    # the parents outside are a smaller tree; as leaves are none of them, it ends
    solved = subtree_totals(upper.drop("shard"), shard_nodes, room, 1)
    entering = solved.join(upper.select("conv_id", "depth", "shard"), ["conv_id", "depth"])
    entering = entering.withColumns({"parent_conv_id": F.lit(None).cast("long"), "parent_depth": F.lit(None).cast("long"), "entering": F.lit(True)})
    return _swept(placed.unionByName(entering), room).filter("NOT leaving").select("conv_id", "depth", "leaves", "saved")


def prefix_trie(conversations: tuple[DataFrame, DataFrame], block: int = BLOCK, shard_nodes: int = SHARD_NODES, room: int = QUEUE, least_shards: int = 4) -> DataFrame:
    """One row per node of the trie over what rebuilt() returns: conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, turns = conversations
    convs = materialize(convs, "convs")
    nodes = materialize(trie_nodes(convs, keyed(turns, block)), "trie")
    tree = nodes.select(
        "conv_id", "depth", "parent_conv_id", (F.col("depth") - 1).alias("parent_depth"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    totals = subtree_totals(tree, shard_nodes, room, least_shards).select("conv_id", "depth", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    return nodes.join(totals, ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
