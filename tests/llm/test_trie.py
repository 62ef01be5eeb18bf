"""The conversation trie against a dictionary."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tracelight.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, key string, part int, own int"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    full = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c / abs(c)) * (abs(c) % 20) if c else 0
        full[c] = own.get(base, [])[:h] + t[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[tuple(full[c][:d])].append(c)
        ends[tuple(full[c])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        saved[p] += (len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        leaves[p] = leaves[p] or 1
        if p:
            kids[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


def run(spark, rows, range_turns=C.RANGE_TURNS, **sizes):
    df = spark.createDataFrame([(*r, "k", 1, 1) for r in rows], SCHEMA)
    return sorted(tuple(r[f] for f in FIELDS) for r in C.prefix_trie(C.rebuilt(df, range_turns), **sizes).collect())


def made(seed, convs, words="a b", hot=0):
    dice = random.Random(seed)
    rows = [(c, t, dice.choice(["user", "assistant", None]), dice.choice([words, "x", "", None, "y z é"])) for c in range(-45, convs) if c % 7 for t in range(dice.choice([0, 1, 2, 3, 5, 9]))]
    return rows + [(40, t, "user", "x") for t in range(hot)] + [(41, t, "user", "x") for t in range(hot - 1)]


ODD = [(0, 0, "user", "a"), (0, 0, "user", "a"), (0, 0, "user", "b"), (0, None, None, None), (0, 1, "b", "a"), (0, 1, "a", "b"), (1, 2, "", "c"), (None, 1, "user", "a"), (-3, 0, "user", "a" * 300_000), (25, 1, "u", "ser:x"), (26, 1, "us", "er:x"), (20, 5, None, " "), (27, 1, "u", "q"), (28, 1, "u", "q")]


def test_odd_rows(spark):
    assert run(spark, ODD) == brute(ODD)
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "a", "b")]) == []
    assert run(spark, [(3, 0, "user", "a")]) == brute([(3, 0, "user", "a")])


@pytest.mark.parametrize("sizes", [{}, {"range_turns": 40, "block": 3, "shard_nodes": 12, "room": 2}])
def test_small_shards_spilling_queues_and_a_hot_conversation(spark, sizes):
    rows = made(5, 90, hot=150)
    assert run(spark, rows, **sizes) == brute(rows)


def test_subtree_totals_over_many_levels_of_shards(spark):
    """Nodes whose parents lie anywhere before them."""
    dice = random.Random(3)
    tree, depth = [(0, 0, None, None, 0, 1)], {0: 0}
    for c in range(1, 300):
        up = dice.randrange(max(0, c - 40), c) if c % 3 else dice.randrange(c)
        depth[c] = depth[up] + 1
        tree.append((c, depth[c], up, depth[up], c % 2, c))
    total = {r[0]: [r[4], r[5]] for r in tree}
    for c, _, up, *_ in reversed(tree[1:]):
        total[up] = [a + b for a, b in zip(total[up], total[c], strict=True)]
    df = spark.createDataFrame(tree, "conv_id long, depth long, parent_conv_id long, parent_depth long, leaves long, saved long")
    got = C.subtree_totals(df, shard_nodes=20, room=3).collect()
    assert {r.conv_id: [r.leaves, r.saved] for r in got} == total and len(got) == 300


def test_the_queue_gives_back_what_it_spilled():
    dice, queue = random.Random(1), C.SpillingQueue(5)
    sent = [(dice.randrange(9), dice.randrange(9), i, -i) for i in range(200)]
    for m in sent:
        queue.push(*m)
    assert queue.spilled > 10
    got = []
    while queue.head() is not None:
        got.append(queue.pop())
    assert got == sorted((-level, *rest) for level, *rest in sent)
