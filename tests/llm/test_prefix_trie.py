"""The trie against a plain dictionary of prefixes."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tideline.llm.prefix_trie import prefix_trie, turn_digests
from tideline.operators.scans import running_sums

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role or "", sha256((text or "").encode()).digest(), text or ""))
    said = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in turns.items()}
    built = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(said.get(c - c % 5, [])[:h] + said[c][h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        stack, leaves, saved = [node], 0, 0
        while stack:
            x = stack.pop()
            leaves += not children[x]
            saved += (len(members[x]) - 1) * len(x[-1][1].encode()) if x else 0
            stack += children[x]
        return leaves, saved

    out = set()
    for node, who in members.items():
        leaves, saved = below(node)
        ends = ",".join(str(c) for c in sorted(who) if built[c] == node)
        out.add((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves, saved, sha256(ends.encode()).hexdigest()))
    return out


def same(spark, rows, **more):
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(v).alias(k) for k, v in more.items()))).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == plain(rows)


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = []
    for c in rng.sample(range(200), 60):
        for turn in range(rng.choice([0, 1, 2, 4, 9, 12])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), "é" * rng.choice([1, 2])))
    same(spark, rows)


def test_edges(spark):
    """Copies, nulls, ties, repeated rows, a lone conversation, turnless rebuilt ones, a long text, clashing names."""
    copies = [(c, t, "user", f"t{t}") for c in (10, 25, 40, 41, 7) for t in range(14)]
    odd = [(1, None, None, None), (1, None, "user", "a"), (1, 3, "user", "a"), (1, 3, "user", "a"), (1, 3, "assistant", "b"), (None, 1, "user", "x"), (2, 5, "user", "x" * 100_000), (3, 0, "user", "")]
    same(spark, copies + odd, depth=1, cls=2, n=3, pos=4)
    same(spark, [(4, 0, "user", "a"), (4, 1, "user", "b")])
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_all_copies_take_one_round(spark):
    same(spark, [(c, t, "user", f"t{t}") for c in (0, 5, 10) for t in range(40)])


@pytest.mark.parametrize("width", [1, 3, 100])
def test_running_sums_over_chunks(spark, width):
    rows = [(k, i, i % 5) for k in ("a", None) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = running_sums(df, {"s": F.col("v")}, key=["k"], chunk=F.floor(F.col("i") / width), by=[F.col("i")]).collect()
    assert len(got) == 100 and all(r.s == sum(x % 5 for x in range(r.i + 1)) for r in got)


def test_places_over_chunks(spark):
    """A conversation longer than a chunk."""
    df = spark.range(10_000).select(F.lit(1).alias("conv_id"), (9_999 - F.col("id")).alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    got = turn_digests(df)
    assert got.agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first()[:] == (1, 10_000, 10_000)
