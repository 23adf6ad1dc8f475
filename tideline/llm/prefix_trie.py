"""Prefix trie of conversations by partition refinement.

All conversations begin in one class.  In every round the active classes are split by their members'
next turn; a class whose members are all alike (one conversation, or copies of one) retires, and its tail
is emitted as a chain of only children without further rounds.  The levels are then folded back, deepest
first, into leaves and saved bytes per node.  A node is named by its smallest member and its depth.

Turns travel as 128-bit digests with their text's length, never as texts.  There are as many rounds as the
longest prefix that different conversations share, each a join on the conversation (unique) and a sum per
class with partial aggregation; conversations of any length are cut into chunks of turns for numbering.

Cases: a null role or text is an empty one; a null turn comes first, and turns of equal number are ordered
by role, then by the text's SHA-256, so repeated rows are turns each; rows with a null conversation take no
part; a conversation without rebuilt turns ends at the root; an empty table has no nodes; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scans import running_sums
from .shared import materialize

#: Turn numbers, or places in a conversation, that one window holds.
CHUNK = 4096
PIECE = 1 << 15
NO_ENDS = sha256(b"").hexdigest()


def _digest(*parts: Column) -> Column:
    """First 128 bits of the SHA-256 of the parts with their lengths."""
    named = [x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]
    return F.unhex(F.substring(F.sha2(F.concat(*named), 256), 1, 32))


def turn_digests(table: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, pos, turn_id, bytes``: every turn's place in its conversation, from 1."""
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    rows = table.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), who.alias("role"), _digest(said).alias("text_id"), _digest(who, said).alias("turn_id"), F.octet_length(said).cast("long").alias("bytes")
    )
    by = [F.asc_nulls_first("turn"), F.col("role"), F.col("text_id")]
    placed = running_sums(rows, {"pos": F.lit(1).cast("long")}, key=["conv"], chunk=F.floor(F.col("turn") / CHUNK), by=by)
    return placed.select("conv", "pos", "turn_id", "bytes")


def rebuilt(turns: DataFrame, *, group: int = 5, heads: int = 9) -> DataFrame:
    """``conv, depth, turn_id, bytes`` after rebuilding: the first h turns of the group's first conversation, then the own ones after the first h.

    h is the CRC-32 of the conversation's number modulo ``heads``.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("size"))
    convs = sizes.select("conv", (F.col("conv") - F.col("conv") % group).alias("base"), h.alias("h"))
    head = F.least(F.col("h"), F.coalesce("base_size", F.lit(0)))
    convs = convs.join(sizes.select(F.col("conv").alias("base"), F.col("size").alias("base_size")), "base", "left").select("conv", "base", head.alias("head"))
    first = turns.filter(F.col("pos") < heads).withColumnRenamed("conv", "base").join(convs, "base").filter("pos <= head")
    own = turns.filter(F.col("pos") > h).join(convs, "conv")
    kept = own.select("conv", (F.col("pos") - h + F.col("head")).alias("depth"), "turn_id", "bytes")
    return first.select("conv", F.col("pos").alias("depth"), "turn_id", "bytes").unionByName(kept)


def _states(table: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns with ``rest`` (bytes from the turn to the end), and the first class: all conversations."""
    built = rebuilt(turns)
    built = running_sums(built, {"so_far": F.col("bytes")}, key=["conv"], chunk=F.floor(F.col("depth") / CHUNK), by=[F.col("depth")])
    built = materialize(built.repartitionByRange("depth", "conv").sortWithinPartitions("depth", "conv"), "trie-turns")
    whole = F.struct(*(F.bit_xor(F.xxhash64("depth", "turn_id", F.lit(k))).alias(f"w{k}") for k in (1, 2)))
    totals = built.groupBy("conv").agg(F.max("depth").alias("size"), F.sum("bytes").alias("rest"), whole.alias("whole"))
    names = table.select(F.col("conv").alias("conv")).distinct().join(totals, "conv", "left")
    names = names.select("conv", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "rest")), F.coalesce("whole", F.struct(F.lit(0).cast("long").alias("w1"), F.lit(0).cast("long").alias("w2"))).alias("whole"))
    return built, materialize(names, "trie-conversations")


_STATE = ["conv", "size", "whole", "parent", "cls", "n", "alike", "bytes", "rest", "total"]


def _grouped(members: DataFrame, by: list[str]) -> DataFrame:
    """The members with their class: its smallest member, its number of members, and whether they are all alike."""
    found = [F.min("conv").alias("cls"), F.count("*").alias("n"), (F.min("whole") == F.max("whole")).alias("alike")]
    if not by:
        top = members.agg(*found)
        return members.join(F.broadcast(top), F.lit(True))  # one row
    return members.join(members.groupBy(*by).agg(*found), by)


def refine(built: DataFrame, names: DataFrame) -> list[DataFrame]:
    """The members of the active classes and of those that retire, one table for each depth."""
    none = F.lit(None).cast("long")
    first = names.select("conv", "size", "whole", none.alias("parent"), F.lit(0).cast("long").alias("bytes"), "rest", F.col("rest").alias("total"))
    levels = [materialize(_grouped(first, []).select(*_STATE), "trie-level")]
    while levels[-1].filter("not alike").take(1):
        depth = len(levels)
        active = levels[-1].filter(f"not alike and size >= {depth}").select("conv", "size", "whole", F.col("cls").alias("parent"), "total")
        turn = built.filter(F.col("depth") == depth).select("conv", "turn_id", "bytes", (F.col("bytes") - F.col("so_far")).alias("before"))
        split = _grouped(active.join(turn, "conv").withColumn("rest", F.col("total") + F.col("before")), ["parent", "turn_id"])
        levels.append(materialize(split.select(*_STATE), "trie-level"))
    return levels


def folded(levels: list[DataFrame]) -> list[DataFrame]:
    """Nodes of every level with children, leaves and saved bytes, deepest level first."""
    out: list[DataFrame] = []
    for depth in range(len(levels) - 1, -1, -1):
        nodes = levels[depth].filter("conv = cls").withColumn("depth", F.lit(depth).cast("long"))
        single = F.col("alike")
        plain = ["conv", "depth", "parent", "n", "size", "alike"]
        if out:
            sums = out[-1].groupBy(F.col("parent").alias("conv")).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            nodes = nodes.join(sums, "conv", "left")
        else:
            nodes = nodes.select("*", *(F.lit(None).cast("long").alias(c) for c in ("children", "leaves", "saved")))
        found = nodes.select(
            *plain,
            F.when(single, (F.col("size") > depth).cast("long")).otherwise(F.col("children")).alias("children"),
            F.when(single, F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("leaves"),
            F.when(single, (F.col("n") - 1) * F.col("rest")).otherwise(F.col("saved") + (F.col("n") - 1) * F.col("bytes")).alias("saved"),
        )
        out.append(materialize(found, "trie-fold") if depth + 1 < len(levels) else found)
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted members of a node as comma-joined texts of bounded size."""
    at, held = None, []

    def piece() -> pa.RecordBatch:
        return pa.record_batch([pa.array([x], t) for x, t in ((at[0], pa.int64()), (at[1], pa.int64()), (held[0], pa.int64()), (",".join(map(str, held)), pa.string()))], ["cls", "depth", "first", "members"])

    for batch in batches:
        for node in zip(*(batch.column(c).to_pylist() for c in ("cls", "depth", "conv"))):
            if held and (node[:2] != at or len(held) == PIECE):
                yield piece()
                held = []
            at = node[:2]
            held.append(node[2])
    if held:
        yield piece()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of every node's pieces in order, one piece in memory at a time."""
    at, running = None, None
    for batch in batches:
        done = []
        for cls, depth, members in zip(*(batch.column(c).to_pylist() for c in ("cls", "depth", "members"))):
            if (cls, depth) != at:
                if at:
                    done.append((*at, running.hexdigest()))
                at, running = (cls, depth), sha256(members.encode())
            else:
                running.update(b"," + members.encode())
        if done:
            yield pa.record_batch([pa.array(x) for x in zip(*done)], ["conv", "depth", "ends"])
    if at:
        yield pa.record_batch([pa.array([x]) for x in (*at, running.hexdigest())], ["conv", "depth", "ends"])


def ends_hashes(ends: DataFrame) -> DataFrame:
    """``conv, depth, ends`` of nodes in which several conversations end: the hash reads their numbers in order.

    A range sort cuts a node's members into pieces wherever they lie; only pieces meet by node.
    """
    by = ["cls", "depth", "conv"]
    pieces = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_pieces, "cls long, depth long, first long, members string")
    return pieces.repartition("cls", "depth").sortWithinPartitions("cls", "depth", "first").select("cls", "depth", "members").mapInArrow(_hashes, "conv long, depth long, ends string")


def prefix_trie(table: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every node of the trie: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    turns = materialize(turn_digests(table, conv=conv, turn=turn, role=role, text=text), "trie-digests")
    built, names = _states(turns, turns)
    levels = refine(built, names)
    nodes = folded(levels)
    inner = nodes[0]
    for level in nodes[1:]:
        inner = inner.unionByName(level)
    tops = inner.filter("alike and size > depth").select("conv", F.col("depth").alias("at"), "n", "size")
    rest = (F.col("n") - 1) * (F.col("total") + F.col("bytes") - F.col("so_far"))
    chains = built.join(tops.join(names.select("conv", F.col("rest").alias("total")), "conv"), "conv").filter("depth > at")
    chains = chains.select("conv", "depth", F.col("conv").alias("parent"), "n", "size", F.lit(True).alias("alike"), (F.col("depth") < F.col("size")).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"), rest.alias("saved"))
    every = inner.unionByName(chains)
    ended = None
    for depth, level in enumerate(levels):
        here = level.filter(f"n > 1 and (alike or size = {depth})").select("cls", F.when(F.col("alike"), F.col("size")).otherwise(depth).cast("long").alias("depth"), "conv")
        ended = here if ended is None else ended.unionByName(here)
    # only nodes where a conversation may end look for a hash
    may = (F.col("n") > 1) & (~F.col("alike") | (F.col("depth") == F.col("size")))
    alone = F.when((F.col("n") == 1) & (F.col("depth") == F.col("size")), F.sha2(F.col("conv").cast("string"), 256)).otherwise(NO_ENDS)
    shared = every.filter(may).join(ends_hashes(ended), ["conv", "depth"], "left").withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS)))
    all_nodes = every.filter(~may).withColumn("ends", alone).unionByName(shared)
    names_out = {"conv": "conv_id", "depth": "depth", "parent": "parent_conv_id", "n": "n_convs", "children": "n_children", "leaves": "n_leaves", "saved": "saved_tokens", "ends": "ends_sha256"}
    return all_nodes.select(*(F.col(a).alias(b) for a, b in names_out.items()))
