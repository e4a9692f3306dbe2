"""Prefix trie of conversations: which beginnings are shared, by how many, and what sharing them saves.

A turn is known by a 128-bit digest of its role and text, a conversation by the array of its turns. The arrays are range-sorted over
the whole cluster, so that conversations with a common beginning stand together; one sweep over the sorted arrays keeps a stack of
the open nodes, of which the longest common prefix (LCP) of two neighbours tells how many stay open. A node that closes within a range
is complete. What a range begins or ends with may go on in the next: these stacks are written as pieces, at most two a level
and range, and pieces of the same node are put together by joins and sums; conversations that end in one keep their order by range.

No row grows with a conversation: an array is cut into blocks of ``block`` turns, and a block is sorted beneath the digest of all
blocks before it, so it hangs below the node where the block before it ends. Sums of deeper blocks are added to the blocks above by
one join, whatever the depth. Numbering turns is a range sort as well, so one conversation may hold any share of all rows.

Stated sizes: a sweep holds the stack, at most ``pending`` closed children a node and ``chunk`` bytes of identifiers a node; a node with
more becomes a piece. The driver sees one row a range. The prefix digests of one conversation's blocks are one window
(a row for every ``block`` turns). The digest of a node's own conversations reads their identifiers in order, as it is defined, by
one task a node, as a stream of strings of ``chunk`` bytes.

Defined cases: rows without a ``conv_id`` belong to no conversation and are left out; null turns come first; rows of a conversation with
the same turn are ordered by their digest, equal rows all count; a null role or text is the empty one; no rows, no nodes (not even
the root). Columns besides the four named ones are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwarden.llm.common import cut, prepare

BLOCK = 64
PENDING = 50_000
CHUNK = 1 << 16
SALT = 4096
NOTHING = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- turns


def numbered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, at, key, chars): the turns of every conversation, numbered from 0; ``key`` is the digest, ``chars`` the text's code points."""
    spark = prepare(conversations.sparkSession)
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said), 256), 1, 32))
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("key"), F.char_length(said).cast("long").alias("chars"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for b in batches:
            conv = b["conv_id"].to_numpy()
            if not len(conv):
                continue
            first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            at = np.arange(len(conv)) - np.repeat(first, np.diff(np.r_[first, len(conv)]))
            if conv[0] == last:
                at[: first[1] if len(first) > 1 else None] += count
            last, count = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part)), b["conv_id"], pa.array(at), b["key"], b["chars"]], ["part", "conv_id", "at", "key", "chars"])

    sorted_rows = cut(rows, "turn-keys").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(sorted_rows.mapInArrow(number, "part long, conv_id long, at long, key binary, chars long"), "turns")
    # A conversation that began in an earlier range goes on counting: one row a range.
    before, open_conv, count = [], None, 0
    for r in sorted(placed.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "at")).alias("tail")).collect()):
        held = count if r.first == open_conv else 0
        if held:
            before.append((r.part, r.first, held))
        open_conv, count = r.tail.conv_id, r.tail.at + 1 + (held if r.tail.conv_id == r.first else 0)
    if not before:
        return placed.drop("part")
    on = F.broadcast(spark.createDataFrame(before, "part long, conv_id long, before long"))
    return placed.join(on, ["part", "conv_id"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), "key", "chars")


def with_heads(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """``numbered`` turns with each conversation's first h replaced by the first h of conversation c - c % ``group``; h is crc32(c) % ``most``.

    A conversation without turns is a row whose ``at``, ``key`` and ``chars`` are null; others have such rows besides.
    """
    c = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.max("at").alias("last"))
    heads = turns.where((F.col("at") < most - 1) & (c % group == 0)).groupBy(c.alias("leader")).agg(F.sort_array(F.collect_list(F.struct("at", "key", "chars"))).alias("head"))
    h = F.crc32(c.cast("string")) % most
    info = sizes.select("conv_id", "last", h.alias("h"), (c - c % group).alias("leader")).join(heads, "leader", "left")
    info = info.select("conv_id", "last", "h", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int")).alias("head"))
    borrowed = info.select("conv_id", F.explode_outer("head").alias("x")).select("conv_id", "x.at", "x.key", "x.chars")
    salt = lambda x: F.floor(x / SALT)
    spread = info.select("conv_id", "h", F.size("head").alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), salt(F.col("last")))).alias("salt"))
    own = turns.withColumn("salt", salt(F.col("at"))).join(spread, ["conv_id", "salt"]).where(F.col("at") >= F.col("h"))
    return borrowed.unionByName(own.select("conv_id", (F.col("at") - F.col("h") + F.col("m")).alias("at"), "key", "chars"))


# ---------------------------------------------------------------- the sweep

_FIELDS = "part long, node binary, path array<binary>, parent binary, seq long, blob binary, k long, d1 long, d2 long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, chars long, goes_on boolean, n1 long, n2 long, ends string"
_ARROW = {"binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
_SCHEMA = pa.schema([(f.rsplit(" ", 1)[0], _ARROW[f.rsplit(" ", 1)[1]]) for f in _FIELDS.split(", ")])
_NAMES = _SCHEMA.names


class Node:
    """An open node: what its closed children and its own conversations have given so far."""

    __slots__ = ("depth", "key", "chars", "piece", "id", "conv", "n", "children", "below", "leaves", "saved", "goes_on", "next", "waiting", "ends", "seq")

    def __init__(self, depth: int, key: bytes, chars: int, piece: bool):
        self.depth, self.key, self.chars, self.piece, self.id = depth, key, chars, piece, None
        self.conv, self.n, self.children, self.below, self.leaves, self.saved = None, 0, 0, 0, 0, 0
        self.goes_on, self.next, self.waiting, self.ends, self.seq = False, (None, None), [], bytearray(), 0


class Sweep:
    """The stack over one range of sorted blocks. ``out`` gathers rows of ``_FIELDS``."""

    def __init__(self, part: int, pending: int, chunk: int):
        self.part, self.pending, self.chunk = part, pending, chunk
        self.stack: list[Node] = []
        self.trie, self.keys, self.out, self.first = None, [], [], True

    def ids(self, upto: int) -> list[bytes]:
        """Identities of the open nodes down to level ``upto``: chained digests."""
        last = "{}:{}:{}".format(*self.trie).encode()
        for x in self.stack[: upto + 1]:
            if x.id is None:
                x.id = hashlib.sha256(last + x.key).digest()[:16]
            last = x.id
        return [x.id for x in self.stack[: upto + 1]]

    def split(self, level: int) -> None:
        """The open nodes down to ``level`` become pieces, and what waits for them goes out."""
        for x, id in zip(self.stack, self.ids(level)):
            x.piece = True
            for row in x.waiting:
                self.out.append({**row, "parent": id})
            x.waiting = []
            if len(x.ends) > self.chunk:
                self.spill(x)

    def spill(self, x: Node) -> None:
        self.out.append({"part": self.part, "node": x.id, "seq": x.seq, "blob": bytes(x.ends)})
        x.ends, x.seq = bytearray(), x.seq + 1

    def close(self) -> None:
        level = len(self.stack) - 1
        x = self.stack[level]
        row = {"part": self.part, "k": self.trie[0], "d1": self.trie[1], "d2": self.trie[2], "depth": x.depth, "conv_id": x.conv, "n_convs": x.n, "goes_on": x.goes_on, "n1": x.next[0], "n2": x.next[1]}
        up = self.stack[level - 1] if level else None
        if x.piece:
            path = self.ids(level)
            if x.waiting:
                self.split(level)
            if x.ends:
                self.spill(x)
            self.out.append({**row, "node": path[-1], "path": path[:-1], "n_children": x.children + x.below, "n_leaves": x.leaves, "saved": x.saved, "chars": x.chars})
        else:
            leaves = x.leaves + (not x.children and not x.goes_on)
            saved = x.saved + (x.n - 1) * x.chars
            for w in x.waiting:
                self.out.append({**w, "parent_conv_id": x.conv})
            row |= {"n_children": x.children + x.below, "n_leaves": leaves, "saved": saved, "ends": hashlib.sha256(x.ends).hexdigest()}
            if up is None:
                self.out.append(row)
            else:
                up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
                if up.piece:
                    self.out.append({**row, "parent": self.ids(level - 1)[-1]})
                else:
                    up.waiting.append(row)
                    if len(up.waiting) > self.pending:
                        self.split(level - 1)
        if up is not None:
            up.n += x.n
            up.conv = x.conv if up.conv is None else min(up.conv, x.conv)
        self.stack.pop()

    def take(self, trie: tuple, conv: int, keys: list[bytes], chars: list[int], goes_on: bool, after: tuple, below: tuple) -> None:
        same = 0
        if trie != self.trie:
            while self.stack:
                self.close()
            self.trie = trie
            self.stack.append(Node(0, b"", 0, self.first))
        else:
            for a, b in zip(self.keys, keys):
                if a != b:
                    break
                same += 1
            while len(self.stack) > same + 1:
                self.close()
        for d in range(same, len(keys)):
            self.stack.append(Node(d + 1, keys[d], chars[d], self.first))
        self.keys, self.first = keys, False
        x = self.stack[-1]
        x.n += 1
        x.conv = conv if x.conv is None else min(x.conv, conv)
        if goes_on:
            x.goes_on, x.next = True, after
            x.below, x.leaves, x.saved = x.below + below[0], x.leaves + below[1], x.saved + below[2]
        else:
            x.ends += b",%d" % conv if x.ends else b"%d" % conv
            if len(x.ends) > self.chunk:
                self.split(len(self.stack) - 1)

    def end(self) -> None:
        if self.stack:
            self.split(len(self.stack) - 1)
            while self.stack:
                self.close()

    def batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _SCHEMA.field(c).type) for c in _NAMES], schema=_SCHEMA)


def swept(rows: DataFrame, pending: int, chunk: int, name: str) -> DataFrame:
    """Blocks (k, d1, d2, keys, chars, conv_id, goes_on, n1, n2, b_children, b_leaves, b_saved), sorted and swept once."""
    order = ["k", "d1", "d2", "keys", "conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(TaskContext.get().partitionId(), pending, chunk)
        for b in batches:
            for k, d1, d2, keys, conv, chars, on, n1, n2, c, v, s in zip(*(b[x].to_pylist() for x in (*order, "chars", "goes_on", "n1", "n2", "b_children", "b_leaves", "b_saved")), strict=True):
                sweep.take((k, d1, d2), conv, keys, chars, on, (n1, n2), (c, v, s))
                if len(sweep.out) > 20_000:
                    yield sweep.batch()
        sweep.end()
        yield sweep.batch()

    return cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _FIELDS), name)


def hashed_ends(blobs: DataFrame) -> DataFrame:
    """(node, ends): the digest of each node's identifiers, read as a stream in the order of ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for b in batches:
            done = []
            for own, blob in zip(b["node"].to_pylist(), b["blob"].to_pylist(), strict=True):
                if own != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = own, hashlib.sha256(blob)
                else:
                    digest.update(b"," + blob)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["node", "ends"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends"])

    return blobs.select("node", "part", "seq", "blob").repartition("node").sortWithinPartitions("node", "part", "seq").mapInArrow(run, "node binary, ends string")


NODE = ["k", "d1", "d2", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "goes_on", "n1", "n2", "ends"]


def stitched(found: DataFrame, name: str) -> DataFrame:
    """All nodes of a sweep: complete ones, and pieces put together across ranges."""
    pieces = found.where(F.col("node").isNotNull() & F.col("blob").isNull())
    same = [F.first(c).alias(c) for c in ("path", "k", "d1", "d2", "depth", "chars")]
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    nodes = cut(pieces.groupBy("node").agg(*same, *sums, F.min("conv_id").alias("conv_id"), F.bool_or("goes_on").alias("goes_on"), F.max("n1").alias("n1"), F.max("n2").alias("n2")), f"{name}-pieces")
    up = F.try_element_at("path", F.lit(-1))
    on_path = nodes.where(F.size("path") > 0).withColumn("up", up)
    children = on_path.groupBy(F.col("up").alias("node")).agg(F.count("*").alias("pieces"))
    own = nodes.join(children, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("pieces", F.lit(0)))
    leaf = ((F.col("n_children") == 0) & ~F.col("goes_on")).cast("long")
    gives = own.select("node", "path", (F.col("n_leaves") + leaf).alias("n_leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    subtree = gives.select(F.explode(F.concat("path", F.array("node"))).alias("node"), "n_leaves", "saved").groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    above = nodes.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    ends = hashed_ends(found.where(F.col("blob").isNotNull()))
    whole = own.drop("n_leaves", "saved").join(subtree, "node").withColumn("up", up).join(above, "up", "left").join(ends, "node", "left").withColumn("ends", F.coalesce("ends", F.lit(NOTHING)))
    complete = found.where(F.col("node").isNull())
    # A range's complete nodes meet their open parents by range and identity, so no parent is one task.
    parents = pieces.select("node", "part").join(nodes.select("node", F.col("conv_id").alias("above")), "node").withColumnRenamed("node", "parent")
    hanging = complete.where(F.col("parent").isNotNull()).join(parents, ["part", "parent"]).withColumn("parent_conv_id", F.col("above"))
    return complete.where(F.col("parent").isNull()).select(NODE).unionByName(hanging.select(NODE)).unionByName(whole.select(NODE))


def trie(turns: DataFrame, block: int = BLOCK, pending: int = PENDING, chunk: int = CHUNK) -> DataFrame:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of turns (conv_id, at, key, chars).

    ``conv_id`` is the smallest member: the node's last turn is number ``depth`` - 1 of that conversation (``node_turns``). Rows without a
    ``key`` stand for a conversation that may have no turns.
    """
    prepare(turns.sparkSession)
    place = F.floor(F.coalesce("at", F.lit(0)) / block)
    kept = F.when(F.col("key").isNotNull(), F.struct("at", "key", "chars"))
    rows = turns.groupBy("conv_id", place.alias("k")).agg(F.sort_array(F.collect_list(kept)).alias("x"))
    blocks = cut(rows.select("conv_id", "k", F.col("x.key").alias("keys"), F.col("x.chars").alias("chars")), "blocks")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    short = (F.col("k") == 0) & (F.size("keys") < block)
    plain = blocks.where(short).select("*", zero.alias("d1"), zero.alias("d2"), F.lit(False).alias("goes_on"), none.alias("n1"), none.alias("n2"), *(zero.alias(f"b_{c}") for c in ("children", "leaves", "saved")))
    long = blocks.where(~short)
    if long.isEmpty():
        return finished(stitched(swept(plain, pending, chunk, "sweep"), "sweep"), block)
    order = Window.partitionBy("conv_id").orderBy("k")
    before, through = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    hashes = long.select("conv_id", "k", *(F.xxhash64(F.lit(s), "k", "keys").alias(f"h{s}") for s in (1, 2)))
    chain = hashes.select(
        "conv_id", "k", F.lead("k").over(order).isNotNull().alias("goes_on"),
        *(F.coalesce(F.bit_xor(f"h{s}").over(before), zero).alias(f"d{s}") for s in (1, 2)),
        *(F.bit_xor(f"h{s}").over(through).alias(f"n{s}") for s in (1, 2)),
    )
    chain = cut(chain.select("conv_id", "k", "d1", "d2", "goes_on", *(F.when(F.col("goes_on"), F.col(f"n{s}")).alias(f"n{s}") for s in (1, 2))), "block-chain")
    deep = long.join(chain, ["conv_id", "k"])
    empty = [zero.alias(f"b_{c}") for c in ("children", "leaves", "saved")]
    tops = cut(stitched(swept(deep.where("k > 0").select("*", *empty), pending, chunk, "deep"), "deep").where("depth = 0"), "deep-tries")
    # What a block's trie holds counts for the node that it hangs below and for those above, on the path of one member.
    steps = tops.where("n_leaves > 0 OR saved > 0").select("conv_id", F.col("k").alias("at"), "n_leaves", "saved", F.explode(F.sequence(zero, F.floor(F.col("k") / SALT))).alias("salt"))
    paths = chain.where("k > 0").select("conv_id", "k", "d1", "d2", F.floor(F.col("k") / SALT).alias("salt"))
    below = steps.join(paths, ["conv_id", "salt"]).where(F.col("k") <= F.col("at")).groupBy("k", "d1", "d2").agg(F.sum("n_leaves").alias("b_leaves"), F.sum("saved").alias("b_saved"))
    hung = tops.select("k", "d1", "d2", "conv_id", F.col("n_children").alias("b_children")).join(below, ["k", "d1", "d2"]).select("conv_id", (F.col("k") - 1).alias("k"), "b_children", "b_leaves", "b_saved")
    deep = deep.join(hung, ["conv_id", "k"], "left").na.fill(0, ["b_children", "b_leaves", "b_saved"])
    nodes = cut(stitched(swept(plain.unionByName(deep), pending, chunk, "sweep"), "sweep"), "nodes")
    # A block's first turn hangs below the last one of the block before.
    tails = nodes.where("goes_on").select((F.col("k") + 1).alias("k"), F.col("n1").alias("d1"), F.col("n2").alias("d2"), F.col("conv_id").alias("above"))
    tops_only = (F.col("k") > 0) & (F.col("depth") == 1)
    joined = nodes.where(tops_only).join(tails, ["k", "d1", "d2"]).withColumn("parent_conv_id", F.col("above"))
    return finished(nodes.where(~tops_only & ~((F.col("k") > 0) & (F.col("depth") == 0))).select(NODE).unionByName(joined.select(NODE)), block)


def finished(nodes: DataFrame, block: int) -> DataFrame:
    depth = F.col("k") * block + F.col("depth")
    return nodes.select("conv_id", depth.alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", **sizes: int) -> DataFrame:
    """The trie of the conversations as they are."""
    return trie(numbered(conversations, conv, turn, role, text), **sizes)


def node_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with ``key`` and ``chars`` of their last turn, from the ``turns`` that the trie was built of."""
    own = turns.where(F.col("key").isNotNull()).select("conv_id", (F.col("at") + 1).alias("depth"), "key", "chars")
    return nodes.join(own, ["conv_id", "depth"], "left")
