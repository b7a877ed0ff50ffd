"""Trie of conversation prefixes, out of adaptive radix trees over turn ids.

A turn's id is WIDTH bytes of a hash of its role and text, big-endian, so a conversation is a string
of fixed-width ids and a prefix of d turns is its first WIDTH d bytes. Equal strings become one row
with a count; the distinct strings are dealt by range, which cuts below turns that very many
conversations begin with, and each task builds trees of at most MOST_KEYS strings of its range.

A tree's nodes hold 4, 16, 48 or 256 children and change their layout as they fill; bytes without a
branch are compressed into the node below. A walk gives a row at turn-aligned depths only: a
compressed path gives one for each turn that ends in it, a branch inside an id gives none.

A prefix is owned by the tree with the least string that begins with it. Strings are in order, so a
tree knows what it owns from the bytes that its first string shares with the string before it, and
whether its last string is continued from the one behind it. Everything counted for a prefix is then
a sum over the trees that hold it: rows of prefixes that several trees may hold (on the way to a
tree's first or last string) are added up, all others are final.

Conversations are rebuilt first: the first turns of a base conversation, then a conversation's own
turns after as many. Only ids and word counts of turns move, never texts; those of one conversation
(20 bytes a turn) meet in one row, as it is one key of the tree. Ids of conversations that end at a
prefix are dealt by range, joined in pieces, and the pieces hashed in order as a stream.

Defined cases: null role and text are empty; c % group is never negative; a null turn comes first; turns with equal numbers are in
the order of their ids; repeated rows are turns of their own; rows without conv_id belong to no
conversation; an empty table gives no rows, not even the root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chat_format import WORD
from .common import durable, partitions

#: Bytes of a turn's id.
WIDTH = 16
#: Strings and bytes of one tree at most (a string longer than that is a tree of its own).
MOST_KEYS, MOST_BYTES = 20_000, 32 << 20
#: Ids in a piece of a list, and rows of a batch.
PIECE, ROWS = 4096, 8192


class Node:
    """An inner node of any layout, with the compressed path that leads to it."""

    __slots__ = ("path", "row", "ends", "n", "least", "layout", "keys", "children")

    def __init__(self, path: bytes, row: int) -> None:
        self.path, self.row, self.ends, self.n, self.least = path, row, False, 0, None
        self.layout, self.keys, self.children = 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.keys.find(byte)
            return self.children[at] if at >= 0 else None
        if self.layout == 48:
            at = self.keys[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def put(self, byte: int, node: Node) -> None:
        """Sets a child, in the next larger layout if this one is full."""
        if self.layout <= 16:
            at = bisect_left(self.keys, byte)
            if at < len(self.keys) and self.keys[at] == byte:
                self.children[at] = node
                return
            if len(self.keys) < self.layout:
                self.keys.insert(at, byte)
                self.children.insert(at, node)
                return
            if self.layout == 4:
                self.layout = 16
            else:
                slots = bytearray(256)
                for k, b in enumerate(self.keys):
                    slots[b] = k + 1
                self.layout, self.keys = 48, slots
            self.put(byte, node)
        elif self.layout == 48:
            if self.keys[byte]:
                self.children[self.keys[byte] - 1] = node
            elif len(self.children) < 48:
                self.children.append(node)
                self.keys[byte] = len(self.children)
            else:
                every = [self.children[s - 1] if s else None for s in self.keys]
                self.layout, self.keys, self.children = 256, bytearray(), every
                self.children[byte] = node
        else:
            self.children[byte] = node

    def ordered(self) -> list[Node]:
        if self.layout == 48:
            return [self.children[s - 1] for s in self.keys if s]
        return [c for c in self.children if c is not None]


def shared_length(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


class Tree:
    """An adaptive radix tree; a string stands for ``n`` conversations with the least id ``least``."""

    def __init__(self) -> None:
        self.root: Node | None = None

    def insert(self, key: bytes, row: int, n: int, least: int) -> None:
        def leaf(path: bytes) -> Node:
            node = Node(path, row)
            node.ends, node.n, node.least = True, n, least
            return node

        if self.root is None:
            self.root = leaf(key)
            return
        node, parent, at = self.root, None, 0
        while True:
            m = len(node.path) if key.startswith(node.path, at) else shared_length(node.path, key[at : at + len(node.path)])
            if m < len(node.path):  # the path is cut in two
                upper = Node(node.path[:m], node.row)
                upper.n, upper.least = node.n, node.least
                upper.put(node.path[m], node)
                node.path = node.path[m + 1 :]
                if parent is None:
                    self.root = upper
                else:
                    parent.put(key[at - 1], upper)
                node = upper
            node.n, node.least = node.n + n, min(node.least, least)
            at += m
            if at == len(key):
                node.ends, node.row = True, row
                return
            below = node.child(key[at])
            if below is None:
                node.put(key[at], leaf(key[at + 1 :]))
                return
            node, parent, at = below, node, at + 1


#: key and parent are hashes of prefixes; saved, leaves and children count what the tree owns.
EMITTED = [
    ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv", pa.int64()), ("parent_conv", pa.int64()), ("n", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()),
    ("saved", pa.int64()), ("ends", pa.string()), ("part", pa.bool_()), ("parent_part", pa.bool_())]
EMITTED_SQL = "key binary, parent binary, depth long, conv long, parent_conv long, n long, children long, leaves long, saved long, ends string, part boolean, parent_part boolean"


def walk(tree: Tree, keys: list[bytes], words: list, ends: list, before: int, after: int) -> Iterator[tuple]:
    """Rows (EMITTED) of the turn-aligned prefixes. keys are in order and distinct; ``before`` bytes of
    the first one also begin the string before it (-1: there is none), ``after`` of the last one the
    string behind it."""
    first, last = keys[0], keys[-1]
    # A step down: node, byte depth of its path, hash state, key, conversation and part of the prefix
    # above, bytes shared with first and last so far. A step up: what is open, with sums from below.
    todo: list[tuple | None] = [(tree.root, 0, hashlib.sha256(), None, None, False, 0, 0)]
    open_nodes: list[list] = []
    while todo:
        step = todo.pop()
        if step is not None:
            node, top, state, parent, parent_conv, parent_part, f, g = step
            key, end = keys[node.row], top + len(node.path)
            start = max(top - 1, 0)  # a branch byte stands before the path
            if f == start:
                f += shared_length(first[start:end], key[start:end])
            if g == start:
                g += shared_length(last[start:end], key[start:end])
            made = []
            for d in range(-(-top // WIDTH) * WIDTH, end + 1, WIDTH):
                if d:
                    state = state.copy()
                    state.update(key[d - WIDTH : d])
                own = d > f or d > before
                part = not own or d <= g and d <= after
                made.append((state.digest()[:WIDTH], parent, d // WIDTH, parent_conv, own, part, parent_part))
                parent, parent_conv, parent_part = made[-1][0], node.least, part
            open_nodes.append([node, end, made, 0, 0, 0])
            todo.append(None)
            todo += [(c, end + 1, state, parent, parent_conv, parent_part, f, g) for c in reversed(node.ordered())]
            continue
        node, end, made, children, leaves, saved = open_nodes.pop()
        if node.ends and not children and not (after == end and keys[node.row] == last):
            leaves += 1
        for key, parent, depth, parent_conv, own, part, parent_part in reversed(made):
            w = words[node.row][depth - 1] if depth else 0
            saved += node.n * w - (w if own else 0)
            yield key, parent, depth, node.least, parent_conv, node.n, children, leaves, saved, ends[node.row] if node.ends and depth * WIDTH == end else None, part, parent_part
            children = int(own)
        if open_nodes:
            for k, v in enumerate((children, leaves, saved)):
                open_nodes[-1][3 + k] += v


def _aligned(a: bytes | None, b: bytes | None) -> int:
    """Bytes of whole ids that two strings share; -1 without one of them."""
    return -1 if a is None or b is None else shared_length(a, b) // WIDTH * WIDTH


def _edges(strings: DataFrame) -> dict[int, tuple[int, int]]:
    """By partition, what its first string shares with the one before and its last with the one behind.

    Two numbers for each partition reach the driver.
    """
    by_place = Window.orderBy("pid")
    each = strings.groupBy("pid").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    near = each.select("pid", "first", "last", F.lag("last").over(by_place).alias("previous"), F.lead("first").over(by_place).alias("next"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pid, first, last, previous, following = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(pid, pa.int32()), pa.array(map(_aligned, first, previous), pa.int64()), pa.array(map(_aligned, last, following), pa.int64())], ["pid", "before", "after"])

    return {r.pid: (r.before, r.after) for r in near.mapInArrow(compare, "pid int, before long, after long").collect()}


def rebuilt(conversations: DataFrame, group: int = 20, shared_turns: int = 4, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, ids (hex), words: each conversation c as the first h turns of c - c % group, then its own
    after as many; h is crc32(c) % shared_turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH).alias("id"),
        F.regexp_count(text, F.lit(WORD)).alias("w")).where("conv_id is not null")
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "w"))).alias("t"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(shared_turns)).cast("int")
    own = durable(own.select("conv_id", F.col("t.id").alias("ids"), F.col("t.w").alias("words"), h.alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(group))).alias("base")))
    first = lambda c: F.slice(c, 1, shared_turns - 1)
    bases = own.where("conv_id = base").select("base", first("ids").alias("base_ids"), first("words").alias("base_words"))

    def joined(c: str):
        head = F.when(F.col(f"base_{c}").isNotNull(), F.slice(f"base_{c}", F.lit(1), F.col("h"))).otherwise(F.slice(c, 1, 0))
        return F.concat(head, F.slice(c, F.col("h") + 1, F.size(c))).alias(c)

    return own.join(bases, "base", "left").select("conv_id", joined("ids"), joined("words"))


def _endings(rows: DataFrame) -> DataFrame:
    """key, ends: hash of the ids (conv_id, ascending, joined by commas) of each key."""
    n = partitions(rows)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        out: list[tuple] = []
        for batch in batches:
            for k, c in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (k != key or len(held) == PIECE):
                    out.append((key, held[0], ",".join(map(str, held))))
                    held = []
                key = k
                held.append(c)
            if len(out) >= ROWS:
                yield _batch(out, [pa.binary(), pa.int64(), pa.string()], ["key", "conv_id", "piece"])
                out = []
        if held:
            out.append((key, held[0], ",".join(map(str, held))))
        if out:
            yield _batch(out, [pa.binary(), pa.int64(), pa.string()], ["key", "conv_id", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for k, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if len(out) >= ROWS:
                yield _batch(out, [pa.binary(), pa.string()], ["key", "ends"])
                out = []
        if state is not None:
            out.append((key, state.hexdigest()))
        if out:
            yield _batch(out, [pa.binary(), pa.string()], ["key", "ends"])

    dealt = rows.select("key", "conv_id").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = dealt.mapInArrow(pieces, "key binary, conv_id long, piece string").repartition(n, "key").sortWithinPartitions("key", "conv_id")
    return parts.select("key", "piece").mapInArrow(digest, "key binary, ends string")


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def prefix_trie(sequences: DataFrame, most_keys: int = MOST_KEYS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: each
    distinct prefix of the sequences (conv_id, ids, words)."""
    key = F.unhex(F.array_join("ids", ""))
    rows = durable(sequences.select("conv_id", key.alias("string"), "words", F.unhex(F.substring(F.sha2(key, 256), 1, 2 * WIDTH)).alias("key")))
    distinct = rows.groupBy("key", "string", "words").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    strings = distinct.join(_endings(rows), "key").select(F.col("string").alias("key"), "words", "n", "least", "ends")
    strings = durable(strings.repartitionByRange(partitions(rows), "key").sortWithinPartitions("key").withColumn("pid", F.spark_partition_id()))
    edges = rows.sparkSession.sparkContext.broadcast(_edges(strings))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = [t for _, t in EMITTED], [n for n, _ in EMITTED]
        held: list[tuple] = []
        out: list[tuple] = []
        size, before, pid = 0, -1, None

        def grown(after: int) -> Iterator[tuple]:
            tree = Tree()
            keys, words, ends = [r[0] for r in held], [r[1] for r in held], [r[4] for r in held]
            for k, (string, _, n, least, _) in enumerate(held):
                tree.insert(string, k, n, least)
            return walk(tree, keys, words, ends, before, after)

        def full(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            for row in rows:
                out.append(row)
                if len(out) == ROWS:
                    yield _batch(out, kinds, names)
                    out.clear()

        for batch in batches:
            for *row, at in zip(*(c.to_pylist() for c in batch.columns)):
                if pid is None:
                    pid, before = at, edges.value[at][0]
                elif len(held) == most_keys or size + len(row[0]) > MOST_BYTES:
                    shared = _aligned(held[-1][0], row[0])
                    yield from full(grown(shared))
                    held, size, before = [], 0, shared
                held.append(row)
                size += len(row[0])
        if held:
            yield from full(grown(edges.value[pid][1]))
        if out:
            yield _batch(out, kinds, names)

    found = durable(strings.select("key", "words", "n", "least", "ends", "pid").mapInArrow(trees, EMITTED_SQL))
    total = lambda c: F.sum(c).alias(c)
    parts = found.where("part").groupBy("key").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv").alias("conv"), *map(total, ["n", "children", "leaves", "saved"]), F.max("ends").alias("ends"), F.bool_or("parent_part").alias("parent_part"), F.min("parent_conv").alias("parent_conv"))
    parts = durable(parts)
    columns = ["parent", "depth", "conv", "parent_conv", "n", "children", "leaves", "saved", "ends"]
    every = found.where("not part").select(*columns, "parent_part").unionByName(parts.select(*columns, "parent_part"))
    known = every.where("not parent_part").select(columns)
    above = parts.select(F.col("key").alias("parent"), F.col("conv").alias("above"))
    joined = every.where("parent_part").drop("parent_conv").join(above, "parent").withColumnRenamed("above", "parent_conv").select(columns)
    return known.unionByName(joined).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, **names) -> DataFrame:
    """The prefix trie of the rebuilt conversations."""
    return prefix_trie(rebuilt(conversations, **names))
