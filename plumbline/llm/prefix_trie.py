"""Prefix trie of conversations: sorted neighbours, union-find over their common prefixes, forests merged across partitions.

A conversation is its sequence of turns; a node is a distinct sequence of the first d turns.

1. *Numbering.* Turns get 128-bit symbols of (role, text) and are dealt by ranges of (conversation, turn, symbol); a place is counted
   inside a partition and shifted by what earlier partitions hold, so that a long conversation spreads over many tasks.
2. *Segments.* ``segment_turns`` symbols of a conversation make a row. Conversations that share a whole segment with others meet again
   in the next one, under the hash of what they share; those that are alone are chains without branches.
3. *Forests.* Segments are sorted by range over (symbols, conversation). Inside a partition the longest common prefixes of sorted
   neighbours are edges; union-find takes them in descending depth, and each merge of components makes the branching node at
   that depth (or widens it). A component's members, children, leaves and savings are final when it is hung on a parent.
4. *Contraction.* Nodes on the path of a partition's first or last conversation may go on in the neighbouring partition. Each of them
   becomes one item: its prefix and the sums of what it holds besides open children. The items of all partitions are sorted and
   go through the same step until one partition is left; there are at most 2 * segment_turns + 1 items per partition.

Deeper segments are done first; the sums of their tops are items of the segment above. Rounds grow with the longest *shared* prefix,
one per ``segment_turns`` turns. Ids that end at a node are joined in order and hashed in pieces, so that thousands of equal
conversations are neither one row nor one list.

Defined cases: null roles and texts are empty; turns with null number come first; equal numbers are ordered by the symbol; repeated
turns count as often as they come; turns of a null conversation belong to no conversation; conversations without turns are
members of the root; texts count whole whatever their length; an empty table gives no rows, not even the root. Other columns are ignored.
Equal sequences are told by 128 bits of SHA-256 per turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written

SEGMENT_TURNS = 64
SYMBOL = 16  # bytes of a turn's symbol
PARTITION_TURNS = 500_000
LAST_ITEMS = 20_000
NOTHING = hashlib.sha256(b"").hexdigest()


def turns(talks: DataFrame) -> DataFrame:
    """conv_id, turn, sym, bytes, n: distinct turns of every conversation and how often they come."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = talks.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.unhex(F.substring(named, 1, 2 * SYMBOL)).alias("sym"),
        F.octet_length(text).cast("bigint").alias("bytes"))
    return rows.groupBy("conv_id", "turn", "sym", "bytes").agg(F.count(F.lit(1)).alias("n"))


def numbered(talks: DataFrame, partition_turns: int = PARTITION_TURNS) -> DataFrame:
    """conv_id, d (from 1), sym, bytes of every turn, in order."""
    rows = turns(talks)
    parts = max(1, -(-talks.count() // partition_turns), rows.sparkSession.sparkContext.defaultParallelism)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv, n = batch.column("conv_id").to_numpy(), batch.column("n").to_numpy()
            if not len(conv):
                continue
            before = np.cumsum(n) - n
            first = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
            base = np.repeat(before[first], np.diff(np.append(first, len(conv))))
            before = before - base
            before[conv == conv[0]] += seen if conv[0] == last else 0
            last, seen = conv[-1], int(before[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(conv), part)), pa.array(before)], names=[*batch.schema.names, "part", "before"])

    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("sym")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(dealt.mapInArrow(count, "conv_id bigint, turn bigint, sym binary, bytes bigint, n bigint, part bigint, before bigint"))
    held = placed.groupBy("conv_id", "part").agg(F.sum("n").alias("held"))
    earlier = F.sum("held").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = held.withColumn("shift", earlier).filter("shift > 0").select("conv_id", "part", "shift")  # conversations cut by a border only
    placed = placed.join(shift, ["conv_id", "part"], "left")
    at = F.col("before") + F.coalesce("shift", F.lit(0))
    return placed.select("conv_id", F.explode(F.sequence(at + 1, at + F.col("n"))).alias("d"), "sym", "bytes")


def grafted(rows: DataFrame, base_of: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations (conv_id, length) after each starts with the first ``heads`` (at most ``most``) turns of ``base_of``, then goes on with its own.

    ``base_of`` and ``heads`` are expressions over conv_id.
    """
    lengths = rows.groupBy("conv_id").agg(F.max("d").alias("own"))
    plan = lengths.select("conv_id", "own", base_of.alias("base"), heads.cast("bigint").alias("h"))
    plan = plan.join(lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("offered")), "base", "left")
    plan = written(plan.withColumn("taken", F.least("h", F.coalesce("offered", F.lit(0)))))
    first = rows.filter(F.col("d") <= most).join(plan.select(F.col("base").alias("conv_id"), F.col("conv_id").alias("to"), "taken"), "conv_id")
    first = first.filter("d <= taken").select(F.col("to").alias("conv_id"), "d", "sym", "bytes")
    short = plan.filter("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("missing"))
    rest = rows.filter(F.col("d") > heads).join(short, "conv_id", "left").withColumn("d", F.col("d") - F.coalesce("missing", F.lit(0)))
    length = F.greatest(F.col("own") - F.col("h"), F.lit(0)) + F.col("taken")
    return first.union(rest.select("conv_id", "d", "sym", "bytes")), plan.select("conv_id", length.alias("length"))


class Forest:
    """Union-find over sorted items; each component is a node of the trie with its sums."""

    def __init__(self, keys: list[bytes], depth: np.ndarray, n: np.ndarray, least: np.ndarray, children: np.ndarray, leaves: np.ndarray, saved: np.ndarray,
                 sums: list[np.ndarray], open_ends: bool):
        m = len(keys)
        self.depth, self.n, self.least, self.children, self.leaves, self.saved = ([int(v) for v in x] for x in (depth, n, least, children, leaves, saved))
        self.item = list(range(m))  # an item whose first symbols are the node's
        self.same: list[int] = list(range(m))  # nodes that turned out to be one
        self.parent: list[int] = [-1] * m
        self.open = [open_ends and (i == 0 or i == m - 1) for i in range(m)]
        self.sums = sums
        common = [self._common(a, b) for a, b in zip(keys, keys[1:])]
        up, node = list(range(m)), list(range(m))

        def find(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for e in np.argsort(-np.array(common, np.int64), kind="stable").tolist():
            d, a, b = common[e], find(e), find(e + 1)
            x, y = node[a], node[b]
            up[b] = a
            if self.depth[x] == d and self.depth[y] == d:
                self._unite(x, y)
            elif self.depth[x] == d:
                self._hang(y, x)
            elif self.depth[y] == d:
                self._hang(x, y)
                node[a] = y
            else:
                node[a] = new = self._node(d, x)
                self._hang(x, new)
                self._hang(y, new)
        self.top = node[find(0)] if m else -1
        if m and not open_ends and self.depth[self.top]:
            x, self.top = self.top, self._node(0, self.top)
            self._hang(x, self.top)

    @staticmethod
    def _common(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            return n // SYMBOL
        for d in range(0, n, SYMBOL):
            if a[d : d + SYMBOL] != b[d : d + SYMBOL]:
                return d // SYMBOL
        return n // SYMBOL

    def _node(self, d: int, like: int) -> int:
        for column, value in ((self.depth, d), (self.n, 0), (self.least, None), (self.children, 0), (self.leaves, 0), (self.saved, 0), (self.item, self.item[like]),
                              (self.same, len(self.same)), (self.parent, -1), (self.open, False)):
            column.append(value)
        return len(self.depth) - 1

    def _add(self, to: int, n: int, least: int | None, children: int, leaves: int, saved: int) -> None:
        self.n[to] += n
        self.least[to] = least if self.least[to] is None else self.least[to] if least is None else min(least, self.least[to])
        self.children[to] += children
        self.leaves[to] += leaves
        self.saved[to] += saved

    def _unite(self, to: int, node: int) -> None:
        self.same[node] = to
        self.open[to] = self.open[to] or self.open[node]
        self._add(to, self.n[node], self.least[node], self.children[node], self.leaves[node], self.saved[node])

    def _hang(self, node: int, on: int) -> None:
        """A closed component hands its sums to its parent; an open one stays an item of its own."""
        self.parent[node] = on
        if self.open[node]:
            self.open[on] = True
            return
        self._add(on, self.n[node], self.least[node], 1, self.leaves_of(node), self.saved_at(node, self.depth[on] + 1))

    def leaves_of(self, node: int) -> int:
        return self.leaves[node] if self.children[node] else 1

    def saved_at(self, node: int, d: int) -> int:
        """Savings of the subtree of the node's prefix of d symbols, along the chain that leads to the node."""
        sums = self.sums[self.item[node]]
        return self.saved[node] + (self.n[node] - 1) * int(sums[self.depth[node]] - sums[d - 1])

    def true(self, node: int) -> int:
        while self.same[node] != node:
            node = self.same[node]
        return node


# kind 0: nodes; 1: items for the next step; 2: pieces of the ids that end at an open node
OUT = ("kind int, part bigint, key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
       "saved_tokens bigint, ends string, sizes array<bigint>")
COLUMNS = ("kind", "part", "key", "parent_key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "sizes")
ITEM = "key binary, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, sizes array<bigint>, ending boolean"


def name_of(prefix: bytes) -> bytes:
    """Short name of a prefix."""
    return hashlib.sha256(prefix).digest()[:SYMBOL]


def _grow(batches: Iterator, open_ends: bool, named: bool) -> Iterator:
    """One partition of sorted items to nodes, items and pieces of ids. ``named`` nodes carry their key; which ids end there is then not known here, but for ``told``."""
    import pyarrow as pa

    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    part = TaskContext.get().partitionId()
    whole = pa.Table.from_batches(tables).combine_chunks()
    column = {c: whole.column(c) for c in whole.column_names}
    keys = column["key"].to_pylist()
    flat, lengths = column["sizes"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.fromiter(map(len, keys), np.int64, len(keys)) // SYMBOL
    ends = np.cumsum(lengths)
    sums = [np.concatenate(([0], np.cumsum(flat[e - k : e]))) for e, k in zip(ends.tolist(), lengths.tolist())]
    ids, ending = column["conv_id"].to_numpy(), column["ending"].to_numpy()
    f = Forest(keys, lengths, *(column[c].to_numpy() for c in ("n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens")), sums, open_ends)

    # ids that end at a node: equal keys are neighbours, ids ascend
    told: dict[int, str] = {}
    pieces = []
    at = 0
    while at < len(keys):
        to = at + 1
        while to < len(keys) and keys[to] == keys[at]:
            to += 1
        own = ids[at:to][ending[at:to]].tolist()
        if own:
            node, text = f.true(at), ",".join(map(str, own))
            if f.open[node]:
                pieces.append((2, part, name_of(keys[at]), None, own[0], None, None, None, None, None, None, text, None))
            else:
                told[node] = hashlib.sha256(text.encode()).hexdigest()
        at = to

    def out(rows):
        schema = pa.schema([(c, t) for c, t in zip(COLUMNS, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.list_(pa.int64())), strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = pieces
    for x in range(len(f.depth)):
        if f.same[x] != x:
            continue
        if len(rows) >= 20_000:
            yield out(rows)
            rows = []
        prefix, own = keys[f.item[x]], f.sums[f.item[x]]
        if f.open[x]:
            if f.n[x]:
                d = f.depth[x]
                rows.append((1, part, prefix[: d * SYMBOL], name_of(prefix[: d * SYMBOL]), f.least[x], d, None, f.n[x], f.children[x], f.leaves[x], f.saved[x], None, np.diff(own[: d + 1]).tolist()))
            continue
        if x == f.top:
            continue
        p, bottom, least, n, leaves = f.true(f.parent[x]), f.depth[x], f.least[x], f.n[x], f.leaves_of(x)
        above = f.depth[p]
        for d in range(above + 1, bottom + 1):
            first, last = d == above + 1, d == bottom
            away = first and above and f.open[p]  # nothing is told of what lies above a group
            rows.append((0, part, name_of(prefix[: d * SYMBOL]) if named else None, name_of(prefix[: above * SYMBOL]) if away else None, least, d,
                         least if not first else None if away or not above else f.least[p], n, f.children[x] if last else 1, leaves, f.saved_at(x, d),
                         told.get(x, "" if named else NOTHING) if last else NOTHING, None))
    if rows:
        yield out(rows)


def _hashed_ends(pieces: DataFrame) -> DataFrame:
    """key, ends: the hash of all ids of a node, piece after piece."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, state, made = None, None, []
        for batch in batches:
            for k, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if k != key:
                    if state is not None:
                        made.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.string())], names=["key", "ends"])
                made = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends"])

    return pieces.select("key", "conv_id", "ends").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, ends string")


def _segment_forest(items: DataFrame, parts: int, last_items: int) -> DataFrame:
    """Nodes of one segment: depth (from 1: the group), conv_id, parent_conv_id and the sums."""
    levels, pieces = [], []
    while True:
        last = parts == 1
        dealt = items.repartitionByRange(parts, "key", "conv_id") if not last else items.repartition(1)
        grown = written(dealt.sortWithinPartitions("key", "conv_id").mapInArrow(lambda b, ends=not last, named=bool(levels): _grow(b, ends, named), OUT))
        levels.append((grown, len(levels)))
        pieces.append(grown.filter("kind = 2"))
        if last:
            break
        open_items = grown.filter("kind = 1")
        items = open_items.select("key", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "sizes", F.lit(False).alias("ending"))
        n = open_items.count()
        parts = 1 if n <= last_items or -(-n // last_items) >= parts else -(-n // last_items)
    nodes = reduce(DataFrame.union, [g.filter("kind = 0").drop("kind", "sizes").withColumn("level", F.lit(i)) for g, i in levels])
    if len(levels) == 1:
        return nodes
    # only nodes of later steps look for their ids, and only children of open nodes for their parent: the rest meets no join
    hashed = _hashed_ends(reduce(DataFrame.union, pieces)).withColumnRenamed("ends", "hashed")
    later = nodes.filter("key is not null").join(hashed, "key", "left").withColumn("ends", F.coalesce(F.nullif("ends", F.lit("")), "hashed", F.lit(NOTHING))).select(*nodes.columns)
    waits = reduce(DataFrame.union, [g.filter("kind = 1").select(F.lit(i).alias("level"), "part", F.col("parent_key").alias("name")) for g, i in levels[:-1]])
    known = waits.join(later.select(F.col("key").alias("name"), F.col("conv_id").alias("found")), "name").select("level", "part", F.col("name").alias("parent_key"), "found")
    every = nodes.filter("key is null").union(later)
    children = every.filter("parent_key is not null").join(known, ["level", "part", "parent_key"]).withColumn("parent_conv_id", F.col("found")).select(*nodes.columns)
    return every.filter("parent_key is null").union(children)


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(rows: DataFrame, convs: DataFrame, segment_turns: int = SEGMENT_TURNS, partition_turns: int = PARTITION_TURNS, last_items: int = LAST_ITEMS) -> DataFrame:
    """All nodes for turns (conv_id, d, sym, bytes) of conversations (conv_id, length): conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (of the subtree: members less one times the bytes of the last text), ends_sha256 (of the ids that end there)."""
    span = segment_turns
    cut = rows.groupBy("conv_id", F.floor((F.col("d") - 1) / span).cast("bigint").alias("b")).agg(
        F.array_sort(F.collect_list(F.struct("d", F.hex("sym").alias("sym"), "bytes"))).alias("t"))
    segments = written(cut.select("conv_id", "b", F.unhex(F.array_join("t.sym", "")).alias("key"), F.col("t.bytes").alias("sizes")))
    group = F.unhex(F.lit("00" * SYMBOL))
    blocks = []  # per segment: conversations in it, with the group they share everything before with
    inside = convs.select("conv_id", "length", group.alias("g"))
    while True:
        b = len(blocks)
        held = inside.join(segments.filter(F.col("b") == b).drop("b"), "conv_id", "left").select(
            "conv_id", "length", "g", F.concat("g", F.coalesce("key", F.unhex(F.lit("")))).alias("key"), F.coalesce("sizes", F.array().cast("array<bigint>")).alias("sizes"))
        held = written(held)
        further = held.filter(F.col("length") > (b + 1) * span).withColumn("next", F.unhex(F.substring(F.sha2("key", 256), 1, 2 * SYMBOL)))
        sizes = further.groupBy("next").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("next")
        shared = written(further.join(sizes, "next", "left_semi").select("conv_id", "length", F.col("next").alias("g")))
        blocks.append((held, shared))
        if shared.isEmpty():
            break
        inside = shared
    def shown(nodes: DataFrame, b: int) -> DataFrame:
        return nodes.withColumn("depth", F.col("depth") - 1 + b * span).withColumnRenamed("ends", "ends_sha256").select(*NODE)

    out, below = [], None
    for b in reversed(range(len(blocks))):
        held, shared = blocks[b]
        goes_on = F.col("length") > (b + 1) * span
        alone = held.filter(goes_on)
        if below is not None:
            alone = alone.join(shared, "conv_id", "left_anti")
        one = F.lit(1).cast("bigint")
        sizes = F.concat(F.array(F.lit(0).cast("bigint")), "sizes")
        items = held.filter(~goes_on).select("key", "conv_id", one, one * 0, one * 0, one * 0, sizes, F.lit(True)).union(
            alone.select("key", "conv_id", one, one, one, one * 0, sizes, F.lit(False)))
        # least member where a segment is full: others may end where a group or a chain goes on
        full = held.filter(F.col("length") >= (b + 1) * span).groupBy("key").agg(F.min("conv_id").alias("least"))
        if below is not None:
            tops = below.filter("depth = 1").select("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens").join(held.select("conv_id", "key", sizes.alias("sizes")), "conv_id")
            items = items.union(tops.select("key", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "sizes", F.lit(False)))
            lower = tops.join(full, "key").filter("least < conv_id").select(F.col("conv_id").alias("parent_conv_id"), "least")
            first = below.filter("depth = 2").join(lower, "parent_conv_id", "left").withColumn("parent_conv_id", F.coalesce("least", "parent_conv_id")).select(*below.columns)
            out.append(shown(below.filter("depth > 2").union(first), b + 1))
        items = items.toDF("key", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "sizes", "ending")
        parts = max(1, held.sparkSession.sparkContext.defaultParallelism, -(-held.agg(F.sum(F.size("sizes") + 1)).first()[0] // partition_turns)) if not held.isEmpty() else 1
        below = written(_segment_forest(items, parts, last_items))
        # chains of conversations that are alone from here on
        rest = alone.join(full, "key").select("conv_id", "length", "least").join(segments.filter(F.col("b") > b).select("conv_id", "b"), "conv_id")
        chain = rest.select("conv_id", "length", "least", F.explode(F.sequence(F.col("b") * span + 1, F.least((F.col("b") + 1) * span, "length"))).alias("depth"))
        end = F.col("depth") == F.col("length")
        up = F.when(F.col("depth") == (b + 1) * span + 1, F.col("least")).otherwise(F.col("conv_id"))
        out.append(chain.select("conv_id", "depth", up, one, F.when(end, one * 0).otherwise(one), one, one * 0,
                                F.when(end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOTHING)).toDF(*NODE))
    return reduce(DataFrame.union, [shown(below, 0), *out])
