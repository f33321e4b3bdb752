"""N-gram Jaccard join: candidates must share prefix tokens under several token orders before their sets are compared.

Documents are sets of hashed word shingles; two link when ``100 * intersection >= percent * union``.

1. *Shared tokens.* Blocks of documents send each of their tokens once, packed, to the shard of its hash; a token that two
   documents of a block hold needs no answer. A shard finds the tokens that several blocks sent and credits their documents.
   A document with fewer than ``percent`` of its tokens shared links with nothing and is done.
2. *Equal sets* become one class; one member's set stands for it. Among these the count is repeated: copies no longer vouch for each other.
3. *Prefixes.* A sketch counts the tokens of the classes' sets. Order k ranks tokens by how much their count stands out, then by
   the k-th hash. Two sets that link share a token among the first ``n - ceil(percent * n) + 1`` under every order, so a pair
   must come up under all orders. The orders differ, so chance pairs seldom do.
4. *Stars.* Under a few fixed permutations the first member of a token's list is its centre, and every set is paired with the first
   centre of all its lists: a few pairs per set, however long the lists. Pairs of all orders are intersected and compared exactly. A second
   round with more permutations goes over the lists that still hold several components.
5. *Rest.* In lists that still hold several components, members outside the largest are paired with all members of other
   components, unless sizes, places in the prefix or parities rule a link out. Parities are bits that tell whether an odd number of
   a set's tokens falls into each of 1,024 hash classes: two sets differ in at least as many tokens as their parities differ in bits, so
   no link is ruled out. Pairs within a component cannot change it, so no link between components is lost.

Sets are compared in chunks of bounded size: a chunk gets each set it needs once. Counts and hashes are exact but for 64-bit
collisions; the sketch and the orders affect speed alone.

Defined cases: null and empty texts, and texts of separators, have the empty set and link with nothing; texts with fewer words
than a shingle are one shingle; repeated rows are equal sets; a null doc_id is never the smallest id unless all of its component
are null; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from plumbline.llm.common import pieces_of, release_memory, worker_cache, written
from plumbline.llm.components import components
from plumbline.operators.joins import checked_broadcast

WORDS = 5
PERCENT = 80
ORDERS = 3
CENTRES = 6
MORE_CENTRES = 18  # in the second round, among lists with more than one component
BLOCK_TOKENS = 500_000
SHARD_BYTES = 4 << 20  # of text for each shard
COUNTERS = 1 << 23
COUNTER_BLOCK = 1 << 17
CHUNK_TOKENS = 4_000_000
CHUNK_PAIRS = 2_000
PARITY_LONGS = 16  # 64 hash classes each
PARITY_ROWS = 500
MANY = 0xFFFF  # owner of a token that several documents of a block hold
BROADCAST_IDS = 2_000_000
SEED = 17


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 17:
            self.clear()
        self[word] = out = xxh3_64_intdigest(word)
        return out


_hashes = worker_cache(_WordHashes())


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; bytes.lower knows A-Z alone."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < size:
        return np.array([xxh3_64_intdigest(b" ".join(found), 1)], np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    n = len(w) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ w[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(32)
    return np.unique(_mix(out, 1))


def signature(tokens: np.ndarray) -> bytes:
    return xxh3_128_digest(tokens.tobytes())


def _pack(sorted_values: np.ndarray) -> bytes:
    """48-bit ascending numbers as planes of the bytes of their differences; the upper planes are nearly all zero."""
    steps = np.diff(sorted_values, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T[:6]).tobytes()


def _unpack(planes: bytes) -> np.ndarray:
    n = len(planes) // 6
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :6] = np.frombuffer(planes, np.uint8).reshape(6, n).T
    return np.cumsum(steps.reshape(-1).view(np.uint64))


def _share_bound(percent: int):
    return lambda n: (percent * n + 99) // 100


def shared_tokens(docs: DataFrame, size: int = WORDS, block_tokens: int = BLOCK_TOKENS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n (set size), sig_a, sig_b (hash of the set), shared (tokens that another row holds too) of every row."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(64, -(-total // shard_bytes))
    width = np.uint64((1 << 48) // shards + 1)
    sent = "route bigint, block bigint, ids array<bigint>, sizes binary, sigs binary, hashes binary, owners binary"

    def send(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release_memory()
        schema = pa.schema([("route", pa.int64()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("sigs", pa.binary()),
                            ("hashes", pa.binary()), ("owners", pa.binary())])
        place, number = TaskContext.get().partitionId(), 0
        ids, sets, tokens = [], [], 0

        def block():
            nonlocal number
            name = (place << 24) + number
            number += 1
            sizes = np.array([len(s) for s in sets], np.int32)
            every = np.concatenate(sets) >> np.uint64(16)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], np.repeat(np.arange(len(sets)), sizes)[order]
            first = np.flatnonzero(np.diff(every, prepend=np.uint64(1) << np.uint64(63)))
            times = np.diff(np.append(first, len(every)))
            credit = np.bincount(owner[np.repeat(times > 1, times)], minlength=len(sets)).astype(np.int32)
            every, owner = every[first], np.where(times > 1, MANY, owner[first]).astype(np.uint16)
            shard = (every // width).astype(np.int64)
            ends = np.flatnonzero(np.diff(shard, append=-1)) + 1
            rows, at = [], 0
            for end in ends:
                rows.append((int(shard[at]), name, None, None, None, _pack(every[at:end]), owner[at:end].tobytes()))
                at = end
            rows.append((shards + name % shards, name, list(ids), sizes.tobytes(), b"".join(map(signature, sets)), None, credit.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(doc_id)
                sets.append(shingles(text.as_py(), size))
                tokens += len(sets[-1])
                if tokens >= block_tokens or len(sets) >= MANY:
                    yield block()
                    ids, sets, tokens = [], [], 0
        if sets:
            yield block()

    answered = "block bigint, kind int, ids array<bigint>, sizes binary, sigs binary, owners binary, counts binary"

    def answer(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release_memory()
        names = ["block", "kind", "ids", "sizes", "sigs", "owners", "counts"]
        types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 4]
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        def credit(held):
            blocks = np.array([h[0] for h in held], np.int64)
            values = [_unpack(h[1]) for h in held]
            which = np.repeat(np.arange(len(held)), [len(v) for v in values])
            every, owner = np.concatenate(values), np.concatenate([np.frombuffer(h[2], np.uint16) for h in held])
            order = np.argsort(every, kind="stable")
            every = every[order]
            same = every[1:] == every[:-1]
            again = np.zeros(len(every), bool)
            again[1:] |= same
            again[:-1] |= same
            hit = order[again]
            hit = hit[owner[hit] != MANY]
            got, times = np.unique(which[hit].astype(np.int64) << 16 | owner[hit], return_counts=True)
            at = got >> 16
            ends = np.searchsorted(at, np.arange(len(held) + 1))
            return [(int(blocks[i]), 1, None, None, None, (got[s:e] & MANY).astype(np.uint16).tobytes(), times[s:e].astype(np.uint32).tobytes())
                    for i, (s, e) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if e > s]

        route, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["route"] != route and held:
                    if out := credit(held):
                        yield make(out)
                    held = []
                route = row["route"]
                if row["hashes"] is None:
                    yield make([(row["block"], 0, row["ids"], row["sizes"], row["sigs"], None, row["owners"])])
                else:
                    held.append((row["block"], row["hashes"], row["owners"]))
        if held and (out := credit(held)):
            yield make(out)

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(row, shared):
            sig = np.frombuffer(row["sigs"], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array(row["ids"], pa.int64()), "n": pa.array(np.frombuffer(row["sizes"], np.int32)), "sig_a": pa.array(np.ascontiguousarray(sig[:, 0])),
                "sig_b": pa.array(np.ascontiguousarray(sig[:, 1])), "shared": pa.array(shared)})

        head, shared = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if head is not None:
                        yield out(head, shared)
                    head, shared = row, np.frombuffer(row["counts"], np.int32).astype(np.int64)
                else:
                    shared[np.frombuffer(row["owners"], np.uint16)] += np.frombuffer(row["counts"], np.uint32)
        if head is not None:
            yield out(head, shared)

    asked = docs.select("doc_id", "text").mapInArrow(send, sent).repartition("route").sortWithinPartitions("route")
    credits = written(asked.mapInArrow(answer, answered))
    return written(credits.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(
        add, "doc_id bigint, n int, sig_a bigint, sig_b bigint, shared bigint"))


def _of_documents(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id and text of the documents that stand for a class. Up to ``BROADCAST_IDS`` ids are broadcast, so that no text is shuffled."""
    ids = checked_broadcast(classes.select("rep").distinct(), BROADCAST_IDS)
    return docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")


def class_sets(docs: DataFrame, classes: DataFrame, size: int = WORDS) -> DataFrame:
    """node, n, tokens: one set for each class (node, sig_b, rep), read again from the text of document ``rep``."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release_memory()
        for batch in batches:
            sets = [shingles(t.as_py(), size) for t in batch.column("text")]
            sig = np.frombuffer(b"".join(map(signature, sets)), np.int64).reshape(-1, 2)
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_pydict({
                "node": pa.array(np.ascontiguousarray(sig[:, 0])), "sig_b": pa.array(np.ascontiguousarray(sig[:, 1])), "n": pa.array(np.diff(ends)),
                "tokens": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})

    sets = _of_documents(docs, classes).mapInArrow(run, "node bigint, sig_b bigint, n int, tokens array<bigint>")
    wanted = sets.join(classes.select("node", "sig_b"), ["node", "sig_b"], "left_semi")
    return written(wanted.dropDuplicates(["node"]).select("node", "n", "tokens"))


def _tokens(batch) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a batch, and where each row's begin and end."""
    column = batch.column("tokens")
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))


def sketch(sets: DataFrame) -> np.ndarray:
    """How often each of COUNTERS hash classes of tokens occurs."""
    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        got = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            np.add.at(got, (_tokens(batch)[0] % np.uint64(COUNTERS)).astype(np.int64), 1)
        table = np.minimum(got, 255).astype(np.uint8).reshape(-1, COUNTER_BLOCK)  # one byte per task is enough to rank by
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_pydict({"part": pa.array(used, pa.int32()), "counts": pa.array([table[i].tobytes() for i in used], pa.binary())})

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(counts.as_buffer(), np.uint8).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.int32()), "counts": pa.array(
            [np.minimum(v, 2**31 - 1).astype(np.int32).tobytes() for v in total.values()], pa.binary())})

    layout = "part int, counts binary"
    out = np.zeros((COUNTERS // COUNTER_BLOCK, COUNTER_BLOCK), np.int32)
    whole = sets.select("tokens").mapInArrow(count, layout).repartition(COUNTERS // COUNTER_BLOCK, "part").mapInArrow(add, layout)
    for row in whole.toLocalIterator():  # COUNTERS numbers in all, whatever the corpus
        out[row.part] = np.frombuffer(row.counts, np.int32)
    return out.reshape(-1)


def prefixes(sets: DataFrame, percent: int = PERCENT, orders: int = ORDERS, seed: int = SEED) -> DataFrame:
    """k, token, node, n, place: the prefix of every set under every order, places from 1."""
    counts = sets.sparkSession.sparkContext.broadcast(sketch(sets))
    bound = _share_bound(percent)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = counts.value
        usual = float(c.mean())
        for batch in batches:
            tokens, ends = _tokens(batch)
            above = np.maximum(0, c[(tokens % np.uint64(COUNTERS)).astype(np.int64)] - usual) / (np.sqrt(usual) + 1)
            rank = np.minimum(127, np.log2(1 + above).astype(np.int64)).astype(np.uint64)
            sizes = np.diff(ends)
            take = np.maximum(0, sizes - bound(sizes) + 1) * (sizes > 0)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            node, n = batch.column("node").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False)
            for k in range(orders):
                order = np.lexsort((rank << np.uint64(57) | _mix(tokens, seed + k) >> np.uint64(7), rows))
                place = np.arange(len(order)) - ends[rows] + 1  # lexsort keeps each row's tokens in its place
                first = place <= take[rows]
                chosen, place, own = order[first], place[first], rows[first]
                yield pa.RecordBatch.from_pydict({
                    "k": pa.array(np.full(len(own), k, np.int32)), "token": pa.array(tokens[chosen].view(np.int64)), "node": pa.array(node[own]), "n": pa.array(n[own].astype(np.int32)),
                    "place": pa.array(place.astype(np.int32))})

    return sets.mapInArrow(run, "k int, token bigint, node bigint, n int, place int")


def _lists(rows: DataFrame) -> DataFrame:
    """The rows of tokens that more than one set has in its prefix, in one shuffle."""
    members = F.count(F.lit(1)).over(Window.partitionBy("k", "token"))
    return written(rows.withColumn("members", members).filter("members > 1").drop("members"))


def star_pairs(lists: DataFrame, labels: DataFrame | None = None, centres: int = CENTRES, orders: int = ORDERS, seed: int = SEED) -> DataFrame:
    """a, b, n: each node with, per fixed permutation, the first centre of all its lists; pairs that come up under every order.

    The centre of a list is its node nearest to a constant by xor, so one constant makes one permutation. Lists and pairs within
    one component of ``labels`` (node, label) are left out. There are at most ``centres`` pairs per node. A list's rows are
    shuffled once and get its centres from a window, so that no table of lists x centres is shuffled beside them.
    """
    marks = [int(x) for x in np.random.default_rng(seed).integers(-(1 << 62), 1 << 62, centres)]
    near = lambda m: F.col("node").bitwiseXOR(F.lit(m))
    rows = lists if labels is None else lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    whole = Window.partitionBy("k", "token")
    rows = rows.repartition("k", "token")  # so that what the window works on is made behind the shuffle
    apart = F.count(F.lit(1)).over(whole) > 1 if labels is None else F.min("label").over(whole) != F.max("label").over(whole)
    met = rows.select("k", "node", "n", apart.alias("apart"), *[F.min(near(m)).over(whole).alias(f"c{i}") for i, m in enumerate(marks)]).filter("apart")
    first = met.groupBy("k", "node").agg(F.max("n").alias("n"), *[F.min(F.when(F.col(f"c{i}") != near(m), F.col(f"c{i}"))).alias(f"c{i}") for i, m in enumerate(marks)])
    own = F.array_distinct(F.array(*[F.col(f"c{i}").bitwiseXOR(F.lit(m)) for i, m in enumerate(marks)]))
    made = first.select("k", "node", "n", F.explode(F.filter(own, lambda c: c.isNotNull())).alias("centre"))
    pairs = _under_all_orders(made.select("k", F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"), "n"), orders)
    if labels is None:
        return pairs
    of = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"l{name}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b", "n")


def _under_all_orders(pairs: DataFrame, orders: int) -> DataFrame:
    """Intersects the filters: a, b, n of the pairs that came up under every order."""
    seen = pairs.groupBy("a", "b").agg(F.bit_or(F.expr("shiftleft(1, k)")).alias("seen"), F.max("n").alias("n"))
    return seen.filter(F.col("seen") == (1 << orders) - 1).select("a", "b", "n")


def parities(sets: DataFrame, longs: int = PARITY_LONGS) -> DataFrame:
    """node, parity: per set the bits of its hash classes with an odd number of tokens, as ``longs`` numbers."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bits = 64 * longs
        for batch in pieces_of(batches, PARITY_ROWS):
            tokens, ends = _tokens(batch)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            place = rows * bits + (_mix(tokens, SEED) % np.uint64(bits)).astype(np.int64)
            odd = np.bincount(place, minlength=batch.num_rows * bits) & 1
            packed = np.packbits(odd.astype(np.uint8)).view(np.int64)
            starts = pa.array(np.arange(0, len(packed) + 1, longs), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(starts, pa.array(packed, pa.int64()))], names=["node", "parity"])

    return sets.select("node", "tokens").mapInArrow(run, "node bigint, parity array<bigint>")


def cross_pairs(lists: DataFrame, labels: DataFrame, sets: DataFrame, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """a, b, n: pairs across components within lists that hold more than one, intersected over the orders."""
    named = written(lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    whole = Window.partitionBy("k", "token")
    sized = named.repartition("k", "token").withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("k", "token", "label")))
    mixed = sized.withColumns({"mixed": F.min("label").over(whole) != F.max("label").over(whole), "major": F.max(F.struct("members", "label")).over(whole)["label"]})
    mixed = mixed.filter("mixed").drop("members", "mixed")
    bits = [F.get("parity", F.lit(i)).alias(f"w{i}") for i in range(PARITY_LONGS)]
    rows = mixed.join(parities(sets).select("node", *bits), "node")
    rows = written(rows.withColumn("minor", F.col("label") != F.col("major")))
    side = lambda c: [F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("place").alias(f"p{c}"), F.col("label").alias(f"l{c}"),
                      *[F.col(f"w{i}").alias(f"{c}{i}") for i in range(PARITY_LONGS)]]
    left, right = rows.filter("minor").select("k", "token", *side("x")), rows.select("k", "token", *side("y"), "minor")
    # at the first token that two sets share, no more than what follows it in either prefix order can be common
    common = 1 + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    apart = sum((F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(PARITY_LONGS)), F.lit(0))
    both = F.col("nx") + F.col("ny")
    made = left.join(right, ["k", "token"]).filter(
        ((100 + percent) * common >= percent * both) & ((100 + percent) * apart <= (100 - percent) * both) &
        (F.col("lx") != F.col("ly")) & (~F.col("minor") | (F.col("x") < F.col("y"))) & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")))
    return _under_all_orders(made.select("k", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.greatest("nx", "ny").alias("n")), orders)


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, chunk_tokens: int = CHUNK_TOKENS, chunk_pairs: int = CHUNK_PAIRS) -> DataFrame:
    """The pairs (a, b) that link. Pairs of nodes with a common partner go to one chunk, until it holds ``chunk_tokens`` or ``chunk_pairs``."""
    pairs = written(pairs)
    parts = lambda tokens, pairs: F.ceil(F.greatest(tokens / chunk_tokens, pairs / chunk_pairs))
    flipped = pairs.groupBy("b").agg(F.min("a").alias("home"), F.sum("n").alias("weight"), F.count(F.lit(1)).alias("asked"))
    homes = flipped.groupBy("home").agg(parts(F.sum("weight"), F.sum("asked")).alias("chunks"))
    dealt = flipped.join(homes, "home").select(
        "b", "home", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), parts(F.col("weight"), F.col("asked")).alias("more"))
    keyed = pairs.join(dealt, "b").select(F.xxhash64("home", "chunk", "more", F.pmod(F.xxhash64("a"), F.col("more"))).alias("chunk"), "a", "b")
    keyed = written(keyed)
    needed = keyed.select("chunk", F.col("a").alias("node")).union(keyed.select("chunk", F.col("b").alias("node"))).distinct()
    none = F.lit(None)
    shipped = needed.join(sets.select("node", "tokens"), "node").select("chunk", F.lit(0).alias("kind"), F.col("node").alias("a"), none.cast("bigint").alias("b"), "tokens")
    asked = keyed.select("chunk", F.lit(1).alias("kind"), "a", "b", none.cast("array<bigint>").alias("tokens"))

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release_memory()
        chunk, held = None, {}
        for batch in batches:
            tokens, ends = _tokens(batch)  # null lists are empty
            out_a, out_b = [], []
            cols = (batch.column(c).to_pylist() for c in ("chunk", "kind", "a", "b"))
            for i, (now, kind, a, b) in enumerate(zip(*cols, strict=True)):
                if now != chunk:
                    chunk, held = now, {}
                if kind == 0:
                    held[a] = tokens[ends[i] : ends[i + 1]].copy()
                    continue
                x, y = held[a], held[b]
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.sort(np.concatenate((x, y)), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_pydict({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    met = shipped.union(asked).repartition("chunk").sortWithinPartitions("chunk", "kind")
    return written(met.mapInArrow(compare, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, orders: int = ORDERS, centres: int = CENTRES,
                    more_centres: int = MORE_CENTRES) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows = shared_tokens(docs, size)
    enough = (F.col("n") > 0) & (100 * F.col("shared") >= percent * F.col("n"))
    by_set = rows.filter(enough).groupBy("sig_a", "sig_b")
    classes = written(by_set.agg(F.min("doc_id").alias("rep")))
    again = shared_tokens(_of_documents(docs, classes), size).filter(enough).select("sig_a", "sig_b").distinct()
    classes = classes.join(again, ["sig_a", "sig_b"], "left_semi").select(F.col("sig_a").alias("node"), "sig_b", "rep")
    sets = class_sets(docs, written(classes), size)
    lists = _lists(prefixes(sets, percent, orders))
    links = verified(star_pairs(lists, None, centres, orders, SEED), sets, percent)
    labels = written(components(links))
    for pairs in (lambda: star_pairs(lists, labels, more_centres, orders, SEED + 1), lambda: cross_pairs(lists, labels, sets, percent, orders)):
        more = verified(pairs(), sets, percent)
        if not more.isEmpty():
            links = links.union(more)
            labels = written(components(links))
    named = rows.join(labels.withColumnRenamed("node", "sig_a"), "sig_a", "left")
    named = named.withColumn("label", F.when(F.col("n") > 0, F.coalesce("label", "sig_a")))
    least = named.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    full = named.filter("label is not null").join(least, "label").select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id")
    empty = named.filter("label is null").select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.union(empty)
