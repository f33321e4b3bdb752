"""Prefix trie against brute force: many partitions and steps, segments shorter than shared prefixes, equal and empty conversations."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import prefix_trie as pt

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, length string"


def symbol(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def sequences(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, symbol(role, text), len((text or "").encode())))
    return {c: [t[2:] for t in sorted(v)] for c, v in out.items()}


def brute(seqs):
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(x[0] for x in s[:d])].append(c)
    children, size = defaultdict(int), {}
    for path, own in members.items():
        if path:
            children[path[:-1]] += 1
            size[path] = seqs[own[0]][len(path) - 1][1]
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, own in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(own) - 1) * size.get(path, 0)
    return sorted((min(own), len(p), -1 if not p else min(members[p[:-1]]), len(own), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in own if len(seqs[c]) == len(p)))).encode()).hexdigest()) for p, own in members.items())


def built(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def of_table(spark, rows, **sizes):
    turns = pt.numbered(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA), partition_turns=sizes.get("partition_turns", 50))
    convs = turns.groupBy("conv_id").agg(F.max("d").alias("length"))
    return built(pt.trie(turns, convs, **sizes))


@pytest.mark.parametrize("seed,words,longest,sizes", [
    (1, 2, 6, {"segment_turns": 64, "partition_turns": 40, "last_items": 10}),
    (2, 2, 9, {"segment_turns": 2, "partition_turns": 30, "last_items": 10}),
    (3, 1, 12, {"segment_turns": 3, "partition_turns": 30, "last_items": 1000}),
    (4, 3, 5, {}),
])
def test_equals_brute_force(spark, seed, words, longest, sizes):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice("ab"), rng.choice(["é", "", "zz"][:words])) for c in range(-20, 180) for t in range(rng.randrange(1, longest))]
    assert of_table(spark, rows, **sizes) == brute(sequences(rows))


def test_thousands_of_equal_conversations(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(1500) for t in range(5)] + [(c, t, "user", f"turn {t * (t < 3)}") for c in range(5000, 5300) for t in range(5)]
    assert of_table(spark, rows, segment_turns=2, partition_turns=400, last_items=20) == brute(sequences(rows))


def test_one_long_conversation_and_its_copy(spark):
    rows = [(c, t, "user", f"{t}") for c in (1, 2) for t in range(150)] + [(3, t, "user", f"{t}") for t in range(400)] + [(4, 0, "user", "0")]
    assert of_table(spark, rows, segment_turns=16, partition_turns=60) == brute(sequences(rows))


def test_defined_cases(spark):
    rows = [(1, None, None, None), (1, 3, "user", "x" * 100_000), (1, 3, "user", "x" * 100_000), (2, None, "", ""), (None, 1, "user", "lost"), (3, 1, "b", "a"), (3, 1, "a", "b"), (4, -1, "user", None),
            (4, -1, "user", None), (4, -1, None, "user")]
    assert of_table(spark, rows) == brute(sequences(rows))
    assert of_table(spark, []) == []


def test_grafted(spark):
    """Heads of another conversation, shorter or absent ones, nothing left."""
    rows = [(c, t, "u", f"{c}:{t}") for c, n in ((0, 3), (1, 5), (2, 2), (4, 9), (6, 4), (7, 1), (10, 2), (13, 3)) for t in range(n)]
    turns = pt.numbered(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA))
    heads = {0: 2, 1: 4, 2: 6, 4: 0, 6: 3, 7: 2, 10: 1, 13: 3}
    h = F.create_map(*[F.lit(v) for kv in heads.items() for v in kv])[F.col("conv_id")]
    got, convs = pt.grafted(turns, F.col("conv_id") - F.col("conv_id") % 5, h, 8)
    seqs = sequences(rows)
    want = {c: (seqs.get(c - c % 5, [])[: heads[c]] + s[heads[c]:]) for c, s in seqs.items()}
    assert {r.conv_id: r.length for r in convs.collect()} == {c: len(s) for c, s in want.items()}
    assert sorted((r.conv_id, r.d, bytes(r.sym)) for r in got.collect()) == sorted((c, d + 1, x[0]) for c, s in want.items() for d, x in enumerate(s))
    assert built(pt.trie(got, convs, segment_turns=2)) == brute(want)
