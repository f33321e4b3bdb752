"""N-gram Jaccard join: brute force over all pairs."""

import random

import numpy as np
import pytest

from plumbline.llm import components as cc
from plumbline.llm import multi_order as mo

SCHEMA = "doc_id bigint, text string, n string, node string"


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    ids = [i for i, _ in rows]
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    parent[find(a)] = find(b)
    groups = {}
    for a in range(len(rows)):
        groups.setdefault(find(a), []).append(a)
    out = []
    for members in groups.values():
        known = [ids[a] for a in members if ids[a] is not None]
        out += [(ids[a], len(sets[a]), min(known) if known else None) for a in members]
    return sorted(out, key=str)


def run(spark, rows, parts=4):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA).repartition(parts)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in mo.near_duplicates(docs).collect()), key=str)


def corpus(seed, groups, members, words=60):
    """Groups of near copies, from nearly equal to just beyond the limit, plus strangers that share a passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(30)]
    rows, n = [], 0
    for _ in range(groups):
        source = [word() for _ in range(words)]
        for m in range(members):
            copy = list(source)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            n += 1
            rows.append((n * 7 % 1009, " ".join(copy)))
    for m in range(40):
        n += 1
        rows.append((2000 + n, " ".join(passage + [word() for _ in range(rng.choice([0, 3, 5, 8, 30]))])))
    return rows


def test_edge_cases(spark):
    rows = [(5, "A b c d e"), (3, "a B\tc\nd e"), (9, "a b c d"), (4, "a  b c d"), (1, None), (2, ""), (6, " \x0b"), (None, "x y z"), (7, "x y Z"), (None, "x y q"),
            (8, "É b c d e f"), (10, "é b c d e f"), (11, "r " * 50_000), (12, "r " * 40_000), (13, "a b c d e"), (13, "a b c d e"), (13, "other text")]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = corpus(seed, 12, 14)
    assert run(spark, rows) == brute(rows)


def test_one_large_group(spark):
    rows = corpus(3, 1, 150, words=45)
    assert run(spark, rows) == brute(rows)


def test_small_blocks_and_chunks(spark, monkeypatch):
    rows = corpus(4, 5, 10)
    want = brute(rows)
    docs = spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA).repartition(3)
    shared = {(r.doc_id, r.n): r.shared for r in mo.shared_tokens(docs, block_tokens=200, shard_bytes=500).collect()}
    sets = {i: sets_of(t) for i, t in rows}
    assert shared == {(i, len(s)): sum(any(t in o for j, o in sets.items() if j != i) for t in s) for i, s in sets.items()}
    verified = mo.verified
    monkeypatch.setattr(mo, "verified", lambda pairs, sets, percent: verified(pairs, sets, percent, chunk_tokens=300, chunk_pairs=7))
    assert run(spark, rows) == want


def test_single_copies_among_forms(spark):
    """Forms of 80 to 89% common shingles do not link; the rare shingles that a form shares with its copy are in lists of two."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    form = [word() for _ in range(200)]
    docs = [form + [word() for _ in range(rng.randint(25, 48))] for _ in range(200)]
    docs += [d[:-1] + [word()] for d in docs[::10]]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    want = brute(rows)
    assert sum(i != c for i, _, c in want) == 20
    assert run(spark, rows) == want


def test_parities_bound_the_difference(spark):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 1, 40, 300, 3000)]
    sets += [np.unique(np.concatenate((sets[3][: 300 - d], rng.integers(0, 1 << 63, d, dtype=np.uint64)))) for d in (1, 10, 60)]
    df = spark.createDataFrame([(i, [int(x) for x in s]) for i, s in enumerate(sets)], "node bigint, tokens array<bigint>")
    found = {r.node: np.array(r.parity).view(np.uint64) for r in mo.parities(df).collect()}
    apart = lambda a, b: sum(int(x).bit_count() for x in found[a] ^ found[b])
    assert len(found) == len(sets) and apart(0, 0) == 0 and apart(0, 1) == 1
    for a in range(len(sets)):
        for b in range(len(sets)):
            assert apart(a, b) <= len(np.setxor1d(sets[a], sets[b]))
    assert apart(3, 5) >= 1 and apart(3, 7) > 60  # close to the true difference while it is small


def test_forms_that_share_a_passage_make_few_pairs(spark):
    """Forms with a common passage of most of their words, none of which link: the rest makes hardly any pair to compare."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    passage = [word() for _ in range(150)]
    rows = [(i, " ".join(passage + [word() for _ in range(rng.randint(55, 75))])) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)
    got = mo.near_duplicates(docs).collect()
    assert all(r.doc_id == r.component_id for r in got) and len(got) == 300
    shingles = {i: sets_of(t) for i, t in rows}
    ordered = [(i, sorted(hash(x) & (1 << 62) - 1 for x in shingles[i])) for i in shingles]
    sets = spark.createDataFrame(ordered, "node bigint, tokens array<bigint>")
    common = sorted(set.intersection(*[set(s) for _, s in ordered]))[:2]
    lists = spark.createDataFrame([(k, t, i, len(s), 1) for k in range(3) for t in common for i, s in ordered], "k int, token bigint, node bigint, n int, place int")
    assert mo.cross_pairs(lists, spark.createDataFrame([], "node bigint, label bigint"), sets).count() <= 3 * len(rows)


def test_pairs_of_a_list_grow_with_its_length(spark):
    made = []
    for members in (100, 400):
        lists = spark.range(members).selectExpr("explode(array(0, 1, 2)) as k", "5 as token", "xxhash64(id) as node", "10 as n", "1 as place")
        made.append(mo.star_pairs(lists).count())
    assert made[1] <= 5 * made[0] and made[1] <= 400 * mo.CENTRES


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1)]


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(180)] + [(900, i) for i in range(901, 960)] + [(5, 5)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in cc.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for e in edges for n in e if e[0] != e[1] or n in got}


def test_lists_are_shuffled_once(spark, tmp_path):
    spark.range(400).selectExpr("explode(array(0, 1, 2)) as k", "id % 7 as token", "xxhash64(id) as node", "10 as n", "1 as place").write.parquet(f"{tmp_path}/lists")
    lists = spark.read.parquet(f"{tmp_path}/lists")
    labels = spark.createDataFrame([(1, 1)], "node bigint, label bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large lists
    try:
        for pairs in (mo.star_pairs(lists), mo.star_pairs(lists, labels, mo.MORE_CENTRES)):
            plan = pairs._jdf.queryExecution().executedPlan().toString().split("\n")
            assert sum("Exchange hashpartitioning(k" in line and "token" in line for line in plan) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
