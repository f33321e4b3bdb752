"""Scaled sketches against brute force: kept hashes, likeness, containment, merging; the successor of every row."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import scaled_sketch as ss

SCHEMA = "doc_id bigint, text string, sketch string, next_text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def hashes(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    runs = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)] or ([" ".join(words)] if words else [])
    return sorted({hashlib.md5(r.encode()).hexdigest()[:16] for r in runs})


def kept(text, share=8, least=32):
    every = hashes(text)
    low = [h for h in every if int(h, 16) < (1 << 64) // share]
    return low if len(low) >= least else every[:least]


def limit(s, share=8, least=32):
    return "~" if len(s) < least else max(s[-1], f"{(1 << 64) // share - 1:016x}")


def like(a, b, **k):
    t = min(limit(a, **k), limit(b, **k))
    x, y = {h for h in a if h <= t}, {h for h in b if h <= t}
    return len(x & y) / len(x | y) if x | y else 1.0


def table(spark, rows):
    return spark.createDataFrame([(*r, "extra", "extra") for r in rows], SCHEMA)


def texts(seed, n=60):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["alpha", "Be", "ç", "d d", "E5", "K"]) + rng.choice(["", "1", "2", "\t", "\n\r "]) for _ in range(rng.choice([0, 1, 3, 5, 40, 900]))) for _ in range(n)]


def test_sketches(spark):
    rows = list(enumerate([*texts(1), None, "", " \n", "one", "\x1f \x85", "w" * 200_000, " ".join(f"word{i}" for i in range(60_000))]))
    got = table(spark, rows).select("doc_id", ss.sketch(F.col("text")).alias("s"), ss.unpacked(ss.packed(ss.sketch(F.col("text")))).alias("u")).collect()
    assert all(r.s == kept(dict(rows)[r.doc_id]) == r.u for r in got) and len(got) == len(rows)


def test_likeness_and_containment(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(6000)]
    pairs = []
    for n in (3, 8, 30, 300, 5000):
        a = words[:n]
        for share in (0.0, 0.3, 1.0):
            pairs.append((" ".join(a), " ".join(a[: int(n * share)] + [f"x{rng.random()}" for _ in range(n // 2)])))
    pairs += [("", ""), ("", "a"), ("a b c d e f", "a b c d e f"), (" ".join(words[100:140]), " ".join(words))]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", ss.sketch(F.col("a")).alias("x"), ss.sketch(F.col("b")).alias("y"))
    for r in df.select("a", "b", ss.likeness(F.col("x"), F.col("y")).alias("l"), ss.containment(F.col("x"), F.col("y")).alias("c")).collect():
        assert r.l == like(kept(r.a), kept(r.b))
        a, b = set(hashes(r.a)), set(hashes(r.b))
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r.l - true) < 0.2 and (r.l == true or len(a) >= 32 or len(b) >= 32)
        if r.c is not None and a:
            assert abs(r.c - len(a & b) / len(a)) < 0.25


def test_merged_equals_the_sketch_of_the_whole(spark):
    parts = [(g, " ".join(f"{g}-{k}-{i}" for i in range(n))) for g, sizes in ((1, (20, 400, 3)), (2, (6, 7)), (None, (1000,)), (4, (0,))) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(parts, "g int, text string").select("g", ss.sketch(F.col("text")).alias("sketch"))
    got = {r.g: r.sketch for r in ss.merged(df, "g").collect()}
    for g in (1, 2, None, 4):
        every = sorted({h for k, t in parts if k == g for h in hashes(t)})
        low = [h for h in every if h < "2"]
        assert got[g] == (low if len(low) >= 32 else every[:32])


@pytest.mark.parametrize("ids", [list(range(100)), [10**15 * (i % 3) + i * i for i in range(80)], [-(2**63), 2**63 - 1, 2**62, 2**62 + 1, 0, -5], [7]])
def test_edited(spark, ids):
    made = texts(3, len(ids))
    rows = list(zip(ids, made, strict=True))
    got = {r.doc_id: r for r in ss.fingerprint_edited(table(spark, rows), bucket_bytes=500).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == ("".join(kept(text)), "".join(kept(edited)))
        assert (r.near_edited, r.near_next) == (like(kept(text), kept(edited)), like(kept(text), kept(after)))


def test_defined_cases(spark):
    rows = [(None, "a b c"), (None, None), (None, "a b c"), (3, "x"), (3, "x"), (3, "yyy zzz"), (9, ""), (5, None)]
    got = ss.fingerprint_edited(table(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert sorted(r.fingerprint for r in got) == sorted("".join(kept(t)) for _, t in rows) and all(0 <= r.near_next <= 1 for r in got)
    (alone,) = ss.fingerprint_edited(table(spark, [(1, "abc def")])).collect()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest()
    assert ss.fingerprint_edited(table(spark, [])).collect() == []
