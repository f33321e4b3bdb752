"""Mixing sources to target weights: subset sums over document lengths.

1. Sources share the words of all documents by weight; no target exceeds ``most`` times its source's size, what is over goes to
   the others by weight.
2. Documents are counted by source and exact length. A target of q whole sizes and a rest r takes every document q times. The
   rest is fitted on the counts: every length gives its share, lengths in seeded order narrow what is left, and a bounded
   knapsack over the remaining counts (bit sets of reachable sums) meets the last words.
3. Of each (source, length) the wanted number of documents is taken in seeded hash order. Hash buckets are counted first, so
   that only one bucket per length is cut inside; a length that a third of all documents share is never sorted in one task.

The table of (source, length) counts has at most sqrt(2 * words) lengths per source; the table of sources is ranked as a whole.
Defined cases: null texts and texts without words have size 0 and are taken 0 times; a null source is a source of its own,
ordered last; repeated rows count one by one; an empty table gives no rows.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import word_count, written

MOST = 3
WEIGHTS = (1, 2, 3)
SEED = 11
EXACT_WORDS = 1 << 16
BUCKET_ROWS = 1000


def source_key(c):
    """A key that also names the null source."""
    return F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """key, source, source_size, weight, target from one row per source; weights repeat along the sources in code point order.

    Sources reach their cap in the order of cap per weight; the level of the others follows from sums before and after.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    w = w.withColumn("level", level)
    # the first source whose cap lies above the level sets it for all that follow
    set_by = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("key"), F.col("level")))).over(whole)
    target = F.least(F.col("cap").cast("double"), F.coalesce(set_by["level"], F.lit(float("inf"))) * F.col("weight"))
    return w.select("key", "source", "source_size", "weight", target.alias("target"))


def fit_counts(lengths: list[int], counts: list[int], budget: int, rng: random.Random, exact_words: int = EXACT_WORDS) -> list[int]:
    """How many documents of each length come as near to ``budget`` words as can be, without exceeding it."""
    total = sum(length * n for length, n in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    take = [n * budget // total if length else 0 for length, n in zip(lengths, counts, strict=True)]
    left = budget - sum(length * n for length, n in zip(lengths, take, strict=True))
    order = [i for i, length in enumerate(lengths) if length]
    rng.shuffle(order)
    for i in order:  # one more of each length, as long as the rest is too large for exact sums
        if left <= exact_words:
            break
        if take[i] < counts[i] and lengths[i] <= left:
            take[i] += 1
            left -= lengths[i]
    while left > exact_words and (room := [i for i in order if take[i] < counts[i] and lengths[i] <= left]):
        for i in room:
            n = min(counts[i] - take[i], left // lengths[i], max(1, (left - exact_words) // (lengths[i] * len(room))))
            take[i], left = take[i] + n, left - n * lengths[i]
            if left <= exact_words:
                break
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for i in order:
        room, part = min(counts[i] - take[i], left // lengths[i]), 1
        while room > 0 and not reach >> left & 1:
            n = min(part, room)
            new = (reach << (n * lengths[i])) & mask & ~reach
            if new:
                steps.append((i, n, new))
                reach |= new
            room, part = room - n, 2 * part
    at = reach.bit_length() - 1
    for i, n, new in reversed(steps):
        if new >> at & 1:
            take[i] += n
            at -= n * lengths[i]
    return take


def fit_sources(histogram: DataFrame, shares: DataFrame, seed: int = SEED, exact_words: int = EXACT_WORDS) -> DataFrame:
    """key, size, whole, extra: every document is taken ``whole`` times, ``extra`` documents of that size once more."""
    def fit(key, part):
        part = part.sort_values("size")
        size, target = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
        whole = int(target // size) if size else 0
        rest = min(size, max(0, round(target - whole * size)))
        lengths, counts = part["size"].tolist(), part["n"].tolist()
        part["whole"] = whole
        part["extra"] = fit_counts(lengths, counts, rest, random.Random(f"{seed}:{key[0]}"), exact_words) if rest else 0
        return part[["key", "size", "whole", "extra"]]

    joined = histogram.join(shares.select("key", "source_size", "target"), "key")
    return joined.groupBy("key").applyInPandas(fit, "key string, size bigint, whole bigint, extra bigint")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED, exact_words: int = EXACT_WORDS,
        bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The documents with size, source_size, target and copies (0 to ``most``)."""
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    # the document's own columns travel as one, so that none of them meets a name used here
    sized = docs.select(
        F.struct(*names).alias("doc"), word_count(F.col("text")).alias("size"), source_key(F.col("source")).alias("key"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("pick"))
    histogram = written(sized.groupBy("key", F.col("doc.source").alias("source"), "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = histogram.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    shares = written(targets(sizes, weights, most))
    plan = written(fit_sources(histogram, shares, seed, exact_words))
    rows = histogram.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, rows // max(bucket_rows, math.isqrt(rows)))
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "pick"), F.lit(buckets)))
    # how many documents of each bucket are wanted: all of the first ones, some of the one that reaches the number
    group = Window.partitionBy("key", "size").orderBy("bucket")
    counted = sized.groupBy("key", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    reached = counted.withColumn("before", F.sum("n").over(group) - F.col("n")).join(plan, ["key", "size"])
    wanted = reached.join(shares.select("key", "source_size", "target"), "key").select(
        "key", "size", "bucket", "whole", (F.col("extra") - F.col("before")).alias("wanted"), "source_size", "target")
    own = Window.partitionBy("key", "size", "bucket").orderBy("pick", F.col("doc.doc_id"))
    ranked = sized.withColumn("rank", F.row_number().over(own)).join(wanted, ["key", "size", "bucket"])
    copies = F.when(F.col("size") > 0, F.col("whole") + (F.col("rank") <= F.col("wanted")).cast("bigint")).otherwise(F.lit(0))
    return ranked.select("doc.*", "size", "source_size", "target", copies.cast("bigint").alias("copies"))
