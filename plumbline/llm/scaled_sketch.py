"""Document fingerprints: every shingle hash below a fixed fraction of the range is kept (a threshold-scaled sketch).

A shingle is five words in a row, a word is a run of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased; a text with one to four words is one
shingle. Its hash is the first 64 bits of its MD5. A fingerprint holds the distinct hashes below ``share`` of the range, in
ascending order, so fingerprints of parts can be merged and those of very unequal documents compared: what two sketches hold below a
common limit are the same shingles' hashes, whatever the sizes. A text with fewer than ``least`` such hashes keeps its ``least``
smallest, so that short texts have a fingerprint too; how far a sketch is complete can be read from it (``_limit``).

``likeness`` (Jaccard) and ``containment`` are ratios of counts below the smaller of the two limits. Both are exact for texts with
fewer than ``least`` shingles.

``with_next`` gives every row its successor in descending doc_id without a window over all rows: borders from sketched quantiles cut
the order into buckets, and each bucket also gets the first row of the bucket after it. Only built-in functions are used.

Defined cases: null texts are empty; a text without words has the empty fingerprint, two of them have likeness 1, one of them 0 with any other;
null ids come last; rows with the same id are ordered by hash of text; the successor of the last row is the first, a single row is its own; texts count
whole whatever their length (hashes grow with them); an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written

WORDS = 5
SHARE = 8  # one of so many hashes is kept
LEAST = 32
BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 65_536
CELLS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     "


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also if it is used inside other lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def border(share: int = SHARE) -> str:
    """Last hash that is always kept."""
    return f"{(1 << 64) // share - 1:016x}"


def shingles(text: Column, size: int = WORDS) -> Column:
    """All runs of ``size`` words, joined by blanks; a shorter text is one."""
    words = F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), " "), "")
    # at the start of each word the look-ahead takes the run, the match only the word
    run = f"(?<![^ ])(?=([^ ]++(?: [^ ]++){{{size - 1}}}))[^ ]++"
    short = lambda line: F.when(line != "", F.array(line)).otherwise(F.array().cast("array<string>"))
    return bind(F.array_join(words, " "), lambda line: bind(F.regexp_extract_all(line, F.lit(run), F.lit(1)), lambda found: F.when(F.size(found) > 0, found).otherwise(short(line))))


def sketch(text: Column, share: int = SHARE, least: int = LEAST, size: int = WORDS) -> Column:
    """Ascending array of the kept hashes, 16 hexadecimal digits each."""
    def least_of(h: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(h, lambda x: F.substring(x, 1, 16))))

    def keep(h: Column) -> Column:
        low = least_of(F.filter(h, lambda x: x < f"{(1 << 64) // share:016x}"))
        return bind(low, lambda s: F.when(F.size(s) >= least, s).otherwise(F.slice(least_of(h), 1, least)))

    return bind(F.transform(shingles(text, size), lambda x: F.md5(x)), keep)


def packed(kept: Column) -> Column:
    """Eight bytes per hash."""
    return F.unhex(F.array_join(kept, ""))


def unpacked(data: Column) -> Column:
    """The hashes of ``packed``."""
    def cut(d: Column) -> Column:
        n = (F.octet_length(d) / 8).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lower(F.hex(F.substring(d, i * 8 + 1, F.lit(8)))))).otherwise(F.array().cast("array<string>"))

    return bind(data, cut)


def _limit(kept: Column, share: int, least: int) -> Column:
    """Up to here the sketch holds every hash of its text."""
    return F.when(F.size(kept) < least, F.lit("~")).otherwise(F.greatest(F.element_at(kept, -1), F.lit(border(share))))


def _compared(a: Column, b: Column, share: int, least: int, use) -> Column:
    """``use`` of what both sketches hold below their common limit, and the size of the first."""
    def common(v: Column) -> Column:
        t = F.least(_limit(v["a"], share, least), _limit(v["b"], share, least))
        low = lambda x: bind(t, lambda t: F.filter(x, lambda h: h <= t))
        return bind(F.struct(low(v["a"]).alias("a"), low(v["b"]).alias("b"), F.size(v["a"]).alias("n")), lambda w: use(w["a"], w["b"], w["n"]))

    return bind(F.struct(a.alias("a"), b.alias("b")), common)


def likeness(a: Column, b: Column, share: int = SHARE, least: int = LEAST) -> Column:
    """Estimated Jaccard similarity of the texts behind two sketches."""
    def use(x, y, _):
        common = F.size(F.array_intersect(x, y))
        every = F.size(x) + F.size(y) - common
        return F.when(every == 0, F.lit(1.0)).otherwise(common / every)

    return _compared(a, b, share, least, use)


def containment(a: Column, b: Column, share: int = SHARE, least: int = LEAST) -> Column:
    """Estimated share of the shingles of the first text that the second holds; null if the first shows none below the common limit."""
    def use(x, y, n):
        return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)).when(n == 0, F.lit(1.0))

    return _compared(a, b, share, least, use)


def merged(kept: DataFrame, by: str, column: str = "sketch", share: int = SHARE, least: int = LEAST) -> DataFrame:
    """``by`` and the sketch of all its rows' shingles: hashes below the common limit of the parts. One row holds a group's sketch, as its result."""
    limits = kept.groupBy(by).agg(F.min(_limit(F.col(column), share, least)).alias("limit"))
    hashes = kept.select(by, F.explode_outer(column).alias("hash")).distinct()
    of_group = hashes.join(limits.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).filter("hash is null or hash <= limit")
    sets = of_group.groupBy(by).agg(F.array_sort(F.collect_list("hash")).alias("all"), F.count(F.when(F.col("hash") <= border(share), 1)).alias("low"))
    return sets.select(by, F.slice("all", 1, F.greatest("low", F.lit(least))).alias(column))


def _key(doc_id: Column, h: Column) -> Column:
    """A number that never falls along (doc_id, h): ids by 2**32 with the upper bits of h between them, null ids below all."""
    fine = F.shiftright(h, 32).cast("double") + float(1 << 31)
    ids = doc_id.cast("double")
    return (F.when(ids.isNull(), fine * float(1 << 64) - float(1 << 98)).when(F.abs(ids) < float(1 << 52), ids * float(1 << 32) + fine).otherwise(ids * float(1 << 32)))


def _bucket(key: Column, borders: list[float]) -> Column:
    """Number of borders up to the key, by halving."""
    if not borders:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(repr, borders))), ",").cast("array<double>")
    steps = F.lit(list(range(len(borders).bit_length())))

    def step(range_: Column, _: Column) -> Column:
        lo, hi = range_["lo"], range_["hi"]
        middle = F.floor((lo + hi) / 2).cast("int")
        up = (lo < hi) & (F.get(table, middle) <= key)
        return F.struct(F.when(up, middle + 1).otherwise(lo).alias("lo"), F.when((lo < hi) & ~up, middle).otherwise(hi).alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(borders)).alias("hi")), step)["lo"]


def with_next(docs: DataFrame, carried: dict[str, Column], bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, text and the columns ``carried`` (worked out once per row), and next_* of them, the successor's in descending doc_id."""
    names = ["text", *carried]
    rows = docs.select("doc_id", "text").withColumn("_hash", F.xxhash64("text")).withColumn("_key", _key(F.col("doc_id"), F.col("_hash")))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(MOST_BUCKETS, max(2 * partitions, -(-total // bucket_bytes)))
    # quantiles of quantiles: they only balance the buckets
    shares = F.lit([i / wanted for i in range(1, wanted)])
    cells = rows.groupBy((F.spark_partition_id() % CELLS).alias("cell")).agg(F.percentile_approx("_key", shares, max(10_000, 10 * wanted)).alias("q"))
    found = cells.select(F.explode("q").alias("q")).agg(F.percentile_approx("q", shares, max(10_000, 10 * wanted))).first()[0]
    rows = rows.withColumn("_bucket", _bucket(F.col("_key"), sorted(set(found or []))))
    # the first row of each bucket also closes the one before it in the order; at most MOST_BUCKETS rows
    heads = rows.groupBy("_bucket").agg(F.max(F.struct("doc_id", "_hash")).alias("head"))
    every = Window.orderBy("_bucket")
    to = F.coalesce(F.lead("_bucket").over(every), F.first("_bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = written(heads.withColumn("_to", to).select(F.col("head.doc_id").alias("_id"), F.col("head._hash").alias("_h"), "_to"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h"))
    closing = rows.join(F.broadcast(heads), same).dropDuplicates(["_to"])
    kept = ["doc_id", "text", *[c.alias(n) for n, c in carried.items()], "_hash"]
    both = rows.select(*kept, "_bucket", F.lit(0).alias("_last")).union(closing.select(*kept, F.col("_to"), F.lit(1)))
    order = Window.partitionBy("_bucket").orderBy("_last", F.col("doc_id").desc_nulls_last(), F.col("_hash").desc(), F.col("text").desc_nulls_last())
    return both.select("doc_id", *names, "_last", *[F.lead(c).over(order).alias(f"next_{c}") for c in names]).filter("_last = 0").drop("_last")


def fingerprint_edited(docs: DataFrame, share: int = SHARE, least: int = LEAST, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by as many first characters (or all) of the next document's text.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, {"sketch": packed(sketch(F.col("text"), share, least))}, bucket_bytes)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), share, least))
    near = lambda other: likeness(unpacked(F.col("sketch")), other, share, least)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.lower(F.hex("sketch")).alias("fingerprint"), F.array_join("edited_sketch", "").alias("edited_fingerprint"),
        near(F.col("edited_sketch")).alias("near_edited"), near(unpacked(F.col("next_sketch"))).alias("near_next"))
