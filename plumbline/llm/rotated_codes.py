"""Nearest neighbours by inner product with randomly rotated codes of few bits.

Each vector is scaled to length 1, rotated by one random orthogonal matrix and reduced to one byte per component (or to the signs,
packed eight to a byte), with two scalars: its length and its inner product with its own code, scaled to length 1. From these the inner product with a
rotated query is estimated without bias, with an error of about ``sqrt((1 - f^2) / f^2 / (d - 1))`` times both lengths, f being
the second scalar. Candidates whose upper bound (``sigmas`` times that error) reaches the k-th best exact score are scored on
the original vectors in double precision; the others are passed over.

Queries and candidates meet in blocks: every block of queries with every block of candidates, one task each, so that no task
holds more than two blocks. Blocks are dealt by a hash of the row, so a vector that many rows share is spread evenly.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without
vec_id; vectors meet only vectors of their own length; repeated rows are rows of their own (a repeated query row has the other
one as candidate); ties go to the smaller vec_id; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written

SEED = 7
SIGMAS = 4.5
BITS = 8  # per component; with signs alone nearly every candidate of 64 dimensions stays within the bound
QUERY_BLOCK = 4096
ROW_BLOCK = 8192
SLACK = 1e-5  # rounding of the single-precision estimates, relative to both lengths


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """The same random orthogonal matrix in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(vectors: np.ndarray, turn: np.ndarray, bits: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (packed signs, or bytes for 8 bits), lengths, and inner products of each rotated unit vector with its own code."""
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    turned = (vectors / lengths[:, None]).astype(np.float32) @ turn
    if bits == 8:
        levels = np.clip(np.floor(turned / np.abs(turned).max(axis=1, keepdims=True) * 127.5), -128, 127).astype(np.int8)
        places = levels + 0.5
        return levels.view(np.uint8), lengths, (places * turned).sum(axis=1) / np.sqrt((places**2).sum(axis=1)) / np.sqrt((turned.astype(np.float64) ** 2).sum(axis=1))
    own = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return np.packbits(turned > 0, axis=1), lengths, own


def estimate(codes: np.ndarray, own: np.ndarray, queries: np.ndarray, turn: np.ndarray, bits: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (queries x vectors) from the codes, and one standard error per vector."""
    d = turn.shape[0]
    if bits == 8:
        places = codes.view(np.int8).astype(np.float32) + np.float32(0.5)
        places /= np.sqrt((places**2).sum(axis=1, keepdims=True))
    else:
        places = (np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1) / np.sqrt(np.float32(d))
    unit = queries / np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))[:, None]
    got = (unit.astype(np.float32) @ turn) @ places.T / own
    return got, np.sqrt(np.maximum(0, 1 - own**2) / own**2 / max(1, d - 1))


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    return np.cumsum(vectors.astype(np.float64) * query.astype(np.float64), axis=1)[:, -1]


def search_block(rows, queries, k: int, sigmas: float, seed: int = SEED, step: int = 128) -> Iterator[tuple]:
    """(query row, query id, vec_id, score) of the k best candidates of one block, for each query of another."""
    stack = lambda f: np.stack(f["vector"].to_numpy()).astype(np.float64)
    vectors, ids, marks = stack(rows), rows["vec_id"].to_numpy(), rows["row"].to_numpy()
    turn = rotation(vectors.shape[1], seed)
    lengths = rows["length"].to_numpy()
    codes, own = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1), rows["own"].to_numpy()
    asked, names, askers = stack(queries), queries["vec_id"].to_numpy(), queries["row"].to_numpy()
    for at in range(0, len(asked), step):
        part = asked[at : at + step]
        cosines, error = estimate(codes, own, part, turn, BITS)
        for i, q in enumerate(part):
            size = np.sqrt((q.astype(np.float64) ** 2).sum())
            open_ = marks != askers[at + i]
            guess = np.where(open_, cosines[i] * lengths * size, -np.inf)
            n = min(k, int(open_.sum()))
            if not n:
                continue
            first = np.argpartition(-guess, n - 1)[:n]
            floor = exact(vectors[first], q).min()  # so many reach this score; better ones must have an upper bound above it
            reach = open_ & ((cosines[i] + sigmas * error + SLACK) * lengths * size >= floor)
            reach[first] = True
            chosen = np.flatnonzero(reach)
            scores = exact(vectors[chosen], q)
            best = np.lexsort((ids[chosen], -scores))[:n]
            yield from zip([askers[at + i]] * n, [names[at + i]] * n, ids[chosen][best], scores[best], strict=True)


def usable(table: DataFrame) -> DataFrame:
    """row, vec_id, vector, dim of the rows that take part."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.filter(F.col("vec_id").isNotNull() & fine).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.size("embedding").alias("dim"))


def coder(seed: int = SEED):
    """Adds code, length, own to frames of rows."""
    def code(batches: Iterator) -> Iterator:
        for f in batches:
            f["code"], f["length"], f["own"] = None, 0.0, 0.0
            for d in f["dim"].unique():
                here = np.flatnonzero(f["dim"] == d)
                packed, lengths, own = encode(np.stack(f["vector"].iloc[here].to_numpy()), rotation(int(d), seed), BITS)
                f.loc[f.index[here], "code"] = [c.tobytes() for c in packed]
                f.loc[f.index[here], "length"], f.loc[f.index[here], "own"] = lengths, own
            yield f

    return code


def with_codes(vectors: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds code, length, own; every row is indexed."""
    return vectors.mapInPandas(coder(seed), "row bigint, vec_id bigint, vector array<double>, dim int, code binary, length double, own double")


def nearest(table: DataFrame, is_query, k: int = 20, sigmas: float = SIGMAS, seed: int = SEED, query_block: int = QUERY_BLOCK,
            row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of every row for which ``is_query`` holds."""
    index = written(with_codes(usable(table), seed))
    queries = index.filter(is_query)
    of = lambda df, size: max(1, -(-df.count() // size))
    row_blocks, query_blocks = of(index, row_block), of(queries, query_block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    rows = index.withColumn("rb", dealt(row_blocks, 1)).withColumn("qb", every(query_blocks))
    asked = queries.select("row", "vec_id", "vector", "dim", dealt(query_blocks, 2).alias("qb")).withColumn("rb", every(row_blocks))

    def search(key, mine, theirs):
        import pandas as pd

        found = search_block(mine, theirs, k, sigmas, seed) if len(mine) and len(theirs) else ()
        return pd.DataFrame(found, columns=["query_row", "query_id", "vec_id", "score"])

    keys = ("dim", "qb", "rb")
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_row bigint, query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
