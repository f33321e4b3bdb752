"""Order statistics of growing frames: for every row the median of what lies before it.

A percentile over a growing frame sorts the whole past again for every row. Here the values of a series are ranked once and
all rows look for their median together: the ranks are split into sixteen parts, running counts along time tell how many earlier
values lie in each part, every search steps into the part that holds its rank, and so on until a part is one value. The work is
rows times levels, and the levels grow with the logarithm of the longest series. All steps keep the partitioning of the series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 4


def levels_of(longest: int) -> int:
    """Steps of BITS bits that tell so many ranks apart."""
    return max(1, -(-max(0, longest - 1).bit_length() // BITS))


def running_median(rows: DataFrame, keys: list[str], order: str, value: str = "value", name: str = "median", longest: int | None = None) -> DataFrame:
    """Adds ``name``: the median of the values of the same keys earlier in ``order``; missing values do not count, NULL where there are none.

    ``longest`` is the number of values of the longest series or more; left out, it is counted, which runs a job on ``rows``.
    """
    if longest is None:
        longest = rows.groupBy(*keys).agg(F.count(value).alias("_n")).agg(F.max("_n")).first()[0] or 0
    series, v = Window.partitionBy(*keys), F.col(value)
    by_time = series.orderBy(order)
    ranked = rows.withColumns({
        "_t": F.row_number().over(by_time), "_before": F.count(value).over(by_time.rowsBetween(Window.unboundedPreceding, -1)),
        "_rank": F.when(v.isNotNull(), F.row_number().over(series.orderBy(v.asc_nulls_last(), order)) - 1),
    })
    search = lambda k: F.struct(F.lit(False).alias("own"), F.floor(k).cast("bigint").alias("k"))
    own = F.array(F.struct(F.lit(True).alias("own"), F.lit(0).cast("bigint").alias("k")))
    middle = F.array_distinct(F.array(search((F.col("_before") + 1) / 2), search(F.col("_before") / 2 + 1)))
    found = ranked.withColumn("_ask", F.explode(F.when(F.col("_before") > 0, F.concat(own, middle)).otherwise(own)))
    found = found.withColumns({"_own": F.col("_ask.own"), "_k": F.col("_ask.k"), "_node": F.lit(0).cast("bigint")}).drop("_ask")
    last = (1 << BITS) - 1
    for level in reversed(range(levels_of(longest))):
        digit = F.shiftright("_rank", BITS * level).bitwiseAND(F.lit(last))
        # at equal times searches (own is false) sort before the row itself, which is not part of its own past
        past = Window.partitionBy(*keys, "_node").orderBy("_t", "_own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = found.withColumns({f"_c{j}": F.sum(F.when(F.col("_own") & (digit <= j), 1).otherwise(0)).over(past) for j in range(last)})
        passed = [F.col(f"_c{j}") < F.col("_k") for j in range(last)]
        child = F.when(F.col("_own"), digit).otherwise(sum((p.cast("int") for p in passed), F.lit(0)))
        skipped = F.greatest(*[F.when(p, F.col(f"_c{j}")).otherwise(F.lit(0)) for j, p in enumerate(passed)])
        found = found.withColumns({"_node": F.col("_node") * (1 << BITS) + child, "_k": F.col("_k") - skipped}).drop(*[f"_c{j}" for j in range(last)])
    at = F.max(F.when(F.col("_own"), v.cast("double"))).over(Window.partitionBy(*keys, "_node"))
    found = found.withColumn("_at", at).withColumn(name, F.avg(F.when(~F.col("_own"), F.col("_at"))).over(Window.partitionBy(*keys, "_t")))
    return found.where("_own").select(*rows.columns, name)
