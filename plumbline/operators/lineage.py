"""Schema lineage of many jobs as tables: snapshots, changes between stages, column edges, impact."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.sources.checkpoint import drop, freed, load, store, stored

SLICES = 16
ROW = 1 << 16  # about the most nodes in one row of arrays
PARTS = 16  # the most parts that a round is cut into
PART = 1 << 25  # edges followed in one part of a round, until there are PARTS
SKETCHED = 1 << 23  # edges over which the sketches of one part of the nodes go, until there are COUNTED
COUNTED = 8  # the most parts that the nodes to be counted are dealt to
FOLDERS = 64  # tables of found pairs, before they are written as one
SNAPSHOT = "job string, stage_no int, stage string, column string, type string"


def snapshot(df: DataFrame, job: str, stage_no: int, stage: str) -> DataFrame:
    """The schema of one stage as rows."""
    rows = [(job, stage_no, stage, f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, SNAPSHOT)


def schema_changes(snapshots: DataFrame) -> DataFrame:
    """(job, stage_no, input, output, new, dropped, kept, retyped columns) for each stage after the first of its job."""
    columns = F.array_sort(F.collect_set(F.struct("column", "type")))
    order = Window.partitionBy("job").orderBy("stage_no")
    # one shuffle by job serves the stages and their order
    steps = snapshots.repartition("job").groupBy("job", "stage_no").agg(columns.alias("_new")).withColumn("_old", F.lag("_new").over(order)).where(F.col("_old").isNotNull())
    old, new = F.transform("_old", lambda x: x["column"]), F.transform("_new", lambda x: x["column"])
    changed = F.filter("_new", lambda x: F.array_contains(old, x["column"]) & ~F.array_contains(F.col("_old"), x))
    return steps.select(
        "job", "stage_no", old.alias("input_columns"), new.alias("output_columns"), F.array_except(new, old).alias("new_columns"),
        F.array_except(old, new).alias("dropped_columns"), F.array_intersect(old, new).alias("kept_columns"),
        F.transform(changed, lambda x: x["column"]).alias("retyped_columns"),
    )


def schema_diff(before: DataFrame, after: DataFrame, transformation: str) -> DataFrame:
    """One row that compares the schemas of two tables."""
    both = snapshot(before, transformation, 0, "before").unionByName(snapshot(after, transformation, 1, "after"))
    return schema_changes(both).select(F.col("job").alias("transformation_type"), "input_columns", "output_columns", "new_columns", "dropped_columns")


def parse_edges(answers: DataFrame, answer: str) -> DataFrame:
    """(job, stage_no, source, target, operation) from model text with a ``lineage`` list; unreadable text gives no rows."""
    body = F.from_json(text.outer_json(F.col(answer)),
                       "lineage array<struct<source_columns:array<string>,target_column:string,operation:string>>")
    rows = answers.select("job", "stage_no", F.inline(body["lineage"]))
    return rows.select("job", "stage_no", F.explode("source_columns").alias("source"), F.col("target_column").alias("target"), "operation")


def check_edges(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Adds ``known_source`` and ``known_target``: whether the stage really reads and writes these columns."""
    facts = changes.select("job", "stage_no", "input_columns", "output_columns")
    has = lambda cols, c: F.coalesce(F.array_contains(F.col(cols), F.col(c)), F.lit(False))
    return edges.join(facts, ["job", "stage_no"], "left").select(
        *edges.columns, has("input_columns", "source").alias("known_source"), has("output_columns", "target").alias("known_target")
    )


def chunked(pairs: DataFrame, key: str, item: str) -> DataFrame:
    """Adds ``_chunk``: 0, or for keys with more than ROW items the part of the key's items that this one is in."""
    hubs = pairs.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / ROW).alias("_parts")).where("_parts > 1")
    if hubs.isEmpty():
        return pairs.withColumn("_chunk", F.lit(0))
    return pairs.join(hubs, key, "left").withColumn("_chunk", F.pmod(F.xxhash64(item), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")


def out_links(pairs: DataFrame) -> tuple[DataFrame, str]:
    """(source, on, off, next, top), and the folder it is stored in: targets of each source that have edges and others; edges of the first, in all and the most of one."""
    sources = pairs.groupBy(F.col("source").alias("target")).agg(F.count(F.lit(1)).alias("_next"))
    joined = pairs.join(sources, "target", "left")
    marked = store(joined)
    one, leads = F.array("target"), F.col("_next").isNotNull()  # a list leaves out NULL, but not an array that holds it
    rows = chunked(load(pairs.sparkSession, joined.schema, [marked]), "source", "target")
    lists = rows.repartition("source", "_chunk").groupBy("source", "_chunk").agg(
        F.flatten(F.collect_list(F.when(leads, one))).alias("on"), F.flatten(F.collect_list(F.when(~leads, one))).alias("off"),
        F.coalesce(F.sum("_next"), F.lit(0)).alias("next"), F.coalesce(F.max("_next"), F.lit(0)).alias("top")).drop("_chunk")
    folder = store(lists)
    drop(pairs.sparkSession, [marked])
    return load(pairs.sparkSession, lists.schema, [folder]), folder


def in_slices(rows: DataFrame, heavy: DataFrame | None, none: Column) -> DataFrame:
    """Adds ``slice``: 0 for whole rows; rows of heavy starts fall into single nodes, dealt to the start's slices by their hash."""
    if heavy is None:
        return rows.withColumn("slice", F.lit(0))
    piece = lambda on, off, more: F.struct(on.alias("on"), off.alias("off"), more.alias("next"))
    single = F.concat(F.transform("on", lambda x: piece(F.array(x), none, F.col("top"))), F.transform("off", lambda x: piece(none, F.array(x), F.lit(0).cast("bigint"))))
    whole = F.array(piece(F.col("on"), F.col("off"), F.col("next")))
    out = rows.join(heavy, "start", "left").select("start", "known", "slices", F.explode(F.when(F.col("slices").isNull(), whole).otherwise(single)).alias("_p"))
    of = F.pmod(F.xxhash64(F.concat("_p.on", "_p.off")[0]), F.col("slices")).cast("int")
    return out.select("start", "known", "_p.on", "_p.off", "_p.next", F.coalesce(of, F.lit(0)).alias("slice"))


def impact(edges: DataFrame, starts: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(start, node, depth): everything reachable from each start along (source, target) edges, at its smallest depth.

    Each round follows the edges of the pairs found in the last one and stores what is new, so plans stay short and finished rounds
    survive the loss of executors. Stops when a round finds nothing new or only nodes without edges; ``max_rounds``
    raises an error beyond so many rounds. The result holds every pair; where only counts are asked, see :func:`reach_sizes`.

    Pairs of a start lie in arrays of nodes, those with edges and others apart. Where a round may bring a start to more than ROW pairs,
    they are moved as single nodes in several slices, so that no start is one task's work. A round that follows many edges
    takes one part of the starts after another, at most PARTS; shuffle files go as soon as a part is stored.
    """
    spark = edges.sparkSession
    with freed(spark):
        distinct = edges.select("source", "target").where("source is not null").distinct()
        folder = store(distinct)
        pairs = load(spark, distinct.schema, [folder])
        total = pairs.count()
        links, linked = out_links(pairs)
        kind = links.schema["off"].dataType
        none, start = F.array_repeat(F.lit(None).cast(kind.elementType), 0), F.col("start").cast(kind.elementType)
        counts = pairs.groupBy("source").agg(F.count(F.lit(1)).alias("next"))
        first = starts.select("start").distinct().join(counts, start == F.col("source"), "left").withColumns(
            {"on": F.when(F.col("next").isNull(), none).otherwise(F.array(start)), "off": F.when(F.col("next").isNull(), F.array(start)).otherwise(none)})
        shown = lambda df, depth: df.select("start", F.lit(depth).alias("depth"), "on", "off", F.coalesce("next", F.lit(0)).alias("next"), F.size("on").alias("leads"), (F.size("on") + F.size("off")).alias("held"))
        seeds = shown(first, 0)
        found = [(1, 0, store(seeds))]  # (parts, part, folder): starts whose hash falls into this part of so many
        drop(spark, [folder])
        for depth in itertools.count(1):
            if max_rounds is not None and depth > max_rounds:
                raise RuntimeError(f"no fixpoint within {max_rounds} rounds")
            last = (F.col("depth") == depth - 1) & (F.col("leads") > 0)
            loads = load(spark, seeds.schema, [f for _, _, f in found]).groupBy("start").agg(
                F.sum("held").alias("_held"), F.least(F.coalesce(F.sum(F.when(last, F.col("next"))), F.lit(0)), F.lit(total)).alias("_work")).where("_work > 0")
            loads = loads.select("start", "_work", F.ceil((F.col("_held") + F.col("_work")) / ROW).alias("slices"))
            work, most = loads.agg(F.sum("_work"), F.max("slices")).first()
            if not work:
                drop(spark, [linked])
                return load(spark, seeds.schema, [f for _, _, f in found]).select("start", F.explode(F.concat("on", "off")).alias("node"), "depth")
            parts = min(PARTS, 1 << max(0, math.ceil(math.log2(work / PART))))
            old, near, heavy, used = list(found), links, None, []
            if most > 1:
                used.append(store(loads.where("slices > 1").select("start", "slices")))
                heavy = load(spark, loads.select("start", "slices").schema, used)
            if parts > 1:
                front = load(spark, seeds.schema, [f for _, _, f in old]).where(last).select(F.explode("on").alias("source")).distinct()
                used.append(store(links.join(front, "source", "left_semi")))
                near = load(spark, links.schema, used[-1:])
            for part in range(parts):
                rows = load(spark, seeds.schema, [f for n, k, f in old if k % min(n, parts) == part % min(n, parts)])
                rows = rows.where(F.pmod(F.xxhash64("start"), F.lit(parts)) == part)
                step = rows.where(last).select("start", F.explode("on").alias("source")).join(near, "source")
                both = step.select("start", F.lit(False).alias("known"), "on", "off", "next", "top").unionByName(
                    rows.select("start", F.lit(True).alias("known"), "on", "off", F.lit(0).cast("bigint").alias("next"), F.lit(0).cast("bigint").alias("top")))
                lists = {f"_{c}{n}": F.flatten(F.collect_list(F.when(F.col("known") == k, F.col(c)))) for c in ("on", "off") for n, k in enumerate((False, True))}
                merged = in_slices(both, heavy, none).repartition("start", "slice").groupBy("start", "slice").agg(
                    F.sum("next").alias("next"), *[v.alias(c) for c, v in lists.items()])
                new = merged.select("start", F.array_except("_on0", "_on1").alias("on"), F.array_except("_off0", "_off1").alias("off"), "next")
                found.append((parts, part, store(shown(new, depth).where("held > 0"))))
            drop(spark, used)
            if len(found) > FOLDERS:
                merged = store(load(spark, seeds.schema, [f for _, _, f in found]))
                drop(spark, [f for _, _, f in found])
                found = [(1, 0, merged)]


def reach_sizes(edges: DataFrame, precision: int = 12, max_rounds: int | None = None) -> DataFrame:
    """(node, nodes, rounds): about how many nodes, itself included, can be reached from each node of the edges, without the pairs.

    Every node holds a sketch of distinct nodes and takes in those of its targets, round after round, until no estimate changes, so
    the work is edges times the longest way, also for cycles and for nodes with many edges (sketches are merged before the
    shuffle). The relative error is about ``1.04 / sqrt(2 ** precision)``. ``rounds`` is the last round that changed the estimate.

    With many edges the nodes to be counted are dealt by their hash to up to COUNTED parts, which are counted one after another and added
    up; a part's sketches have so many times fewer registers, so the error stays and sketches and shuffles shrink.
    """
    spark = edges.sparkSession
    with freed(spark):
        distinct = edges.select("source", "target").where("source <> target").distinct()
        folder = store(distinct)
        pairs = load(spark, distinct.schema, [folder])
        total = pairs.count()
        parts = min(COUNTED, 1 << max(0, precision - 4), 1 << max(0, math.ceil(math.log2(max(total, 1) / SKETCHED))))
        lists = chunked(pairs, "target", "source").repartition("target", "_chunk").groupBy("target", "_chunk").agg(F.collect_list("source").alias("sources"))
        ends = edges.select(F.explode(F.array("source", "target")).alias("node")).where("node is not null").distinct()
        made = [store(lists.drop("_chunk")), store(ends)]
        links, nodes = load(spark, lists.drop("_chunk").schema, made[:1]), load(spark, ends.schema, made[1:])
        drop(spark, [folder])
        bits = precision - (parts.bit_length() - 1)
        sizes = []
        for part in range(parts):
            state = nodes.where(F.pmod(F.xxhash64("node"), F.lit(parts)) == part).groupBy("node").agg(F.hll_sketch_agg("node", F.lit(bits)).alias("sketch"))
            state = state.select("node", "sketch", F.lit(1).cast("bigint").alias("nodes"), F.lit(0).alias("rounds"))
            schema, folder = state.schema, store(state)
            for number in itertools.count(1):
                if max_rounds is not None and number > max_rounds:
                    raise RuntimeError(f"no fixpoint within {max_rounds} rounds")
                state = load(spark, schema, [folder])
                moved = state.where(F.col("rounds") == number - 1).select(F.col("node").alias("target"), "sketch")
                taken = links.join(moved, "target").select(F.explode("sources").alias("node"), "sketch", F.lit(None).cast("bigint").alias("nodes"), F.lit(None).cast("int").alias("rounds"), F.lit(True).alias("_taken"))
                joined = state.withColumn("_taken", F.lit(False)).unionByName(taken).groupBy("node").agg(
                    F.hll_union_agg("sketch").alias("sketch"), F.max("nodes").alias("_nodes"), F.max("rounds").alias("_rounds"), F.bool_or("_taken").alias("_taken"))
                size = F.when(F.col("_taken"), F.hll_sketch_estimate("sketch")).otherwise(F.col("_nodes"))
                changed = F.when(size.eqNullSafe(F.col("_nodes")), F.col("_rounds")).otherwise(F.lit(number))
                past, folder = folder, store(joined.select("node", "sketch", size.alias("nodes"), changed.alias("rounds")))
                drop(spark, [past])
                if load(spark, schema, [folder]).where(F.col("rounds") == number).isEmpty():
                    break
            sizes.append(store(load(spark, schema, [folder]).drop("sketch")))
            drop(spark, [folder])
        counted = load(spark, state.drop("sketch").schema, sizes)
        drop(spark, made)
        if parts == 1:
            return counted
        out = stored(counted.groupBy("node").agg(F.sum("nodes").alias("nodes"), F.max("rounds").alias("rounds")))
        drop(spark, sizes)
        return out


def job_record(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """(job, transformations): ordered stages of each job with their schema change and number of edges, as JSON."""
    counts = edges.groupBy("job", "stage_no").agg(F.count(F.lit(1)).alias("edges"))
    rows = changes.join(counts, ["job", "stage_no"], "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    item = F.struct("stage_no", "input_columns", "output_columns", "new_columns", "dropped_columns", "edges")
    return rows.groupBy("job").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("transformations"))
