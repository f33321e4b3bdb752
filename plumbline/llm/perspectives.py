"""Chat formatting: the same dialogue from the side of every participant.

For each participant of a conversation the dialogue is rendered with that participant as the assistant and everybody else as
a named user; the assistant's words and the sign that ends them are marked for training. Turns of ``system`` stay system turns
in every rendering and are nobody's side.

Format of a turn: ``<|im_start|>ROLE[ name=NAME]\\nTEXT<|im_end|>\\n``. Texts and names cannot forge these signs: ``<|`` in a text
becomes ``< |``, and a name keeps letters, digits, ``_``, ``-`` and ``.`` of ASCII only (others become ``_``).

A rendering comes in parts of ``part_turns`` turn numbers, so that a conversation of any length never meets in one task; spans
are code points within the part, ends excluded. Only built-in functions are used.

Defined cases: a turn without role is spoken by ``unknown``, who is a participant like others; a null text is empty; turns
without number follow in parts of their own, dealt by hash (part -1 and below); equal turn numbers are ordered by role, then
text; repeated rows are rendered as often as they come; conversations without participant (system only) give no row; a null
conv_id is a conversation of its own; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART_TURNS = 512
LOOSE_PARTS = 64


def _turns(talks: DataFrame, part_turns: int) -> DataFrame:
    speaker = F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit("unknown"))
    loose = -1 - F.pmod(F.xxhash64("role", "text"), F.lit(LOOSE_PARTS))
    return talks.select(
        "conv_id", F.coalesce(F.floor(F.col("turn") / part_turns), loose).cast("bigint").alias("part"), F.col("turn").cast("bigint").alias("turn"),
        F.regexp_replace(speaker, "[^A-Za-z0-9_.-]", "_").alias("speaker"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"))


def rotate(talks: DataFrame, system: str = "system", part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, participant, part, n_turns, n_trained, rendered, spans (array of start and end)."""
    turns = _turns(talks, part_turns)
    key = ("conv_id", "part")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(0)).alias("turn"), "speaker", "text")))
    parts = turns.groupBy(*key).agg(order.alias("turns"))
    sides = turns.filter(F.col("speaker") != system).select("conv_id", F.col("speaker").alias("participant")).distinct()
    both = parts.join(sides.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")

    def head(t):
        role = (F.when(t["speaker"] == F.col("participant"), F.lit("assistant")).when(t["speaker"] == system, F.lit("system"))
                .otherwise(F.concat(F.lit("user name="), t["speaker"])))
        return F.concat(F.lit(START), role, F.lit("\n"))

    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), t["text"].alias("text"), (t["speaker"] == F.col("participant")).alias("own")))
    both = both.withColumn("pieces", pieces)
    tail = len(END) + 1
    # places follow from the lengths of what comes before
    walk = F.aggregate(
        "pieces", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["text"]) + tail).alias("at"),
            F.when(p["own"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(p["head"])).alias("start"), (acc["at"] + F.length(p["head"]) + F.length(p["text"]) + len(END)).alias("end")))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    rendered = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], F.lit(END + "\n"))), "")
    return both.select(
        "conv_id", "participant", "part", F.size("turns").alias("n_turns"), F.size(F.filter("pieces", lambda p: p["own"])).alias("n_trained"),
        rendered.alias("rendered"), walk.alias("spans"))
