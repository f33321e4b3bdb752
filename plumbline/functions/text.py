"""Regular expressions and text-to-value parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date layouts that count as a date when a text column is typed.
DATE_LAYOUTS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy",
)


def anchored(pattern: str) -> str:
    """The same pattern, tied to the start of the text."""
    return f"^(?:{pattern})"


def java_pattern(pattern: str, unicode: bool = False) -> str:
    """Java reading of a pattern; ``unicode`` widens ``\\w`` and ``\\d`` beyond ASCII."""
    return f"(?U){pattern}" if unicode else pattern


def search(c: Column, pattern: str, unicode: bool = False) -> Column:
    """True where ``pattern`` occurs anywhere in ``c``."""
    return c.cast("string").rlike(java_pattern(pattern, unicode))


def match_start(c: Column, pattern: str, unicode: bool = False) -> Column:
    """True where ``c`` starts with a match of ``pattern``."""
    return c.cast("string").rlike(java_pattern(anchored(pattern), unicode))


def parse_date(c: Column, layouts: tuple[str, ...] = DATE_LAYOUTS) -> Column:
    """Timestamp of ``c`` by the first layout that fits, else NULL."""
    return F.coalesce(*[F.try_to_timestamp(c.cast("string"), F.lit(f)) for f in layouts])


def contains_any(c: Column, words) -> Column:
    """True where the lower-cased ``c`` holds one of ``words``."""
    low = F.lower(c)
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w)
    return hit


def first_keyword_label(c: Column, labelled, default: str) -> Column:
    """Label of the first (label, words) pair with a hit in ``c``."""
    out = None
    for label, words in labelled:
        cond = contains_any(c, words)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


def all_keyword_labels(c: Column, labelled, default: str) -> Column:
    """Comma-joined labels of every (label, words) pair with a hit in ``c``."""
    hits = F.array_compact(F.array(*[F.when(contains_any(c, words), label) for label, words in labelled]))
    return F.when(F.size(hits) == 0, default).otherwise(F.array_join(hits, ", "))


def outer_json(c: Column) -> Column:
    """Text from the first ``{`` to the last ``}``, NULL without one."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def outer_list(c: Column) -> Column:
    """Text from the first ``[`` to the last ``]``, NULL without one."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\[.*\])", 1), F.lit(""))
