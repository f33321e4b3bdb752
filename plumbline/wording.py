"""Sentences of reports, in one place: the operators build them with Spark expressions, the registered SQL with CASE.

``{}`` stands for the column a metric belongs to. Limits that decide between them live with the operators.
"""

# Advice per severity; the last entry is for metrics without history.
ADVICE = {
    "CRITICAL": "Stop and look at what feeds {} now",
    "HIGH": "Look into how {} is loaded today",
    "MEDIUM": "Plan a check of {} for tomorrow",
    "LOW": "Keep {} on the list of the next regular check",
}
NO_ADVICE = "Collect more periods of {} first"

# How far a value moved, from the largest share of its baseline (percent) down.
MOVES = ((200, "far"), (100, "a lot"), (50, "clearly"))
SMALL_MOVE = "a little"
UP, DOWN = "up", "down"

# What to change on a detector that a metric sets off, from the largest distance (deviations) down.
TUNING = (
    (4, "expect 1% outliers, ask for 0.7 agreement"),
    (3, "expect 1.5% outliers, ask for 0.6 agreement"),
    (2, "keep 2% outliers and 0.5 agreement"),
)
LOOSE_TUNING = "expect 3% outliers, ask for 0.4 agreement"

# What to repair per quality dimension.
REPAIRS = {
    "Completeness": "find where values of {} get lost",
    "Accuracy": "recompute {} from its source and compare",
    "Consistency": "bring all producers of {} to one format",
    "Validity": "test {} against its rules",
    "Uniqueness": "find out why {} comes twice",
}
LATE_REPAIR = "check how often {} is refreshed"
NOW, SOON = "now: ", "soon: "

DEADLINES = {True: "within 2 hours", False: "within 4 hours"}  # critical or not
OWNERS = {True: "pipeline owners", False: "quality owners"}  # missing data or anything else


def sql_fill(template: str, column: str) -> str:
    """The template as a SQL expression around ``column``."""
    before, after = template.split("{}")
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return f"{quote(before)} || {column} || {quote(after)}"
