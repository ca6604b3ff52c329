"""The most frequent values of a count table, within a bound on their number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayline.llm.store import materialise

#: Classes of counts for each doubling.
STEPS = 16


def most_frequent(counts: DataFrame, bound: int, n: str = "n") -> DataFrame:
    """The rows of counts with the highest n, never more than bound rows.

    Counts fall into classes of nearly equal n, a few hundred at most; the driver sees how many
    rows each class has and takes whole classes from the top as long as they fit. Nothing is
    sorted, and only chosen rows leave the executors.
    """
    counts = materialise(counts)
    step = F.floor(F.log2(F.col(n)) * STEPS)
    classes = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect(), reverse=True)
    total, least = 0, None
    for step_value, rows in classes:
        total += rows
        if total > bound:
            break
        least = step_value
    return counts.where(F.lit(False) if least is None else step >= F.lit(least))
