"""Places of rows inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def with_places(rows: DataFrame, groups: list[str], order: list[str], place: str, size: str, bins: int = 1024) -> DataFrame:
    """rows with their place in the group, from 0, by order, and the group's size.

    The first column of order is a number or a time. Each group's range of it is cut into bins of
    equal width; rows are ranked inside their bin and the counts of the bins before are added, so
    no task ranks a whole group. Nulls come first.
    """
    lead = F.col(order[0])
    if isinstance(rows.schema[order[0]].dataType, TimestampNTZType):
        lead = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), lead)
    lead = lead.cast("double")
    of = [F.col(g).alias(f"__{g}") for g in groups]
    met = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups]
    spans = rows.groupBy(*of).agg(F.count("*").alias(size), F.min(lead).alias("__low"), F.max(lead).alias("__high"))
    share = F.try_divide(lead - F.col("__low"), F.col("__high") - F.col("__low"))
    cut = F.when(lead.isNull(), -1).otherwise(F.coalesce(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(0)))
    binned = rows.join(spans, met).select(*rows.columns, size, cut.alias("__bin"))
    counts = binned.groupBy(*of, F.col("__bin").alias("__of")).agg(F.count("*").alias("__n"))
    names = [f"__{g}" for g in groups]
    offsets = counts.withColumn("__before", F.sum("__n").over(W.partitionBy(*names).orderBy("__of")) - F.col("__n")).drop("__n")
    own = F.row_number().over(W.partitionBy(*groups, "__bin").orderBy(*order)) - 1
    ranked = binned.withColumn("__own", own).join(offsets, [*met, F.col("__bin") == F.col("__of")])
    return ranked.select(*rows.columns, (F.col("__before") + F.col("__own")).cast("long").alias(place), size)
