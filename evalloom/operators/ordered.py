"""Order-sensitive computations that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with number, from 0 on, in the order, nulls first.

    Rows are dealt to as many ranges of all order columns as a shuffle has partitions, sorted and numbered there, and
    shifted by the sizes of the ranges before; so no task sees all rows, nor all rows of one value. The sorted rows are
    kept, since where ranges end is drawn anew each time they are cut.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).persist()
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
    before = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__before"))  # a row for each range
    return ranged.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("number", F.col("__before") + place).drop("__part", "__at", "__before")


def running_share(rows: DataFrame, group: list[str], order: list, cost: str) -> DataFrame:
    """The share of the group's cost before each row."""
    w = Window.partitionBy(*group)
    before = F.coalesce(F.sum(cost).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("position", before / F.sum(cost).over(w))


def interleaved(rows: DataFrame, group: list[str], copy: str, probe: str) -> DataFrame:
    """The k-th copy of every probe before any (k + 1)-th."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(copy, probe)) - 1)


def even_positions(k):
    """One half for a single one; else evenly from 35 to 65 percent."""
    return F.when(k <= 1, F.array(F.lit(0.5))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: 0.35 + 0.3 * i / F.greatest(k - 1, F.lit(1))))
