"""Values carried along an order: a forward fill in segments, and pointers followed by doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromatid.session import durable

#: Rows of a segment, which one task fills.
SEGMENT = 10_000


def carried(rows: DataFrame, key: str, order: str, value: str, segment: int = SEGMENT) -> DataFrame:
    """rows with the column ``value`` filled from the last row of the key before it that has one; rows before any keep null.

    ``order`` is a whole number, unlike within a key. Each key's rows are cut into segments of that order: a segment is filled by itself, and its last value is
    carried to later segments over one row a segment, so a key of any length is dealt to many tasks.
    """
    at = rows.withColumn("_segment", F.floor(F.col(order) / segment))
    own = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    each = at.groupBy(key, "_segment").agg(own.alias("_own"))
    before = F.last("_own", ignorenulls=True).over(Window.partitionBy(key).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1))
    brought = each.select(F.col(key).alias("_key"), F.col("_segment").alias("_at"), before.alias("_brought"))
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy(key, "_segment").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    filled = at.withColumn("_inside", inside).join(brought, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_segment") == F.col("_at")), "left")
    return filled.withColumn(value, F.coalesce("_inside", "_brought")).drop("_segment", "_inside", "_key", "_at", "_brought")


def followed(links: DataFrame) -> DataFrame:
    """(id, root) for links (id, next): where the way from id along next ends; next is null at its end. An id that only a next names ends its way, too.

    Pointers double: after k rounds every id within 2^k steps of an end has arrived, so the rounds grow with the logarithm of the longest way. Ids on or before a
    cycle have no row, as their ways never end: a round in which nobody arrives is the last.
    """
    state = durable(links.select("id", F.coalesce("next", "id").alias("next"), F.col("next").isNull().alias("done")))
    left = state.where("NOT done").count()
    while left:
        ahead = state.select(F.col("id").alias("_id"), F.col("next").alias("_next"), F.col("done").alias("_done"))
        moved = state.where("NOT done").join(ahead, F.col("next") == F.col("_id"), "left").select("id", F.coalesce("_next", "next"), F.coalesce("_done", F.lit(True)))
        state = durable(state.where("done").union(moved))
        before, left = left, state.where("NOT done").count()
        if left == before:
            break
    return state.where("done").select("id", F.col("next").alias("root"))
