"""Differences of two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame, compare: list[str], key: str = "id") -> DataFrame:
    """(key, change): added, removed or modified rows; modified if any of the compared columns differs, nulls being equal."""
    b, a = (t.select(F.col(key), F.struct(*compare).alias(n)) for t, n in ((before, "b"), (after, "a")))
    both = b.join(a, key, "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("b").eqNullSafe(F.col("a")), "modified")
    return both.select(key, change.alias("change")).where("change is not null")


def name_report(design: DataFrame, code: DataFrame) -> DataFrame:
    """(key, side): names (name) in the design only, in the code only, or in both, compared by their letters and digits."""
    from chromatid.functions.strings import alphanumeric_key

    d, c = (t.select(alphanumeric_key(F.col("name")).alias("key")).distinct().withColumn(n, F.lit(True)) for t, n in ((design, "d"), (code, "c")))
    side = F.when(F.col("d") & F.col("c"), "matched").when(F.col("d"), "design only").otherwise("code only")
    return d.join(c, "key", "full_outer").select("key", side.alias("side"))
