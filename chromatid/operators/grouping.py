"""Grouping of drift signals by strategies that take turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromatid.functions import ids
from chromatid.functions.strings import glob_regex
from chromatid.session import durable


def keys(path_globs: list[str] | None = None) -> dict[str, Column]:
    """The strategies value, suggestion, path and entity, in turn: each a key of a signal, or null."""
    value = F.when(F.col("type") == "hardcoded-value", F.concat(F.lit("value:"), "actual"))
    first = F.get("token_suggestions", F.lit(0))
    token = F.nullif(F.regexp_extract(first, r"→\s*([^\s(]+)", 1), F.lit(""))
    place = F.col("location")
    path = None
    for g in path_globs or []:
        hit, out = place.rlike(glob_regex(g)), F.lit(f"path:{g}")
        path = F.when(hit, out) if path is None else path.when(hit, out)
    folder = F.concat(F.lit("path:"), F.regexp_replace(place, "/[^/]*$", ""))
    path = folder if path is None else path.otherwise(folder)
    return {
        "value": value,
        "suggestion": F.concat(F.lit("suggestion:"), token),
        "path": F.when(place.contains("/"), path),
        "entity": F.concat(F.lit("entity:"), "entity_id"),
    }


def assign(signals: DataFrame, min_size: int = 2, strategies: dict[str, Column] | None = None) -> DataFrame:
    """signals with (strategy, key): the first strategy whose group, among the signals that earlier ones left, has min_size members; else nulls.

    Later groups depend on what earlier ones took, but only by counts: signals are counted once by all their keys together, the turns are taken on
    those counts, and the outcome is joined back. Each turn is a partial aggregate and an equi-join, so a key that very many signals share
    is no task of its own. A strategy is any column that gives a key or null.
    """
    turns = strategies or keys()
    names = [f"_k{i}" for i in range(len(turns))]
    keyed = signals.withColumns(dict(zip(names, turns.values(), strict=True)))
    left = durable(keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).withColumns({"strategy": F.lit(None).cast("string"), "key": F.lit(None).cast("string")}))
    for name, k in zip(turns, names, strict=True):
        free = F.when(F.col("strategy").isNull(), F.col(k))
        large = left.groupBy(free.alias("_k")).agg(F.sum("_n").alias("_size")).where(F.col("_k").isNotNull() & (F.col("_size") >= min_size)).select("_k", F.lit(name).alias("_s"))
        taken = F.col("_s").isNotNull()
        left = left.join(large, free == F.col("_k"), "left").withColumns({"strategy": F.when(taken, F.col("_s")).otherwise(F.col("strategy")), "key": F.when(taken, F.col("_k")).otherwise(F.col("key"))})
        left = durable(left.drop("_k", "_s"))
    found = left.select(*[F.col(k).alias(f"_r{k}") for k in names], "strategy", "key")
    same = F.lit(True)
    for k in names:
        same = same & F.col(k).eqNullSafe(F.col(f"_r{k}"))
    return keyed.join(found, same, "left").drop(*names, *[f"_r{k}" for k in names])


def groups(assigned: DataFrame) -> DataFrame:
    """(group_id, strategy, key, n, critical, warning, info, first_id) of assigned signals."""
    by = assigned.where("strategy is not null").groupBy("strategy", "key").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")], F.min_by("id", "seq").alias("first_id")
    )
    return by.withColumn("group_id", ids.group_id(F.col("strategy"), F.col("key")))


def reduction(assigned: DataFrame) -> DataFrame:
    """One row (signals, groups, ungrouped, ratio): signals over groups and ungrouped ones; 1 without any."""
    one = assigned.agg(
        F.count(F.lit(1)).alias("signals"), F.countDistinct(F.when(F.col("strategy").isNotNull(), F.struct("strategy", "key"))).alias("groups"),
        F.count_if(F.col("strategy").isNull()).alias("ungrouped"),
    )
    units = F.col("groups") + F.col("ungrouped")
    return one.withColumn("ratio", F.when(units == 0, F.lit(1.0)).otherwise(F.col("signals") / units))
