"""Token vocabularies from hard-coded values: clusters, names, coverage.

Clustering is order-dependent but works on distinct values, after a distributed count: colors settle in rounds, whole px are one ordered fold per
category (or a caller's scope), never the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromatid.functions import colors, spacing
from chromatid.operators import match
from chromatid.session import durable

# Names by position.
NEUTRALS = "50 100 200 300 400 500 600 700 800 900 950".split()
SIZES = "3xs 2xs xs sm md lg xl 2xl 3xl 4xl".split()
RADII = "sm md lg xl 2xl full".split()
BREAKPOINTS = "xs sm md lg xl 2xl 3xl".split()
# Palettes stop at 12 colors, 30 apart; spacing bases in the order they are tried; the scale without any values.
PALETTE_SIZE, PALETTE_GAP, PALETTE_POOL = 12, 30.0, 20
BASES, DEFAULT_SCALE, SCALE_TOP, SCALE_SIZE = (4, 8, 5, 6, 10), (4, 8, 12, 16, 24, 32, 48, 64), 128, 10


def _names(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def color_counts(values: DataFrame) -> DataFrame:
    """(scope, color, n, seq) of values (scope, value, seq): normalized colors, their uses and first sighting."""
    return values.groupBy("scope", colors.normal_color(F.col("value"), "tokenize").alias("color")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))


#: Colors of a scope that one task looks for representatives among, in a round.
STEP = 1024


def color_clusters(values: DataFrame, threshold: float = 5.0, step: int = STEP) -> DataFrame:
    """(scope, cluster, representative, n, members): colors by falling use each join the first cluster whose representative is nearer than threshold * 10.

    In each round the commonest ``step`` open colors of a scope are looked through in order for representatives, and every open color near one of those joins the first
    by an equi-join on cells of the color cube. Representatives lie apart, so the color cube bounds their number and with it the rounds; no task holds a scope's colors.
    Values that are no colors are clusters of their own.
    """
    reach = threshold * 10
    order = [F.desc("n"), F.col("seq"), F.col("color")]
    # A null scope is one like others: scopes meet as JSON.
    c = durable(color_counts(values).withColumn("scope", F.to_json(F.struct("scope"))).withColumn("rgb", colors.channels(F.col("color"))))
    rank = F.struct((-F.col("n")).alias("n"), "seq", "color")

    def leaders(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        rgb, found = pdf[["r", "g", "b"]].to_numpy(dtype=float), []
        for i in range(len(pdf)):
            if not found or not (np.sqrt(((rgb[found] - rgb[i]) ** 2).sum(axis=1)) < reach).any():
                found.append(i)
        return pdf.iloc[found][["scope", "color", "n", "seq"]]

    def cells(at: Column, around: int) -> Column:
        return match._cells(at, max(reach, 5.0) + 1e-6, around)

    open_ = c.where("rgb is not null")
    joined = c.where("rgb is null").select("scope", "color", "n", "seq", rank.alias("leader"))
    while not open_.isEmpty():
        first = open_.withColumn("k", F.row_number().over(Window.partitionBy("scope").orderBy(*order))).where(F.col("k") <= step)
        found = first.select("scope", "color", "n", "seq", "k", "rgb.*").groupBy("scope").applyInPandas(leaders, "scope string, color string, n long, seq long")
        found = durable(found.select("scope", colors.channels(F.col("color")).alias("at"), rank.alias("leader")))
        near = open_.withColumn("cell", cells(F.col("rgb"), 0)[0] + match.CELL_STEPS).join(found.withColumn("cell", F.explode(cells(F.col("at"), 1))), ["scope", "cell"])
        near = near.where((F.col("leader") <= rank) & ((colors.distance(F.col("rgb"), F.col("at")) < reach) | (F.col("leader.color") == F.col("color"))))
        near = durable(near.groupBy("scope", "color", "n", "seq").agg(F.min("leader").alias("leader")))
        joined = joined.unionByName(near)
        open_ = durable(open_.join(near.select("scope", "color"), ["scope", "color"], "left_anti"))
    clusters = joined.groupBy("scope", "leader").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(rank)).alias("all"))
    place = (F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("n"), "leader")) - 1).cast("int")
    scope = F.from_json("scope", "scope string")["scope"].alias("scope")
    return clusters.select(scope, place.alias("cluster"), F.col("leader.color").alias("representative"), "n", F.transform("all", lambda x: x["color"]).alias("members"))


def color_tokens(clusters: DataFrame) -> DataFrame:
    """(scope, name, value, n, orphan) of color clusters: greys by lightness as neutrals, the two commonest others as primary and secondary, the third an orphan, three accents, the rest orphans."""
    rep = F.col("representative")
    c = clusters.where(colors.channels(rep).isNotNull())
    grey = colors.saturation(rep) < 0.1
    by_use = Window.partitionBy("scope", grey).orderBy("cluster")
    by_light = Window.partitionBy("scope", grey).orderBy(colors.lightness(rep).desc(), "cluster")
    c = c.withColumn("grey", grey).withColumn("k", F.when(grey, F.row_number().over(by_light)).otherwise(F.row_number().over(by_use)))
    k = F.col("k").cast("int")
    name = (
        F.when(F.col("grey") & (k <= len(NEUTRALS)), F.concat(F.lit("color-neutral-"), F.try_element_at(_names(NEUTRALS), k)))
        .when(~F.col("grey") & (k == 1), "color-primary-500")
        .when(~F.col("grey") & (k == 2), "color-secondary-500")
        .when(~F.col("grey") & k.between(4, 6), F.concat(F.lit("color-accent-"), (k - 3).cast("string")))
    )
    c = c.withColumn("name", name)
    lost = Window.partitionBy("scope", F.col("name").isNull()).orderBy(F.col("grey").desc(), "k")
    orphan = F.concat(F.lit("color-orphan-"), F.row_number().over(lost).cast("string"))
    return c.select("scope", F.coalesce("name", orphan).alias("name"), rep.alias("value"), "n", F.col("name").isNull().alias("orphan"))


def size_counts(values: DataFrame) -> DataFrame:
    """(scope, px, n) of lengths (scope, value) of 0 and more, in whole px."""
    px = F.floor(spacing.to_px(F.col("value")) + 0.5).cast("long")
    return values.select("scope", px.alias("px")).where("px >= 0").groupBy("scope", "px").agg(F.count(F.lit(1)).alias("n"))


def size_clusters(values: DataFrame, threshold: float = 2.0) -> DataFrame:
    """(scope, value, n): lengths by rising px each join the first cluster within the threshold, which takes the more frequent one's value; 0 stays alone."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[list] = []
        for px, n in pdf.sort_values("px")[["px", "n"]].itertuples(index=False):
            near = next((c for c in found if px and c[0] and abs(px - c[0]) <= threshold), None)
            if near:
                near[0] = px if n > near[1] else near[0]
                near[1] += n
            else:
                found.append([px, n])
        return pd.DataFrame([(*key, v, n) for v, n in found], columns=["scope", "value", "n"])

    return size_counts(values).groupBy("scope").applyInPandas(run, "scope string, value long, n long")


def size_tokens(clusters: DataFrame, prefix: str = "spacing", top: int = 10) -> DataFrame:
    """(scope, name, value, n, orphan): the ``top`` commonest clusters named by rising value, the others orphans by falling use."""
    by_use = Window.partitionBy("scope").orderBy(F.desc("n"), "value")
    c = clusters.withColumn("r", F.row_number().over(by_use)).withColumn("orphan", F.col("r") > top)
    k = F.row_number().over(Window.partitionBy("scope", "orphan").orderBy("value")).cast("int")
    c = c.withColumn("k", k)
    name = F.when(F.col("orphan"), F.concat(F.lit(f"{prefix}-orphan-"), (F.col("r") - top).cast("string"))).otherwise(
        F.concat(F.lit(f"{prefix}-"), F.coalesce(F.try_element_at(_names(SIZES), F.col("k")), F.col("k").cast("string")))
    )
    return c.select("scope", name.alias("name"), F.concat(F.col("value").cast("string"), F.lit("px")).alias("value"), "n", "orphan")


def radius_tokens(clusters: DataFrame) -> DataFrame:
    """(scope, name, value, n, orphan): 0 is none; the next six by value have names, the sixth as 9999px; the rest are orphans."""
    order = Window.partitionBy("scope", F.col("value") == 0).orderBy("value")
    k = F.row_number().over(order).cast("int")
    c = clusters.withColumn("k", k)
    zero, orphan = F.col("value") == 0, (F.col("value") != 0) & (F.col("k") > len(RADII))
    name = F.when(zero, "radius-none").when(orphan, F.concat(F.lit("radius-orphan-"), (F.col("k") - len(RADII)).cast("string")))
    name = name.otherwise(F.concat(F.lit("radius-"), F.try_element_at(_names(RADII), F.col("k"))))
    px = F.concat(F.col("value").cast("string"), F.lit("px"))
    value = F.when(zero, "0").when(F.col("k") == len(RADII), "9999px").otherwise(px)
    return c.select("scope", name.alias("name"), value.alias("value"), "n", orphan.alias("orphan"))


def breakpoint_tokens(values: DataFrame) -> DataFrame:
    """(scope, name, value, n, orphan): distinct widths over 0 by rising px; the first seven have names."""
    c = size_counts(values).where("px > 0")
    c = c.withColumn("k", F.row_number().over(Window.partitionBy("scope").orderBy("px")).cast("int"))
    orphan = F.col("k") > len(BREAKPOINTS)
    name = F.when(orphan, F.concat(F.lit("breakpoint-orphan-"), (F.col("k") - len(BREAKPOINTS)).cast("string")))
    name = name.otherwise(F.concat(F.lit("breakpoint-"), F.try_element_at(_names(BREAKPOINTS), F.col("k"))))
    return c.select("scope", name.alias("name"), F.concat(F.col("px").cast("string"), F.lit("px")).alias("value"), "n", orphan.alias("orphan"))


def coverage(tokens: DataFrame, values: DataFrame) -> DataFrame:
    """(scope, input, covered, percent): the share of the values that named tokens stand for."""
    total = values.groupBy("scope").agg(F.count(F.lit(1)).alias("input"))
    met = tokens.groupBy("scope").agg(F.sum(F.when(~F.col("orphan"), F.col("n")).otherwise(0)).alias("covered"))
    return total.join(met, "scope", "left").select("scope", "input", F.coalesce("covered", F.lit(0)).alias("covered"), F.floor(F.coalesce("covered", F.lit(0)) * 100 / F.col("input") + 0.5).cast("int").alias("percent"))


def without_breakpoints(sizes: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """Sizes (value) whose px isn't a breakpoint's (value)."""
    b = breakpoints.select(spacing.to_px(F.col("value")).alias("_px")).where("_px is not null").distinct()
    return sizes.join(b, spacing.to_px(F.col("value")) == F.col("_px"), "left_anti")


def palette(values: DataFrame) -> DataFrame:
    """(scope, color, rank): of the 20 commonest colors, by falling use, those at least 30 from all taken before; 12 at most."""
    counts = color_counts(values).withColumn("rgb", colors.channels(F.col("color")))
    order = Window.partitionBy("scope").orderBy(F.desc("n"), "seq", "color")
    pool = counts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= PALETTE_POOL)
    ordered = pool.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("k", "color", "rgb"))).alias("all"))
    none = F.filter("all", lambda x: F.lit(False))

    def take(kept: Column, c: Column) -> Column:
        near = F.exists(kept, lambda k: F.coalesce(colors.distance(k["rgb"], c["rgb"]) < PALETTE_GAP, F.lit(False)))
        return F.when(near | (F.size(kept) >= PALETTE_SIZE), kept).otherwise(F.concat(kept, F.array(c)))

    return ordered.select("scope", F.posexplode(F.aggregate("all", none, take)).alias("pos", "c")).select("scope", F.col("c.color").alias("color"), (F.col("pos") + 1).alias("rank"))


def spacing_scale(values: DataFrame) -> DataFrame:
    """(scope, base, scale) of px values (scope, px): the base that divides most of them, the earlier tried of equals; its multiples to 128, ten at most.

    A scope without a value in px (null) has no base and the default scale.
    """
    hits = [F.count_if(F.col("px") % b == 0).alias(f"h{b}") for b in BASES]
    by = values.groupBy("scope").agg(F.count("px").alias("known"), *hits)
    best = F.greatest(*[F.col(f"h{b}") for b in BASES])
    base = F.lit(BASES[0])
    for b in reversed(BASES):
        base = F.when((F.col(f"h{b}") == best) & (best > 0), b).otherwise(base)
    multiples = F.filter(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: i * F.col("base")), lambda v: v <= SCALE_TOP)
    out = by.select("scope", F.when(F.col("known") > 0, base).alias("base"))
    default = F.array(*[F.lit(x) for x in DEFAULT_SCALE])
    return out.withColumn("scale", F.when(F.col("base").isNull(), default).otherwise(F.slice(multiples, 1, SCALE_SIZE)))


def css(tokens: DataFrame) -> DataFrame:
    """(scope, css): a :root rule of the tokens, by name. One row a scope: a vocabulary is one document."""
    line = F.concat(F.lit("  --"), "name", F.lit(": "), "value", F.lit(";"))
    by = tokens.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))).alias("all"))
    body = F.array_join(F.transform("all", lambda x: x["line"]), "\n")
    return by.select("scope", F.concat(F.lit(":root {\n"), body, F.lit("\n}\n")).alias("css"))


# Where a Tailwind theme has the tokens of a name's first word.
THEME_KEYS = {"color": "colors", "space": "spacing", "spacing": "spacing", "size": "spacing", "radius": "borderRadius", "font": "fontSize", "breakpoint": "screens"}


def tailwind(tokens: DataFrame) -> DataFrame:
    """(scope, theme): tokens (scope, name, value) as the ``theme.extend`` of a Tailwind configuration in JSON; a vocabulary is one document."""
    word = F.split_part("name", F.lit("-"), F.lit(1))
    key = F.coalesce(F.create_map(*[F.lit(x) for kv in THEME_KEYS.items() for x in kv])[word], F.lit("colors"))
    by = tokens.withColumn("key", key).groupBy("scope", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("values"))
    whole = by.groupBy("scope").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.to_json("values").alias("values"))))).alias("all"))
    parts = F.transform(F.map_entries("all"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
    return whole.select("scope", F.concat(F.lit('{"theme":{"extend":{'), F.array_join(parts, ","), F.lit("}}}")).alias("theme"))
