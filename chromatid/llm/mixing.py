"""Mixing sources to target weights by the cube method.

Every source gets a target share of the words; a document's expected number of copies is its source's target over its source's size,
at most ``max_epochs``. The whole part is taken outright. The fractional parts are inclusion probabilities, moved through the null
space of the balancing constraints (documents and words) until all but a few are 0 or 1: first within chunks of each source, then
within chunks of what those left over, level by level, until a source has one chunk. Its last two or three fractional rows are the
landing problem: they move on by the words constraint alone, and the last one is drawn. Every step keeps each row's expectation.

A chunk is chosen by a hash of the row, and holds at most ``chunk_rows`` rows on average, so a source with a third of all rows is many
chunks. Rows of one chunk are ordered by falling size, so that the rows still fractional at the end are small ones. Each step of each chunk and
level has a draw of its own, from a generator seeded by the chunk's name: reruns agree, whatever the partitioning.

Null text counts 0 words; null sources are one source, ranked last; repeated rows are counted, then numbered, and are rows of their own; very long
texts are counted whole. An empty table gives an empty result; a table without any words has targets of 0. Extra columns are ignored (kept by
``mixed``, where rows that differ in any column are rows of their own).
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromatid.llm.common import free_name, stored

#: A word: a run of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
#: Repeated rows are numbered in blocks of so many.
_BLOCK = 4096
_STATE = "source string, key long, seq long, size long, p double, done boolean"


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: float) -> DataFrame:
    """(source, source_size, target) for sizes (source, size).

    The capped shares are min(cap, level * weight) for the one level that makes them add up to the total; the level is found from
    running sums over the sources, ordered by cap / weight. One row per source: this table is as small as the list of sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * float(max_epochs))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    # The first source, by cap / weight, that its level does not fill sets the level of all that follow.
    per = per.withColumn("level", level).withColumn("open", F.col("cap") >= F.col("level") * F.col("w"))
    found = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("w")).alias("r"), "source", "level"))).over(whole)
    return per.withColumn("found", found["level"]).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("found") * F.col("w"), F.col("cap"))).alias("target")
    )


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, documents: bool = True) -> np.ndarray:
    """Moves p along vectors that keep sum(p * size) and, if documents is set, sum(p), until at most one or two entries stay fractional.

    Each step goes up or down by a draw of its own, so that every entry keeps its expectation.
    """
    eps = 1e-9
    size, p = size.tolist(), p.astype(float).tolist()
    window: list[int] = []
    for i in range(len(p)):
        if not eps < p[i] < 1 - eps:
            p[i] = float(round(p[i]))
            continue
        window.append(i)
        while True:
            pair = next(((a, b) for a, b in itertools.combinations(window, 2) if size[a] == size[b]), None)
            if pair:
                use, u = pair, (1.0, -1.0)
            elif len(window) == 3:
                a, b, c = use = tuple(window)
                u = (float(size[b] - size[c]), float(size[c] - size[a]), float(size[a] - size[b]))
            elif len(window) == 2 and not documents:
                a, b = use = tuple(window)
                u = (float(size[b]), -float(size[a]))
            else:
                break
            up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(use, u, strict=True) if x)
            down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(use, u, strict=True) if x)
            step = up if rng.random() * (up + down) < down else -down
            for k, x in zip(use, u, strict=True):
                p[k] += step * x
                if not eps < p[k] < 1 - eps:
                    p[k] = float(round(p[k]))
            window = [k for k in window if 0 < p[k] < 1]
    return np.array(p)


def landing(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds the few fractional entries: the documents constraint is given up first, then the words one."""
    p = flight(size, p, rng, documents=False)
    for k in np.flatnonzero((p > 0) & (p < 1)):
        p[k] = float(rng.random() < p[k])
    return p


def _chunk(last: bool, seed: int, level: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key", "seq"], ascending=[False, True, True], kind="stable")
        size = pdf["size"].to_numpy()
        source = None if key[0] is None or key[0] != key[0] else str(key[0])
        rng = np.random.default_rng(xxhash.xxh3_64_intdigest(repr((seed, level, source, int(key[1])))))
        p = flight(size, pdf["p"].to_numpy(), rng)
        if last:
            p = landing(size, p, rng)
        return pdf.assign(p=p, done=(p == 0) | (p == 1))[["source", "key", "seq", "size", "p", "done"]]

    return run


def numbered(rows: DataFrame) -> DataFrame:
    """The rows, each with its number nth among equal ones: equal rows are counted (partly before their shuffle), then dealt out again in blocks."""
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    few = counted.where(F.col("n") <= _BLOCK).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    many = counted.where(F.col("n") > _BLOCK).withColumn("block", F.explode(F.expr(f"sequence(0L, (n - 1) div {_BLOCK})"))).repartition("key", "block")
    many = many.withColumn("nth", F.explode(F.expr(f"sequence(block * {_BLOCK} + 1, least((block + 1) * {_BLOCK}, n))")))
    return few.select(*rows.columns, "nth").union(many.select(*rows.columns, "nth"))


def row_key() -> Column:
    return F.xxhash64("doc_id", "source", F.xxhash64("text"))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: float = 3.0, chunk_rows: int = 4096, seed: int = 1, key: Column | None = None
) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken, key) for every row of docs (doc_id, text, source).

    Sources are ranked by code point, null last, and take the weights in turn. Rows with one key (by default row_key()) are repeated rows; it must
    hold their doc_id, source and text.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size")
    rows = docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`source`").alias("source"), size, (row_key() if key is None else key).alias("key"))
    rows = numbered(rows).withColumn("seq", F.xxhash64(F.lit(seed), "key", "nth")).drop("nth")
    rows = stored(rows, "mix-rows")
    targets = source_targets(rows, weights, max_epochs)
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("source_rows"))
    targets = stored(targets.join(counts, targets["source"].eqNullSafe(counts["source"])).drop(counts["source"]), "mix-targets")
    t = targets.withColumnRenamed("source", "t_source")
    planned = rows.join(t, rows["source"].eqNullSafe(t["t_source"])).drop("t_source")
    epochs = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_epochs)))).otherwise(F.lit(0.0))
    planned = planned.withColumn("epochs", epochs).withColumn("whole", F.floor("epochs").cast("long")).withColumn("p", F.col("epochs") - F.col("whole"))

    live = planned.where("p > 0").select("source", "key", "seq", "size", "p", "source_rows")
    most = targets.agg(F.max("source_rows")).first()[0] or 0
    taken, level = [], 0
    chunks = F.ceil(F.col("source_rows") / float(chunk_rows))
    while True:
        last = most <= chunk_rows * 1.5
        chunk = F.lit(0).cast("long") if last else F.pmod(F.xxhash64("seq", F.lit(level)), chunks.cast("long"))
        done = live.withColumn("chunk", chunk).groupBy("source", "chunk").applyInPandas(_chunk(last, seed, level), _STATE)
        done = stored(done, f"mix-{level}")
        taken.append(done.where("done and p = 1").select("source", "key", "seq"))
        if last:
            break
        live = done.where("not done").drop("done")
        left = live.groupBy("source").agg(F.count(F.lit(1)).alias("source_rows"))
        live = live.join(left.withColumnRenamed("source", "l_source"), F.col("source").eqNullSafe(F.col("l_source"))).drop("l_source")
        most = left.agg(F.max("source_rows")).first()[0] or 0
        level += 1
    extra = taken[0]
    for x in taken[1:]:
        extra = extra.union(x)
    extra = extra.select(F.col("key").alias("e_key"), F.col("seq").alias("e_seq"), F.lit(1).alias("extra"))
    out = planned.join(extra, (F.col("key") == F.col("e_key")) & (F.col("seq") == F.col("e_seq")), "left")
    copies = F.col("whole") + F.coalesce("extra", F.lit(0))
    return out.select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"), "key")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns."""
    key, n = free_name(docs, "_key"), free_name(docs, "_n")
    # Maps have no hash of their own.
    parts = [F.to_json(c) if "map<" in docs.schema[c.strip("`")].dataType.simpleString() else F.col(c) for c in (f"`{x}`" for x in docs.columns)]
    whole = F.xxhash64(F.xxhash64("text"), *parts)
    copies = mix(docs, key=whole, **options).groupBy(F.col("key").alias(key)).agg(F.sum("copies").alias(n)).where(F.col(n) > 0)
    copies = stored(copies, "mix-copies")

    def one_each(wanted: DataFrame) -> DataFrame:
        return docs.withColumn(key, whole).join(wanted, key).dropDuplicates([key])

    # A row that is taken very often is dealt out in blocks, so no task makes all of its copies.
    few = one_each(copies.where(F.col(n) <= _BLOCK)).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), n)))
    block = free_name(docs, "_block")
    many = one_each(copies.where(F.col(n) > _BLOCK)).withColumn(block, F.explode(F.expr(f"sequence(0L, (`{n}` - 1) div {_BLOCK})"))).repartition(key, block)
    many = many.withColumn(n, F.explode(F.expr(f"sequence(`{block}` * {_BLOCK} + 1, least((`{block}` + 1) * {_BLOCK}, `{n}`))")))
    return few.drop(key, n).union(many.drop(key, n, block))
