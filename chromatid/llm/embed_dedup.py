"""Near-duplicate embeddings: products of int8 tiles with rigorous error bounds, full precision only where they leave a doubt.

Vectors of one label are compared by cosine. Each unit vector x is quantised to whole numbers c in -127..127 with its own step s, and
carries e = ||x - s c||, the exact length of its quantisation error. For two vectors

    |x.y - sx sy (cx.cy)| <= ex + ey + ex ey        (Cauchy-Schwarz; both x and y have length 1)

so a pair whose int8 product lies farther than that from the threshold is decided, and all other pairs are recomputed in double
precision from the original components. No pair is missed.

Equal vectors of a label are one representative with a count, which is what large groups of copies shrink to. Representatives' codes are
dealt to tiles by a hash, about ``tile_rows`` a tile; each pair of tiles of a label is one group of at most two tiles, so no label, however
large, meets in one task. A pair of tiles returns each vector's number of links, a spanning forest of them and its partners in doubt, never the links. Only
vectors in doubt are then fetched, by pair of tiles, in their full length.

Null, zero, non-finite vectors, null components and null labels link with nothing: such a row is its own component. Vectors of
unequal lengths don't link; long ones make smaller tiles. Rows with a null vec_id link with nothing. Rows that share a vec_id are rows of their own, whatever their
vectors. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromatid.llm.common import connected_components, forest, join_groups, only, runs, stored

#: Components of a tile's vectors at most, on average.
TILE_COMPONENTS = 1 << 21


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that their squares neither overflow nor vanish; cosines stay what they are."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None])


def quantise(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, steps, errors) of the unit vectors of the rows of a double matrix, none of them zero; errors are rounded up."""
    m = scaled(m)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    steps = np.maximum(np.abs(unit).max(axis=1), 1e-300) / 127
    codes = np.rint(unit / steps[:, None]).astype(np.int8)
    errors = np.linalg.norm(unit - codes * steps[:, None], axis=1) * (1 + 1e-12) + 1e-12
    return codes, steps, errors


Quantised = tuple[np.ndarray, np.ndarray, np.ndarray]


def decided(a: Quantised, b: Quantised, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(pairs that surely reach the threshold, pairs that may) as boolean matrices of the rows of a and b."""
    (ca, sa, ea), (cb, sb, eb) = a, b
    # Products of whole numbers up to 127 in up to a thousand components are exact in single precision.
    kind = np.float32 if ca.shape[1] <= 1024 else np.float64
    product = (ca.astype(kind) @ cb.astype(kind).T).astype(float) * np.outer(sa, sb)
    bound = ea[:, None] + eb[None, :] + np.outer(ea, eb) + 1e-9
    sure = product - bound >= threshold
    return sure, (product + bound >= threshold) & ~sure


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    x, y = scaled(x), scaled(y)
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1)) / np.sqrt((y * y).sum(axis=1))


def _quantised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for _, part in pdf.groupby("size", sort=False):
            codes, steps, errors = quantise(np.array(part["embedding"].tolist(), dtype=float))
            yield part.drop(columns="embedding").assign(codes=[c.tobytes() for c in codes], step=steps, error=errors)


def _compare(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (group, a, b), pdf in runs(batches, ["label", "a", "b"]):
            first = (pdf["tile"] == a).to_numpy()
            p = np.arange(len(pdf)) if a == b else np.flatnonzero(first)
            q = p if a == b else np.flatnonzero(~first)
            if not len(p) or not len(q):
                continue
            codes = np.frombuffer(b"".join(pdf["codes"]), dtype=np.int8).reshape(len(pdf), -1)
            steps, errors = pdf["step"].to_numpy(), pdf["error"].to_numpy()
            found = decided((codes[p], steps[p], errors[p]), (codes[q], steps[q], errors[q]), threshold)
            sure, maybe = np.zeros((2, len(pdf), len(pdf)), dtype=bool)
            for m, part in zip((sure, maybe), found, strict=True):
                m[np.ix_(p, q)] = part
                np.fill_diagonal(m, False)
                m |= m.T
            some = np.flatnonzero(sure.any(axis=1) | maybe.any(axis=1))
            if len(some):
                ids, root = pdf["rep"].to_numpy(), forest(sure)
                yield pd.DataFrame(
                    {
                        "label": group, "a": a, "b": b, "src": ids[some], "dst": ids[root[some]], "copies": pdf["copies"].to_numpy()[some],
                        "links": (sure @ pdf["copies"].to_numpy())[some].astype("int64"), "doubt": maybe[some].any(axis=1),
                        "partners": [ids[k + 1 + np.flatnonzero(maybe[k, k + 1 :])] for k in some],
                    }
                )

    return run


def _recompute(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, pdf in runs(batches, ["label", "a", "b"]):
            ids, m = pdf["src"].to_numpy(), np.array(pdf["embedding"].tolist(), dtype=float)
            order = np.argsort(ids)
            i = np.repeat(np.arange(len(pdf)), [len(x) for x in pdf["partners"]])
            j = order[np.searchsorted(ids[order], np.concatenate(pdf["partners"].tolist()))]
            linked = np.zeros((len(pdf), len(pdf)), dtype=bool)
            for k in range(0, len(i), 1 << 14):
                x, y = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
                linked[x, y] = cosines(m[x], m[y]) >= threshold
            linked |= linked.T
            some = np.flatnonzero(linked.any(axis=1))
            if len(some):
                yield pd.DataFrame({"src": ids[some], "dst": ids[forest(linked)[some]], "links": (linked @ pdf["copies"].to_numpy())[some].astype("int64")})

    return run


def link_near(vectors: DataFrame, threshold: float = 0.93, tile_rows: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label)."""
    rows = only(vectors, "vec_id", "embedding", "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    useful = F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # Vectors are keyed by their bits, so that equal ones meet without comparing arrays.
    bits = F.md5(F.array_join(F.transform("embedding", lambda x: (x.cast("double") + 0.0).cast("string")), ","))
    keyed = rows.withColumn("useful", useful & F.col("vec_id").isNotNull()).withColumn("key", F.when(F.col("useful"), F.struct("label", bits.alias("bits"))))
    reps = (
        keyed.where("useful")
        .groupBy("key")
        .agg(F.min("vec_id").alias("min_id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
        .withColumn("size", F.size("embedding"))
        .withColumn("rep", F.monotonically_increasing_id())  # a number of the row, fixed once it is written
    )
    reps = stored(reps, "vec-reps")
    per = reps.groupBy(F.col("key.label").alias("p_label"), F.col("size").alias("p_size")).agg(F.count(F.lit(1)).alias("n"))
    in_tile = F.greatest(F.lit(1.0), F.least(F.lit(float(tile_rows)), F.lit(float(TILE_COMPONENTS)) / F.col("p_size")))
    per = per.select("p_label", "p_size", F.ceil(F.col("n") / in_tile).cast("int").alias("tiles"))
    codes = reps.select("key.label", "rep", "copies", "size", "embedding").mapInPandas(
        _quantised, f"label {reps.schema['key'].dataType['label'].dataType.simpleString()}, rep long, copies long, size int, codes binary, step double, error double"
    )
    tiled = (
        codes.join(per, (F.col("label") == F.col("p_label")) & (F.col("size") == F.col("p_size")))
        .withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles").cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            F.xxhash64("label", "size").alias("label"), F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "rep", "copies", "codes", "step", "error"
        )
    )
    group = ["label", "a", "b"]
    found = tiled.repartition(*group).sortWithinPartitions(*group, "rep").mapInPandas(
        _compare(threshold), "label long, a int, b int, src long, dst long, copies long, links long, doubt boolean, partners array<long>"
    )
    found = stored(found, "vec-tiles")
    doubted = found.where("doubt").select(*group, "src", "copies", "partners").join(reps.select(F.col("rep").alias("src"), "embedding"), "src")
    again = doubted.repartition(*group).sortWithinPartitions(*group, "src").mapInPandas(_recompute(threshold), "src long, dst long, links long")
    found = stored(found.where("links > 0").select("src", "dst", "links").union(again), "vec-links")

    links = found.groupBy(F.col("src").alias("rep")).agg(F.sum("links").alias("rep_links"))
    components = connected_components(found.select("src", "dst")).select(F.col("id").alias("rep"), "component")
    members = reps.select("key", "rep", "copies", "min_id").join(links, "rep", "left").join(components, "rep", "left")
    members = stored(members.withColumn("component", F.coalesce("component", "rep")), "vec-members")
    total = members.agg(F.count(F.lit(1)), F.sum("copies")).first()
    ids = members.groupBy("component").agg(F.min("min_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    lookup = join_groups(members, ids, "component", total[0]).select(
        "key", F.col("copies").alias("n"), (F.coalesce("rep_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    linked = join_groups(keyed.where("useful").select("vec_id", "key"), lookup, "key", total[1] or 0)
    out = linked.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    out = out.union(keyed.where("NOT useful").select("vec_id", F.lit(0).cast("long"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
