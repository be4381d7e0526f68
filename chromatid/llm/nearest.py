"""Nearest neighbours by a block matrix join: products of int8 tiles bound every distance, doubtful pairs are measured in double precision, heaps merge.

Each vector x is quantised to whole numbers c in -127..127 with its own step s; e bounds ||x - s c||. By the triangle inequality

    | ||x - y|| - ||sx cx - sy cy|| |  <=  ex + ey

so the product of two tiles of codes brackets all their distances. A candidate is out where its least distance exceeds the k-th smallest greatest
distance of its query within the tile; all others are measured from the original components, so no neighbour is missed and every score is exact.

Candidates are dealt to tiles of at most ``tile_rows`` by a hash, queries to blocks; a group is one tile with one block, in which the tile's rows come first
and are held, while queries stream past them. So candidates are shipped once a block (65,536 queries), queries once a tile, and no group grows with the
table. Each group returns k candidates a query at most, whatever the number of ties or of near copies; a heap of k a query merges them.

Vectors that are null, zero or hold null or non-finite components take no part; vectors are compared with those of their length only. Ties go to the
smaller vec_id (null last). Every row is a row of its own: rows that share a vec_id are candidates of each other, and each query row gives its own result.
A query with fewer candidates than k gets all of them; one with none, or an empty table, gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromatid.llm.common import join_groups, only, stored

#: Queries of a block on average; a tile meets a block in one task.
BLOCK_QUERIES = 1 << 16
#: Components of a tile's vectors at most, on average.
TILE_COMPONENTS = 1 << 21
#: Pairs whose distances are bracketed at once, and pairs that are measured at once.
BRACKETED, MEASURED = 1 << 20, 1 << 14


def quantise(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, steps, squared lengths of step times codes, bounds) of the rows of a double matrix.

    Bounds are the lengths of the quantisation errors, with room for what rounding does to distances of such lengths: squares are off by less than
    1e-12 of the squared lengths, so roots are by less than 1e-6 of the lengths. They are infinite where squares overflow.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        steps = np.maximum(np.abs(m).max(axis=1) / 127, 1e-300)
        codes = np.rint(m / steps[:, None]).astype(np.int8)
        squares = steps * steps * (codes.astype(float) ** 2).sum(axis=1)
        bounds = np.linalg.norm(m - codes * steps[:, None], axis=1) * (1 + 1e-9) + 1.1e-6 * np.sqrt(squares) + 1e-150
    return codes, steps, squares, np.where(np.isfinite(bounds) & np.isfinite(squares), bounds, np.inf)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean, row by row, in double precision, squares summed from the first component to the last."""
    total = np.zeros(len(x))
    with np.errstate(over="ignore"):
        for a, b in zip(x.T, y.T, strict=True):
            total += (a - b) ** 2
        return np.sqrt(total)


class Tile:
    """Vectors with their codes, in the order of their rows."""

    def __init__(self, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts)
        self.size = rows["size"][0].as_py()
        self.row, self.step, self.square, self.bound = (rows[c].to_numpy() for c in ("row", "step", "square", "bound"))
        self.null = rows["vec_id"].is_null().to_numpy()
        self.id = rows["vec_id"].fill_null(0).to_numpy()
        self.code = np.concatenate([np.frombuffer(c.as_buffer(), dtype=np.int8) for c in rows["codes"]]).reshape(-1, self.size)
        self.vector = rows["vector"].combine_chunks().flatten().to_numpy().reshape(-1, self.size)
        # Products of whole numbers up to 127 in up to a thousand components are exact in single precision.
        self.factor = self.code.astype(np.float32 if self.size <= 1024 else np.float64)


def bracketed(q: Tile, c: Tile, part: slice) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) distances that the queries of a part may have from the tile's rows."""
    product = (q.factor[part] @ c.factor.T).astype(float)
    product *= np.outer(-2 * q.step[part], c.step)
    product += q.square[part][:, None]
    product += c.square
    middle = np.sqrt(np.maximum(product, 0))
    room = q.bound[part][:, None] + c.bound
    with np.errstate(invalid="ignore"):
        least, most = middle - room, middle + room
    wild = ~np.isfinite(room) | ~np.isfinite(middle)
    if wild.any():
        least[wild], most[wild] = -np.inf, np.inf
    return least, most


def nearest_in(q: Tile, c: Tile, k: int) -> pd.DataFrame:
    """Of each query, its k nearest rows of the tile and their distances."""
    found = []
    at_once = max(1, BRACKETED // len(c.row))
    for low in range(0, len(q.row), at_once):
        part = slice(low, low + at_once)
        with np.errstate(over="ignore", invalid="ignore"):
            least, most = bracketed(q, c, part)
        own = q.row[part][:, None] == c.row
        least[own], most[own] = np.inf, np.inf
        kth = np.partition(most, k - 1, axis=1)[:, k - 1] if most.shape[1] > k else np.full(len(most), np.inf)
        near = (least <= kth[:, None]) & ~own
        i, j = np.nonzero(near)
        i += low
        if not len(i):
            continue
        exact = np.concatenate([distances(q.vector[i[n : n + MEASURED]], c.vector[j[n : n + MEASURED]]) for n in range(0, len(i), MEASURED)])
        order = np.lexsort((c.row[j], c.id[j], c.null[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        begins = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        kept = np.arange(len(i)) - np.repeat(begins, np.diff(np.r_[begins, len(i)])) < k
        i, j = i[kept], j[kept]
        found.append(pd.DataFrame({"query": q.row[i], "query_id": q.id[i], "row": c.row[j], "vec_id": pd.array(c.id[j], dtype="Int64"), "score": exact[kept]}))
        found[-1].loc[c.null[j], "vec_id"] = pd.NA
    return pd.concat(found) if found else pd.DataFrame()


_FOUND = "query long, query_id long, row long, vec_id long, score double"


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes):
            part = batch.filter(pa.array(sizes == size))
            codes, steps, squares, bounds = quantise(part.column("vector").flatten().to_numpy().reshape(-1, size))
            more = {"codes": pa.array([c.tobytes() for c in codes], pa.binary()), "step": pa.array(steps), "square": pa.array(squares), "bound": pa.array(bounds)}
            yield pa.RecordBatch.from_arrays([*part.columns, *more.values()], names=[*part.schema.names, *more])


def _search(k: int):
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tile, of = [], None, None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "tile", "block", "asks")])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if low == high:
                    continue
                part, key = batch.slice(low, high - low), tuple(keys[low, :3])
                if key != of:
                    held, tile, of = [], None, key
                if not keys[low, 3]:
                    held.append(part)
                    continue
                if tile is None and held:
                    tile, held = Tile(held), []
                if tile:
                    found = nearest_in(Tile([part]), tile, k)
                    if len(found):
                        yield pa.RecordBatch.from_pandas(found, schema=schema, preserve_index=False)

    return run


def _merge(k: int):
    """Rows sorted by query: a heap of k a query, which takes what the tiles found as it comes."""

    def ranked(query_id: int, best: list) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "query_id": query_id, "rank": np.arange(1, len(best) + 1, dtype=np.int32),
                "vec_id": pd.array([None if null else v for _, null, v, _ in best], dtype="Int64"), "score": [s for s, *_ in best],
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, query_id, best = None, None, []
        for pdf in batches:
            null = pdf["vec_id"].isna()
            pdf = pdf.assign(null=null, vec_id=pdf["vec_id"].fillna(0).astype("int64"))
            done = []
            for query, rows in pdf.groupby("query", sort=False):
                if query != of:
                    done += [ranked(query_id, best)] if best else []
                    of, query_id, best = query, rows["query_id"].iloc[0], []
                best = heapq.nsmallest(k, [*best, *zip(rows["score"], rows["null"], rows["vec_id"], rows["row"], strict=True)])
            if done:
                yield pd.concat(done)
        if best:
            yield ranked(query_id, best)

    return run


def search(vectors: DataFrame, queries: Column, k: int = 10, tile_rows: int = 1 << 15) -> DataFrame:
    """(query_id, rank, vec_id, score): of every row of vectors (vec_id, embedding) for which queries holds, its k nearest others."""
    rows = only(vectors, "vec_id", "embedding").withColumn("asks", F.coalesce(queries, F.lit(False)))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False)))
    rows = rows.select("vec_id", "asks", F.size("embedding").alias("size"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # fixed once it is written
    kinds = "vec_id long, asks boolean, size int, vector array<double>, row long"
    rows = stored(rows.mapInArrow(_quantised, f"{kinds}, codes binary, step double, square double, bound double"), "nearest")

    # At least a few tiles a core, but of a thousand rows or more, and of the greatest size that a task holds well beyond that.
    cores = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = F.least(F.lit(tile_rows), F.greatest(F.lit(1), F.floor(F.lit(TILE_COMPONENTS) / F.col("size"))))
    per = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asked"))
    tiles = F.greatest(F.ceil(F.col("n") / most), F.least(F.lit(2 * cores), F.ceil(F.col("n") / 1024)))
    per = per.select("size", "n", tiles.cast("int").alias("tiles"), F.ceil(F.col("asked") / BLOCK_QUERIES).cast("int").alias("blocks"))
    total = rows.count()
    dealt = join_groups(rows, per.where("blocks > 0"), "size", total)
    at = {n: F.pmod(F.xxhash64("row", F.lit(n)), F.col(n).cast("long")).cast("int") for n in ("tiles", "blocks")}
    each = {n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)) for n in ("tiles", "blocks")}
    columns = ["size", "tile", "block", "asks", "row", "vec_id", "vector", "codes", "step", "square", "bound"]
    offered = dealt.withColumn("asks", F.lit(False)).withColumn("tile", at["tiles"]).withColumn("block", each["blocks"]).select(columns)
    asking = dealt.where("asks").withColumn("block", at["blocks"]).withColumn("tile", each["tiles"]).select(columns)
    group = ["size", "tile", "block"]
    found = offered.union(asking).repartition(*group).sortWithinPartitions(*group, "asks").mapInArrow(_search(k), _FOUND)
    merged = found.repartition("query").sortWithinPartitions("query").mapInPandas(_merge(k), "query_id long, rank int, vec_id long, score double")
    return merged
