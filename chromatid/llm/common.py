"""What the training-data operators share: reading, durable intermediate tables, joins by hot keys, connected components.

Executors may be lost at any time, so lineage is cut only by files in the shared folder that the session names in
``spark.checkpoint.dir``; a folder of our own is made only where that setting is missing and driver and executors are one process.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of letters, marks, digits and underscores.
WORD_PATTERN = r"[\p{L}\p{M}\p{N}_]+"
#: Rows that a key may have in one task without care.
HOT_ROWS = 2000
#: Bytes of rows that Spark hands to a Python worker at once, where an operator writes its own tables.
BATCH_BYTES = 16 << 20
_memos: dict[str, dict] = {}


class _Stored(threading.local):
    """The tables that stored() has written, by thread: what one thread drops is its own."""

    def __init__(self):
        self.paths: list[str] = []


_stored = _Stored()


def memo(owner: str) -> dict:
    """A dict that lasts as long as a Python worker serves one owner: asking for another's drops it, so a worker holds one memo at a time."""
    if owner not in _memos:
        _memos.clear()
        _memos[owner] = {}
    return _memos[owner]


def release() -> None:
    """Hands memory that is free in this process back to the system: a Python worker serves many tasks, and what the largest needed would stay with it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries have no such call
        pass


def releasing(run: Callable) -> Callable:
    """A function of an iterator of batches that releases its memory once a task is through."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and no others, so extra columns with clashing names never meet the operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def free_name(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="chromatid-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def batches_of(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Bounds the bytes of the batches that jobs run in this block hand to Python workers."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: a cut in the lineage that outlives executors and has a measured size.

    The files stay until drop_stored() is called, as results are read from them later.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with batches_of(spark):
        df.write.parquet(path)
    _stored.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_so_far() -> int:
    """How many tables stored() has written, as drop_stored() takes it."""
    return len(_stored.paths)


def drop_stored(spark: SparkSession, keep: DataFrame | None = None, since: int = 0) -> None:
    """Deletes the tables that stored() has written since there were so many, but those whose files keep reads directly."""
    kept = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for f in keep.inputFiles()} if keep is not None else set()
    left = _stored.paths[:since]
    for path in _stored.paths[since:]:
        if path.split(":", 1)[-1].lstrip("/") in kept:
            left.append(path)
            continue
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _stored.paths[:] = left


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for narrow tables in loops; Spark's cleaner removes it once nothing refers to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """The equi-join of rows with one row a key: groups (key, n, ...), where n says how many of the ``total`` rows have the key.

    Keys with more rows than two tasks' fair share would gather in one task, so those are broadcast and their rows stay where they are. There are at most
    half as many such keys as shuffle partitions, whatever the tables' sizes; all other rows meet in a shuffle by the key. total may be an upper bound.
    """
    fair = 2 * total // int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy, light = F.broadcast(groups.where(F.col("n") > fair)), groups.where(F.col("n") <= fair)
    apart = rows.join(heavy, key)
    return rows.join(F.broadcast(groups.where(F.col("n") > fair).select(key)), key, "left_anti").join(light, key).select(apart.columns).union(apart)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in the undirected edges (src, dst): component is the smallest id reachable.

    Alternates the large-star and small-star steps: each is one grouped minimum, which is partly taken before its shuffle, and one join back by
    join_groups(), so a hub of any degree is never a group in one task. The edge count never grows.
    """
    e = (
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    e = checkpointed(e)
    last, count = None, e.count()

    def with_least(rows: DataFrame, low: DataFrame) -> DataFrame:
        # A plain join, whose plan is a third as large, where no key is worth more. All rounds have one bound, so that Spark compiles their code once.
        most = low.agg(F.max("n")).first()[0] or 0
        return join_groups(rows, low, "u", 2 * count) if most > HOT_ROWS else rows.join(low, "u")

    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = with_least(both, low).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = with_least(large, large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        e = checkpointed(
            small.select("u", F.col("m").alias("v"))
            .union(small.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))
            .distinct()
        )
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def forest(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, each row's root: the smallest row index reachable."""
    n = len(linked)
    root = np.arange(n)
    while True:
        best = np.where(linked, root[None, :], n).min(axis=1, initial=n)
        new = np.minimum(root, best)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def runs(batches, keys: list[str]) -> Callable:
    """Yields (key tuple, pandas frame) for rows that arrive sorted by the key columns, holding one key's rows at a time."""
    import pandas as pd

    held, held_key = [], None
    for pdf in batches:
        if pdf.empty:
            continue
        k = pdf[keys].to_numpy()
        cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        for part in np.split(np.arange(len(pdf)), cut):
            rows, key = pdf.iloc[part], tuple(k[part[0]])
            if held and key != held_key:
                yield held_key, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
                held = []
            held_key = key
            held.append(rows)
    if held:
        yield held_key, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
