"""File discovery, caches and incremental scans over a table of files (path, content, mtime)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromatid.functions.strings import glob_regex

# What is never scanned, and what isn't by default.
CORE_EXCLUDES = (
    "**/node_modules/** **/dist/** **/build/** **/.next/** **/out/** **/coverage/** **/.turbo/** **/.cache/** **/.git/** **/*.gen.ts **/*.gen.tsx **/*.gen.js **/*.gen.jsx"
    " **/*.generated.ts **/*.generated.tsx **/*.generated.js **/*.generated.jsx **/*.d.ts **/*.min.js **/*.min.css **/sandbox/** **/examples/**"
).split()
DEFAULT_EXCLUDES = CORE_EXCLUDES + (
    "**/*.test.* **/*.spec.* **/*.e2e.* **/*.stories.* **/__stories__/** **/.storybook/** **/__tests__/** **/__mocks__/** **/__fixtures__/** **/fixtures/** **/e2e/**"
    " **/cypress/** **/playwright/**"
).split()
# Where packages of a monorepo have their sources.
MONOREPO_PATTERNS = (
    "packages/*/src/** packages/*/*/src/** apps/*/src/** sandbox/*/src/** libs/*/src/** modules/*/src/** examples/*/src/** tools/*/src/** website/src/** docs/src/**"
    " @*/*/src/** packages/@*/*/src/**"
).split()
LARGE_SCAN = 1000


def excludes(custom: list[str] | None = None, override: bool = False) -> list[str]:
    """No custom list: the default one; a custom one: added to the core, or alone if it overrides."""
    if not custom:
        return DEFAULT_EXCLUDES
    return list(custom) if override else list(dict.fromkeys([*CORE_EXCLUDES, *custom]))


def path_regex(globs: list[str]) -> str:
    """One expression for many globs; a leading ``**/`` also fits no directory at all."""
    return "|".join(glob_regex(g, escape=True).replace("^.*/", "^(.*/)?", 1) for g in globs) or "^\\b$"


def discover(files: DataFrame, include: list[str], exclude: list[str] | None = None) -> DataFrame:
    """Files (path) that an include glob fits and no exclude glob, once each."""
    kept = files.where(F.col("path").rlike(path_regex(include)))
    if exclude:
        kept = kept.where(~F.col("path").rlike(path_regex(exclude)))
    return kept.dropDuplicates(["path"])


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, content, mtime) of text files below root, by Spark's readers."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return found.select("path", F.decode("content", "UTF-8").alias("content"), F.unix_timestamp("modificationTime").cast("double").alias("mtime"))


def pattern_stats(files: DataFrame, globs: list[str]) -> DataFrame:
    """(pattern, n): how many files each glob fits; 0 for those that fit none. One scan."""
    n = files.agg(*[F.count_if(F.col("path").rlike(path_regex([g]))).alias(f"n{i}") for i, g in enumerate(globs)])
    return n.select(F.explode(F.array(*[F.struct(F.lit(g).alias("pattern"), F.col(f"n{i}").alias("n")) for i, g in enumerate(globs)])).alias("x")).select("x.*")


def missing_paths(wanted: DataFrame, files: DataFrame) -> DataFrame:
    return wanted.join(files.select("path").distinct(), "path", "left_anti")


def spread(files: DataFrame) -> DataFrame:
    """The files over all cores: reading their text takes far longer than its bytes let Spark expect, so that a stored table of a few MB would be one task."""
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism)


def scan(files: DataFrame, parse: Callable, schema: str) -> tuple[DataFrame, DataFrame]:
    """(items, errors) of files parsed by ``parse(path, content)``, which yields tuples of the schema; a file that raises gives an error row, no items.

    Batches of files go to Python by Arrow; the items carry their file's path.
    """
    import pandas as pd
    from pyspark.sql import types as T

    item = T._parse_datatype_string(schema)
    out = T.StructType([T.StructField("path", T.StringType()), T.StructField("error", T.StringType()), T.StructField("items", T.ArrayType(item))])

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in pdf[["path", "content"]].itertuples(index=False):
                try:
                    rows.append((path, None, [dict(zip(item.names, x, strict=True)) for x in parse(path, content)]))
                except Exception as e:  # one bad file mustn't end the scan
                    rows.append((path, f"{type(e).__name__}: {e}", []))
            yield pd.DataFrame(rows, columns=["path", "error", "items"])

    parsed = spread(files.select("path", "content")).mapInPandas(run, out)
    items = parsed.where("error is null").select("path", F.explode("items").alias("x")).select("path", "x.*")
    return items, parsed.where("error is not null").select("path", F.lit("PARSE_ERROR").alias("code"), F.col("error").alias("message"))


def scan_warnings(files: DataFrame, globs: list[str]) -> DataFrame:
    """(code, detail): globs that fit no file, no files at all, or very many."""
    per = pattern_stats(files, globs).where("n = 0").select(F.lit("PATTERN_NO_MATCH").alias("code"), F.col("pattern").alias("detail"))
    total = files.agg(F.count(F.lit(1)).alias("n"))
    code = F.when(F.col("n") == 0, "NO_FILES_MATCHED").when(F.col("n") > LARGE_SCAN, "LARGE_FILE_COUNT")
    return per.union(total.select(code.alias("code"), F.col("n").cast("string").alias("detail")).where("code is not null"))


def cache_split(files: DataFrame, cache: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """files (path, mtime) with ``hit``: whether the cache (path, cached_mtime, result) has the file as it is, and it isn't among changed (path)."""
    c = cache.select("path", "cached_mtime", "result")
    out = files.join(c, "path", "left")
    fresh = F.col("cached_mtime").isNotNull() & (F.col("mtime") <= F.col("cached_mtime"))
    if changed is not None:
        out = out.join(changed.select("path").distinct().withColumn("_changed", F.lit(True)), "path", "left")
        fresh = fresh & F.col("_changed").isNull()
    out = out.withColumn("hit", fresh).withColumn("result", F.when(F.col("hit"), F.col("result")))
    return out.drop("_changed")


def merge_cache(cache: DataFrame, parsed: DataFrame) -> DataFrame:
    """The cache after a scan: newly parsed files (path, cached_mtime, result) replace their old rows."""
    return cache.join(parsed.select("path"), "path", "left_anti").unionByName(parsed)


def changed_files(*lists: DataFrame) -> DataFrame:
    """Distinct paths of committed, uncommitted and untracked changes."""
    out = lists[0].select("path")
    for x in lists[1:]:
        out = out.union(x.select("path"))
    return out.distinct()


def concurrency(n: Column) -> Column:
    """Parallel tasks for n files: n to 5, 10, 20, then a twentieth, 50 at most."""
    return F.when(n <= 10, F.least(n, F.lit(5))).when(n <= 100, 10).when(n <= 500, 20).otherwise(F.least(F.ceil(n / 20), F.lit(50))).cast("int")
