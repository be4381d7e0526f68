"""Source divergence audit: how far each source's use of words is from the other sources of its language, by joint histograms of counts.

A term is a run of ASCII letters (A-Z lower-cased) and characters beyond ASCII. A language keeps the V terms that at least ``min_docs`` of its documents
hold. A group (lang, source) gives a kept term the smoothed share p = 1 + floor(10^9 (count + 1) / (N + V)) with N all its kept occurrences, and two
groups differ in a term by f(p, q) = floor((p - q)^2 / q). All of that is whole numbers.

p depends on a term's count alone, so for a pair of sources f has one value for each combination (count here, count there). Combinations are
tallied, never terms: those of two counts over 0 by pairing the sources of each term, each unordered pair once; those of a count and 0 as what is left of
each source's own histogram of counts; (0, 0) as what is left of V. f is evaluated once a combination, in either direction, times its tally.

Tasks add up what their documents hold, in tables of bounded size, and Spark sums those by (lang, source, term), so neither a frequent term nor a hot source gathers
rows; a kept term's row holds a count for each source that has it. Pairs of sources are as many as the result has rows, for that is what it lists.

Null text, lang and source are ''. Every row is a document of its own, repeated or not. A language without kept terms (V = 0) has its pairs with a value
of 0 and no terms; a source alone in its language has no pairs. Ties rank by the UTF-8 bytes of the item. A text's words are held at once, whole.
An empty table gives an empty result, and extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromatid.llm.common import only, stored

TERM_PATTERN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of UTF-8 as they count: letters in lower case, those of characters beyond ASCII as they are, all others as a space.
_TERM_BYTES = bytes(c if c >= 128 or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
#: Terms that a task adds up before it hands them on.
HELD = 300_000
GROUP = ["lang", "source"]


def share(count: str, total: str) -> Column:
    """p of the column count, where the column total is N + V. Counts whose products leave a long are taken as decimals."""
    near = f"({count} + 1) * 1000000000L DIV {total}"
    far = f"CAST(CAST({count} + 1 AS DECIMAL(19, 0)) * CAST(1000000000 AS DECIMAL(10, 0)) DIV {total} AS BIGINT)"
    return F.expr(f"1 + CASE WHEN {count} < 9000000000 THEN {near} ELSE {far} END")


def difference(p: str, q: str) -> Column:
    """f of the columns p and q."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) DIV {q}")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every term by group, added up over as many documents as leave ``HELD`` terms at most, but one document at least."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def given() -> pa.RecordBatch:
        rows = [(lang, source, term, n, docs[term]) for (lang, source), (all_, docs) in counts.items() for term, n in all_.items()]
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[*GROUP, "term", "count", "docs"])

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in (*GROUP, "text")), strict=True):
            words = text.translate(_TERM_BYTES).split()
            all_, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            before = len(all_)
            all_.update(words)
            docs.update(set(words))
            held += len(all_) - before
            if held > HELD:
                yield given()
                counts.clear()
                held = 0
    if held:
        yield given()


def kept_terms(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """(lang, term, total, held) of the terms that languages keep; held lists (source, count) by source."""
    counted = docs.select(*GROUP, F.col("text").cast("binary").alias("text")).mapInArrow(_count, "lang string, source string, term binary, count long, docs long")
    counts = counted.groupBy(*GROUP, F.col("term").cast("string").alias("term")).agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.array_sort(F.collect_list(F.struct("source", "count"))).alias("held")
    )
    return terms.where(F.col("docs") >= min_docs).select("lang", "term", "total", "held")


def joint_counts(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, x, y, n): for sources a < b of a language, n of its kept terms have x occurrences in a and y in b, 0 included."""
    key = ["lang", "a", "b", "x", "y"]
    both = terms.select("lang", "held", F.posexplode("held").alias("k", "one")).select(
        "lang", "one", F.explode(F.expr("slice(held, k + 2, size(held))")).alias("two")
    )
    both = both.groupBy("lang", F.col("one.source").alias("a"), F.col("two.source").alias("b"), F.col("one.count").alias("x"), F.col("two.count").alias("y"))
    both = both.agg(F.count(F.lit(1)).alias("n"))
    # Counts over 0 in both are taken out of what each source holds, and both sources' terms out of all.
    zero, n = F.lit(0).cast("long"), F.col("n")
    x, y = F.col("x"), F.col("y")
    signed = F.explode(F.array(*[F.struct(i.alias("x"), j.alias("y"), m.alias("n")) for i, j, m in ((x, y, n), (x, zero, -n), (zero, y, -n), (zero, zero, n))]))
    both = both.select("lang", "a", "b", signed.alias("s")).select("lang", "a", "b", "s.*")
    alone = terms.select("lang", F.explode("held").alias("one")).groupBy("lang", F.col("one.source").alias("source"), F.col("one.count").alias("count")).agg(F.count(F.lit(1)).alias("n"))
    pairs = groups.select("lang", F.col("source").alias("a"), "kept").join(groups.select("lang", F.col("source").alias("b")), "lang").where("a < b AND kept > 0")
    ours = pairs.join(alone.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", F.col("count").alias("x"), zero.alias("y"), "n")
    theirs = pairs.join(alone.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", zero.alias("x"), F.col("count").alias("y"), "n")
    held = ours.union(theirs)
    rest = held.select("lang", "a", "b", zero, zero, -n).union(pairs.select("lang", "a", "b", zero, zero, F.col("kept")))
    return both.union(held).union(rest).groupBy(*key).agg(F.sum("n").alias("n")).where("n > 0")


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` for every other source of the language, part ``term`` for the top terms a source overuses."""
    docs = only(docs, "text", *GROUP).select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", *GROUP)])
    terms = stored(kept_terms(docs, min_docs), "terms")
    held = terms.select("lang", "term", "total", F.explode("held").alias("h")).select("lang", "h.source", "term", "h.count", "total")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("occurrences"))
    groups = docs.select(*GROUP).distinct().join(held.groupBy(*GROUP).agg(F.sum("count").alias("held")), GROUP, "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["held", "kept", "occurrences"])
    # The table has a row a group; as a written table its size is known, and so is whether it may be broadcast.
    groups = stored(groups.select(*GROUP, "kept", F.expr("held + kept").alias("size"), F.expr("occurrences + kept").alias("lang_size")), "groups")

    at = {c: groups.select("lang", F.col("source").alias(c), F.col("size").alias(f"size_{c}")) for c in ("a", "b")}
    cells = joint_counts(terms, groups).join(at["a"], ["lang", "a"]).join(at["b"], ["lang", "b"])
    cells = cells.withColumn("p", share("x", "size_a")).withColumn("q", share("y", "size_b"))
    sums = cells.groupBy("lang", "a", "b").agg(F.sum(difference("p", "q") * F.col("n")).alias("ab"), F.sum(difference("q", "p") * F.col("n")).alias("ba"))
    ways = F.explode(F.array(*[F.struct(F.col(s).alias("source"), F.col(i).alias("item"), F.col(v).alias("value")) for s, i, v in (("a", "b", "ab"), ("b", "a", "ba"))]))
    sums = sums.select("lang", ways.alias("w")).select("lang", "w.*")
    pairs = groups.select(*GROUP).join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select(*GROUP, F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    over = held.join(groups, GROUP).withColumn("p", share("count", "size")).withColumn("q", share("total", "lang_size")).where("p > q")
    over = over.select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), difference("p", "q").alias("value"))
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", place).union(over.withColumn("rank", place).where(F.col("rank") <= top))
