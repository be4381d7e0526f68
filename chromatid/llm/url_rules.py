"""URL filters: host-suffix and path-prefix expressions, joined with the rules on short hash prefixes and confirmed by full digests.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or
the end. A null url, or one without ``://``, has an empty host and path and fits no rule. A rule (host, path, verdict) fits its host and
all subdomains where the url's path starts with the rule's; the rule with the longest host + path wins, then the longer host, then block.

Everything is DataFrame expressions. Each distinct (host, path) is judged once and joined back, so a host with a third of all rows
meets as many rows as it has distinct paths; the join back is an equi-join that adaptive execution splits.
Nulls, empty tables, repeated rows and extra columns: every input row is returned once, with the columns named below and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromatid.llm.common import only

#: Hex digits of the digest's prefix that is joined on: 32 bits.
PREFIX_HEX = 8


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise(F.lit(""))


def split_urls(pages: DataFrame) -> DataFrame:
    """Adds host and path to a table with a column url."""
    rest = _rest(F.col("url"))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def expressions(addresses: DataFrame, lengths: list[int]) -> DataFrame:
    """(host, path, expr_host, expr_path, prefix, digest): every host suffix with every path prefix of one of the lengths."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.char_length("path"))
    return (
        addresses.where("host <> ''")
        .withColumn("expr_host", F.explode(F.array_distinct(suffixes)))
        .withColumn("cut", F.explode(cuts))
        .withColumn("expr_path", F.expr("substr(path, 1, cut)"))
        .withColumn("digest", _digest(F.col("expr_host"), F.col("expr_path")))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
        .drop("cut")
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of pages (id, url); rules: (host, path, verdict).

    Rule paths come in few distinct lengths, which bound the path prefixes of a url; they are read first (one small aggregate).
    """
    r = (
        rules.select(F.lower("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .where("rule_host is not null and rule_verdict is not null")
        .distinct()
    )
    lengths = sorted(x[0] for x in r.select(F.char_length("rule_path")).distinct().collect())
    r = r.withColumn("rule_digest", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn("prefix", F.substring("rule_digest", 1, PREFIX_HEX))
    rows = split_urls(only(pages, id_col, "url"))
    if not lengths:
        return rows.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    rank = F.struct(
        (F.char_length("rule_host") + F.char_length("rule_path")).alias("n"), F.char_length("rule_host").alias("h"), (F.col("rule_verdict") == "block").alias("b")
    )
    best = (
        expressions(rows.select("host", "path").distinct(), lengths)
        .join(r, "prefix")
        .where("digest = rule_digest and expr_host = rule_host and expr_path = rule_path")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"), rank).alias("best"))
    )
    return rows.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )
