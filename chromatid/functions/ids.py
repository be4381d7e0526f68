"""Stable ids: rolling hashes and joined parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rolling_hash(text: Column) -> Column:
    """The signed 32-bit hash h = 31 h + c over the characters' code points, wrapping around; 0 for an empty string."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wrap = lambda x: F.pmod(x + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c))


def hash_hex(text: Column) -> Column:
    return F.lower(F.hex(F.abs(rolling_hash(text))))


def stable_drift_id(kind: Column, entity: Column, prop: Column, expected: Column, actual: Column) -> Column:
    """Id of a drift signal by its content; absent and empty parts are left out."""
    parts = F.filter(F.array(kind, entity, prop, expected, actual), lambda p: p.isNotNull() & (p != ""))
    return F.concat_ws(":", F.lit("drift"), kind, entity, hash_hex(F.array_join(parts, "|")))


def group_id(strategy: Column, key: Column) -> Column:
    return F.concat_ws(":", F.lit("group"), strategy, hash_hex(F.concat_ws(":", strategy, key)))


def short_sha(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def node_id(kind: Column, key: Column) -> Column:
    return F.concat_ws(":", F.lower(kind), key)


def edge_id(kind: Column, src: Column, dst: Column) -> Column:
    return F.concat_ws(":", F.lower(kind), src, dst)


def signal_id(kind: Column, path: Column, line: Column, value: Column) -> Column:
    """Id of a raw signal: type, path, line and the first 20 characters of its value."""
    return F.concat_ws(":", kind, path, line.cast("string"), F.substring(value, 1, 20))
