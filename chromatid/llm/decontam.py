"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared in a normal form: lower case, ASCII punctuation and white space as single spaces. A region of a document
that is within k edits of an item of m characters shares at least m + 1 - q (k + 1) of its q-grams, all on diagonals (document
position less item position) that lie within k of each other. So:

1. every q-gram of a document is looked up among the items' q-grams (a bit table, then exact 64-bit hashes);
2. shared q-grams are counted by item in diagonal bands that overlap by k of that item, so that some band holds all those of any true region;
3. bands that meet the item's bound are regions to check; banded alignment gives the least edit distance of every end within a band.

A region counts within k = ``edit_rate`` of the item's characters, rounded down. q is 8; an item for which the lemma says nothing at that q is searched with the
largest q at which it does, m // (k + 1). Of one item's regions that overlap the nearest counts (then the one that ends first); all others are
returned, so a document that holds an item twelve times has twelve regions of it, whatever else is in the benchmark.

Items of fewer than 8 characters are words rather than passages: they count where they don't begin or end within a word, which in scripts that are
written without spaces (or whose words take endings) is anywhere.

Documents are independent rows: no shuffle, and each whole text is searched, in time and memory that grow with its length. Items travel to the executors in
blocks of about ``block_bytes`` (6 MB, which most benchmarks are within), each searched in a pass of its own over the documents; the driver and a task hold one block
at a time, so what they hold doesn't grow with the benchmark.

Null texts hold nothing; null items and items without a letter or digit are left out; repeated items are searched once, under their smallest id. Repeated
documents are searched each; an empty table gives an empty result. Extra columns are ignored (kept by ``decontaminate``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromatid.llm.common import free_name, only, release, stored

Q, EDIT_RATE, BLOCK_BYTES = 8, 0.08, 6 << 20
#: Shared q-grams that are counted at once; more are counted in turns.
COUNTED = 1 << 22
#: Ranges of scripts whose words aren't set apart by spaces, or take endings: Thai to Myanmar, Khmer, Japanese, Chinese, Korean.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1100-\u11ff\u1780-\u17ff\u2e80-\u9fff\ua960-\ua97f\uac00-\ud7ff\uf900-\ufaff\uff66-\uffdc\U00020000-\U0003ffff]")
#: By code, up to 128 for all others: whether it stands for a space.
_IS_SPACE = np.array([not chr(c).isalnum() for c in range(128)] + [False])
_PRIME = 0x9E3779B97F4A7C15
_HIT = "array<struct<item_id: bigint, start: bigint, end: bigint, distance: bigint, shared: bigint>>"
_built: dict[str, list[Items]] = {}


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the normal form's characters, place of each in the lower-cased text)."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    space = _IS_SPACE[np.minimum(raw, 128)]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    at = np.flatnonzero(keep)
    if len(at) and space[at[-1]]:
        at = at[:-1]
    if len(at) and space[at[0]]:
        at = at[1:]
    return np.where(space[at], np.uint32(32), raw[at]), at


def qgrams(a: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hashes of the q characters from each place on, by doubling."""
    if len(a) < q:
        return np.empty(0, dtype=np.uint64)
    by = {1: a.astype(np.uint64) + np.uint64(1)}
    n = 1
    while 2 * n <= q:
        x = by[n]
        by[2 * n] = x[:-n] * np.uint64(pow(_PRIME, n, 1 << 64)) + x[n:]
        n *= 2
    out, at = None, 0
    for k in sorted(by, reverse=True):
        if at + k <= q:
            x = by[k]
            out = x if out is None else out[: len(x) - at] * np.uint64(pow(_PRIME, k, 1 << 64)) + x[at : at + len(out)]
            at += k
    out = out[: len(a) - q + 1]
    return (out ^ (out >> np.uint64(32))) * np.uint64(_PRIME)


def edits_of(m: int, edit_rate: float) -> int:
    return int(edit_rate * m)


def q_of(m: int, q: int, edit_rate: float) -> int:
    """The q that an item of m characters is searched with: at most q, and small enough that its bound is 1 at least."""
    return max(1, min(q, m // (edits_of(m, edit_rate) + 1)))


class Items:
    """Items of one q (id, normal form) and the places of their q-grams. short: they are found as whole words only."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], q: int, edit_rate: float, short: bool = False):
        self.q, self.short = q, short
        self.ids, self.bytes = [i for i, _ in items], [a for _, a in items]
        m = np.array([len(a) for a in self.bytes], dtype=np.int64)
        self.edits = np.array([edits_of(int(x), edit_rate) for x in m], dtype=np.int64)
        self.bound = m + 1 - q * (self.edits + 1)
        grams = [qgrams(a, q) for a in self.bytes]
        hashes = np.concatenate([*grams, np.empty(0, dtype=np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, dtype=np.int64)]).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        self.item, self.place = item[order], place[order]
        self.hash, self.first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.bits = max(16, int(np.ceil(np.log2(max(1, len(self.hash)) * 64))))
        self.table = np.zeros(1 << self.bits, dtype=bool)
        self.table[self.hash >> np.uint64(64 - self.bits)] = True
        # An item's bands are twice as wide as its edits, and dealt out every half of that; halves are powers of two.
        self.shift = np.maximum(3, np.ceil(np.log2(self.edits + 1)).astype(np.int64))

    def bands(self, a: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, half band, shared q-grams) of the bands that meet their item's bound."""
        h = qgrams(a, self.q)
        at = np.flatnonzero(self.table[h >> np.uint64(64 - self.bits)]) if len(self.hash) else np.empty(0, dtype=np.int64)
        if not len(at):
            return []
        k = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        ok = self.hash[k] == h[at]
        at, k = at[ok], k[ok]
        n = self.count[k]
        if int(n.sum()) < int(self.bound.min()):
            return []
        keys, count = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        ends = np.cumsum(n)
        low = 0
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + COUNTED, side="right")))
            part, m = slice(low, high), n[low:high]
            of = np.repeat(self.first[k[part]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            item, diagonal = self.item[of], np.repeat(at[part], m) - self.place[of]
            # Half band b counts for the bands b - 1 and b, each of two halves.
            key, times = np.unique(item * (1 << 40) + ((diagonal >> self.shift[item]) + (1 << 38)), return_counts=True)
            both, into = np.unique(np.concatenate([keys, key]), return_inverse=True)
            count = np.bincount(into, np.concatenate([count, times]), len(both)).astype(np.int64)
            keys, low = both, high
        follows = np.flatnonzero(keys[1:] == keys[:-1] + 1)
        both = count.copy()
        both[follows] += count[follows + 1]
        # A band may also begin with an empty half: then it is its second half alone, counted as that half's own band.
        found = np.flatnonzero(both >= self.bound[keys >> 40])
        return [(int(keys[f] >> 40), int(keys[f] & ((1 << 40) - 1)) - (1 << 38), int(both[f])) for f in found]

    def ends(self, a: np.ndarray, item: int, half: int) -> tuple[np.ndarray, np.ndarray]:
        """(ends, distances) of all regions within the item's edits whose diagonals lie in the band."""
        p, k, shift = self.bytes[item], int(self.edits[item]), int(self.shift[item])
        lo, hi = half << shift, (half + 2) << shift
        if not k:  # no edit: the places of the band where the item stands as it is
            x = np.arange(max(0, lo), min(len(a) - len(p), hi) + 1)
            x = x[a[x] == p[0]] if len(x) else x
            x = np.array([y for y in x.tolist() if (a[y : y + len(p)] == p).all() and not (self.short and _within_word(a, y, y + len(p)))], dtype=np.int64)
            return x + len(p), np.zeros(len(x), dtype=np.int64)
        return banded(p, a, lo - k, hi + k, k)

    def regions(self, a: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(start, end, distance, item, shared) of every item's regions that don't overlap, nearest ones first."""
        by_item: dict[int, list[tuple[int, int]]] = {}
        for item, half, shared in self.bands(a):
            by_item.setdefault(item, []).append((half, shared))
        for item, found in by_item.items():
            m, k = len(self.bytes[item]), int(self.edits[item])
            ends, distances, shares = [], [], []
            for half, shared in found:
                e, d = self.ends(a, item, half)
                ends.append(e)
                distances.append(d)
                shares.append(np.full(len(e), shared))
            ends, distances, shares = np.concatenate(ends), np.concatenate(distances), np.concatenate(shares)
            order = np.lexsort((-shares, ends, distances))
            # An end whose region can't lie beside one that is taken is out: a region that begins at or after another's end ends m - k later at least.
            ends, distances, shares = ends[order], distances[order], shares[order]
            taken = []
            while len(ends):
                end, distance, shared = int(ends[0]), int(distances[0]), int(shares[0])
                start = end - m if not distance else self.start(a, item, end, distance)
                ok = all(end <= x or y <= start for x, y in taken)
                out = (ends > start) & (ends < end + m - k) if ok else np.arange(len(ends)) == 0
                out[0] = True
                if ok:
                    taken.append((start, end))
                    yield start, end, distance, item, shared
                ends, distances, shares = ends[~out], distances[~out], shares[~out]

    def start(self, a: np.ndarray, item: int, end: int, distance: int) -> int:
        """Where the shortest region of that distance begins that ends there."""
        p = self.bytes[item][::-1]
        k = int(self.edits[item])
        r = np.ascontiguousarray(a[max(0, end - len(p) - k) : end][::-1])
        lengths, distances = banded(p, r, -k, k, k, anchored=True)
        return end - int(lengths[distances == distances.min()].min())


def _within_word(a: np.ndarray, x: int, y: int) -> bool:
    """Whether a cut at x or y would part two letters of a word."""
    return any(0 < at < len(a) and not any(c == 32 or _UNSPACED.match(chr(c)) for c in (int(a[at - 1]), int(a[at]))) for at in (x, y))


def banded(p: np.ndarray, a: np.ndarray, lo: int, hi: int, most: int, anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(ends in a, distances) of the alignments of all of p with a part of a on the diagonals lo..hi, for each end the least if it is at most ``most``.

    anchored: the part begins at 0. Where every alignment takes more edits it stops early.
    """
    width = hi - lo + 1
    far = 1 << 30
    column = np.arange(lo, hi + 1)
    ramp = np.arange(width)
    row = np.where((column >= 0) & (column <= len(a)), column if anchored else 0, far).astype(np.int64)
    edge = np.iinfo(np.uint32).max  # no character
    padded = np.concatenate([np.full(max(0, -lo) + 1, edge, dtype=np.uint32), a, np.full(max(0, hi + len(p) - len(a)) + 1, edge, dtype=np.uint32)])
    shift = max(0, -lo) + 1
    for i in range(1, len(p) + 1):
        j = column + i  # columns of this row; its character is a[j - 1]
        here = padded[lo + i - 1 + shift : lo + i - 1 + shift + width]
        new = row + (here != p[i - 1])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new[(j < 0) | (j > len(a))] = far
        if j[0] <= 0 <= j[-1]:
            new[-j[0]] = i
        row = np.minimum.accumulate(new - ramp) + ramp
        row[(j < 0) | (j > len(a))] = far
        if not i % 16 and row.min() > most:
            break
    ok = np.flatnonzero(row <= most) if i == len(p) else np.empty(0, dtype=np.int64)
    return column[ok] + len(p), row[ok]


def index(items: list[tuple[int | None, str]], q: int = Q, edit_rate: float = EDIT_RATE) -> list[Items]:
    """The items by their q, short ones apart."""
    by: dict[tuple[int, bool], list] = {}
    for i, t in items:
        a = normal(t)[0]
        if len(a):
            by.setdefault((q_of(len(a), q, edit_rate), len(a) < q), []).append((i, a))
    return [Items(x, n, edit_rate, short) for (n, short), x in by.items()]


def _spans(text: str, at: np.ndarray, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in characters of the text itself, end exclusive."""
    if len(text.lower()) == len(text):
        return [(int(at[s]), int(at[e - 1]) + 1) for s, e in found]
    ends = np.cumsum([len(c.lower()) for c in text])
    return [tuple(int(np.searchsorted(ends, at[x], side="right")) + d for x, d in ((s, 0), (e - 1, 1))) for s, e in found]


def search(text: str | None, items: list[Items]) -> list[dict[str, int | None]]:
    """Regions of the text that are within an item's edits; of overlapping ones of one item, the nearest, then the one that ends first."""
    if not text:
        return []
    a, at = normal(text)
    best = [(start, end, distance, n, item, shared) for n, part in enumerate(items) for start, end, distance, item, shared in part.regions(a)]
    if not best:
        return []
    best.sort(key=lambda f: (f[0], f[3], f[4]))
    return [
        {"item_id": items[f[3]].ids[f[4]], "start": s, "end": e, "distance": f[2], "shared": f[5]}
        for f, (s, e) in zip(best, _spans(text, at, [f[:2] for f in best]), strict=True)
    ]


def _finder(items: list[tuple[int | None, str]], q: int, edit_rate: float) -> Column:
    """The regions of a row's text that hold one of the items. A worker keeps the index of one block."""
    name = hashlib.sha256(repr((items, q, edit_rate)).encode("utf-8", "replace")).hexdigest()

    @F.pandas_udf(_HIT)
    def find(text: pd.Series) -> pd.Series:
        if name not in _built:
            _built.clear()
            _built[name] = index(items, q, edit_rate)
        out = pd.Series([search(t, _built[name]) for t in text.tolist()], dtype=object)
        release()
        return out

    # Not to be evaluated again by filters that Spark derives from it.
    return find.asNondeterministic()("text")


def finders(benchmark: DataFrame, q: int = Q, edit_rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> Iterator[Column]:
    """For one block of benchmark (item_id, text) after the other, an array of regions (item_id, start, end, distance, shared) of a column text."""
    items = only(benchmark, "item_id", "text").where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    # Items are dealt by a hash to as many blocks as their bytes need, so a block has about block_bytes.
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        if rows:
            yield _finder([(r["item_id"], r["text"]) for r in rows], q, edit_rate)


def regions(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, start, end, distance, shared): one row per region of a document that holds an item. What all blocks but the last find is stored."""
    rows = only(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out, last = [], None
    for find in finders(benchmark, **options):
        if last is not None:
            out.append(stored(last, "regions"))
        last = rows.select("doc_id", F.explode(find).alias("h")).select("doc_id", "h.item_id", "h.start", "h.end", "h.distance", "h.shared")
    if last is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id long, start long, end long, distance long, shared long")
    for part in out:
        last = last.union(part)
    return last


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any such region, with all their columns. What a block leaves is stored for the next one."""
    hits, out, first = free_name(docs, "_hits"), docs, True
    for find in finders(benchmark, **options):
        out = (out if first else stored(out, "decontaminated")).withColumn(hits, find).where(F.size(hits) == 0).drop(hits)
        first = False
    return out
