"""N-gram Jaccard self-join by MinHash banding.

A text's n-grams are runs of five words; words are runs of letters, marks, digits and underscores in lower case. A text of one to four words has
one n-gram, itself. Two documents are linked where the Jaccard similarity of their n-gram sets is at least the threshold.

1. Spark's expressions cut texts into words and hash them. Every text becomes a fingerprint of its n-gram set and MinHash values in bands; the
   numbers of bands and rows follow from the target recall at the threshold (``band_plan``). Documents with one fingerprint are one
   representative with a count.
2. Representatives are shuffled on their band hashes. A bucket is the representatives that share one; a bucket whose members all share an earlier
   band's bucket as well is left out, as every pair of it is verified there.
3. The members' n-gram sets are made anew from their texts. A bucket is dealt to tiles of about ``tile_rows`` representatives (fewer, if their sets are
   large) by a hash; each pair of tiles is one group, in which the pairs that share this band and none before are verified on the
   full sets. It returns each representative's number of links and a spanning forest of the links, never the pairs.
4. Connected components of the verified forests are the classes.

Counts include copies: a document's n_links is the number of all other documents linked with it directly. A class's id is its smallest doc_id.

Null and word-less texts link with nothing and are their own class. Null doc_ids are rows like others; a class of nothing else has a
null id. Repeated rows are copies. Very long texts are whole sets like others: the largest thing a task holds is two tiles' sets, about 2 * ``tile_grams``
n-grams and two texts' own. N-grams and fingerprints are 64-bit hashes: two sets are taken for one with a chance of 2^-64.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromatid.llm.common import WORD_PATTERN, connected_components, forest, free_name, join_groups, only, releasing, runs, stored, text_of

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: At this similarity, at most this share of pairs may become candidates.
UNLIKE, UNLIKE_SHARE = 0.3, 0.03
#: A tile holds about so many representatives, and about so many n-grams.
TILE_ROWS, TILE_GRAMS = 256, 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def band_plan(threshold: float = THRESHOLD, recall: float = RECALL, unlike: float = UNLIKE, share: float = UNLIKE_SHARE) -> tuple[int, int]:
    """(bands, rows): the fewest hashes that find a pair at the threshold with the wanted recall and few pairs that are unlike."""
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if 1 - (1 - unlike**rows) ** bands <= share:
            return bands, rows
    return bands, rows


def word_hashes(column: str = "text") -> Column:
    """The text's words in order, each as a 64-bit hash."""
    return F.transform(F.regexp_extract_all(F.lower(text_of(column)), F.lit(WORD_PATTERN), F.lit(0)), lambda w: F.xxhash64(w))


def ngrams(words: np.ndarray, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of a text's word hashes."""
    h = words.view(np.uint64)
    if not len(h):
        return h
    k = max(1, len(h) - n + 1)
    total = np.zeros(k, dtype=np.uint64)
    for i in range(min(n, len(h))):
        total = (total ^ h[i : i + k]) * _MIX
        total ^= total >> np.uint64(29)
    return np.unique(total)


def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(1, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def signature(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash a band, of the smallest value of each of its hash functions (of the n-grams' upper 32 bits)."""
    a, b = _multipliers(bands * rows)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    low = np.full(bands * rows, np.iinfo(np.uint32).max, dtype=np.uint32)
    for k in range(0, len(x), 512):
        low = np.minimum(low, (x[k : k + 512, None] * a[None, :] + b[None, :]).min(axis=0))
    low = low.astype(np.uint64).reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64) * _MIX
    for r in range(rows):
        out = (out ^ low[:, r]) * _MIX
        out ^= out >> np.uint64(31)
    return out


def _fingerprint(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes())


def _lists(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    """The rows of a column of arrays of longs."""
    c = batch.column(column)
    flat, at = c.flatten().to_numpy(zero_copy_only=False), c.offsets.to_numpy() - c.offsets[0].as_py()
    return (flat[x:y] for x, y in zip(at[:-1], at[1:], strict=True))


def _sketch(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, counts, marks = [], [], []
            for words in _lists(batch, "words"):
                g = ngrams(words)
                counts.append(len(g))
                prints.append(_fingerprint(g))
                marks.append(signature(g, bands, rows) if len(g) else np.empty(0, dtype=np.uint64))
            ends = np.cumsum([0, *map(len, marks)])
            flat = np.concatenate([*marks, np.empty(0, dtype=np.uint64)]).view(np.int64)
            columns = [
                batch.column("doc_id"), batch.column("text_hash"), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(counts, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "fp", "n_grams", "bands"])

    return run


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the words by the n-gram set as bytes; a representative that repeated rows bring again to a task mostly passes once."""
    seen: set[int] = set()
    for batch in batches:
        if len(seen) > 200_000:
            seen.clear()
        keep, sets = [], []
        for k, (fp, words) in enumerate(zip(batch.column("fp").to_pylist(), _lists(batch, "words"), strict=True)):
            if fp not in seen:
                seen.add(fp)
                keep.append(k)
                sets.append(ngrams(words).tobytes())
        rest = batch.select([c for c in batch.schema.names if c != "words"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sets, pa.binary())], names=[*rest.schema.names, "grams"])


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all intersections, by products of slices of the 0/1 matrix of sets and n-grams."""
    every = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, count = np.unique(every, return_inverse=True, return_counts=True)
    keep = count[code] > 1
    code, of = code[keep], of[keep]
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    code, of = code[order], of[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    width = max(64, (1 << 22) // len(sets))
    top = int(code[-1]) + 1 if len(code) else 0
    for lo in range(0, top, width):
        x, y = np.searchsorted(code, [lo, lo + width])
        m = np.zeros((len(sets), min(width, top - lo)), dtype=np.float32)
        m[of[x:y], code[x:y] - lo] = 1
        out += m @ m.T
    return out


def verified(sets: list[np.ndarray], candidate: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of the candidate pairs (a symmetric matrix) that reach the threshold on their full sets."""
    out = np.zeros_like(candidate)
    some = np.flatnonzero(candidate.any(axis=1))
    size = np.array([len(s) for s in sets], dtype=float)
    i, j = np.nonzero(np.triu(candidate))
    # Sets whose sizes alone keep them apart need no look.
    near = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
    i, j = i[near], j[near]
    if len(i) <= 4 * len(some):
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], dtype=float)
    else:
        place = np.cumsum(candidate.any(axis=1)) - 1
        both = _shared([sets[x] for x in some])[place[i], place[j]]
    # In whole numbers, but for the threshold: shared >= threshold * union.
    ok = both >= threshold * (size[i] + size[j] - both) - 1e-9
    out[i[ok], j[ok]] = out[j[ok], i[ok]] = True
    return out


def first_shared(bands: np.ndarray, band: int, hash_: int) -> np.ndarray:
    """Boolean matrix of the pairs of rows that share this band and none before it."""
    of = bands[:, band] == hash_
    out = of[:, None] & of[None, :]
    for b in range(band):
        out &= bands[:, b][:, None] != bands[:, b][None, :]
    np.fill_diagonal(out, False)
    return out


def _verify(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        src, dst, links, held = [], [], [], 0
        for (band, hash_, a, b), pdf in runs(batches, ["band", "hash", "a", "b"]):
            pdf = pdf.drop_duplicates("fp")
            candidate = first_shared(np.array(pdf["bands"].tolist()), int(band), int(hash_))
            if a != b:  # pairs within a tile belong to the group of that tile alone
                first = (pdf["tile"] == a).to_numpy()
                candidate &= first[:, None] != first[None, :]
            if not candidate.any():
                continue
            linked = verified([np.frombuffer(g, dtype=np.uint64) for g in pdf["grams"]], candidate, threshold)
            ids, root = pdf["fp"].to_numpy(), forest(linked)
            some = np.flatnonzero(linked.any(axis=1))
            src.append(ids[some])
            dst.append(ids[root[some]])
            links.append((linked @ pdf["copies"].to_numpy())[some])
            held += len(some)
            if held > 20_000:
                yield pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst), "links": np.concatenate(links).astype("int64")})
                src, dst, links, held = [], [], [], 0
        if held:
            yield pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst), "links": np.concatenate(links).astype("int64")})

    return run


def buckets(reps: DataFrame, tile_rows: int, tile_grams: int) -> DataFrame:
    """(fp, in): the buckets (band, hash, tiles) that each representative has to be verified in, an array of at most as many as there are bands."""
    banded = reps.select("fp", F.posexplode("bands").alias("band", "hash"))
    shared = banded.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = banded.join(shared, ["band", "hash"]).join(reps.select("fp", "n_grams", F.col("bands").alias("all")), "fp")
    members = stored(members, "ngram-buckets")
    # The bands before this one in which a member is like the bucket's smallest: one that all members have in common holds all their pairs.
    first = members.groupBy("band", "hash").agg(F.min(F.struct("fp", "all")).alias("first"))
    bits = F.zip_with("all", "first.all", lambda x, y: (x == y).cast("long"))
    like = F.aggregate(F.slice(bits, 1, F.col("band")), F.lit(0).cast("long"), lambda m, bit: m * 2 + bit)
    per = (
        members.join(first, ["band", "hash"])
        .withColumn("like", like)
        .groupBy("band", "hash")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("grams"), F.bit_and("like").alias("like"))
    )
    tiles = F.greatest(F.ceil(F.col("n") / float(tile_rows)), F.ceil(F.col("grams") / float(tile_grams))).cast("int")
    kept = per.where("like = 0").select("band", "hash", F.least(tiles, F.col("n").cast("int")).alias("tiles"))
    return members.select("band", "hash", "fp").join(kept, ["band", "hash"]).groupBy("fp").agg(F.collect_list(F.struct("band", "hash", "tiles")).alias("in"))


def classes(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, tile_rows: int = TILE_ROWS, tile_grams: int = TILE_GRAMS
) -> DataFrame:
    """(doc_id, text_hash, class_key, class_id, n_links) for every row of docs (doc_id, text).

    text_hash is Spark's xxhash64 of the text; class_key is one for each class, and null for texts without words. Both help callers that
    pick a row of each class.
    """
    bands, rows = band_plan(threshold, recall)
    if bands > 63:
        raise ValueError("so high a recall at so low a threshold takes more than 63 bands")
    texts = only(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    sketched = texts.select("doc_id", "text_hash", word_hashes().alias("words")).mapInArrow(
        releasing(_sketch(bands, rows)), f"doc_id {kind}, text_hash long, fp long, n_grams long, bands array<long>"
    )
    sketched = stored(sketched, "ngram-sketches")
    reps = stored(
        sketched.where("n_grams > 0")
        .groupBy("fp")
        .agg(
            F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("min_id"), F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("bands").alias("bands"),
            F.first("n_grams").alias("n_grams"),
        ),
        "ngram-reps",
    )
    wanted = reps.join(buckets(reps, tile_rows, tile_grams), "fp").select(
        "fp", F.col("row.doc_id").alias("w_id"), F.col("row.text_hash").alias("w_hash"), "copies", "bands", "in"
    )
    sets = (
        texts.join(wanted, (F.col("text_hash") == F.col("w_hash")) & F.col("doc_id").eqNullSafe(F.col("w_id")))
        .select("fp", "copies", "bands", "in", word_hashes().alias("words"))
        .mapInArrow(releasing(_grams), "fp long, copies long, bands array<long>, in array<struct<band: int, hash: bigint, tiles: int>>, grams binary")
    )
    dealt = sets.withColumn("x", F.explode("in")).select("fp", "copies", "bands", "grams", "x.*")
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    paired = dealt.select("band", "hash", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "fp", "copies", "bands", "grams")
    key = ["band", "hash", "a", "b"]
    found = paired.repartition(*key).sortWithinPartitions(*key).mapInPandas(releasing(_verify(threshold)), "src long, dst long, links long")
    found = stored(found, "ngram-links")

    links = found.groupBy(F.col("src").alias("fp")).agg(F.sum("links").alias("rep_links"))
    joined = connected_components(found.select("src", "dst")).select(F.col("id").alias("fp"), "component")
    of_rep = reps.select("fp", "copies", "min_id").join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    of_rep = stored(of_rep.join(links, "fp", "left"), "ngram-members")
    ids = of_rep.groupBy("component").agg(F.min("min_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    totals = of_rep.agg(F.count(F.lit(1)), F.sum("copies")).first()
    of_rep = join_groups(of_rep, ids, "component", totals[0]).select(
        "fp", F.col("copies").alias("n"), F.col("component").alias("class_key"), "class_id", (F.coalesce("rep_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = sketched.where("n_grams > 0").select("doc_id", "text_hash", "fp")
    out = join_groups(out, of_rep, "fp", totals[1] or 0).select("doc_id", "text_hash", "class_key", "class_id", F.col("n_links").cast("long").alias("n_links"))
    none = sketched.where("n_grams = 0").select("doc_id", "text_hash", F.lit(None).cast("long"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long"))
    return out.union(none)


def join(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, n_links) for every row of docs."""
    return classes(docs, **options).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, the one with the smallest doc_id (null last), text hash and other columns, with all its columns; rows without words all stay.

    The choice is the same in every run: of rows that share doc_id and text, the one whose other columns have the smallest digest stays, and only rows alike in every
    column are taken for each other.
    """
    hash_, length, nth = (free_name(docs, n) for n in ("_hash", "_length", "_nth"))
    spoken = F.coalesce(F.col("text").rlike(WORD_PATTERN), F.lit(False))
    found = classes(docs, **options).where("class_key is not null")
    first = found.groupBy("class_key").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "text_hash")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    rows = docs.where(spoken).withColumn(hash_, F.xxhash64("text")).withColumn(length, F.char_length("text"))
    kept = rows.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col(hash_) == F.col("first_hash")), "left_semi")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    place = Window.partitionBy("doc_id", hash_).orderBy(length, F.sha2(F.to_json(F.struct(F.lit(0).alias("_"), *others)), 256))
    kept = kept.withColumn(nth, F.row_number().over(place)).where(F.col(nth) == 1).drop(hash_, length, nth)
    return kept.unionByName(docs.where(~spoken))
