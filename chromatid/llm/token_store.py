"""Token ids as binary: every document is one zstandard frame, compressed with a dictionary that all documents share.

A store is a folder of three Parquet tables, which Spark's writers commit, so it lives in any store that Spark reaches:

* ``dictionary``: one row (dict_hash, dictionary, tokenizer, end_id);
* ``chunks``: rows (shard, chunk, dict_hash, payload): payload is frames one after another, about ``CHUNK_BYTES`` of them;
* ``offsets``: one row per document (shard, chunk, nth, doc_id, start, n_tokens, offset, length), sorted by doc_id: where its frame lies in
  its chunk's payload, and how many ids all documents before it have.

Documents are dealt to shards by ranges of doc_id, null first, and lie in ascending order; a frame holds little-endian unsigned 32-bit ids,
ending with the end id. There are at most ``MAX_SHARDS`` shards, whatever the input; a shard is one file of each table, so a reader that wants few documents
reads the payloads of their shards only. The dictionary is trained on pieces of the serialized ids of a bounded sample of documents of any length,
taken by a hash; where there are too few pieces to train on, they are the dictionary themselves.

Null text is empty text (one id: the end id). Very long texts are encoded whole, each a frame of its own. Repeated rows are stored as often as they
come, and may lie in several shards. An empty table gives an empty store. Extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chromatid.llm import common
from chromatid.llm.common import batches_of, only, releasing, stored

CHUNK_BYTES = 1 << 20
#: The dictionary is trained on about so many documents, so many pieces of each spread over its length, each of so many ids.
SAMPLE_DOCS, DOC_PIECES, PIECE_IDS, DICT_BYTES = 400, 16, 512, 32_768
MAX_SHARDS = 1 << 16
#: Bytes that the memo of pieces may take, at about _PIECE_BYTES a piece beside its characters.
MEMO_BYTES, _PIECE_BYTES = 96 << 20, 180
#: Shards that a reader names in its filter at most; beyond, it reads all and joins.
_NAMED = 1000
_SHARD_CHARS = 16 << 20
_PORTION = 4 << 20
_loaded: dict = {}


_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: A Latin-1 word in any case with ASCII punctuation behind it: its ids are its letters' in lower case, then its punctuation's.
_SIMPLE = re.compile(rf"([{_LETTERS}]*)([,.!?;:%$#*&|()\"\-]*)")
_LOWER = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Texts of other characters, or with other than a letter or digit before a comma or full stop, are split at spaces only.
_UNUSUAL = rf"[^ -~\n{_LETTERS}]|[^0-9{_LETTERS}][,.][ \n]|<\|"


class Pieces:
    """Ids of pieces, one after another in an array that grows; a piece is its place in the order they came."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.ids, self.begin, self.size, self.used = np.empty(1 << 20, dtype="<u4"), np.empty(1 << 18, dtype="int64"), np.empty(1 << 18, dtype="int64"), 0

    def add(self, pieces: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        at, k = len(self.place), len(pieces)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while at + k > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.begin, self.size))
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[at : at + k], self.size[at : at + k] = self.used + np.cumsum(size) - size, size
        self.used += len(ids)
        self.chars += sum(map(len, pieces))
        self.place.update(zip(pieces, range(at, at + k), strict=True))

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces one after another, where each piece's end)."""
        size = self.size[places]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.begin[places] - (ends - size), size) + np.arange(total)], ends


class Encoder:
    """The tokenizer, with a bounded memo of ids by piece.

    Its pre-tokenizer never joins characters across a space or line feed, or letters and the punctuation behind them, and lower-cases
    them all; so a text's ids are its pieces' ids one after another. A tokenizer for which that isn't so on a probe of such texts encodes whole texts.
    """

    PROBE = (
        "The quick, brown Fox (jumps) over 12.5 dogs; isn't it? YES!\nÉté à Ärger: straße -- \"quoted\" & more...",
        "a,b c . d , e\nx, y. z <|end|> Σίσυφος 日本語 naïve\tTAB  two   spaces \n\n $5 #tag *** %%% don't I'LL",
    )

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.name, self.tokenizer = f"ids of {path}", Tokenizer.from_file(path)
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, dtype=bool)
        for w, i in words.items():
            self.ends[i] = w.endswith("</w>")
        self.whole = False
        self.whole = any(x.tolist() != y.tolist() for x, y in zip(self.encode(list(self.PROBE)), self._encode_whole(list(self.PROBE)), strict=True))

    def _encode_whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _one_by_one(self, known: Pieces, new: list[str]) -> None:
        ids = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in new]
        known.add(new, np.array(list(itertools.chain.from_iterable(ids)), dtype="<u4"), np.array([len(x) for x in ids], dtype="int64"))

    def _learn(self, known: Pieces, new: list[str]) -> None:
        place = known.place
        letters, pairs, others = [], [], []
        for w in new:
            if w.isascii() and w.isalpha() and w.islower() or _LOWER.fullmatch(w):
                letters.append(w)
            elif (m := _SIMPLE.fullmatch(w)) and m[1]:
                pairs.append((w, m[1].lower(), m[2]))
            else:
                others.append(w)
        told = set(letters)
        letters += {x for _, x, _ in pairs if x not in place and x not in told}
        for k in range(0, len(letters), 2048):
            # A word of letters is one pre-token, whose last id alone ends a word.
            part = letters[k : k + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                known.add(part, ids, np.diff(cuts, prepend=0))
            else:
                self._one_by_one(known, part)
        told = set(others)
        self._one_by_one(known, others + list({x for _, _, x in pairs if x and x not in place and x not in told}))
        pairs = [x for x in pairs if x[0] not in place]
        ends = np.array([(place[x], place[y] if y else -1) for _, x, y in pairs], dtype="int64").reshape(-1, 2)
        ids, _ = known.take(ends[ends >= 0])
        size = known.size[ends[:, 0]] + np.where(ends[:, 1] >= 0, known.size[ends[:, 1]], 0)
        known.add([x[0] for x in pairs], ids, size)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if self.whole:
            return self._encode_whole(texts)
        whole = pa.array(texts, pa.large_string())
        plain = pc.utf8_lower(whole)
        for mark in (", ", ",\n", ". ", ".\n"):
            plain = pc.replace_substring(plain, mark, f" {mark[0]} ")
        whole = pc.if_else(pc.match_substring_regex(whole, _UNUSUAL), whole, plain)
        pieces = pc.split_pattern(pc.replace_substring(whole, "\n", " "), " ")
        coded = pieces.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        memo = common.memo(self.name)
        known = memo.setdefault("pieces", Pieces())
        new = [w for w in words if w not in known.place]
        if known.chars + sum(map(len, new)) + (len(known.place) + len(new)) * _PIECE_BYTES > MEMO_BYTES:
            known = memo["pieces"] = Pieces()
            new = words
        self._learn(known, new)
        places = np.fromiter(map(known.place.__getitem__, words), dtype="int64", count=len(words))
        out, ends = known.take(places[coded.indices.to_numpy(zero_copy_only=False)])
        edges = np.concatenate([[0], ends])[np.asarray(pieces.offsets)]
        return [out[x:y] for x, y in itertools.pairwise(edges.tolist())]


def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _pack(ids: np.ndarray, end_id: int) -> bytes:
    return ids.tobytes() + end_id.to_bytes(4, "little")


def _portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _PORTION characters; a longer text is one of its own."""
    begin = held = 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= _PORTION:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _sample_pieces(tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for h, text in zip(pdf["h"].tolist(), pdf["text"].tolist(), strict=True):
                raw = _pack(encoder(tokenizer_path).encode([text])[0], end_id)
                cut = 4 * PIECE_IDS
                at = np.unique(np.linspace(0, (len(raw) - 1) // cut, DOC_PIECES).astype(int))
                yield pd.DataFrame({"h": h, "k": at, "piece": [raw[k * cut : (k + 1) * cut] for k in at.tolist()]})

    return run


def train_dictionary(docs: DataFrame, eligible: int, tokenizer_path: str, end_id: int) -> bytes:
    """From about SAMPLE_DOCS of the eligible documents (those with text), by a share of their hashes; their pieces are cut out by the tasks."""
    rows = only(docs, "doc_id", "text").where("text <> ''").withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1) / float(1 << 63))
    # Repeated rows have one hash and count once; a share of the range, so that no task sends more than its part.
    sample = rows.where(F.col("h") < min(1.0, SAMPLE_DOCS / max(1, eligible))).dropDuplicates(["h"]).select("h", "text")
    pieces = sample.mapInPandas(releasing(_sample_pieces(tokenizer_path, end_id)), "h double, k long, piece binary").toPandas().sort_values(["h", "k"])["piece"]
    pieces = [bytes(x) for x in pieces]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces, level=3).as_bytes() if len(pieces) >= 64 else b"".join(pieces)[:DICT_BYTES]
    except zstandard.ZstdError:
        return b"".join(pieces)[:DICT_BYTES]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def dict_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


_CHUNK = "shard int, chunk int, dict_hash string, doc_ids array<bigint>, starts array<bigint>, n_tokens array<bigint>, offsets array<bigint>, lengths array<bigint>, payload binary"


def _write_chunks(tokenizer_path: str, end_id: int, dictionary: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gc.disable()  # the memo is millions of small objects without cycles
        enc, zip_, name = encoder(tokenizer_path), _compressor(dictionary), dict_hash(dictionary)
        chunk, frames, ids_of, counts, shard = 0, [], [], [], 0

        def flush() -> pd.DataFrame:
            lengths = np.array([len(f) for f in frames], dtype="int64")
            starts, offsets = (np.concatenate([[0], np.cumsum(x)[:-1]]).astype("int64").tolist() for x in (counts, lengths))
            row = (shard, chunk, name, list(ids_of), starts, list(counts), offsets, lengths.tolist(), b"".join(frames))
            return pd.DataFrame([row], columns=["shard", "chunk", "dict_hash", "doc_ids", "starts", "n_tokens", "offsets", "lengths", "payload"])

        held = 0
        for pdf in batches:
            if len(pdf):
                shard = int(pdf["shard"].iloc[0])
            texts = pdf["text"].tolist()
            doc_ids = [None if no else x for no, x in zip(pdf["no_id"].tolist(), pdf["doc_id"].tolist(), strict=True)]
            for x, y in _portions(texts):
                for doc_id, ids in zip(doc_ids[x:y], enc.encode(texts[x:y]), strict=True):
                    frames.append(zip_.compress(_pack(ids, end_id)))
                    ids_of.append(doc_id)
                    counts.append(len(ids) + 1)
                    held += len(frames[-1])
                    if held >= CHUNK_BYTES:
                        yield flush()
                        chunk, frames, ids_of, counts, held = chunk + 1, [], [], [], 0
        if frames:
            yield flush()
        gc.enable()

    return run


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, shard_chars: int = _SHARD_CHARS) -> None:
    """Encodes every whole text of docs (doc_id, text), appends end_id, and writes the store."""
    spark = docs.sparkSession
    rows = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    total, eligible = rows.agg(F.sum(F.octet_length("text")), F.count_if(F.col("text") != "")).first()
    dictionary = train_dictionary(docs, eligible, tokenizer_path, end_id)
    spark.createDataFrame(
        [(dict_hash(dictionary), bytearray(dictionary), tokenizer_path, end_id)], "dict_hash string, dictionary binary, tokenizer string, end_id long"
    ).coalesce(1).write.parquet(f"{path}/dictionary")
    shards = max(1, min(MAX_SHARDS, math.ceil((total or 0) / shard_chars)))
    # The text's hash, and a number, split a doc_id and a whole row that very many rows share over shards; doc_id stays the order between them.
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(shards, *key, "nth").sortWithinPartitions(*key)
    dealt = dealt.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.isnull("doc_id").alias("no_id"), "text", F.spark_partition_id().alias("shard"))
    chunks = dealt.mapInPandas(releasing(_write_chunks(tokenizer_path, end_id, dictionary)), _CHUNK)
    with batches_of(spark):
        chunks.write.parquet(f"{path}/chunks")

    # Starts: sums over shards (at most MAX_SHARDS rows), then over the chunks of a shard, then over the documents of a chunk.
    index = spark.read.schema(_CHUNK).parquet(f"{path}/chunks").drop("payload")
    index = index.withColumn("tokens", F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)"))
    per_shard = index.groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per_shard = per_shard.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    index = index.withColumn("chunk_start", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(per_shard, "shard")
    index.select(
        "shard", "chunk", (F.col("shard_start") + F.col("chunk_start")).alias("base"),
        F.posexplode(F.arrays_zip("doc_ids", "starts", "n_tokens", "offsets", "lengths")).alias("nth", "x"),
    ).select(
        "shard", "chunk", "nth", F.col("x.doc_ids").alias("doc_id"), (F.col("base") + F.col("x.starts")).alias("start"),
        F.col("x.n_tokens").alias("n_tokens"), F.col("x.offsets").alias("offset"), F.col("x.lengths").alias("length"),
    ).sortWithinPartitions("shard", "chunk", "nth").write.parquet(f"{path}/offsets")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row["dictionary"])
    if dict_hash(dictionary) != row["dict_hash"]:
        raise ValueError(f"the dictionary of {path} doesn't have the hash it is stored under")
    return row["dict_hash"], dictionary


def _ids(unzip: zstandard.ZstdDecompressor, frame: bytes) -> np.ndarray:
    return np.frombuffer(unzip.decompress(frame), dtype="<u4")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its decompressed frame; start comes from the offset index."""
    name, dictionary = _dictionary(spark, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = _decompressor(dictionary)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.dict_hash != name:
                    raise ValueError("a chunk was written with another dictionary")
                frames = [row.payload[o : o + n] for o, n in zip(row.offsets, row.lengths, strict=True)]
                raw = [unzip.decompress(f) for f in frames]
                yield pd.DataFrame(
                    {"shard": row.shard, "chunk": row.chunk, "nth": range(len(raw)), "n": [len(x) // 4 for x in raw], "ids_crc32": [zlib.crc32(x) for x in raw]}
                )

    chunks = spark.read.parquet(f"{path}/chunks").select("shard", "chunk", "dict_hash", "offsets", "lengths", "payload")
    found = chunks.mapInPandas(releasing(run), "shard int, chunk int, nth int, n long, ids_crc32 long")
    index = spark.read.parquet(f"{path}/offsets")
    return index.join(found, ["shard", "chunk", "nth"]).select("doc_id", "start", F.col("n").alias("n_tokens"), "ids_crc32")


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents in wanted (doc_id): their frames only are cut out of the chunks and decompressed.

    Where they lie in few shards, the scan skips the payloads of all others by the files' statistics.
    """
    name, dictionary = _dictionary(spark, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = _decompressor(dictionary)
        for pdf in batches:
            if (pdf["dict_hash"] != name).any():
                raise ValueError("a chunk was written with another dictionary")
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [_ids(unzip, f).astype("int64") for f in pdf["frame"]]})

    index = spark.read.parquet(f"{path}/offsets").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    chunks = spark.read.parquet(f"{path}/chunks").select("shard", "chunk", "dict_hash", "payload")
    index = stored(index, "token-wanted")
    shards = [r[0] for r in index.select("shard").distinct().limit(_NAMED + 1).collect()]
    if len(shards) <= _NAMED:
        chunks = chunks.where(F.col("shard").isin(shards))
    chunks = chunks.join(index.select("shard", "chunk").distinct(), ["shard", "chunk"], "left_semi")
    frames = index.join(chunks, ["shard", "chunk"]).select("doc_id", "dict_hash", F.expr("substring(payload, cast(offset + 1 as int), cast(length as int))").alias("frame"))
    return frames.mapInPandas(run, "doc_id long, ids array<long>")
