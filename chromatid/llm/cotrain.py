"""Quality classifier by co-training of two views.

The content view sees the text only: shares of its characters' classes and marks, and counts of its words, pairs of words and runs of three
characters, hashed into a bounded number of columns. The metadata view sees lang, source and n_chars only. Both are logistic regressions, fitted on a
bounded sample of labelled documents. For some rounds each view scores all unlabelled documents and hands those it is surest of, some of each class, to the other
view as pseudo-labels of half weight. Each view is then calibrated on labelled documents held out from training, a last small regression on held-out
ones weighs the two calibrated views, and every document gets its probability of being good.

Bounds (the fit's; scoring covers every row): at most ``max_labelled`` labelled documents, taken by a hash of doc_id, and ``exchange`` pseudo-labels
a class, view and round; rows that share doc_id and content hand on one. Where labels are more than that, a class rarer than a tenth of the bound still gets up to a tenth of it, and log-odds are
shifted back to the true shares. A fifth of each class's labelled documents are held out, one at least; a class's only one is trained on and calibrated on, as without it
there is nothing to learn. The calibration and the weights of the views have a half of the held-out ones each, where every class has four of them at least.

Null text is empty; very long texts are read whole, in one pass; null metadata are a category of their own. Documents with several labels count by their
mean, a tie as good; of unlike rows with one labelled doc_id the one with the smallest hash is learned from. Only where no
document of a class has a label nothing is learned: every document scores the share of good labels, or 1 without any. An empty table gives an empty
result; repeated rows are scored each; extra columns are ignored (kept by ``keep_good``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromatid.llm.common import only, release, releasing, stored

MAX_LABELLED, EXCHANGE, ROUNDS, SURE, THRESHOLD = 20_000, 200, 3, 0.95, 0.5
_PSEUDO_WEIGHT = 0.5
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"
#: Buckets that lang and source are hashed into.
_LANGS, _SOURCES = 16, 64


#: Columns that words and pairs of words are hashed into, and runs of three characters.
_WORDS, _RUNS = 96, 48
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
_IS_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def _places(h: np.ndarray, count: int) -> np.ndarray:
    """Signed sums of hashed things by column, as shares of their number, their roots taken so that rare things count as well."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    total = np.bincount((h >> np.uint64(32)).astype(np.int64) % count, weights=sign, minlength=count) / max(1, len(h))
    return np.sign(total) * np.sqrt(np.abs(total))


def hashed(raw: np.ndarray) -> np.ndarray:
    """Counts of words, pairs of words and runs of three characters (bytes of the UTF-8 form, in lower case but for letters outside ASCII)."""
    a = _LOWER[raw]
    inside = np.concatenate([[False], _IS_WORD[a], [False]])
    begin, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    # A word's hash is the sum of its bytes' hashes by their place in it.
    at = np.arange(len(a)) - np.repeat(begin, end - begin)[np.cumsum(inside[1:-1]) - 1] if len(begin) else np.empty(0, dtype=np.int64)
    letters = (a.astype(np.uint64) + np.uint64(1) + at.astype(np.uint64) * _BASE) * _MIX if len(begin) else np.empty(0, dtype=np.uint64)
    letters = (letters ^ (letters >> np.uint64(29))) * _BASE
    words = np.add.reduceat(letters[inside[1:-1]], np.cumsum(end - begin) - (end - begin)) if len(begin) else np.empty(0, dtype=np.uint64)
    pairs = words[:-1] * _BASE + words[1:]
    x = a.astype(np.uint64)
    runs = (x[:-2] * _BASE + x[1:-1]) * _BASE + x[2:] if len(x) > 2 else np.empty(0, dtype=np.uint64)
    return np.concatenate([_places(np.concatenate([words, pairs]), _WORDS), _places(runs, _RUNS)])


def content(text: str | None) -> np.ndarray:
    """Shares of characters by kind, shapes of words and lines, and hashed n-grams; nothing but the text itself."""
    whole = (text or "").encode("utf-8", "replace")
    raw = np.frombuffer(whole, dtype=np.uint8)
    n = np.bincount(raw, minlength=256)
    size = max(1, len(raw))
    upper, lower, digit = int(n[65:91].sum()), int(n[97:123].sum()), int(n[48:58].sum())
    words, lines = int(n[32] + n[10] + 1), int(n[10] + 1)
    parts = whole.split()
    kinds = len(set(parts)) / max(1, len(parts))
    out = [
        upper / size, lower / size, digit / size, int(n[128:].sum()) / size, upper / max(1, upper + lower), words / size, min(1.0, lines / words),
        min(4.0, np.log1p(size / words)), kinds, 1.0 if not parts else 0.0,
    ]
    out += [min(1.0, 10 * int(n[c]) / words) for c in _MARKS]
    return np.concatenate([np.array(out), hashed(raw)]).astype(np.float32)


N_CONTENT = len(content(""))


def _contents(texts: pd.Series) -> pd.Series:
    out = pd.Series([content(t) for t in texts.tolist()], dtype=object)
    release()
    return out


def metadata() -> Column:
    """The length in two forms, whether it is missing, and the buckets of lang and source: expressions on lang, source and n_chars."""

    def bucket(column: str, count: int) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(column, F.lit("\0"))), F.lit(count)).cast("double")

    size = F.log1p(F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0)))
    return F.array(size / 10.0, size * size / 100.0, F.col("n_chars").isNull().cast("double"), bucket("lang", _LANGS), bucket("source", _SOURCES))


def one_hot(meta: np.ndarray) -> np.ndarray:
    """The regression's columns of metadata rows: a column for each bucket."""
    return np.column_stack([meta[:, :3], meta[:, 3:4] == np.arange(_LANGS), meta[:, 4:5] == np.arange(_SOURCES)]).astype(np.float32)


#: Rows, labels and weights of a part of the training data.
Part = tuple[np.ndarray, np.ndarray, np.ndarray]


def _blocks(parts: list[Part], rows: int = 2048):
    for x, y, w in parts:
        for k in range(0, len(y), rows):
            yield x[k : k + rows].astype(float), y[k : k + rows], w[k : k + rows]


def fit(parts: list[Part], ridge: float = 1.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of a ridge logistic regression on the columns as they are, by Newton's method; sums are taken block by block."""
    n = sum(len(y) for _, y, _ in parts)
    mean = sum(x.sum(axis=0) for x, _, _ in _blocks(parts)) / n
    spread = np.sqrt(sum(((x - mean) ** 2).sum(axis=0) for x, _, _ in _blocks(parts)) / n)
    spread[spread < 1e-9] = 1.0
    penalty = np.full(len(mean) + 1, ridge)
    penalty[-1] = 1e-6
    w = np.zeros(len(mean) + 1)
    for _ in range(steps):
        slope, curve = penalty * w, np.diag(penalty)
        for x, y, weight in _blocks(parts):
            z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope += z.T @ (weight * (p - y))
            curve += (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    beta = w[:-1] / spread
    return beta, float(w[-1] - beta @ mean)


@dataclass
class Model:
    """Per view coefficients and calibration (slope, shift of its log-odds), and the weights that combine them; ``share`` alone if nothing was learned."""

    share: float
    content: tuple[np.ndarray, float] | None = None
    meta: tuple[np.ndarray, float] | None = None
    calibration: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (1.0, 0.0))
    blend: tuple[float, float, float] = (1.0, 0.0, 0.0)

    def log_odds(self, view: str) -> Column:
        beta, shift = getattr(self, view)
        return dot(view, beta, shift)

    def scores(self) -> tuple[Column, Column, Column]:
        """(p_content, p_metadata, score) from columns content and meta."""
        if self.content is None:
            return (F.lit(float(self.share)),) * 3
        cal = [a * self.log_odds(v) + b for v, (a, b) in zip(("content", "meta"), self.calibration, strict=True)]
        both = self.blend[0] * cal[0] + self.blend[1] * cal[1] + self.blend[2]
        return tuple(1 / (1 + F.exp(-x)) for x in (*cal, both))


def dot(view: str, beta: np.ndarray, shift: float) -> Column:
    """The log-odds of a view's regression, within 30 of 0."""
    c = F.col(view)
    if view == "meta":
        lang, source = (F.array(*[F.lit(float(x)) for x in part]) for part in np.split(beta[3:], [_LANGS]))
        total = sum((float(beta[i]) * c[i] for i in range(3)), F.lit(float(shift)))
        total = total + F.get(lang, c[3].cast("int")) + F.get(source, c[4].cast("int"))
    else:
        terms = F.zip_with(c, F.lit(np.asarray(beta, dtype=float)).cast("array<double>"), lambda a, b: a * b)
        total = F.aggregate(terms, F.lit(float(shift)), lambda a, t: a + t)
    return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))


def _matrix(view: str, values: pa.ChunkedArray) -> np.ndarray:
    """A view's rows from a column of arrays, without an object a row."""
    x = values.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, N_CONTENT if view == "content" else 5)
    return one_hot(x) if view == "meta" else x


def features(docs: DataFrame) -> DataFrame:
    """docs with the views' columns content and meta, for tables that have no columns of these names."""
    return docs.withColumn("content", F.pandas_udf("array<float>")(_contents)("text")).withColumn("meta", metadata())


def quotas(counts: dict[bool, int], most: int) -> dict[bool, int]:
    """How many labelled documents of each class to take: all, or by the classes' shares but a tenth of most of each (or all it has)."""
    total = sum(counts.values())
    if total <= most:
        return dict(counts)
    least = max(1, most // 10)
    out = {c: min(n, max(least, round(most * n / total))) for c, n in counts.items()}
    largest = max(out, key=out.get)
    out[largest] = max(1, most - sum(n for c, n in out.items() if c != largest))
    return out


def folds(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row is held out, and whether it is trained on: every fifth of each class is held out, in order; a class's only row is both."""
    held, rest = np.zeros(len(y), dtype=bool), np.zeros(len(y), dtype=bool)
    for c in (0.0, 1.0):
        at = np.flatnonzero(y == c)
        held[at[::5]] = True
        rest[at if len(at) == 1 else np.delete(at, np.s_[::5])] = True
    return held, rest


def surest(model: Model, wanted: dict[tuple[str, bool], int], limit: float):
    """For mapInArrow: of each batch of unlabelled rows, for each view and class as many as wanted of those it is surest of, their log-odds over the limit.

    Rows of one doc_id and content (key) count once.
    """
    kinds = list(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "key"))
            x = {v: batch.column(v).flatten().to_numpy(zero_copy_only=False).reshape(len(h), -1).astype(float) for v in ("content", "meta")}
            x["meta"] = one_hot(x["meta"])
            for k, (view, good) in enumerate(kinds):
                beta, shift = getattr(model, view)
                z = (x[view] @ beta + shift) * (1 if good else -1)
                at = np.flatnonzero(z >= limit)
                at = at[np.lexsort((h[at], -z[at]))]
                at = at[np.sort(np.unique(key[at], return_index=True)[1])[: wanted[view, good]]]
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, dtype=np.int32)), pa.array(z[at]), *part.columns], names=["pick", "z", *part.schema.names])

    return run


def train(
    docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, exchange: int = EXCHANGE, rounds: int = ROUNDS, sure: float = SURE
) -> tuple[Model, DataFrame]:
    """The model, and the stored table (doc_id, content, meta, good) of all documents it was trained among."""
    good = only(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    table = features(only(docs, "doc_id", "text", "lang", "source", "n_chars")).select("doc_id", "content", "meta")
    table = stored(table.join(good, "doc_id", "left"), "cotrain-features")
    order = F.xxhash64("doc_id", F.lit(17))
    labelled = table.where("good is not null").withColumn("h", F.shiftrightunsigned(order, 1) / float(1 << 63))
    counts = {r["good"]: r["count"] for r in labelled.select("doc_id", "good").distinct().groupBy("good").count().collect()}
    quota = quotas(counts, max_labelled)
    # A share of the hashes' range (with a margin, so that the quota is met), not the smallest ones: no task sends more than its part. Repeated rows count once.
    share = {c: 1.0 if n == counts[c] else min(1.0, (n + 6 * n**0.5 + 20) / counts[c]) for c, n in quota.items()}
    below = F.when(F.col("good"), F.lit(share.get(True, 0.0))).otherwise(F.lit(share.get(False, 0.0)))
    one = F.min_by(F.struct("content", "meta"), F.xxhash64("content", "meta")).alias("one")
    sample = labelled.where(F.col("h") < below).groupBy("doc_id", "h", "good").agg(one).select("doc_id", "h", "good", "one.*").toArrow()
    keys = sample.select(["h", "doc_id", "good"]).to_pandas().sort_values(["h", "doc_id"], kind="stable")
    keys = keys[keys.groupby("good").cumcount() < keys["good"].map(quota).astype("int64")] if len(keys) else keys
    y = keys["good"].to_numpy(dtype=float)
    total = sum(counts.values())
    good_share = counts.get(True, 0) / total if total else 1.0
    if len(counts) < 2:
        return Model(good_share), table
    # From the sample's shares of the classes back to those of all labelled documents; 0 where all are taken.
    prior = float(np.log(counts[True] / counts[False]) - np.log(y.sum() / (1 - y).sum()))
    held, rest = folds(y)
    taken = keys.index.to_numpy()
    views = {v: _matrix(v, sample[v])[taken] for v in ("content", "meta")}
    del sample, keys
    have = {v: [(x[rest], y[rest], np.ones(rest.sum()))] for v, x in views.items()}
    model = Model(good_share)
    open_ = table.where("good is null").select("doc_id", order.alias("h"), F.xxhash64("doc_id", "content").alias("key"), "content", "meta")
    schema = f"pick int, z double, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in open_.schema)}"
    given = {v: set() for v in views}

    def refit() -> None:
        for v in views:
            beta, shift = fit(have[v])
            setattr(model, v, (beta, shift + prior))

    refit()
    limit = float(np.log(sure / (1 - sure)))
    for _ in range(rounds):
        share_of = {True: good_share, False: 1 - good_share}
        count = {c: max(1, round(2 * exchange * part)) for c, part in share_of.items()}
        # Enough documents that those given before can be told apart.
        wanted = {(v, c): count[c] + len(given[other]) for v, other in (("content", "meta"), ("meta", "content")) for c in (True, False)}
        # One pass over all rows: the surest of each batch, then of each task, then of all.
        picked = open_.mapInArrow(releasing(surest(model, wanted, limit)), schema)
        nth = {part: F.row_number().over(Window.partitionBy(*part).orderBy(F.col("z").desc(), "h", "doc_id", "key")) for part in (("pick", "key"), ("pick",))}
        picked = picked.withColumn("nth", nth["pick", "key"]).where("nth = 1").withColumn("nth", nth["pick",]).where(F.col("nth") <= max(wanted.values())).toArrow().sort_by([("pick", "ascending"), ("nth", "ascending")])
        which, keys_ = picked["pick"].to_numpy(), picked["key"].to_pylist()
        for k, (view, good_) in enumerate(wanted):
            other = "meta" if view == "content" else "content"
            at = [i for i in np.flatnonzero(which == k).tolist() if keys_[i] not in given[other]][: count[good_]]
            if at:
                given[other].update(keys_[i] for i in at)
                have[other].append((_matrix(other, picked[other].take(pa.array(at))), np.full(len(at), float(good_)), np.full(len(at), _PSEUDO_WEIGHT)))
        refit()
    z = [np.clip(x @ getattr(model, v)[0] + getattr(model, v)[1], -30, 30) for v, x in views.items()]
    first, second = halves(y, held)
    curves = [fit([(x[first, None], y[first], np.ones(first.sum()))]) for x in z]
    model.calibration = tuple((float(b[0]), float(c) + prior) for b, c in curves)
    cal = np.column_stack([a * x + b for x, (a, b) in zip(z, model.calibration, strict=True)])
    beta, shift = fit([(cal[second], y[second], np.ones(second.sum()))])
    model.blend = (float(beta[0]), float(beta[1]), float(shift) + prior)
    return model, table


def halves(y: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The held-out rows to calibrate on and to weigh the views on: a half of each class each, or all for both where a class has fewer than four."""
    if min(((y == c) & held).sum() for c in (0, 1)) < 4:
        return held, held
    first = np.zeros_like(held)
    for c in (0, 1):
        first[np.flatnonzero((y == c) & held)[::2]] = True
    return first, held & ~first


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """(doc_id, p_content, p_metadata, score, kept) for every row of docs."""
    model, table = train(docs, labels, **options)
    a, b, both = model.scores()
    return table.select("doc_id", a.alias("p_content"), b.alias("p_metadata"), both.alias("score")).withColumn("kept", F.col("score") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns. Where all labels are of one class, all documents stay or go with it.

    Views are computed again from the rows: matching rows with train()'s table would shuffle all texts.
    """
    model, _ = train(docs, labels, **options)
    if model.content is None:
        return docs if model.share >= threshold else docs.limit(0)
    names = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *[F.col(f"`{c}`") for c in ("text", "lang", "source", "n_chars")])
    return features(own).where(model.scores()[2] >= threshold).select("row.*")
