"""Names within an edit distance: in a task, a tile of names is met as a tree of prefixes, so what begins too far off is left at once, with all that begins so."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Cells of edit distances that a task works on at once, and pairs of a tile that are handed on without a search.
CELLS, FEW_PAIRS = 1 << 20, 4096
FAR = 1 << 14


def _codes(names: list[str], width: int, end: int) -> np.ndarray:
    """Code points, a row a name; ``end`` behind a name's end."""
    out = np.full((len(names), width), end, np.int32)
    for i, n in enumerate(names):
        out[i, : len(n)] = np.frombuffer(n.encode("utf-32-le"), np.int32)
    return out


def _every(sources: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, CELLS // len(others))
    for i in range(0, len(sources), step):
        s = sources[i : i + step]
        yield np.repeat(s, len(others)), np.tile(others, len(s))


def near(a: list[str], share: np.ndarray, b: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of all pairs whose edit distance is at most the share of a's of the longer name's characters, and of some beyond that; no pair twice."""
    if not a or not b:
        return
    if len(a) * len(b) <= FEW_PAIRS:
        yield from _every(np.arange(len(a)), np.arange(len(b)))
        return
    # Names of like lengths, as many as a matrix of their code points may hold.
    by_length, block = sorted(range(len(b)), key=lambda i: len(b[i])), []
    for i in by_length:
        if block and (len(block) + 1) * (len(b[i]) + 1) > 16 * CELLS:
            yield from _near_block(a, share, b, block)
            block = []
        block.append(i)
    yield from _near_block(a, share, b, block)


def _near_block(a: list[str], share: np.ndarray, b: list[str], block: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    length, width = np.array([len(x) for x in a]), max(len(b[i]) for i in block)
    # A name that is longer than the source's by more than the edits isn't near.
    longer = np.where(share < 1, length / np.maximum(1 - share, 1e-9), width)
    longest = np.maximum(length, np.minimum(width, np.ceil(longer)))
    most = np.floor(share * longest + 1e-9).astype(int)
    whole = most >= np.maximum(length, width)
    yield from _every(np.flatnonzero(whole), np.array(block))
    by_name = sorted(block, key=b.__getitem__)
    order, code = np.array(by_name), _codes([b[i] for i in by_name], width + 1, -1)
    same = code[1:] == code[:-1]
    shared = np.where(same.all(axis=1), width + 1, same.argmin(axis=1))
    # Where names that share d characters part, by d.
    parts = [np.flatnonzero(shared == d) + 1 for d in range(width + 1)]
    for k in np.unique(most[~whole]):
        sources = np.flatnonzero(~whole & (most == k))
        # Each source takes a row of its code points in its slice's matrix, which is no larger than the cells.
        step = max(1, CELLS // (int(length[sources].max()) + width + 3 * int(k) + 2))
        for i in range(0, len(sources), step):
            yield from _search([a[x] for x in sources[i : i + step]], sources[i : i + step], int(k), order, code, parts)


def _search(a: list[str], sources: np.ndarray, k: int, order: np.ndarray, code: np.ndarray, parts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """near() for sources of one number of edits. Depth first: a state is a source, a range of names that share depth characters, and the edits between those and the source's first characters, from k fewer than depth to k more."""
    wide = 2 * k + 1
    length = np.array([len(x) for x in a])
    own = np.full((len(a), k + max(int(length.max()), code.shape[1]) + wide), -2, np.int32)
    for i, x in enumerate(a):
        own[i, k : k + len(x)] = np.frombuffer(x.encode("utf-32-le"), np.int32)
    kind = np.int16 if k < FAR // 2 else np.int32
    far = FAR if kind is np.int16 else 1 << 30
    step = np.arange(wide, dtype=kind)
    first = np.where(step < k, far, step - k).astype(kind)
    n = len(a)
    stack = [(0, np.arange(n), np.zeros(n, int), np.full(n, len(order)), np.broadcast_to(first, (n, wide)))]
    while stack:
        depth, src, low, high, edits = stack.pop()
        begins = parts[depth]
        x, y = np.searchsorted(begins, low, "right"), np.searchsorted(begins, high, "left")
        count = y - x + 1
        if len(src) > 1 and int(count.sum()) * wide > CELLS:
            half = len(src) // 2
            stack += [(depth, src[s], low[s], high[s], edits[s]) for s in (slice(half), slice(half, None))]
            continue
        up = np.repeat(np.arange(len(src)), count)
        nth = np.arange(len(up)) - np.repeat(np.cumsum(count) - count, count)
        at = np.append(begins, 0)
        lo = np.where(nth == 0, low[up], at[x[up] + nth - 1])
        hi = np.where(nth == count[up] - 1, high[up], at[np.minimum(x[up] + nth, len(begins))])
        char, src, edits = code[lo, depth], src[up], edits[up]
        ends = char == -1
        if ends.any():
            s = src[ends]
            place = length[s] - depth + k
            near_ = (place >= 0) & (place < wide)
            near_[near_] = edits[ends][np.flatnonzero(near_), place[near_]] <= k
            s, l, h = s[near_], lo[ends][near_], hi[ends][near_]
            if len(s):
                size = h - l
                yield sources[np.repeat(s, size)], order[np.repeat(l - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            go = ~ends
            char, src, edits, lo, hi = char[go], src[go], edits[go], lo[go], hi[go]
        if not len(src):
            continue
        # Replaced or kept, inserted, and then left out: a running minimum along the row.
        new = edits + (own[src[:, None], depth + np.arange(wide)] != char[:, None])
        new[:, :-1] = np.minimum(new[:, :-1], edits[:, 1:] + 1)
        new = np.minimum(np.minimum.accumulate(new - step, axis=1) + step, far).astype(kind)
        go = new.min(axis=1) <= k
        if go.any():
            stack.append((depth + 1, src[go], lo[go], hi[go], new[go]))


def near_in_tiles(batches, key: str, columns: list[str], others: list[str], name: str, share: str, other: str):
    """For Arrow batches with two tiles a row (key, columns and others: lists), a row for each pair of near(): name and share are of the columns, other is of the others."""
    import pyarrow as pa

    def made(held):
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held)], names=[key, *columns, *others])

    held, rows = [], 0
    for batch in batches:
        for r in range(batch.num_rows):
            left, right = ({c: batch.column(c)[r].values for c in names} for names in (columns, others))
            for i, j in near(left[name].to_pylist(), left[share].to_numpy(zero_copy_only=False), right[other].to_pylist()):
                i, j = pa.array(i), pa.array(j)
                held.append([pa.repeat(batch.column(key)[r], len(i)), *[left[c].take(i) for c in columns], *[right[c].take(j) for c in others]])
                rows += len(i)
                if rows >= 50_000:
                    yield made(held)
                    held, rows = [], 0
    if held:
        yield made(held)
