"""Fill-in-middle transformation: one scan by a byte automaton finds the units and sentinels, a second pass finds the cuts.

A text is cut into units (a run of A-Z and a-z, or any other code point) and its units into prefix, middle and suffix. The table of the automaton is
built from the sentinels: its states are what of a UTF-8 sequence is still to come, or whether a run of letters is open, together with how much of a
sentinel has been read; each transition says whether a unit, a code point, or neither begins at its byte, and whether a sentinel ends there. The scan
counts those transitions in stretches of bytes; the second pass finds the cut's stretch by the counts and looks for the cut in it alone.

The automaton forgets: its state depends on the last few bytes only (memory_of() proves that of a table). So a block of bytes is scanned in many lanes at
once, each starting that many bytes early, which makes one table lookup of a whole row of lanes of one Python step.

A document keeps its text (form ``plain``) if that is empty, holds a sentinel, or is dealt to the share that stays as it is; others become ``psm``
(prefix, suffix, middle) or ``spm`` (suffix, prefix, middle). All draws come from the sha256 of seed and doc_id, so reruns agree, and rows that share a
doc_id are dealt alike. restore() gives the exact text back.

Null text is the empty text; a null doc_id counts as an empty string in the draw. A bytes sequence that isn't UTF-8 doesn't crash: bytes that no sequence
expects are units of their own. Long texts are scanned in segments, so memory grows by a few bytes for each byte of the longest text. Every row is a row
of its own: there is no shuffle, repeated rows stay, extra columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromatid.llm.common import only

SENTINELS = ("<P>", "<S>", "<M>")
UNIT, CHAR, SENTINEL = 1, 2, 4
#: Modes: nothing is open; a run of letters is; so many bytes of a code point are still to come.
_BREAK, _WORD, _NEED = 0, 1, 2
#: Bytes that are scanned at once, bytes of a lane, and bytes of a stretch that has a count.
BLOCK, LANE, STRETCH = 1 << 22, 1024, 4096


def _mode(mode: int, byte: int) -> tuple[int, int]:
    """(mode behind the byte, what begins at it)."""
    if 65 <= byte <= 90 or 97 <= byte <= 122:
        return _WORD, CHAR if mode == _WORD else CHAR | UNIT
    if 128 <= byte < 192 and mode >= _NEED:
        return (mode - 1 if mode > _NEED else _BREAK), 0
    more = 3 if byte >= 240 else 2 if byte >= 224 else 1 if byte >= 192 else 0
    return (_NEED + more - 1 if more else _BREAK), CHAR | UNIT


class Automaton:
    """The table: step and emitted have a row a state and a column a class of bytes, then the same columns for bytes that a text starts with."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS):
        marks = [s.encode() for s in sentinels]
        for i, a in enumerate(marks):
            for j, b in enumerate(marks):
                if not a or i != j and a in b or any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)) + (i != j))):
                    raise ValueError(f"sentinels must not overlap: {sentinels}")
        begun = {m[:n] for m in marks for n in range(len(m))}  # a whole sentinel begins no other, as they don't overlap

        def after(read: bytes, byte: int) -> tuple[bytes, int]:
            read += bytes([byte])
            if read in marks:
                return b"", SENTINEL
            return next(read[k:] for k in range(len(read) + 1) if read[k:] in begun), 0

        start = (_BREAK, b"")
        states, rows = [start], []
        for mode, read in states:  # grows while it is walked
            row = []
            for byte in range(256):
                (to, what), (rest, found) = _mode(mode, byte), after(read, byte)
                if (to, rest) not in states:
                    states.append((to, rest))
                row.append((states.index((to, rest)), what | found))
            rows.append(row)
        table = np.array(rows)  # state, byte, (to, emitted)
        columns, of_byte = np.unique(table.transpose(1, 0, 2).reshape(256, -1), axis=0, return_inverse=True)
        classes = columns.reshape(len(columns), len(states), 2).transpose(1, 0, 2)
        both = np.concatenate([classes, np.broadcast_to(classes[:1], classes.shape)], axis=1)  # a text's first byte is read in the first state
        self.of_byte, self.classes = of_byte.reshape(-1).astype(np.uint8), len(columns)
        self.step, self.emitted = both[:, :, 0], both[:, :, 1].astype(np.uint8)
        self.memory = memory_of(self.step)


def memory_of(step: np.ndarray) -> int:
    """After so many bytes, whatever they are, the state no longer depends on the state before them."""
    sets, n = {tuple(range(len(step)))}, 0
    while any(len(s) > 1 for s in sets):
        sets = {tuple(sorted(set(step[list(s), c]))) for s in sets if len(s) > 1 for c in range(step.shape[1])}
        n += 1
        if n > 4 * len(step):
            raise ValueError("the automaton's state depends on bytes of any distance")
    return n


def scan(automaton: Automaton, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What each byte of data emits, where texts begin at starts (ascending)."""
    out = np.empty(len(data), dtype=np.uint8)
    width, back = automaton.step.shape[1], automaton.memory
    step, emitted = (automaton.step * width).reshape(-1), automaton.emitted.reshape(-1)
    for low in range(0, len(data), BLOCK):
        high, early = min(low + BLOCK, len(data)), min(low, back)
        codes = automaton.of_byte[data[low - early : high]]
        codes[starts[np.searchsorted(starts, low - early) : np.searchsorted(starts, high)] - (low - early)] += automaton.classes
        lanes = -(-(high - low) // LANE)
        padded = np.zeros(back + lanes * LANE, dtype=np.uint8)
        padded[back - early : back - early + len(codes)] = codes
        view = np.lib.stride_tricks.as_strided(padded, (lanes, back + LANE), (LANE, 1))
        columns, seen = np.ascontiguousarray(view.T), np.empty((LANE, lanes), dtype=np.uint8)
        state = np.zeros(lanes, dtype=step.dtype)
        for t in range(back + LANE):
            at = state + columns[t]
            if t >= back:
                seen[t - back] = emitted[at]
            state = step[at]
        out[low:high] = seen.T.reshape(-1)[: high - low]
    return out


class Counted:
    """Positions and counts of one kind of transitions, by the counts of each stretch."""

    def __init__(self, emits: np.ndarray, kind: int):
        self.hits = (emits & kind) != 0
        each = [np.count_nonzero(self.hits[k : k + STRETCH]) for k in range(0, len(emits), STRETCH)]
        self.before = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])

    def until(self, position: int) -> int:
        k = position // STRETCH
        return int(self.before[k]) + int(np.count_nonzero(self.hits[k * STRETCH : position]))

    def place(self, n: int) -> int:
        """Where the n-th transition (from 0) is."""
        k = int(np.searchsorted(self.before, n, side="right")) - 1
        return k * STRETCH + int(np.flatnonzero(self.hits[k * STRETCH : (k + 1) * STRETCH])[n - self.before[k]])


def _cut(automaton: Automaton, sentinels: tuple[str, ...], fim_percent: int, spm_percent: int):
    p, s, m = (x.encode() for x in sentinels)

    def transformed(texts: pa.Array, draws: np.ndarray) -> tuple[list, ...]:
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8) if len(texts) else np.empty(0, dtype=np.uint8)
        wide = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
        ends = np.frombuffer(texts.buffers()[1], dtype=wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data, ends = data[ends[0] : ends[-1]], ends - ends[0]
        emits = scan(automaton, data, np.unique(ends[:-1][ends[:-1] < ends[1:]]))
        units, chars, found = (Counted(emits, kind) for kind in (UNIT, CHAR, SENTINEL))
        rows = []
        for (h1, h2, h3, h4), low, high in zip(draws.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            text, first = data[low:high].tobytes(), units.until(low)
            n = units.until(high) - first
            if not n or h3 % 100 >= fim_percent or found.until(high) > found.until(low):
                rows.append((n, "plain", None, None, text))
                continue
            a, b = (high if k == n else units.place(first + k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
            prefix, middle, suffix = text[: a - low], text[a - low : b - low], text[b - low :]
            spm = h4 % 100 < spm_percent
            out = s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle
            rows.append((n, "spm" if spm else "psm", chars.until(a) - chars.until(low), chars.until(b) - chars.until(a), out))
        return tuple(list(c) for c in zip(*rows, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = np.column_stack([batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)])
            sizes = np.array([x.as_buffer().size for x in batch.column("text")], dtype=np.int64)
            low = 0
            while low < batch.num_rows:  # as many texts as fill a block, or one that is longer
                high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low:]), BLOCK, side="right")))
                n, form, prefix, middle, out = transformed(batch.column("text").slice(low, high - low), draws[low:high])
                columns = [
                    batch.column("doc_id").slice(low, high - low), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                    pa.array(middle, pa.int64()), pa.array(out, texts_type(batch)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                low = high

    def texts_type(batch: pa.RecordBatch) -> pa.DataType:
        return batch.schema.field("text").type

    return run


def transform(docs: DataFrame, seed: str = "1", fim_percent: int = 90, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of docs (doc_id, text); sentinels are those before prefix, suffix and middle."""
    rows = only(docs, "doc_id", "text")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), digest.alias("digest")).select("doc_id", "text", *draws)
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = _cut(Automaton(tuple(sentinels)), tuple(sentinels), fim_percent, spm_percent)
    out = rows.mapInArrow(cut, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restore(output: Column | str = "output", form: Column | str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text that output was made of. Each sentinel is in an output once, as a text that holds one stays plain."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
