"""Windows of W consecutive units (bytes or words), met through sampled anchors.

Every window owns an anchor: the k-gram of smallest hash in it, leftmost among equals.  Equal windows have equal anchors at
equal offsets, and neighbouring windows mostly share one, so a text of n units is described by about 2n / (W - k + 2) runs
(first window, last window, anchor) in place of n windows.  Runs are found in numpy over a few documents at a time; long
documents are cut into overlapping pieces, each window lying in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import shared_table
from driftwell.llm.feistel import mix64

PIECE = 1 << 17  # units looked at together: arrays of a megabyte
LOW = np.uint64((1 << 24) - 1)
BASE = np.uint64(0xD6E8FEB86659FD93)
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))
SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty."""
    if pa.types.is_string_view(column.type) if hasattr(pa.types, "is_string_view") else False:
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    places = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), places.astype(np.int64)


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive unit values, by doubling."""
    with np.errstate(over="ignore"):
        power, length, block, out, done = BASE, 1, units, None, 0
        while True:
            if k & length:
                if out is None:
                    out = block
                else:
                    m = len(units) - done - length + 1
                    out = out[:m] * power + block[done : done + m]
                done += length
            length *= 2
            if length > k:
                return mix64(out)
            half = length // 2
            block = block[:-half] * power + block[half:]
            power = power * power


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def runs(units: np.ndarray, stops: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, anchor hash) of each run; ``stops``: end of each unit's document."""
    count = len(units) - window + 1
    if count < 1:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    hashes = gram_hashes(units, gram)
    ranked = (hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64)
    owner = (sliding_min(ranked, window - gram + 1) & LOW).astype(np.int64)
    owner[np.arange(count) + window > stops[:count]] = -1
    turns = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    first, last = np.concatenate([[0], turns]), np.concatenate([turns - 1, [count - 1]])
    kept = owner[first] >= 0
    first, last = first[kept], last[kept]
    return first, last, owner[first], hashes[owner[first]]


def _groups(lengths: np.ndarray, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (row, first unit, units), each of about PIECE units."""
    held, size = [], 0
    for row, n in enumerate(lengths.tolist()):
        if n < window:
            continue
        for first in range(0, n - window + 1, PIECE):
            units = min(n - first, PIECE + window - 1)
            held.append((row, first, units))
            size += units
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _place(pieces: list[tuple[int, int, int]], found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """(row, first, last, anchor, hash) in units of the row's document."""
    first, last, anchor, hashes = found
    lengths = np.array([p[2] for p in pieces])
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    which = np.searchsorted(begins, first, "right") - 1
    shift = np.array([p[1] for p in pieces])[which] - begins[which]
    return np.array([p[0] for p in pieces])[which], first + shift, last + shift, anchor + shift, hashes


def byte_runs(column: pa.Array, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    data, offsets = column_bytes(column)
    for pieces in _groups(np.diff(offsets), window):
        parts = [data[offsets[r] + f : offsets[r] + f + n] for r, f, n in pieces]
        lengths = np.array([p[2] for p in pieces])
        stops = np.repeat(np.cumsum(lengths), lengths)
        yield _place(pieces, runs(BYTE_VALUES[np.concatenate(parts)], stops, window, gram))


def _word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each word, from running sums of byte values times powers."""
    base = int(starts[0])
    span = int(ends[-1]) - base
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(span, BASE)]))
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(span, inverse)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_VALUES[data[base : base + span]] * powers[:span])])
        s, e = starts - base, ends - base
        return mix64((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte string."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = np.concatenate([[False], ~SPACE[data], [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2]


def word_runs(column: pa.Array, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    data, offsets = column_bytes(column)
    rows = len(offsets) - 1
    begin = 0
    while begin < rows:  # a few documents at a time
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + 8 * PIECE, "right")) - 1)
        bounds = [word_bounds(data[offsets[r] : offsets[r + 1]]) for r in range(begin, end)]
        for pieces in _groups(np.array([len(b[0]) for b in bounds]), window):
            values, lengths = [], []
            for r, f, n in pieces:
                s, e = bounds[r]
                at = offsets[begin + r]
                values.append((s[f : f + n] + at, e[f : f + n] + at))
                lengths.append(n)
            starts, ends = np.concatenate([v[0] for v in values]), np.concatenate([v[1] for v in values])
            lengths = np.array(lengths)
            stops = np.repeat(np.cumsum(lengths), lengths)
            row, *rest = _place(pieces, runs(_word_values(data, starts, ends), stops, window, gram))
            yield row + begin, *rest
        begin = end


KINDS = {"bytes": byte_runs, "words": word_runs}


def pack(first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """A run as one integer: first window, number of further windows, offset of the anchor."""
    return (first << 32) | ((last - first) << 16) | (anchor - first)


def unpack(run: int) -> tuple[int, int, int]:
    """(first, last, anchor) of a packed run."""
    first = run >> 32
    return first, first + (run >> 16 & 0xFFFF), first + (run & 0xFFFF)


def anchors(keyed: DataFrame, kind: str, window: int, gram: int, full: bool) -> DataFrame:
    """Runs of all texts: (a, did), with rid and the packed run if ``full``.  ``keyed`` has did, rid and text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did = batch.column("did").to_numpy(zero_copy_only=False)
            rid = batch.column("rid").to_numpy(zero_copy_only=False) if full else None
            for row, first, last, anchor, hashes in KINDS[kind](batch.column("text"), window, gram):
                out = {"a": hashes.view(np.int64), "did": did[row]}
                if full:
                    out |= {"rid": rid[row], "run": pack(first, last, anchor)}
                yield pa.RecordBatch.from_pydict(out)

    schema = "a long, did long" + (", rid long, run long" if full else "")
    return keyed.select("did", "rid", "text").mapInArrow(scan, schema)


def keyed_texts(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, text and the pair (did, rid) that tells documents apart: id (null: the largest long) and text hash.

    Columns named in ``carry`` are gathered in the struct ``carried``.
    """
    carried = F.struct(*carry) if carry else F.lit(None).cast("boolean")
    return docs.select("doc_id", "text", carried.alias("carried"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("did"), F.xxhash64("text").alias("rid"))


def listed(keyed: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``keyed`` with the packed runs of ``found`` (did, rid, run) gathered per document as ``runs``, null where none."""
    lists = found.groupBy("did", "rid").agg(F.collect_set("run").alias("runs"))
    joined = keyed.join(lists, ["did", "rid"], "left").select("doc_id", "did", "rid", "text", "carried", "runs")
    return shared_table(joined, name)
