"""Suffix-array dedup: a radix sort of suffixes, most significant digits first, no deeper than the threshold.

Suffixes that agree on their first W bytes are exactly the repeated windows.  Passes order them by ever longer digits:

* The leading digit of a window is its anchor (see ``windows``), so windows that share one stand together as a run.
  Anchors met once leave before anything else is shuffled.
* In each further pass a run is cut into blocks of neighbouring windows (all, then 13, then 1).  ``i`` is the digit string
  that all windows of a block have in common (32, then 188, then 200 bytes), ``u`` the string they cover together.  A
  block whose ``i`` is met once leaves; one whose ``u`` is met again is repeated as a whole; of each ``u`` one block goes
  on to the next pass if its ``i`` group holds other strings.

The last pass compares single windows, so every repeated window is found and nothing else.  Copies collapse into one
representative per pass: a group of any size costs map-side counts and a join that adaptive execution may split.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import discard, shared_table
from driftwell.llm.windows import anchors, keyed_texts, listed, pack, unpack

WINDOW, GRAM, BLOCK = 200, 32, 13


def blocks(listed_docs: DataFrame, width: int, window: int) -> DataFrame:
    """(i, u, did, rid, run) of every block of ``width`` anchor offsets in the listed runs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            dids, rids = batch.column("did").to_pylist(), batch.column("rid").to_pylist()
            out: list[list[int]] = [[], [], [], [], []]
            for row, packed in enumerate(batch.column("runs")):
                text = batch.column("text")[row].as_buffer()
                text = memoryview(text) if text is not None else b""
                for run in packed.as_py():
                    first, last, anchor = unpack(run)
                    for b in range((anchor - last) // width, (anchor - first) // width + 1):
                        low, high = max(first, anchor - b * width - width + 1), min(last, anchor - b * width)
                        common = text[anchor - b * width : anchor - b * width - width + 1 + window]
                        out[0].append(digest(common, 1))
                        out[1].append(digest(text[low : high + window], 2))
                        out[2].append(dids[row])
                        out[3].append(rids[row])
                        out[4].append((low << 32) | ((high - low) << 16) | (anchor - low))
                if len(out[0]) > 50_000:
                    yield _rows(out)
                    out = [[], [], [], [], []]
            yield _rows(out)

    return listed_docs.select("did", "rid", "text", "runs").mapInArrow(scan, "i long, u long, did long, rid long, run long")


def _rows(out: list[list[int]]) -> pa.RecordBatch:
    i, u = (np.array(x, np.uint64).view(np.int64) for x in out[:2])
    return pa.RecordBatch.from_pydict({"i": i, "u": u, "did": np.array(out[2], np.int64), "rid": np.array(out[3], np.int64), "run": np.array(out[4], np.int64)})


def radix_pass(rows: DataFrame, name: str) -> DataFrame:
    """(did, rid, run, repeated, open): blocks found repeated, and blocks that the next pass has to look into."""
    rows = shared_table(rows, f"{name}-rows")
    groups = rows.groupBy("i", "u").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("did", "rid", "run")).alias("one"))
    groups = shared_table(groups, f"{name}-groups")
    digits = groups.groupBy("i").agg(F.count(F.lit(1)).alias("strings"), F.sum("c").alias("met")).where("met > 1")
    # Aggregates are written before they are joined: only then can adaptive execution split the join of a frequent digit.
    digits = shared_table(digits, f"{name}-digits")
    state = groups.join(digits, "i").select("i", "u", "c", "strings", "one")
    me = F.struct("did", "rid", "run")
    marked = rows.join(state, ["i", "u"]).select(
        "did",
        "rid",
        "run",
        (F.col("c") > 1).alias("repeated"),
        ((F.col("strings") > 1) & ((F.col("c") == 1) | (F.col("one") == me))).alias("open"),
    )
    marked = shared_table(marked.where("repeated or open"), name)
    discard(rows, groups, digits)
    return marked


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, text, carried and ``runs``: the packed runs of windows that start elsewhere too (null or empty: none)."""
    keyed = keyed_texts(docs, carry)
    often = anchors(keyed, "bytes", window, gram, full=False).groupBy("a").count().where("count > 1").select("a")
    often = shared_table(often, "repeated-anchors")  # a side of its own, so that a join task of a frequent anchor can be split
    found = anchors(keyed, "bytes", window, gram, full=True).join(often, "a", "left_semi").select("did", "rid", "run")
    found = shared_table(found, "anchors")
    discard(often)
    texts = listed(keyed, found, "candidates")
    discard(found)
    active = texts.where("runs is not null")
    repeated = None
    waiting = active
    for step, width in enumerate((window - gram + 1, block, 1)):
        marked = radix_pass(blocks(waiting, width, window), f"pass{step}")
        now = marked.where("repeated").select("did", "rid", "run")
        repeated = now if repeated is None else repeated.unionByName(now)
        if width > 1:
            again = marked.where("open").groupBy("did", "rid").agg(F.collect_set("run").alias("runs"))
            waiting = active.drop("runs").join(again, ["did", "rid"])
    lists = repeated.groupBy("did", "rid").agg(F.collect_set("run").alias("runs"))
    spans = active.drop("runs").join(lists, ["did", "rid"], "left").select("doc_id", "text", "carried", "runs")
    return spans.unionByName(texts.where("runs is null").select("doc_id", "text", "carried", "runs"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (array of start, end in bytes) and kept (binary: the bytes that stay), and
    ``carried``, a struct of the columns named in ``carry``.

    Null texts are empty; texts shorter than a window keep every byte; repeated rows repeat each other's windows; a null
    doc_id is a document like any other; columns other than doc_id and text are ignored unless carried; no rows give no rows.
    """
    spans_and_texts = repeated_spans(docs, window, gram, block, carry)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            removed, spans, kept, sizes = [], [], [], []
            for row in range(batch.num_rows):
                value = batch.column("text")[row].as_buffer()
                text = value.to_pybytes() if value is not None else b""
                merged: list[list[int]] = []
                for run in sorted(batch.column("runs")[row].as_py() or []):
                    first, last, _ = unpack(run)
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], last + window)
                    else:
                        merged.append([first, last + window])
                rest, at = [], 0
                for a, b in merged:
                    rest.append(text[at:a])
                    at = b
                rest.append(text[at:])
                kept.append(b"".join(rest))
                sizes.append(len(text))
                removed.append(len(text) - len(kept[-1]))
                spans.append([{"start": a, "end": b} for a, b in merged])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), batch.column("carried")],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "carried"],
            )

    carried = spans_and_texts.schema["carried"].dataType.simpleString()
    schema = f"doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, carried {carried}"
    return spans_and_texts.mapInArrow(cut, schema)
