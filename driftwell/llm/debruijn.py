"""Substring dedup on a compacted De Bruijn graph of words.

Edges of the graph are the runs of K consecutive words (K-mers).  Nearly all edges occur once, so they are not listed one
by one: each belongs to the smallest of its g-mers (its anchor), and neighbouring edges with one anchor form a path.

1. Anchors that only one document holds are dropped: none of their edges repeats in another document.
2. The paths of the remaining anchors are joined by (anchor, words of the path).  Paths with equal words are one
   nonbranching path: it is compacted into one row with its first source coordinate, the smallest doc_id.  Every source of
   a larger doc_id is a verified repeat of the whole path.
3. Anchors with several different paths branch.  The first source of each path is opened into single edges, joined by the
   words of the edge, again with the smallest doc_id as source.
4. Repeated edges of a document are merged into spans of words by their source coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import discard, shared_table
from driftwell.llm.windows import anchors, keyed_texts, listed, unpack

WORDS, GRAM = 13, 4


def paths(listed_docs: DataFrame, words: int, gram: int, edges: bool) -> DataFrame:
    """(node, label, did, rid, run): the listed runs as paths, or each of their edges.

    ``node`` is a hash of the anchor of a path or of the first words - 1 words of an edge; ``label`` a hash of all its words.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            dids, rids = batch.column("did").to_pylist(), batch.column("rid").to_pylist()
            out: list[list[int]] = [[], [], [], [], []]
            for row, packed in enumerate(batch.column("runs")):
                value = batch.column("text")[row].as_buffer()
                parts = value.to_pybytes().split() if value is not None else []
                for run in packed.as_py():
                    first, last, anchor = unpack(run)
                    steps = [(first, last)] if not edges else [(s, s) for s in range(first, last + 1)]
                    for low, high in steps:
                        node = parts[low : low + words - 1] if edges else parts[anchor : anchor + gram]
                        out[0].append(digest(b" ".join(node), 1))
                        out[1].append(digest(b" ".join(parts[low : high + words]), 2))
                        out[2].append(dids[row])
                        out[3].append(rids[row])
                        out[4].append((low << 32) | ((high - low) << 16) | max(0, anchor - low))
                if len(out[0]) > 50_000:
                    yield _rows(out)
                    out = [[], [], [], [], []]
            yield _rows(out)

    return listed_docs.select("did", "rid", "text", "runs").mapInArrow(scan, "node long, label long, did long, rid long, run long")


def _rows(out: list[list[int]]) -> pa.RecordBatch:
    node, label = (np.array(x, np.uint64).view(np.int64) for x in out[:2])
    return pa.RecordBatch.from_pydict({"node": node, "label": label, "did": np.array(out[2], np.int64), "rid": np.array(out[3], np.int64), "run": np.array(out[4], np.int64)})


def compact(rows: DataFrame, name: str, branching: bool) -> DataFrame:
    """(did, rid, run, repeated, open): sources of a path after its first, and first sources of branching paths."""
    rows = shared_table(rows, f"{name}-rows")
    unitigs = rows.groupBy("node", "label").agg(F.min("did").alias("source"), F.max("did").alias("latest"))
    unitigs = shared_table(unitigs, f"{name}-unitigs")
    repeated = F.col("did") > F.col("source")
    if branching:
        nodes = unitigs.groupBy("node").agg(
            F.count(F.lit(1)).alias("branches"), F.min("source").alias("least"), F.max("latest").alias("most")
        )
        # An anchor within one document cannot repeat an earlier one.  Aggregates are written before they are joined: only
        # then can adaptive execution split the join of a frequent anchor.
        nodes = shared_table(nodes.where("least < most"), f"{name}-nodes")
        state = unitigs.join(nodes, "node").select("node", "label", "source", "branches")
        opened = (F.col("branches") > 1) & ~repeated
    else:
        state = unitigs.where("source < latest").select("node", "label", "source")
        opened = F.lit(False)
    marked = rows.join(state, ["node", "label"]).select("did", "rid", "run", repeated.alias("repeated"), opened.alias("open"))
    marked = shared_table(marked.where("repeated or open"), name)
    discard(rows, unitigs, *([nodes] if branching else []))
    return marked


def repeated_spans(docs: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """doc_id, text and ``runs``: packed runs of windows of ``words`` words that a smaller doc_id also holds."""
    keyed = keyed_texts(docs)
    shared = anchors(keyed, "words", words, gram, full=False).groupBy("a").agg(F.min("did").alias("least"), F.max("did").alias("most"))
    shared = shared_table(shared.where("least < most").select("a"), "shared-anchors")
    found = anchors(keyed, "words", words, gram, full=True).join(shared, "a", "left_semi")
    found = shared_table(found.select("did", "rid", "run"), "nodes")
    discard(shared)
    texts = listed(keyed, found, "candidates")
    discard(found)
    active = texts.where("runs is not null")
    whole = compact(paths(active, words, gram, edges=False), "paths", branching=True)
    branches = whole.where("open").groupBy("did", "rid").agg(F.collect_set("run").alias("runs"))
    single = compact(paths(active.drop("runs").join(branches, ["did", "rid"]), words, gram, edges=True), "edges", branching=False)
    repeated = whole.where("repeated").select("did", "rid", "run").unionByName(single.where("repeated").select("did", "rid", "run"))
    lists = repeated.groupBy("did", "rid").agg(F.collect_set("run").alias("runs"))
    spans = active.drop("runs").join(lists, ["did", "rid"], "left").select("doc_id", "text", "runs")
    return spans.unionByName(texts.where("runs is null").select("doc_id", "text", "runs"))


def remove_repeats(docs: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, spans (array of start, end in words) and kept (the other words joined by one space).

    Null texts have no words; texts shorter than a window keep all; a null doc_id counts as larger than any other, and
    null ones are not told apart; rows of one doc_id do not repeat each other; other columns are ignored; no rows give no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            removed, spans, kept, sizes = [], [], [], []
            for row in range(batch.num_rows):
                value = batch.column("text")[row].as_buffer()
                parts = value.to_pybytes().split() if value is not None else []
                merged: list[list[int]] = []
                for run in sorted(batch.column("runs")[row].as_py() or []):
                    first, last, _ = unpack(run)
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], last + words)
                    else:
                        merged.append([first, last + words])
                rest, at = [], 0
                for a, b in merged:
                    rest += parts[at:a]
                    at = b
                rest += parts[at:]
                kept.append(b" ".join(rest).decode())
                sizes.append(len(parts))
                removed.append(len(parts) - len(rest))
                spans.append([{"start": a, "end": b} for a, b in merged])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"
    return repeated_spans(docs, words, gram).mapInArrow(cut, schema)
