"""Embedding near-dedup by counting collisions on sorted one-dimensional projections.

Each of ``lines`` lists sorts the vectors by b sign bits and then by one projection.  Two vectors collide in a list where they
share the bits and the projection of one lies within a window around that of the other.  Pairs with at least two collisions are
verified exactly.

Calibration: vectors at the limit share a sign bit with probability s = 1 - arccos(limit) / pi, and with a window of their
distance apart, w = sqrt(2 - 2 limit), they lie in one window with probability 0.683.  b grows with log2 of the number of
vectors, so that a window of unrelated vectors stays short, and ``lines`` is such that a pair at the limit is expected to
collide EXPECTED times: fewer than two collisions then have a probability of (1 + EXPECTED) exp(-EXPECTED), 0.1 %.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import shared_table
from driftwell.llm.components import components
from driftwell.llm.vectors import by_width, matrix, unit, usable

EXPECTED, COUNT = 9.2, 2
PAIRS = 500_000  # pairs handed over at a time


def calibrate(vectors: int, limit: float) -> tuple[int, int, float]:
    """(sign bits, lists, window) for a number of vectors and a cosine."""
    bits = max(2, math.ceil(math.log2(max(vectors, 2))) - 4)
    shared = 1 - math.acos(limit) / math.pi
    return bits, math.ceil(EXPECTED / (shared**bits * math.erf(1 / math.sqrt(2)))), math.sqrt(2 - 2 * limit)


def sorted_lists(nodes: DataFrame, bits: int, lines: int, seed: int) -> DataFrame:
    """(width, bucket, place, node): components, list and sign bits, projection, vector; one row per vector and list."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in (b for whole in batches for b in by_width(whole, "vector")):
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                points = unit(matrix(part.column("vector"), part.num_rows))
                node = part.column("node").to_numpy()
                draw = np.random.default_rng(seed)
                for line in range(lines):
                    shadow = points @ draw.standard_normal((points.shape[1], bits + 1))
                    bucket = (line << 40) | ((shadow[:, :bits] > 0) @ weights)
                    width = np.full(len(node), points.shape[1], np.int32)
                    yield pa.RecordBatch.from_pydict({"width": width, "bucket": bucket, "place": shadow[:, bits], "node": node})

    return nodes.select("node", "vector").mapInArrow(scan, "width int, bucket long, place double, node long")


def collide(lists: DataFrame, window: float) -> DataFrame:
    """(a, b), a < b: one row per collision."""
    stream = lists.repartition("width", "bucket").sortWithinPartitions("width", "bucket", "place")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, bucket, place, node = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        for batch in batches:
            old = len(bucket)
            width, bucket, place, node = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in ((width, "width"), (bucket, "bucket"), (place, "place"), (node, "node")))
            # Buckets are spread so far apart on one axis that windows never cross them.
            rank = np.cumsum(np.concatenate([[False], (bucket[1:] != bucket[:-1]) | (width[1:] != width[:-1])])[: len(bucket)])
            axis = rank * 1e4 + np.clip(place, -1e3, 1e3)
            first = np.searchsorted(axis, axis - window)
            right = np.arange(old, len(axis))
            sizes = right - first[old:]
            ends = np.cumsum(sizes)
            for at in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
                pair = np.arange(at, min(at + PAIRS, int(ends[-1])))
                which = np.searchsorted(ends, pair, "right")
                left = first[right[which]] + pair - (ends[which] - sizes[which])
                x, y = node[left], node[right[which]]
                yield pa.RecordBatch.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y)})
            near = axis >= axis[-1] - window if len(axis) else slice(0, 0)
            width, bucket, place, node = width[near], bucket[near], place[near], node[near]

    return stream.mapInArrow(sweep, "a long, b long")


def near_pairs(df: DataFrame, limit: float = 0.9, seed: int = 23) -> tuple[DataFrame, DataFrame]:
    """(nodes, pairs): distinct vectors (node: their smallest vec_id, copies) and the verified pairs (a, b, score) of nodes."""
    vectors = usable(df)
    nodes = shared_table(vectors.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")), "nodes")
    bits, lines, window = calibrate(nodes.count(), limit)
    met = collide(sorted_lists(nodes, bits, lines, seed), window)
    often = met.groupBy("a", "b").count().where(F.col("count") >= COUNT).select("a", "b")
    often = shared_table(often, "candidates")
    sides = often.join(nodes.select(F.col("node").alias("a"), F.col("vector").alias("va")), "a").join(nodes.select(F.col("node").alias("b"), F.col("vector").alias("vb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in by_width(whole, "va")):
            x, y = unit(matrix(batch.column("va"), batch.num_rows)), unit(matrix(batch.column("vb"), batch.num_rows))
            score = (x * y).sum(1) if batch.num_rows else np.empty(0)
            keep = score >= limit
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").to_numpy()[keep], "b": batch.column("b").to_numpy()[keep], "score": score[keep]})

    pairs = sides.select("a", "b", "va", "vb").mapInArrow(verify, "a long, b long, score double")
    return nodes, shared_table(pairs, "pairs")


def near_duplicates(df: DataFrame, limit: float = 0.9, seed: int = 23) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Equal vectors link to each other and share the links of their node.  Vectors that are null or zero or hold
    null or non-finite components link with nothing, and vectors of different widths never link; repeated rows are rows of their own; a row
    without vec_id links with nothing and its component is null; no rows give no rows.
    """
    nodes, pairs = near_pairs(df, limit, seed)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weights = nodes.select(F.col("node").alias("b"), "copies")
    links = both.join(weights, "b").groupBy("a").agg(F.sum("copies").alias("others"))
    roots = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = (
        nodes.join(links, nodes["node"] == links["a"], "left")
        .join(roots.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left")
        .select("vector", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    placed = shared_table(placed, "placed")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    found = rows.where("vec_id is not null").join(placed, "vector", "left").unionByName(
        rows.where("vec_id is null").withColumns({"n_links": F.lit(0).cast("long"), "root": F.lit(None).cast("long")})
    )
    component = F.coalesce("root", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
