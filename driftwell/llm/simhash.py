"""SimHash near-dedup with pigeonring filtering.

Fingerprints of 64 bits are cut into a ring of 8 segments.  If two differ in at most t bits, some segment starts a chain
whose first l segments differ in at most l x t / 8 bits, for every l.  With t = 3 the budgets are 0, 0, 1, 1, 1, 2, 2, 3:
the first two segments are equal, and of the next three at most one differs.  Each fingerprint is therefore filed under 24
keys of 32 bits (8 starts, two segments and two of the next three); pairs met under a key must keep the budgets along the
whole ring, the last of which is the Hamming check.  Keys of 32 bits stay short at billions of fingerprints.

Equal fingerprints are one node.  Under a key only a spanning forest of its links is emitted.  A crowded key is split into
blocks, and pairs of blocks are compared, each in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import shared_table
from driftwell.llm.components import components
from driftwell.llm.feistel import mix64

SEGMENTS, BITS, BUDGET = 8, 8, 3
BLOCK = 512  # fingerprints compared at once
SHINGLES = 400_000  # shingle hashes compared at once
PAIRS = 1_000_000  # pairs of texts whose similarity is held at once
BANDS, MISSED = 64, 1e-5  # keys of a text in ``sketches``, and the share of pairs at the similarity itself that may share none


def _majority(hashes: np.ndarray) -> np.uint64:
    """Bit is 1 where it is 1 in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


def shingle_hashes(text: bytes, words: int, distinct: bool = False) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of a lower-cased text, in order; of the whole sequence if it is shorter."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    if words == 1:
        shingles = set(parts) if distinct else parts
    else:
        joined = b" ".join(parts)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = max(1, len(parts) - words + 1)
        shingles = [joined[a:b] for a, b in zip(starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist(), strict=True)]
        shingles = set(shingles) if distinct else shingles
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles))


def fingerprints(docs: DataFrame, words: int = 3, distinct: bool = False, seeds: Sequence[int] = (0,)) -> DataFrame:
    """doc_id, rid (hash of the text) and fps, one fingerprint per seed (seed 0: the XXH64 values as they are)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column("text"):
                raw = value.as_buffer()
                hashes = shingle_hashes(raw.to_pybytes() if raw is not None else b"", words, distinct)
                out.append([int(_majority(mix64(hashes ^ np.uint64(s)) if s else hashes).view(np.int64)) if len(hashes) else 0 for s in seeds])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "rid", "fps"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid"), "text").mapInArrow(scan, "doc_id long, rid long, fps array<long>")


def ring_keys(fp: Column) -> Column:
    """Array of the 24 keys of a fingerprint: start and left-out segment above 32 bits of segments."""
    keys = []
    for start in range(SEGMENTS):
        turned = fp if not start else F.shiftleft(fp, BITS * start).bitwiseOR(F.shiftrightunsigned(fp, 64 - BITS * start))
        segment = [F.shiftrightunsigned(turned, 56 - BITS * s).bitwiseAND(F.lit(255)) for s in range(5)]
        for left_out in (2, 3, 4):
            key = F.lit(start * 3 + left_out - 2).cast("long")
            for s in (0, 1, *[x for x in (2, 3, 4) if x != left_out]):
                key = F.shiftleft(key, BITS).bitwiseOR(segment[s])
            keys.append(key)
    return F.array(*keys)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Star edges (root, member) of the components of a boolean adjacency matrix."""
    todo = linked.any(1)
    edges = []
    while todo.any():
        root = int(np.argmax(todo))
        reached = np.zeros(len(linked), bool)
        front = np.array([root])
        reached[root] = True
        while len(front):
            found = np.zeros(len(linked), bool)
            for at in range(0, len(front), BLOCK):
                found |= linked[front[at : at + BLOCK]].any(0)
            found &= ~reached
            reached |= found
            front = np.flatnonzero(found)
        todo &= ~reached
        edges += [(root, int(m)) for m in np.flatnonzero(reached) if m != root]
    return edges


def _ring_links(fps: np.ndarray, start: int) -> np.ndarray:
    """Adjacency of the pairs that keep every budget of the chain from ``start``; the last budget is the Hamming limit."""
    shift = np.uint64(BITS * start)
    turned = (fps << shift) | (fps >> (np.uint64(64) - shift)) if start else fps
    a, b = np.triu_indices(len(fps), 1)
    for length in range(5, SEGMENTS + 1):
        apart = (turned[a] ^ turned[b]) >> np.uint64(64 - BITS * length)
        fits = np.bitwise_count(apart) <= length * BUDGET // SEGMENTS
        a, b = a[fits], b[fits]
    linked = np.zeros((len(fps), len(fps)), bool)
    linked[a, b] = linked[b, a] = True
    return linked


def blocked(rows: DataFrame, key: str, parts: Column, total: Column) -> DataFrame:
    """Deals the rows of each key into ceil(total) cells such that any two rows of the key meet in a cell.

    ``total`` aggregates the load of a key in blocks; keys of one row are dropped.  Adds ``cell``.
    """
    load = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.ceil(total).cast("int").alias("__blocks")).where("__n > 1").drop("__n")
    dealt = rows.join(load, key).withColumn("__mine", F.pmod(F.xxhash64(parts), F.col("__blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))
    dealt = dealt.withColumn("__other", other)
    cell = F.greatest("__mine", "__other") * F.col("__blocks") + F.least("__mine", "__other")
    return dealt.withColumn("cell", cell).drop("__mine", "__other", "__blocks")


def links(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all fingerprints (column fp, distinct) within the limit, a spanning forest per key."""
    keyed = nodes.select("fp", F.explode(ring_keys(F.col("fp"))).alias("key"))
    cells = blocked(keyed, "key", F.col("fp"), F.count(F.lit(1)) / BLOCK)
    lists = cells.groupBy("key", "cell").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for key, packed in zip(batch.column("key").to_pylist(), batch.column("fps"), strict=True):
                fps = packed.values.to_numpy().view(np.uint64)
                if len(fps) == 2:
                    close = np.bitwise_count(fps[0] ^ fps[1]) <= BUDGET
                    edges = [(0, 1)] if close else []
                else:
                    edges = _forest(_ring_links(fps, (key >> 32) // 3))
                named = fps.view(np.int64).tolist()
                u += [named[a] for a, _ in edges]
                v += [named[b] for _, b in edges]
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return lists.mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id reachable over fingerprints at most 3 bits apart.

    A text without words (null, empty) has fingerprint 0 and links like any other; a text of fewer words is one shingle;
    null ids take part, but a component without an id has a null component_id; repeated rows are one node; columns other
    than doc_id and text are ignored; no rows give no rows.
    """
    found = shared_table(fingerprints(docs, words).select("doc_id", F.col("fps")[0].alias("fp")), "fingerprints")
    nodes = shared_table(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes))
    placed = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = shared_table(placed.join(least, "root").select("fp", "component_id"), "labels")
    return found.join(labels, "fp").select("doc_id", "fp", "component_id")


def band_width(similarity: float) -> int:
    """Minima per key: as many as leave a pair of this similarity without a common key in at most ``MISSED`` of cases."""
    needed = 1 - MISSED ** (1 / BANDS)
    return 32 if similarity >= 1 else min(32, max(1, int(np.log(needed) / np.log(similarity))))


def random_orders(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts of BANDS x ``width`` random maps of 32 bits onto themselves."""
    draw = np.random.default_rng(42)
    factors = draw.integers(0, 2**31, BANDS * width, np.uint32) * np.uint32(2) + np.uint32(1)
    return factors, draw.integers(0, 2**32, BANDS * width, np.uint32)


def minima(hashes: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Smallest image of the hashes under each map."""
    low = hashes.astype(np.uint32)
    out = np.full(len(factors), 2**32 - 1, np.uint32)
    for at in range(0, len(low), 8_192):
        piece = low[at : at + 8_192]
        step = max(1, 65_536 // len(piece))
        for i in range(0, len(factors), step):
            values = np.multiply.outer(factors[i : i + step], piece)
            values += shifts[i : i + step, None]
            np.minimum(out[i : i + step], values.min(1), out=out[i : i + step])
    return out


def band_keys(found: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``minima`` to rows of BANDS keys of 64 bits; two texts share a key with the probability similarity ** width."""
    parts = found.reshape(len(found), BANDS, width)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for j in range(width):
        keys = mix64(keys ^ parts[:, :, j])
    return keys


def sketches(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, rid (hash of the text) and keys of samples of its distinct shingles; a text without words has none."""
    width = band_width(similarity)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = random_orders(width)
        for whole in batches:
            for batch in (whole.slice(at, 1_024) for at in range(0, len(whole), 1_024)):
                found, counts = [], []
                for value in batch.column("text"):
                    raw = value.as_buffer()
                    hashes = shingle_hashes(raw.to_pybytes() if raw is not None else b"", words, True)
                    counts.append(BANDS if len(hashes) else 0)
                    if len(hashes):
                        found.append(minima(hashes, factors, shifts))
                keys = band_keys(np.stack(found), width).view(np.int64).ravel() if found else np.empty(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(keys))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), lists], names=["doc_id", "rid", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid"), "text").mapInArrow(scan, "doc_id long, rid long, keys array<long>")


def text_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, rid (hash of the text), root (of the group) and component_id over texts whose sets of word shingles have at least this Jaccard similarity.

    Candidates share one of 64 keys, each made of the smallest of their shingles under several random orders; a pair at the
    similarity itself shares none in one of 100,000 cases, a closer pair less often.  Within the candidate groups, similarity
    is computed exactly on the shingles, block by block.  Texts without words link to nothing but their own copies.
    """
    found = shared_table(sketches(docs, words, similarity), "sketches")
    texts = shared_table(found.groupBy("rid").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys")), "texts")
    found = found.select("doc_id", "rid")
    member = texts.select("rid", F.explode("keys").alias("key"))
    crowd = member.groupBy("key").agg(F.min("rid").alias("v"), F.max("rid").alias("last")).where("v <> last").select("key", "v")
    groups = components(member.join(crowd, "key").select(F.col("rid").alias("u"), "v"))

    keyed = docs.select(F.xxhash64("text").alias("rid"), "text")
    shared = keyed.join(groups.select(F.col("node").alias("rid"), "root"), "rid").groupBy("rid").agg(F.first("text").alias("text"), F.first("root").alias("root"))

    @F.pandas_udf("array<long>")
    def hashed(text: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t.encode(), words, True)).view(np.int64) for t in text])

    sets = shared_table(shared.select("rid", "root", hashed("text").alias("shingles")), "shingles")
    # A tenth of a block's load per text at least, so that crowds of short texts are split too.
    cells = blocked(sets, "root", F.col("rid"), F.sum(F.size("shingles") + SHINGLES // (4 * BLOCK)) / SHINGLES)
    # The texts of a cell meet in one sorted stream.
    stream = cells.repartition("root", "cell").sortWithinPartitions("root", "cell").select("root", "cell", "rid", "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rids, at = [], [], None

        def done():
            edges = _forest(_similar(held, similarity)) if len(held) > 1 else []
            return pa.RecordBatch.from_pydict({"u": pa.array([rids[a] for a, _ in edges], pa.int64()), "v": pa.array([rids[b] for _, b in edges], pa.int64())})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("root", "cell", "rid")]
            for row, (root, cell, rid) in enumerate(zip(*columns, strict=True)):
                if (root, cell) != at:
                    if held:
                        yield done()
                    held, rids, at = [], [], (root, cell)
                held.append(batch.column("shingles")[row].values.to_numpy())
                rids.append(rid)
        if held:
            yield done()

    near = components(stream.mapInArrow(verify, "u long, v long"))
    placed = texts.join(near.select(F.col("node").alias("rid"), "root"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = shared_table(placed.join(least, "root").select("rid", "root", "component_id"), "labels")
    return found.join(labels, "rid").select("doc_id", "rid", "root", "component_id")


def alike(docs: DataFrame, words: int = 3) -> DataFrame:
    """Edges (u, v) between texts (hashes) that connect those with fingerprints at most 3 bits apart, by the links of ``near_duplicates``.

    A text without words has fingerprint 0 and links like any other.
    """
    found = shared_table(fingerprints(docs, words).select("rid", F.col("fps")[0].alias("fp")).distinct(), "fingerprints")
    roots = components(links(found.select("fp").distinct()))
    placed = found.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("rid", F.coalesce("root", "fp").alias("group"))
    least = placed.groupBy("group").agg(F.min("rid").alias("v"))
    return placed.join(least, "group").where("rid <> v").select(F.col("rid").alias("u"), "v")


def one_of_each_group(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay when of each group only the smallest doc_id is kept, null last; of equal rows one stays.

    Groups are connected by fingerprints at most 3 bits apart (see ``near_duplicates``) and by the exact similarity of texts (see
    ``text_groups``), which finds pairs that lie further apart than 3 bits.
    """
    groups = text_groups(docs, words, similarity)
    edges = alike(docs).unionByName(groups.where("rid <> root").select(F.col("rid").alias("u"), F.col("root").alias("v")))
    merged = components(edges).select(F.col("node").alias("rid"), F.col("root").alias("whole"))
    groups = groups.join(merged, "rid", "left").withColumn("root", F.coalesce("whole", "root"))
    last = F.lit(2**63 - 1)
    stay = groups.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("__did"), F.col("rid").alias("__rid"))).alias("one")).select("one.*")
    keyed = docs.withColumns({"__did": F.coalesce(F.col("doc_id").cast("long"), last), "__rid": F.xxhash64("text")})
    return keyed.join(shared_table(stay, "stay"), ["__did", "__rid"]).dropDuplicates(["__did", "__rid"]).select(*docs.columns)


def _similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Adjacency of sets with at least the given Jaccard similarity, from exact sizes of their intersections.

    Sets are compared in strips of about ``PAIRS`` pairs with those from the strip on; beside the adjacency, memory holds one strip.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    keep = (np.bincount(where, minlength=len(values)) > 1)[where]
    owner, where = owner[keep], where[keep]
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    linked = np.zeros((n, n), bool)
    rows, step = max(64, PAIRS // n), max(256, 2 * PAIRS // n)
    for top in range(0, n, rows):
        end = min(n, top + rows)
        # Only hashes that the strip holds can be common; they become columns.
        here = np.zeros(len(values), bool)
        here[where[(owner >= top) & (owner < end)]] = True
        column = np.cumsum(here) - 1
        mine = here[where] & (owner >= top)
        row, col = owner[mine] - top, column[where[mine]]
        common = np.zeros((end - top, n - top), np.float32)
        for low in range(0, int(here.sum()), step):
            a, b = np.searchsorted(col, [low, low + step])
            held = np.zeros((n - top, step), np.float32)
            held[row[a:b], col[a:b] - low] = 1
            common += held[: end - top] @ held.T
        union = sizes[top:end, None] + sizes[None, top:] - common
        linked[top:end, top:] = common >= similarity * union - 1e-6
        linked[top:, top:end] |= linked[top:end, top:].T
    np.fill_diagonal(linked, False)
    return linked
