"""Prefix trie of rebuilt conversations by composable fingerprints.

A conversation c is rebuilt from the head of its base (the first h turns of conversation c - c % ``FAMILY``) and its own turns
after its first h.  No rebuilt text is made:

1. A turn is an invertible affine map x -> a x + b modulo 2^64, drawn from a hash of its role and text.  Maps form a monoid, so
   the fingerprint of any run of turns is a product, and products of conversations are prefix scans: within range partitions
   first, then over the products of partitions.  A conversation of any length is spread over tasks.
2. The fingerprint of a rebuilt prefix is  head product of the base * inverse of the own head's product * own prefix product.
   A row (conversation, depth, fingerprint) refers to the stored turn it ends in and knows its parent's fingerprint by
   multiplying with the inverse of that turn.
3. Rows of equal depth and fingerprint form a node.  Each node is verified: the turns its rows refer to are equal in role and
   text, and so are their parents' fingerprints.  By induction all its prefixes are equal; otherwise another seed is drawn.
4. Sums over subtrees are sums along conversations: a node belongs to its smallest member, and every node below a node is seen
   by a member whose path passes through both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import WORD, discard, running_total, shared_table
from driftwell.llm.feistel import mix64

FAMILY, HEADS = 20, 4  # conversations of a base; heads have fewer turns than HEADS
CHUNK = 100_000  # ids hashed together
MASK = (1 << 64) - 1
ONE = (1, 0)
NODE = ["depth", "a", "b"]


def product(first: tuple, then: tuple) -> tuple:
    """The map that applies ``first`` and then ``then``; of numpy arrays or of Python integers below 2^64."""
    if isinstance(first[0], int) and isinstance(then[0], int):
        return first[0] * then[0] & MASK, first[1] * then[0] + then[1] & MASK
    return first[0] * then[0], first[1] * then[0] + then[1]


def inverse(a, b) -> tuple:
    """The map that undoes x -> a x + b (a is odd): Newton's steps double the correct bits of 1 / a."""
    x = a * 3 ^ 2 if isinstance(a, int) else a * np.uint64(3) ^ np.uint64(2)
    for _ in range(4):
        x = x * (2 - a * x) & MASK if isinstance(a, int) else x * (np.uint64(2) - a * x)
    return (x, -b * x & MASK) if isinstance(a, int) else (x, (np.uint64(0) - b) * x)


def prefix_products(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of each row's map with all before it from row ``first`` on, by doubling."""
    rows, step = np.arange(len(a)), 1
    reach = int((rows - first).max()) if len(a) else 0
    while step <= reach:
        late = np.flatnonzero(rows - step >= first)
        x, y = product((a[late - step], b[late - step]), (a[late], b[late]))
        a[late], b[late] = x, y
        step *= 2
    return a, b


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def head_length(conv_id: str) -> Column:
    """Turns that a conversation takes from its base: CRC-32 of its decimal id modulo ``HEADS``."""
    return (F.crc32(F.col(conv_id).cast("string").cast("binary")) % HEADS).cast("int")


def scanned_turns(conversations: DataFrame, seed: int) -> DataFrame:
    """Turns with place (``at``, from 1) and product within (conv_id, part), and with their own map (ta, tb)."""
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *text)
    turns = turns.withColumns({"x": F.xxhash64(F.lit(seed), "role", "text"), "y": F.xxhash64("text", F.lit(seed), "role"), "words": F.regexp_count("text", F.lit(WORD)).cast("long")})
    order = ["conv_id", "turn", "x"]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text").withColumn("part", F.spark_partition_id())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done, state = None, 0, ONE  # conversation, turns and product at the end of the last batch
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
            begins = np.concatenate([[True], ids[1:] != ids[:-1]])
            first = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
            ta, tb = mix64(_unsigned(batch.column("x"))) | np.uint64(1), mix64(_unsigned(batch.column("y")))
            a, b = prefix_products(ta.copy(), tb.copy(), first)
            at = np.arange(n) - first + 1
            if held == ids[0]:
                here = first == 0
                a[here], b[here] = product((np.uint64(state[0]), np.uint64(state[1])), (a[here], b[here]))
                at[here] += done
            held, done, state = ids[-1], int(at[-1]), (int(a[-1]), int(b[-1]))
            columns = [batch.column(c) for c in ("conv_id", "part")] + [pa.array(at.astype(np.int64)), *map(_signed, (a, b, ta, tb))]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(c) for c in ("words", "role", "text")], names=["conv_id", "part", "at", "a", "b", "ta", "tb", "words", "role", "text"])

    schema = "conv_id long, part int, at long, a long, b long, ta long, tb long, words long, role string, text string"
    return dealt.mapInArrow(scan, schema)


def layouts(turns: DataFrame) -> DataFrame:
    """One row per conversation: n_turns, heads (map and words of its first turns) and parts (turns and product before each)."""
    head = F.when(F.col("at") < HEADS, F.struct("at", "a", "b", "words"))
    parts = turns.groupBy("conv_id", "part").agg(F.max("at").alias("n"), F.max_by(F.struct("a", "b"), "at").alias("whole"), F.collect_list(head).alias("heads"))
    # A conversation has one entry per range partition that it reaches into, so the list is bounded by their number.
    listed = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n", "whole", "heads"))).alias("parts"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def signed(x: int) -> int:
            return x - (1 << 64) if x >> 63 else x

        for batch in batches:
            out: list[list] = [[], [], []]
            for parts_ in batch.column("parts").to_pylist():
                done, state, heads, placed = 0, ONE, [], []
                for part in parts_:
                    placed.append({"part": part["part"], "before": done, "a": signed(state[0]), "b": signed(state[1])})
                    for h in sorted(part["heads"], key=lambda h: h["at"]):
                        if done + h["at"] < HEADS:
                            a, b = product(state, (h["a"] & MASK, h["b"] & MASK))
                            heads.append({"a": signed(a), "b": signed(b), "words": h["words"]})
                    done, state = done + part["n"], product(state, (part["whole"]["a"] & MASK, part["whole"]["b"] & MASK))
                for held, value in zip(out, (done, heads, placed), strict=True):
                    held.append(value)
            kinds = [pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("words", pa.int64())]))]
            kinds.append(pa.list_(pa.struct([("part", pa.int32()), ("before", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names=["conv_id", "n_turns", "heads", "parts"])

    schema = "conv_id long, n_turns long, heads array<struct<a:long,b:long,words:long>>, parts array<struct<part:int,before:long,a:long,b:long>>"
    return listed.mapInArrow(chain, schema)


def rebuilt_layouts(laid: DataFrame) -> DataFrame:
    """conv_id, head (the base's turns it takes), skip (own turns it leaves out), length and parts, whose maps now begin with
    the head: product of the base's head * inverse of the own head's product * product of the parts before."""
    own = laid.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", head_length("conv_id"))
    joined = own.join(laid.select(F.col("conv_id").alias("base"), F.col("heads").alias("head")), "base", "left")
    joined = joined.withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<a:long,b:long,words:long>>")), F.lit(1), F.col("h")))
    joined = joined.withColumn("skip", F.least(F.col("h").cast("long"), F.col("n_turns"))).withColumn("length", F.size("head") + F.col("n_turns") - F.col("skip"))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def signed(x: int) -> int:
            return x - (1 << 64) if x >> 63 else x

        for batch in batches:
            moved = []
            for head, heads, skip, parts in zip(*(batch.column(c).to_pylist() for c in ("head", "heads", "skip", "parts")), strict=True):
                state = (head[-1]["a"] & MASK, head[-1]["b"] & MASK) if head else ONE
                if skip:
                    state = product(state, inverse(heads[skip - 1]["a"] & MASK, heads[skip - 1]["b"] & MASK))
                for p in parts:
                    a, b = product(state, (p["a"] & MASK, p["b"] & MASK))
                    p["a"], p["b"] = signed(a), signed(b)
                moved.append(parts)
            columns = [batch.column(c) for c in ("conv_id", "head", "skip", "length")] + [pa.array(moved, batch.column("parts").type)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "head", "skip", "length", "parts"])

    schema = "conv_id long, head array<struct<a:long,b:long,words:long>>, skip long, length long, parts array<struct<part:int,before:long,a:long,b:long>>"
    return joined.select("conv_id", "head", "heads", "skip", "length", "parts").mapInArrow(start, schema)


def own_rows(turns: DataFrame, rebuilt: DataFrame, texts: bool) -> DataFrame:
    """Rows (conv_id, depth, fingerprint a and b, parent's pa and pb, words, length) that end in an own turn.

    With ``texts`` also the stored turn, for the rows that others refer to: every turn after the skipped ones, and all of a base.
    """
    placed = rebuilt.select("conv_id", "skip", "length", F.size("head").alias("taken"), F.explode("parts").alias("p"))
    placed = placed.select("conv_id", "skip", "length", "taken", "p.part", "p.before", F.col("p.a").alias("oa"), F.col("p.b").alias("ob"))
    carried = ["role", "text"] if texts else []
    rows = turns.select("conv_id", "part", "at", "a", "b", "ta", "tb", "words", *carried).join(placed, ["conv_id", "part"])
    stands = F.col("before") + F.col("at") > F.col("skip")
    rows = rows.where(stands | (F.col("conv_id") % FAMILY == 0) if texts else stands)
    rows = rows.withColumn("depth", F.col("taken") + F.col("before") + F.col("at") - F.col("skip"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb, oa, ob = (_unsigned(batch.column(c)) for c in ("a", "b", "ta", "tb", "oa", "ob"))
            node = product((oa, ob), (a, b))
            parent = product(node, inverse(ta, tb))
            columns = [batch.column("conv_id"), batch.column("depth"), *map(_signed, (*node, *parent))]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(c) for c in ("words", "length", *carried)], names=["conv_id", *NODE, "pa", "pb", "words", "length", *carried])

    schema = "conv_id long, depth long, a long, b long, pa long, pb long, words long, length long" + "".join(f", {c} string" for c in carried)
    return rows.mapInArrow(multiply, schema)


def member_rows(turns: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """One row per conversation and prefix of its rebuilt turns, the empty one included."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    none = F.lit(None).cast("long")
    roots = rebuilt.select("conv_id", zero.alias("depth"), one.alias("a"), zero.alias("b"), none.alias("pa"), none.alias("pb"), zero.alias("words"), "length")
    # The row before the first is the root, so that every turn of the head finds its parent at its own place in the longer array.
    path = F.concat(F.array(F.struct(one.alias("a"), zero.alias("b"), zero.alias("words"))), "head")
    heads = rebuilt.select("conv_id", "length", path.alias("path"), F.posexplode("head").alias("i", "t"))
    parent = F.col("path")[F.col("i")]
    heads = heads.select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), "t.a", "t.b", parent["a"].alias("pa"), parent["b"].alias("pb"), "t.words", "length")
    return roots.unionByName(heads).unionByName(own_rows(turns, rebuilt, texts=False))


def collisions(turns: DataFrame, rebuilt: DataFrame) -> int:
    """Number of nodes whose rows end in different turns or come from different parents."""
    rows = own_rows(turns, rebuilt, texts=True)
    said = F.struct("role", "text")
    ends = rows.groupBy(*NODE).agg(F.min(said).alias("least"), F.max(said).alias("most"), F.min(F.struct("pa", "pb")).alias("p"), F.max(F.struct("pa", "pb")).alias("q"))
    return ends.where("least <> most or p <> q").count()


def with_nodes(rows: DataFrame, nodes: DataFrame, on: list[str], total: int, columns: list[str]) -> DataFrame:
    """Left join of ``rows`` to ``columns`` of their nodes.

    Each of the ``total`` member rows has one node, so fewer than a thousand nodes hold more than a thousandth of them: these are
    broadcast.  The other nodes have few rows each and are joined by key.
    """
    crowded = F.col("__size") * 1000 > total
    renamed = nodes.select(*(F.col(n).alias(f"__{n}") for n in NODE), F.col("n_convs").alias("__size"), *(F.col(c).alias(f"__{c}_") for c in columns))
    match = [F.col(c) == F.col(f"__{n}") for c, n in zip(on, NODE, strict=True)]
    mine = rows.columns
    hot = rows.join(F.broadcast(renamed.where(crowded)), match, "left")
    done = hot.where("__depth is not null").select(*mine, *(F.col(f"__{c}_").alias(f"node_{c}") for c in columns))
    rest = hot.where("__depth is null").select(*mine)
    cold = rest.join(renamed.where(~crowded), match, "left").select(*mine, *(F.col(f"__{c}_").alias(f"node_{c}") for c in columns))
    return done.unionByName(cold)


def end_digests(ends: DataFrame) -> DataFrame:
    """NODE and ends_sha256 of the conversations that end in a node: their decimal ids, ascending, joined by commas.

    Ids are sorted over range partitions and packed in chunks there; a node's digest reads its chunks in order, one at a time.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in NODE]
            ids = batch.column("conv_id").to_pylist()
            turns = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            bounds = [0, *turns.tolist(), len(ids)]
            spans = [(i, min(i + CHUNK, high)) for low, high in zip(bounds[:-1], bounds[1:], strict=True) for i in range(low, high, CHUNK)]
            at = np.array([s[0] for s in spans])
            packed = pa.array([",".join(map(str, ids[low:high])).encode() for low, high in spans], pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.array(k[at]) for k in keys), pa.array([ids[i] for i in at], pa.int64()), packed], names=[*NODE, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None

        def done(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[*NODE, "ends_sha256"])

        for batch in batches:
            rows = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if key != held:
                    if held is not None:
                        rows.append((*held, state.hexdigest()))
                    held, state = key, hashlib.sha256(ids)
                else:
                    state.update(b",")
                    state.update(ids)
            yield done(rows)
        if held is not None:
            yield done([(*held, state.hexdigest())])

    order = [*NODE, "conv_id"]
    packed = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, "depth long, a long, b long, first long, ids binary")
    return packed.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, seed: int = 1, tries: int = 4) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256 and the fingerprint (a, b).

    Turns follow ``turn``, null first; turns that tie follow a hash of role and text, equal ones are interchangeable, and a
    repeated row is a turn of its own.  Null roles and texts are empty, rows without conv_id belong to no conversation, other
    columns are ignored, and no conversation gives no row, not even a root.
    """
    for attempt in range(tries):
        turns = shared_table(scanned_turns(conversations, seed + attempt), "turns")
        laid = shared_table(layouts(turns), "layouts")
        rebuilt = shared_table(rebuilt_layouts(laid), "rebuilt")
        if not collisions(turns, rebuilt):
            break
        discard(turns, laid, rebuilt)
    else:
        raise RuntimeError("different prefixes share a fingerprint under every seed")
    members = shared_table(member_rows(turns, rebuilt), "members")
    total = members.count()
    nodes = members.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.max("pa").alias("pa"), F.max("pb").alias("pb")
    )
    nodes = shared_table(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = shared_table(nodes.join(children, NODE, "left").fillna(0, ["n_children"]), "parents")
    # A node's value counts on the path of its smallest member alone; the last bit counts that member's end without children.
    seen = with_nodes(members.select("conv_id", *NODE), nodes, NODE, total, ["conv_id", "n_convs", "words", "n_children"])
    mine = F.col("conv_id") == F.col("node_conv_id")
    value = F.when(mine, 2 * (F.col("node_n_convs") - 1) * F.col("node_words") + (F.col("node_n_children") == 0).cast("long")).otherwise(0)
    paths = running_total(seen.select("conv_id", *NODE, (-F.col("depth")).alias("up"), value.alias("value")), ["conv_id"], ["up"], "value")
    below = F.col("before") + F.col("value")
    sums = paths.groupBy(*NODE).agg(F.sum(F.shiftright(below, 1)).alias("saved_tokens"), F.sum(below.bitwiseAND(F.lit(1))).alias("n_leaves"))
    ends = end_digests(members.where("depth = length"))
    upper = with_nodes(nodes.withColumn("up", F.col("depth") - 1), nodes, ["up", "pa", "pb"], total, ["conv_id"])
    whole = upper.join(sums, NODE).join(ends, NODE, "left")
    return whole.select(
        "conv_id", "depth", F.col("node_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "a", "b",
    )
