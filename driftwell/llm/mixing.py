"""Mixing sources to target weights with blocks of fixed length.

The words of each source are laid end to end and cut into blocks of ``block_words``.  Every output shard draws how many
of its slots each source fills from a multinomial.  The slots of a source are numbered through all shards; slot t takes
block perm(t mod N) of pass t div N, where perm is a Feistel permutation keyed by source and pass, and blocks are joined
by that index.  Draws beyond a source's number of slots are cut and shortfalls go to closing shards, so that totals are
exact, no block is taken more often than the number of passes, and reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwell.llm.common import WORD, running_total, shared_table
from driftwell.llm.feistel import mix64, permute

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, PASSES = 1.5, 2
BLOCK_WORDS, SHARD_SLOTS = 128, 4096
MAX_SOURCES = 100_000  # one row each reaches every task that draws; more is refused


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, passes: float = PASSES) -> DataFrame:
    """One row per source: sid (rank by code point, null last), source, source_size, weight, target.

    Sources share ``share`` x all sizes by weight, none above ``passes`` x its own size.  What a full source leaves over
    goes to the others by weight, which ends at one level: target = least(passes x size, level x weight).  Sources fill up
    in the order of passes x size / weight, so the level follows from running sums over the sources in that order.
    """
    ordered = W.orderBy(F.asc_nulls_last("source"))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", (F.row_number().over(ordered) - 1).cast("long"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_fill = W.orderBy(F.col("__cap") / F.col("weight"), "sid")
    earlier, everything = by_fill.rowsBetween(W.unboundedPreceding, -1), by_fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = (
        sources.withColumn("weight", F.get(cycle, (F.col("sid") % len(weights)).cast("int")))
        .withColumn("__cap", F.col("source_size") * F.lit(float(passes)))
        .withColumn("__rest", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("__cap").over(earlier), F.lit(0.0)))
        .withColumn("__weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
        .withColumn("__full", F.col("__cap") * F.col("__weights") <= F.col("__rest") * F.col("weight"))
        .withColumn("__level", F.max(F.when(~F.col("__full"), F.struct(-F.col("__cap") / F.col("weight"), -F.col("sid"), F.col("__rest") / F.col("__weights")).alias("x"))).over(everything))
    )
    target = F.when(F.col("__full"), F.col("__cap")).otherwise(F.least("__cap", F.col("__level.col3") * F.col("weight")))
    return filled.select("sid", "source", "source_size", "weight", target.alias("target"))


def pack_blocks(laid: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pieces of documents in blocks: (sid, position, block, first_word, n_words); a document without words has none."""
    start, stop = F.col("before"), F.col("before") + F.col("size")
    low = F.greatest(start, F.col("block") * block_words)
    high = F.least(stop, (F.col("block") + 1) * block_words)
    blocks = F.sequence(F.floor(start / block_words), F.floor((stop - 1) / block_words))
    return (
        laid.where(F.col("size") > 0)
        .withColumn("block", F.explode(blocks))
        .select("sid", "position", "block", (low - start).alias("first_word"), (high - low).alias("n_words"))
    )


def draw_slots(spark, plan: list, shard_slots: int, seed: int) -> DataFrame:
    """Multinomial counts per output shard: (shard, sid, n).  ``plan`` holds (sid, N, T) per source."""
    sids, wanted = np.array([p[0] for p in plan], np.int64), np.array([p[2] for p in plan], np.float64)
    total = wanted.sum()
    shards = int(-(-total // shard_slots))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for shard in batch["id"].tolist():
                n = np.random.Generator(np.random.Philox(key=[seed, shard])).multinomial(min(shard_slots, int(total) - shard * shard_slots), wanted / total)
                out.append(pd.DataFrame({"shard": shard, "sid": sids[n > 0], "n": n[n > 0]}))
            if out:
                yield pd.concat(out)

    return spark.range(shards).mapInPandas(draw, "shard long, sid long, n long")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, passes: int = PASSES, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 20240601):
    """(laid documents, pieces, placement).

    ``laid``: doc_id, text_hash, sid, size, position (rank within the source), before (words of earlier documents),
    source_size, target.  ``pieces``: see ``pack_blocks``.  ``placement``: (shard, sid, turn, pass, block), one row
    per output block; shard -1 holds the closing draws and turn numbers the blocks of a source.  Null texts have size 0; null sources form one source; repeated rows are laid one after another;
    columns other than doc_id, text and source are ignored; an empty table gives three empty frames.
    """
    spark = docs.sparkSession
    sizes = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = shared_table(sizes, "sizes")
    targets = source_targets(sizes, weights, share, passes)
    rows = targets.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    catalog = spark.createDataFrame(rows, targets.schema)
    same = sizes["source"].eqNullSafe(catalog["source"])
    known = sizes.join(F.broadcast(catalog), same).select("doc_id", "text_hash", "size", "sid", "source_size", "target")
    laid = running_total(known, ["sid"], ["doc_id", "text_hash"], "size")
    laid = shared_table(laid, "laid")

    plan = []
    for r in rows:
        if r.source_size:
            blocks = -(-r.source_size // block_words)
            wanted = min(passes * blocks, round(r.target * blocks / r.source_size))
            if wanted:
                plan.append((r.sid, blocks, wanted))
    if plan:
        drawn = draw_slots(spark, plan, shard_slots, seed)
    else:
        drawn = spark.createDataFrame([], "shard long, sid long, n long")
    limits = F.broadcast(spark.createDataFrame(plan, "sid long, blocks long, wanted long"))
    numbered = running_total(drawn, ["sid"], ["shard"], "n").join(limits, "sid")
    numbered = numbered.withColumn("n", F.least("n", F.greatest(F.lit(0), F.col("wanted") - F.col("before")))).where("n > 0")
    numbered = shared_table(numbered.select("shard", "sid", "n", "before", "blocks"), "draws")
    short = (
        limits.join(numbered.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left")
        .withColumn("before", F.coalesce("got", F.lit(0)).cast("long"))
        .withColumn("n", F.col("wanted") - F.col("before"))
        .where("n > 0")
        .withColumn("shard", F.lit(-1).cast("long"))
    )
    runs = numbered.unionByName(short.select("shard", "sid", "n", "before", "blocks"))

    @F.pandas_udf("long")
    def block_of(turn: pd.Series, blocks: pd.Series, sid: pd.Series) -> pd.Series:
        t, n = turn.to_numpy(np.uint64), blocks.to_numpy(np.uint64)
        with np.errstate(over="ignore"):
            key = mix64(sid.to_numpy(np.uint64) * np.uint64(1_000_003) + t // n + np.uint64(seed))
        return pd.Series(permute(t % n, n, key))

    # A run is split into parts of bounded length before its slots are listed.
    part = 65_536
    parts = runs.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(part).cast("long"))))
    listed = parts.withColumn("turn", F.explode(F.sequence(F.col("before") + F.col("__from"), F.col("before") + F.least("n", F.col("__from") + part) - 1)))
    placement = listed.select(
        "shard",
        "turn",
        "sid",
        F.floor(F.col("turn") / F.col("blocks")).cast("long").alias("pass"),
        block_of("turn", "blocks", "sid").alias("block"),
    )
    return laid, pack_blocks(laid, block_words), placement


def words_taken(laid: DataFrame, pieces: DataFrame, placement: DataFrame) -> DataFrame:
    """``laid`` plus ``taken``: words of each document in the mix, repeats counted (0 where no block is taken)."""
    times = placement.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = pieces.join(times, ["sid", "block"]).groupBy("sid", "position").agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
    return laid.join(taken, ["sid", "position"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, laid: DataFrame, pieces: DataFrame, placement: DataFrame) -> DataFrame:
    """The columns doc_id, text, lang, source, n_chars of the mix: one row per document and pass with the words taken in it.

    Runs of words keep the spacing of the document; runs apart are joined by one newline.  Where all words are taken the text is
    unchanged.  Documents of which nothing is taken, and documents without words, are left out.
    """
    hashed = docs.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias("text_hash"))
    # Equal rows are laid one after another; each is told apart by its place among its equals.
    equals = W.partitionBy("doc_id", "text_hash")
    hashed = hashed.withColumn("__copy", F.row_number().over(equals.orderBy("source")))
    chosen = pieces.join(placement.select("sid", "pass", "block"), ["sid", "block"]).groupBy("sid", "position", "pass").agg(
        F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("runs")
    )
    keyed = laid.select("doc_id", "text_hash", "sid", "size", "position").withColumn("__copy", F.row_number().over(equals.orderBy("sid", "position")))
    chosen = keyed.join(chosen, ["sid", "position"]).select("doc_id", "text_hash", "__copy", "size", "pass", "runs")
    same = hashed["doc_id"].eqNullSafe(chosen["doc_id"]) & (hashed["text_hash"] == chosen["text_hash"]) & (hashed["__copy"] == chosen["__copy"])

    @F.pandas_udf("string")
    def cut(text: pd.Series, size: pd.Series, runs: pd.Series) -> pd.Series:
        import re

        word, out = re.compile(WORD), []
        for t, n, parts in zip(text, size, runs, strict=True):
            merged: list[list[int]] = []
            for r in parts:
                first, count = r["first_word"], r["n_words"]
                if merged and merged[-1][1] == first:
                    merged[-1][1] += count
                else:
                    merged.append([first, first + count])
            if merged == [[0, n]]:
                out.append(t)
                continue
            spans = [m.span() for m in word.finditer(t)]
            out.append("\n".join(t[spans[a][0] : spans[b - 1][1]] for a, b in merged))
        return pd.Series(out, dtype=object)

    joined = hashed.join(chosen, same).select(hashed["doc_id"], hashed["text"], hashed["lang"], hashed["source"], "size", "runs")
    cut_text = joined.withColumn("text", cut("text", "size", "runs"))
    return cut_text.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
