"""Exact order statistics per group from pre-aggregated value counts.

``value_counts`` shuffles on (keys, value), so a group that holds a third of all rows is spread over all tasks and
combined map-side first.  ``ranked`` then runs streaming, spillable windows over the *distinct* values.  A group of more than
``HOT`` of them is cut at its own quantiles into ``BLOCKS`` blocks that are ranked by different tasks and connected by prefix
sums over block totals.  No group is gathered into an array.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwell.functions.numeric import exact_sum, finite

#: Distinct values of a group that one task may rank, and blocks of a larger group.
HOT, BLOCKS, COARSE = 100_000, 256, 16


def value_counts(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    return (
        df.select(*keys, finite(value).alias("v"))
        .where(F.col("v").isNotNull())
        .groupBy(*keys, "v")
        .agg(F.count(F.lit(1)).alias("c"))
    )


def at_rank(rank: Column) -> Column:
    """Aggregate: value at a zero-based rank (needs the columns of ``ranked``)."""
    return F.min(F.when(F.col("cum") > rank, F.col("v")))


def _same(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> Column:
    """Null-safe equality of ``keys`` with the columns ``names`` of another frame; true without keys."""
    return reduce(lambda a, b: a & b, [df[k].eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)], F.lit(True))


def in_blocks(rows: DataFrame, keys: Sequence[str], value: str, totals: dict[str, Column] | None = None, hot: int = HOT) -> DataFrame:
    """``rows`` (keys, value and counts, one per keys and value) with ``block`` and, in groups of more than ``hot`` rows, the aggregates ``totals``.

    Other groups are block 0 and have null totals.  Cuts are approximate quantiles of the group's own values, so a block holds
    about a ``BLOCKS``-th of its rows however close together they lie.  Where no group is that large, adaptive execution finds
    the tables of cuts empty and drops their joins.  A value is placed by two short searches, among every sixteenth cut first.
    """
    totals = totals or {}
    names = [f"__{k}" for k in keys]
    fractions = [i / BLOCKS for i in range(1, BLOCKS)]
    # Every branch reads all columns of ``rows``, if only to add them up: all then share one exchange below.
    counts = [c for c in rows.columns if c not in keys and c != value]
    found = {"__size": F.count(F.lit(1)), **{f"__total_{c}": F.sum(c) for c in counts}}
    crowded = reduce(lambda a, c: a & (F.col(f"__total_{c}") >= 0), counts, F.col("__size") > hot)
    cut = {**found, "__cuts": F.percentile_approx(value, fractions, 10_000), **totals}
    renamed = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    if keys:
        sizes = rows.groupBy(*renamed).agg(*(c.alias(n) for n, c in found.items())).where(crowded)
        large = rows.join(sizes, _same(rows, keys, names), "left_semi")
        cuts = large.groupBy(*renamed).agg(*(c.alias(n) for n, c in cut.items())).where(crowded)
    else:
        cuts = F.broadcast(rows.agg(*(c.alias(n) for n, c in cut.items())).where(crowded))  # one row
    cuts = cuts.withColumn("__coarse", F.filter("__cuts", lambda c, i: i % COARSE == COARSE - 1))
    joined = rows.join(cuts, _same(rows, keys, names), "left")
    coarse = F.size(F.filter("__coarse", lambda c: c <= F.col(value)))
    near = F.slice("__cuts", coarse * COARSE + 1, F.lit(COARSE))
    block = F.when(F.col("__cuts").isNotNull(), coarse * COARSE + F.size(F.filter(near, lambda c: c <= F.col(value)))).otherwise(0)
    return joined.select(*rows.columns, block.alias("block"), *totals)


def ranked(counts: DataFrame, keys: Sequence[str], hot: int = HOT) -> DataFrame:
    """Running count (``cum``), size (``n``) and value sum (``sum``) of each group.

    The frames of a block share one partitioning and one order, so they are a single window operator over a single sort.
    """
    whole_group = {"__n": F.sum("c"), "__sum": exact_sum(F.col("v") * F.col("c"))}
    tagged = in_blocks(counts, keys, "v", whole_group, hot)
    names = [f"__{k}" for k in keys]
    held = tagged.where("__n is not null").groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("block").alias("__block"))
    along = W.partitionBy(*names, *([] if keys else [F.lit(0)])).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    before = held.agg(F.sum("c").alias("__held")).withColumn("__before", F.coalesce(F.sum("__held").over(along), F.lit(0))).drop("__held")
    tagged = tagged.join(before, _same(tagged, keys, names) & (tagged["block"] == F.col("__block")), "left")
    ordered = W.partitionBy(*keys, "block").orderBy("v")
    whole = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return tagged.select(
        *counts.columns,
        (F.coalesce("__before", F.lit(0)) + F.sum("c").over(ordered.rowsBetween(W.unboundedPreceding, 0))).alias("cum"),
        F.coalesce(F.col("__n"), F.sum("c").over(whole)).alias("n"),
        F.coalesce(F.col("__sum"), exact_sum(F.col("v") * F.col("c"), whole)).alias("sum"),
    )


def middle(lo_rank: Column, size: Column) -> Column:
    """Aggregate: median of the ``size`` values that start at ``lo_rank``."""
    a = at_rank(lo_rank + F.floor((size - 1) / 2))
    b = at_rank(lo_rank + F.floor(size / 2))
    return F.when(F.max(size) > 0, (a + b) / F.lit(2.0))


def median_expr() -> Column:
    return middle(F.lit(0), F.col("n"))


def hinge_quartiles() -> tuple[Column, Column]:
    """Aggregates: medians of the lower and of the upper half; an odd middle value belongs to neither."""
    half = F.floor(F.col("n") / 2)
    return middle(F.lit(0), half), middle(F.col("n") - half, half)


def global_median(df: DataFrame, value: Column, blocks: int = 256) -> DataFrame:
    """One-row median of a whole column without sorting it in one task.

    Distinct values are folded into ``blocks`` ranges cut at approximate quantiles, so a block holds about a ``blocks``-th of
    the rows whatever their distribution; only the (at most two) blocks that hold a middle rank are ranked, and the prefix
    sum runs over the block totals alone.
    """
    counts = value_counts(df, [], value)
    cuts = counts.agg(F.percentile_approx("v", [i / blocks for i in range(1, blocks)], 10_000).alias("cuts")).first()["cuts"] or []
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    counts = counts.withColumn("block", F.size(F.filter(edges, lambda c: c <= F.col("v"))))
    whole = W.partitionBy(F.lit(0))
    lo, hi = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    prefix = (
        counts.groupBy("block")
        .agg(F.sum("c").alias("in_block"))
        .withColumns(
            {
                "upto": F.sum("in_block").over(whole.orderBy("block").rowsBetween(W.unboundedPreceding, 0)),
                "n": F.sum("in_block").over(whole),
            }
        )
        .withColumn("before", F.col("upto") - F.col("in_block"))
        .where(
            ((F.col("before") <= lo) & (F.col("upto") > lo)) | ((F.col("before") <= hi) & (F.col("upto") > hi))
        )
    )
    opened = counts.join(F.broadcast(prefix), "block")  # two rows at most
    running = F.sum("c").over(W.partitionBy("block").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    opened = opened.withColumn("cum", F.col("before") + running)
    return opened.agg(((at_rank(lo) + at_rank(hi)) / F.lit(2.0)).alias("median"))
