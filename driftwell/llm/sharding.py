"""Sharding by a keyed permutation of global row numbers.

Rows are numbered in a total order without a single-task sort; a Feistel permutation with cycle walking moves row r to
place p(r); shard = p mod n and slot = p div n.  The order depends on the seed alone, shard sizes differ by one row at
most, and shard and slot of any row number (and back) are computed without a lookup.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import running_total
from driftwell.llm.feistel import permute


def locate(row: np.ndarray, rows: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of row numbers."""
    place = permute(row, rows, seed)
    return place % shards, place // shards


def row_at(shard: np.ndarray, slot: np.ndarray, rows: int, shards: int, seed: int) -> np.ndarray:
    """Row numbers that lie at (shard, slot): the inverse of ``locate``."""
    return permute(np.asarray(slot) * shards + np.asarray(shard), rows, seed, inverse=True)


def assign_shards(df: DataFrame, order: Sequence[str], shards: int = 24, seed: int = 20240501) -> DataFrame:
    """All columns of ``df`` plus ``row_number``, ``shard`` and ``slot`` (input columns of these names are replaced).

    Row numbers follow ``order``, nulls first.  Rows equal in ``order`` may swap numbers, so include every column that
    tells rows apart.  Repeated rows each get a place of their own.  An empty table gives an empty result.
    """
    clean = df.drop("row_number", "shard", "slot", "before", "position")
    order = [c for c in order if c in clean.columns]
    # The last key spreads equal rows over range partitions; which of them gets which number makes no difference.
    spread = clean.withColumns({"__one": F.lit(1), "__tie": F.monotonically_increasing_id()})
    numbered = running_total(spread, [], [*order, "__tie"], "__one")
    rows = clean.count()

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), rows, seed))

    return (
        numbered.withColumnRenamed("position", "row_number")
        .withColumn("__place", place("row_number"))
        .withColumn("shard", (F.col("__place") % shards).cast("int"))
        .withColumn("slot", F.floor(F.col("__place") / F.lit(shards)).cast("long"))
        .drop("__one", "__tie", "__place", "before")
    )


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard, each file sorted by slot; replaying a write gives the same folders."""
    assigned.repartition("shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
