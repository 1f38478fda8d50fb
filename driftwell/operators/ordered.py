"""Neighbour access and running totals along a series that may be far too long for one task.

A series is cut into chunks of its order column.  Windows run inside (key, chunk) partitions; one small row per chunk
carries the border values and totals to the next chunk.  A recording that holds a third of all samples is therefore
spread over as many tasks as it has chunks, and the result equals that of one window over the whole series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sequenced(
    df: DataFrame,
    keys: list[str],
    order: str,
    chunk: float,
    neighbours: list[str] | None = None,
    running: dict[str, Column] | None = None,
    tie: str | None = None,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Adds ``idx`` (zero-based position), ``prev_*`` / ``next_*`` of the named columns, and running totals.

    ``order`` must be numeric; ``tie`` makes the order total. ``carried`` has one row per series; its columns reach the rows
    with the borders of their chunk, so no join of samples is partitioned by series alone. Series it lacks drop out, as do
    rows without key or position.
    """
    cols, sums = neighbours or [], running or {}
    part = [*keys, "_chunk"]
    sort = [order] + ([tie] if tie else [])
    rank = F.struct(*sort)
    base = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)))
    d = base
    if sums:
        d = d.withColumns({f"_in_{n}": e for n, e in sums.items()})
    w = W.partitionBy(*part).orderBy(*sort)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumns(
        {
            "_rn": F.row_number().over(w),
            **{f"_lag_{c}": F.lag(c).over(w) for c in cols},
            **{f"_lead_{c}": F.lead(c).over(w) for c in cols},
            **{f"_cum_{n}": F.sum(f"_in_{n}").over(upto) for n in sums},
        }
    )
    border = F.struct(*cols) if cols else F.struct(F.lit(0).alias("none"))
    edges = base.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(border, rank).alias("_first"),
        F.max_by(border, rank).alias("_last"),
        *[F.sum(e).alias(f"_tot_{n}") for n, e in sums.items()],
    )
    along = W.partitionBy(*keys).orderBy("_chunk")
    before = along.rowsBetween(W.unboundedPreceding, -1)
    edges = edges.select(
        *part,
        F.col("_n").alias("_size"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.lag("_last").over(along).alias("_from"),
        F.lead("_first").over(along).alias("_to"),
        *[F.coalesce(F.sum(f"_tot_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in sums],
    )
    extra = []
    if carried is not None:
        edges = edges.join(carried, keys)
        extra = [c for c in carried.columns if c not in keys]
    joined = d.join(edges, part)
    out = {"idx": F.col("_offset") + F.col("_rn") - 1}
    for c in cols:
        out[f"prev_{c}"] = F.when(F.col("_rn") == 1, F.col(f"_from.{c}")).otherwise(F.col(f"_lag_{c}"))
        out[f"next_{c}"] = F.when(F.col("_rn") == F.col("_size"), F.col(f"_to.{c}")).otherwise(F.col(f"_lead_{c}"))
    for n in sums:
        out[n] = F.col(f"_base_{n}") + F.coalesce(F.col(f"_cum_{n}"), F.lit(0))
    return joined.select(*df.columns, *extra, *[e.alias(n) for n, e in out.items()])
