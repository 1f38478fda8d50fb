"""Power spectra of evenly sampled series of any length by a four-step transform.

A series of ``size`` samples (a power of two) is laid out as a matrix of about its square root in both directions.  Its
columns are transformed, multiplied by the twiddle factors and regrouped as rows, which are transformed again.  Work is
size x log(size); a task holds one column or one block of rows, never a series.  A series of at most ``SINGLE`` samples
is one column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SINGLE = 4096  # longest column of a series that is not split
BLOCK = 1 << 16  # values per block of rows


def columns_of(size: Column, single: int = SINGLE) -> Column:
    """Number of columns of the matrix: 1 for a short series, else the square root of ``size`` or half of it."""
    root = F.pow(F.lit(2.0), F.floor(F.log2(size.cast("double")) / 2 + 1e-9))
    return F.when(size <= single, F.lit(1)).otherwise(root).cast("long")


def power_bins(
    series: DataFrame, keys: list[str], size: str, index: str, values: list[str], low: float, high: float, single: int = SINGLE, block: int = BLOCK
) -> DataFrame:
    """Squared magnitude of the transform of each column of ``values`` at the bins between ``low`` and ``high``.

    ``low`` and ``high`` are shares of the sampling rate, at most 0.5.  ``keys`` name a series and may hold columns that depend on it;
    ``size`` is one of them.  ``index`` counts from 0, absent positions are zero.  Returns keys, ``bin`` and one column per
    value.  A series without samples has no rows; a null value counts as zero.
    """
    schema = series.schema
    head = ", ".join(f"`{k}` {schema[k].dataType.simpleString()}" for k in keys)
    n2 = columns_of(F.col(size), single)
    i = F.col(index).cast("long")
    numbers = [F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values]
    samples = series.select(*keys, F.pmod(i, n2).alias("_n2"), F.floor(i / n2).cast("int").alias("_n1"), n2.alias("_cols"), *numbers)
    gathered = samples.groupBy(*keys, "_n2", "_cols").agg(F.collect_list(F.struct("_n1", *values)).alias("_a"))
    columns = gathered.select(*keys, "_n2", "_cols", F.col("_a._n1").alias("_at"), *[F.col(f"_a.{v}").alias(f"_v{j}") for j, v in enumerate(values)])

    def transform_columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            source, pieces = [], []
            arrays = zip(*[pdf[f"_v{j}"] for j in range(len(values))], strict=True)
            for r, (total, cols, col, at, data) in enumerate(zip(pdf[size], pdf["_cols"], pdf["_n2"], pdf["_at"], arrays, strict=True)):
                x = np.zeros((len(values), int(total) // cols))
                x[:, at] = data
                # Real input: rows above the middle are conjugates of those below.
                half = np.fft.rfft(x, axis=1)
                if col:
                    half *= np.exp(-2j * math.pi * col / total * np.arange(half.shape[1]))
                width = max(1, block // cols)
                for b, lo in enumerate(range(0, half.shape[1], width)):
                    source.append(r)
                    pieces.append((b, np.ascontiguousarray(half[:, lo : lo + width]).view(np.float64).ravel()))
            out = pdf[[*keys, "_n2", "_cols"]].iloc[source].reset_index(drop=True)
            yield out.assign(_block=[b for b, _ in pieces], _x=[x for _, x in pieces])

    pieces = columns.mapInPandas(transform_columns, f"{head}, _n2 long, _cols long, _block int, _x array<double>")
    # A block gathers one piece per column: at most ``block`` values, or one row of the matrix.
    rows = pieces.groupBy(*keys, "_cols", "_block").agg(F.collect_list(F.struct("_n2", "_x")).alias("_a"))
    rows = rows.select(*keys, "_cols", "_block", F.col("_a._n2").alias("_at"), F.flatten(F.col("_a._x")).alias("_x"))

    def transform_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for total, cols, number, at, flat in zip(*[pdf[c] for c in (size, "_cols", "_block", "_at", "_x")], strict=True):
                total = int(total)
                length = total // cols
                present = np.asarray(flat, dtype=np.float64).view(np.complex128).reshape(len(at), len(values), -1)
                x = np.zeros((cols, *present.shape[1:]), dtype=np.complex128)
                x[at] = present
                power = np.abs(np.fft.fft(x, axis=0)) ** 2
                k1 = number * max(1, block // cols) + np.arange(x.shape[2])
                bins = k1[None, :] + length * np.arange(cols)[:, None]
                mirrored = np.broadcast_to((k1 > 0) & (2 * k1 < length), bins.shape)
                lo, hi = math.ceil(low * total), math.floor(high * total)
                own = (bins >= lo) & (bins <= hi)
                other = mirrored & (total - bins >= lo) & (total - bins <= hi)
                found.append([np.r_[bins[own], total - bins[other]], *[np.r_[p[own], p[other]] for p in power.transpose(1, 0, 2)]])
            names = ["_bin", *[f"_p{j}" for j in range(len(values))]]
            yield pdf[keys].assign(**{name: [f[j] for f in found] for j, name in enumerate(names)})

    found = rows.mapInPandas(transform_rows, f"{head}, _bin array<long>, " + ", ".join(f"_p{j} array<double>" for j in range(len(values))))
    zipped = F.arrays_zip("_bin", *[f"_p{j}" for j in range(len(values))])
    return found.select(*keys, F.inline(zipped)).select(*keys, F.col("_bin").alias("bin"), *[F.col(f"_p{j}").alias(v) for j, v in enumerate(values)])
