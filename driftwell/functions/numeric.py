"""Column expressions for the four-decimal arithmetic used by every operator.

Values stay doubles: ranks, medians and quartiles need nothing else.  Sums go through ``exact_sum``, whose decimal
arithmetic does not depend on the order in which tasks finish, so a retried or re-partitioned job returns the same bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def round_half_away(x: Column, digits: int) -> Column:
    """Half-away-from-zero rounding without the BigDecimal detour that ``round`` takes on doubles.

    A value of 2^53 or more units has no such digits and is returned as it is.
    """
    scale = F.lit(float(10**digits))
    magnitude = F.floor(F.abs(x) * scale + F.lit(0.5))
    rounded = F.when(x < 0, -magnitude).otherwise(magnitude) / scale
    return F.when(F.abs(x) * scale >= F.lit(float(2**53)), x.cast("double")).otherwise(rounded)


def round4(x: Column) -> Column:
    return round_half_away(x, 4)


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    d = x.cast("double")
    return F.when(F.abs(d) < F.lit(float("inf")), d)


def exact_sum(v: Column, over: WindowSpec | None = None) -> Column:
    """Sum (or window sum) of doubles in decimal arithmetic with 12 fractional digits, as a double.

    Groups whose largest magnitude lies outside [0.001, 1e14), where 12 digits would cut or overflow, are summed as doubles.
    """

    def scoped(c: Column) -> Column:
        return c if over is None else c.over(over)

    largest = scoped(F.max(F.abs(v)))
    exact = scoped(F.try_sum(v.try_cast("decimal(38,12)"))).cast("double")
    return F.when((largest >= 1e-3) & (largest < 1e14), exact).otherwise(scoped(F.sum(v)))


def clamp(x: Column, lo: float, hi: float) -> Column:
    """Null stays null; ``least``/``greatest`` alone would turn it into a bound."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def reasons(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the messages whose condition holds; an empty array means accepted."""
    items = [F.when(cond, F.lit(msg) if isinstance(msg, str) else msg) for cond, msg in pairs]
    return F.array_compact(F.array(*items))


def first_present(df_columns: list[str], candidates: list[str], dtype: str = "double") -> Column:
    """First non-null value of the candidate columns that exist in the frame."""
    found = [F.col(f"`{c}`").try_cast(dtype) for c in candidates if c in df_columns]
    return F.coalesce(*found) if found else F.lit(None).cast(dtype)


def null_safe_sum(cols: list[Column]) -> Column:
    """Row-wise sum that is null only when every input is null."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    return F.when(F.coalesce(*cols).isNotNull(), total)


# ---- order statistics over a sorted array -------------------------------------------------------

def _at(arr: Column, index: Column) -> Column:
    return F.get(arr, index.cast("int"))


def sorted_median(arr: Column) -> Column:
    """Median of an ascending array."""
    n = F.size(arr)
    lo, hi = F.floor((n - 1) / 2), F.floor(n / 2)
    return (_at(arr, lo) + _at(arr, hi)) / F.lit(2.0)


def sorted_quantile(arr: Column, q: float) -> Column:
    """Linear-interpolation quantile of an ascending array."""
    pos = (F.size(arr) - 1) * F.lit(q)
    lo, hi = F.floor(pos), F.ceil(pos)
    low = _at(arr, lo).cast("double")
    return low + (pos - lo) * (_at(arr, hi) - low)
