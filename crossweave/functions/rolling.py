"""Row-count windows over one series.

A series (one instrument, one industry, one user) holds at most one row per
date, so its length is bounded by the calendar, not by the size of the data.
All frames of one :class:`Series` share partitioning and order: Spark plans one
exchange and one sort for them. :func:`by_blocks` takes windows of a known reach to
series without that bound.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .columns import col, safe_div
from .groups import fits_one_task, order_position

#: rows of one key of a panel, two tables together: one row per date and table, over a century of days
PANEL_ROWS = 100_000
#: rows of a block of a series that is too long for one task
BLOCK_ROWS = 100_000


class Series:
    def __init__(self, keys: Sequence[str] | str = "ts_code", order: Sequence[str] | str = "trade_date"):
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.order = [order] if isinstance(order, str) else list(order)

    @property
    def spec(self) -> WindowSpec:
        # built on use: a window needs a running session, importing this module does not
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def frame(self, start: int, end: int = 0) -> WindowSpec:
        return self.spec.rowsBetween(start, end)

    @property
    def so_far(self) -> WindowSpec:
        return self.spec.rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, x, n: int = 1) -> Column:
        return F.lag(col(x), n).over(self.spec)

    def lead(self, x, n: int = 1) -> Column:
        return F.lead(col(x), n).over(self.spec)

    def roll(self, fn, x, n: int, m: int | None = None) -> Column:
        """``fn`` over the last ``n`` rows, null unless ``m`` of them hold a value."""
        m = n if m is None else m
        w = self.frame(-(n - 1))
        return F.when(F.count(col(x)).over(w) >= m, fn(col(x)).over(w))

    def mean(self, x, n, m=None):
        return self.roll(F.avg, x, n, m)

    def sum(self, x, n, m=None):
        return self.roll(F.sum, x, n, m)

    def std(self, x, n, m=None):
        # one value has no sample deviation
        return self.roll(F.stddev_samp, x, n, max(2, n if m is None else m))

    def max(self, x, n, m=None):
        return self.roll(F.max, x, n, m)

    def min(self, x, n, m=None):
        return self.roll(F.min, x, n, m)

    def median(self, x, n, m=None):
        return self.roll(lambda c: F.percentile(c, F.lit(0.5)), x, n, m)

    def pct_change(self, x, n: int = 1) -> Column:
        return safe_div(x, self.lag(x, n)) - 1

    def cumsum(self, x) -> Column:
        """Running sum: null at a null input, the sum is carried past it."""
        return F.when(col(x).isNotNull(), F.sum(col(x)).over(self.so_far))

    def corr(self, x, y, n: int, m: int | None = None) -> Column:
        """Pairwise-complete rolling correlation; null if one side is constant."""
        m = n if m is None else m
        w = self.frame(-(n - 1))
        return pair_corr(x, y, m, w)


def pair_corr(x, y, m: int = 2, w: WindowSpec | None = None) -> Column:
    """Pairwise-complete Pearson correlation as an aggregate, or over ``w``.

    Null below ``m`` pairs or if one side is constant (its running deviation is then
    exactly zero). Built from covariance and deviations: the built-in raises on a
    constant side under ANSI mode.
    """
    over = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    both = col(x).isNotNull() & col(y).isNotNull()
    px, py = F.when(both, col(x)), F.when(both, col(y))
    spread = over(F.stddev_pop(px)) * over(F.stddev_pop(py))
    return F.when(over(F.count(px)) >= m, safe_div(over(F.covar_pop(px, py)), spread))


def corrected_skew(n, lo, hi, skew) -> Column:
    """Bias-corrected skewness from count, bounds and population skewness; null below three values or without spread."""
    n = col(n).cast("double")
    return F.when((n >= 3) & (col(hi) > col(lo)), col(skew) * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(n, lo, hi, kurtosis) -> Column:
    """Bias-corrected excess kurtosis from count, bounds and population kurtosis; null below four values or without spread."""
    n = col(n).cast("double")
    return F.when((n >= 4) & (col(hi) > col(lo)), ((n + 1) * col(kurtosis) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def unbiased_skew(x: Column, w: WindowSpec | None = None) -> Column:
    """Bias-corrected sample skewness; null below three values or without spread."""
    over = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    return corrected_skew(over(F.count(x)), over(F.min(x)), over(F.max(x)), over(F.skewness(x)))


def unbiased_kurtosis(x: Column, w: WindowSpec | None = None) -> Column:
    """Bias-corrected excess kurtosis; null below four values or without spread."""
    over = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    return corrected_kurtosis(over(F.count(x)), over(F.min(x)), over(F.max(x)), over(F.kurtosis(x)))


def streak(df, cond: Column, out: str, keys="ts_code", order="trade_date"):
    """Length of the current run of true rows, 0 on a false row (null counts as false)."""
    s = Series(keys, order)
    n = F.row_number().over(s.spec)
    df = df.withColumns({"_n": n, "_hit": F.coalesce(cond, F.lit(False))})
    missed = F.max(F.when(~F.col("_hit"), F.col("_n"))).over(s.so_far)
    return df.withColumn(out, (F.col("_n") - F.coalesce(missed, F.lit(0))).cast("double")).drop("_n", "_hit")


def by_blocks(
    df: DataFrame,
    add: Callable[[DataFrame], DataFrame],
    reach: int,
    ahead: int = 0,
    key: str = "ts_code",
    order: Sequence[str] | str = "trade_date",
    series_rows: int | None = None,
    limit: int | None = None,
    block_rows: int = BLOCK_ROWS,
    slice_rows: int | None = None,
) -> DataFrame:
    """``add(df)`` for series of any length: a function that adds columns by row windows over ``key`` and ``order``.

    ``add`` looks back at most ``reach`` rows and forward at most ``ahead``, keeps all other columns, and uses the key for nothing
    but its windows. ``series_rows`` bounds the rows of one key (``None``: measured). Beyond one task the rows are numbered by range
    slices and cut into blocks; each block also receives the last ``reach`` rows of the block before it and the first
    ``ahead`` of the next, so a hot key spreads over as many tasks as it has blocks. ``order`` must be a total order of a key's rows.
    """
    if fits_one_task(df, key, series_rows, limit):
        return add(df)
    size = max(block_rows, reach, ahead, 1)
    order = [order] if isinstance(order, str) else list(order)
    placed = order_position(df, key, order, "_place", group_rows=1, limit=0, slice_rows=slice_rows)
    own, inside = F.floor((F.col("_place") - 1) / size), (F.col("_place") - 1) % size
    sent = F.array(
        F.struct(own.alias("block"), F.lit(True).alias("own")),
        F.when(inside >= size - reach, F.struct((own + 1).alias("block"), F.lit(False).alias("own"))),
        F.when((inside < ahead) & (own > 0), F.struct((own - 1).alias("block"), F.lit(False).alias("own"))),
    )
    copies = placed.withColumn("_to", F.explode(F.filter(sent, lambda s: s.isNotNull()))).drop("_place")
    # windows by the key become windows by key and block
    blocks = copies.withColumn(key, F.struct(F.col(key).alias("key"), F.col("_to.block").alias("block"))).withColumn("_own", F.col("_to.own")).drop("_to")
    return add(blocks).where("_own").withColumn(key, F.col(key)["key"]).drop("_own")
