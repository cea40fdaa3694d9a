"""Rolling columns with minimum counts, on a base window of one ordered series."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def frame(w: WindowSpec, rows: int) -> WindowSpec:
    return w.rowsBetween(-(rows - 1), Window.currentRow)


def rolled(agg: Column, value: Column, w: WindowSpec, rows: int, least: int | None = None) -> Column:
    """``agg`` over the last ``rows`` rows, null unless ``least`` of them are non-null."""
    f = frame(w, rows)
    return F.when(F.count(value).over(f) >= (rows if least is None else least), agg.over(f))


def mean(value: Column, w: WindowSpec, rows: int, least: int | None = None) -> Column:
    return rolled(F.avg(value), value, w, rows, least)


def total(value: Column, w: WindowSpec, rows: int, least: int | None = None) -> Column:
    return rolled(F.sum(value), value, w, rows, least)


def highest(value: Column, w: WindowSpec, rows: int, least: int | None = None) -> Column:
    return rolled(F.max(value), value, w, rows, least)


def lowest(value: Column, w: WindowSpec, rows: int, least: int | None = None) -> Column:
    return rolled(F.min(value), value, w, rows, least)


def spread(value: Column, w: WindowSpec, rows: int, least: int | None = None) -> Column:
    """Sample standard deviation; null for a flat window, so that a z-score on it is null."""
    f = frame(w, rows)
    flat = F.max(value).over(f) == F.min(value).over(f)
    enough = F.count(value).over(f) >= (rows if least is None else least)
    return F.when(enough & ~flat, F.stddev_samp(value).over(f))


def quantile(value: Column, q: float, w: WindowSpec, rows: int, least: int | None = None) -> Column:
    """Exact, linearly interpolated quantile of a short frame."""
    return rolled(F.percentile(value, F.lit(q)), value, w, rows, least)


def zscore(value: Column, w: WindowSpec, rows: int, least: int | None = None) -> Column:
    return (value - mean(value, w, rows, least)) / spread(value, w, rows, least)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return a / F.nullif(b, F.lit(0.0))


def change(value: Column, w: WindowSpec, rows: int) -> Column:
    """Relative change against ``rows`` rows earlier."""
    return ratio(value, F.lag(value, rows).over(w)) - 1.0


def holds(condition: Column) -> Column:
    """Comparisons with nulls fail closed."""
    return F.coalesce(condition, F.lit(False))


def clip(value: Column, low: float, high: float) -> Column:
    """``value`` held between both bounds; null stays null, as least and greatest alone would pass the bound."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))
