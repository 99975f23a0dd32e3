"""Column expressions shared by all metrics.  Undefined values are NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NULL for NaN and infinities."""
    d = col(c).cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def ratio(n: Column | str, d: Column | str, default: float | None = None) -> Column:
    """n / d, or the default where d is 0 or either is NULL."""
    value = F.try_divide(col(n).cast("double"), col(d).cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def precision_recall_f1(tp, fp, fn, default: float | None = 0.0) -> tuple[Column, Column, Column]:
    """With a default (vector tiles) an undefined share is that default; without one it is NULL, and so is F1 when P + R = 0."""
    tp, fp, fn = col(tp), col(fp), col(fn)
    p, r = ratio(tp, tp + fp, default), ratio(tp, tp + fn, default)
    return p, r, ratio(2 * p * r, p + r, default)


#: Edges and labels of footprint sizes in square metres.
SIZE_EDGES = (0.0, 25.0, 50.0, 100.0, 500.0, 1000.0, float("inf"))
SIZE_LABELS = ("<25", "25-50", "50-100", "100-500", "500-1000", ">1000")


def right_closed_bin(value, edges: Sequence[float] = SIZE_EDGES, labels: Sequence[str] = SIZE_LABELS) -> Column:
    """Label of the bin (lo, hi]; the first bin holds its lower edge too; NULL outside."""
    v = col(value)
    out = F.when(v < edges[0], F.lit(None))
    for hi, label in zip(edges[1:], labels, strict=True):
        out = out.when(v <= hi, F.lit(label)) if hi != float("inf") else out.when(v.isNotNull(), F.lit(label))
    return out


def mean_dropping_missing(value, weight) -> Column:
    """Aggregate: sum(v w) / sum(w) over rows where both are finite; NULL where the weights sum to 0 or less."""
    v, w = finite(value), finite(weight)
    total = F.sum(F.when(v.isNotNull(), w))
    return F.when(total > 0, F.sum(v * w) / total)


def mean_missing_as_zero(value, weight) -> Column:
    """Aggregate: a missing value counts as 0 with its whole weight; NULL where the weights sum to 0 or less."""
    v, w = F.coalesce(finite(value), F.lit(0.0)), F.coalesce(finite(weight), F.lit(0.0))
    total = F.sum(w)
    return F.when(total > 0, F.sum(v * w) / total)


def quantile(value, q: float, default: float | None = None) -> Column:
    """Aggregate: exact quantile, linear between ranks."""
    out = F.percentile(col(value), F.lit(q))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


#: Density classes of buildings per square kilometre.
DENSITY_LOW, DENSITY_HIGH = 100, 1500


def density_class(value) -> Column:
    v = col(value)
    return F.when(v == 0, "none").when(v < DENSITY_LOW, "low").when(v <= DENSITY_HIGH, "medium").otherwise("high")


def marker_radius(count) -> Column:
    """Radius of a map marker, growing with the root of a count."""
    return F.least(6 + F.sqrt(F.greatest(col(count).cast("double"), F.lit(0.0))) * 3.5, F.lit(28.0))


def rounded(c, places: int = 4) -> Column:
    return F.round(col(c).cast("double"), places)
