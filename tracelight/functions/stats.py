"""Statistics of evaluation logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.96


def wilson(k: Column, n: Column, z: float = Z95, scale: float = 1.0) -> Column:
    """struct(low, high): the Wilson score interval of k successes in n, (0, 0) for n = 0; ``scale`` 100 gives percent."""
    k, n = k.cast("double"), n.cast("double")
    size = F.nullif(n, F.lit(0.0))
    p = k / size
    bottom = 1 + z * z / size
    centre = p + z * z / (2 * size)
    half = z * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size))
    low, high = F.greatest(F.lit(0.0), (centre - half) / bottom), F.least(F.lit(1.0), (centre + half) / bottom)
    some = lambda x: F.when(n > 0, x * scale).otherwise(F.lit(0.0))
    return F.struct(some(low).alias("low"), some(high).alias("high"))


def safe_corr(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson's correlation over rows where both are known; NULL for fewer than ``least`` or a constant side.

    A side is constant when its least and greatest values are equal: the deviation of a constant, added up over partitions, need not be 0.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when((F.count(F.when(both, 1)) >= least) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), r)


def bucketize(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the first edge that the value is below, the last label beyond all edges, 'unknown' for NULL."""
    out = F.lit(labels[len(edges)])
    for edge, label in reversed(list(zip(edges, labels, strict=False))):
        out = F.when(value < F.lit(edge), F.lit(label)).otherwise(out)
    return F.when(value.isNull(), F.lit("unknown")).otherwise(out)


def tercile_label(value: Column, low: Column, high: Column) -> Column:
    return F.when(value <= low, F.lit("low")).when(value <= high, F.lit("mid")).otherwise(F.lit("high"))


def psnr(mse: Column, peak: float = 255.0) -> Column:
    """Peak signal-to-noise ratio in dB; infinite for no error."""
    return F.when(mse <= 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(peak * peak) / mse))
