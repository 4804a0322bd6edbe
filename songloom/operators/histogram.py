"""Histograms of view counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.constants import VIEW_BINS, VIEW_CAP, VIEW_EDGES


def _counted(values: DataFrame, bin_no, edges: list[float]) -> DataFrame:
    """Counts per bin, empty bins included; numbers of no bin are outside the range."""
    # No filter on the number: it would put the whole expression into the scan's filter once more.
    counts = values.select(bin_no.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("songs"))
    bins = values.sparkSession.createDataFrame(
        [(i + 1, float(edges[i]), float(edges[i + 1])) for i in range(len(edges) - 1)],
        "bin int, left_edge double, right_edge double")
    return bins.join(counts, "bin", "left").fillna(0, ["songs"])


def histogram_edges(views: DataFrame, edges: list[float] | None = None, value: str = "views") -> DataFrame:
    """Counts between given edges: bins are closed on the left, the last one on both sides."""
    edges = list(edges if edges is not None else VIEW_EDGES)
    if any(e < 0 for e in edges):
        raise ValueError("bin edges must not be negative")
    if edges != sorted(edges):
        raise ValueError("bin edges must be in ascending order")
    v, last = F.col(value), len(edges) - 1
    # How many edges are not above the value; the last one counts if it is below, so the last bin ends with it.
    bin_no = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e, i: (e < v) | ((e == v) & (i < last))))
    return _counted(views, bin_no, edges)


def histogram_equal(views: DataFrame, cap: float = VIEW_CAP, bins: int = VIEW_BINS, value: str = "views") -> DataFrame:
    """Counts in equal bins from 0 to ``cap``; larger values are left out (see :func:`trimmed_count`)."""
    v = F.col(value)
    bin_no = F.when(v.between(0, cap), F.least(F.floor(v * bins / cap) + 1, F.lit(bins)).cast("int"))
    return _counted(views, bin_no, [cap * i / bins for i in range(bins + 1)])


def trimmed_count(views: DataFrame, cap: float = VIEW_CAP, value: str = "views") -> DataFrame:
    return views.agg(F.count_if(F.col(value) > cap).alias("trimmed"))
