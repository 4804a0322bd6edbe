"""Hard negatives against a plain version."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from check_results import compare, open_tables
from songloom.llm import negatives

SF = "/root/testdata/sf0.01"


def _plain(rows, positives=5, count=10):
    usable = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, label, [math.floor(256 * x) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = []
    for a in (r for r in usable if r[0] % 100 == 0):
        scored = [(b[1] == a[1], b[0], dot(a[2], b[2])) for b in usable]
        first = lambda s: (-s[2], s[1])
        for _, p, ps in sorted((s for s in scored if s[0] and s[1] != a[0]), key=first)[:positives]:
            found = sorted((s for s in scored if not s[0] and 30 * ps <= 100 * s[2] <= 90 * ps), key=first)
            out += [(a[0], p, k, s[1], ps, s[2]) for k, s in enumerate(found[:count], 1)]
    return sorted(out)


def _found(spark, rows, parts=3):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows],
                                  "vec_id long, label int, embedding array<double>, score string, anchor string")
    return sorted(tuple(r) for r in negatives.hard_negatives(frame.repartition(parts), F.col("id") % 100 == 0).collect())


def _clusters(n=900, seed=2, dims=12):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, dims))
    rows = []
    for i in range(n):
        v = middles[i % 6] + 0.1 * rng.normal(size=dims)
        rows.append((i, int(rng.integers(0, 4)), (v * rng.uniform(0.2, 2)).tolist()))
    return rows


def test_query_agrees_with_sql(spark):
    ok, said = compare(spark, open_tables(SF), SF, "op13_hard_negatives")
    assert ok, said


def test_clusters_ties_and_odd_rows(spark):
    rows = _clusters()
    rows += [(200, 1, rows[200][2]), (300, 2, rows[5][2]),            # ids twice: same and other vector
             *[(5000 + k, k % 4, rows[100][2]) for k in range(40)],    # copies: ties
             (None, 1, rows[0][2]), (6000, None, rows[0][2]), (6100, 1, None), (6200, 1, []), (6300, 1, [0.0] * 12),
             (6400, 2, [1.0, None] + [0.0] * 10), (6500, 2, [float("nan")] * 12), (6501, 2, [float("inf")] * 12),
             (6600, 3, rows[0][2][:5]), (6700, 3, rows[0][2] + [1.0, 2.0]), (6800, 0, [-x for x in rows[100][2]])]
    wanted = _plain(rows)
    assert len(wanted) > 100
    # Of two rows that share an id and a score either may come first, so compare what is returned.
    assert _found(spark, rows) == wanted


@pytest.mark.parametrize("scale", [2.0 ** 12, 2.0 ** 19])
def test_large_numbers_are_exact(spark, scale):
    rows = [(i, label, [x * scale for x in v]) for i, label, v in _clusters(250, dims=4)]
    assert _found(spark, rows) == _plain(rows)


def test_beyond_64_bits_is_an_error(spark):
    rows = [(0, 1, [1e16]), (1, 1, [1e16])]
    with pytest.raises(Exception, match="OverflowError"):
        _found(spark, rows, 1)


def test_no_rows(spark):
    assert _found(spark, []) == []
    assert _found(spark, [(0, 1, [1.0]), (1, 2, [1.0])]) == []  # no positives
    assert _found(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == []  # no anchors


def test_bounds_hold_and_rows_outside_the_windows_are_not_scored():
    rows = [r for r in _clusters(3000, seed=5)]
    whole = np.floor(256 * np.array([r[2] for r in rows])).astype(np.int64)
    references = negatives.directions(whole[:500])
    lengths, found = negatives.angles(whole, references)
    low, high = negatives.score_bounds(lengths[:50], found[:50], lengths, found, found)
    exact = whole[:50] @ whole.T
    assert (low <= exact).all() and (exact <= high).all()

    table = pa.table({"id": [r[0] for r in rows], "label": [r[1] for r in rows], "vector": [v.tobytes() for v in whole],
                      "length": lengths, "angles": [a.tobytes() for a in found], "anchor": list(range(len(rows)))})
    order = np.argsort(found.argmin(axis=1), kind="stable")
    search = negatives._Positives(table.slice(0, 60), 5)
    for a in range(0, len(rows), 500):
        search.add(negatives._Rows(table.take(order[a:a + 500])))
    assert 0 < search.scored < 0.3 * search.met
