"""Centroid clustering against plain rounds over all centroids."""

import hashlib
import math
import random

import numpy as np
import pytest

from sievework.llm import clustering as C


def plain(rows, k, rounds, dim, salt="3"):
    """rows (vec_id, vector): a sorted list of (vec_id, cluster, distance), and the centroids."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"{salt}:{i}".encode()).hexdigest())
    cents = [v for _, v in sorted(kept, key=lambda r: name(r[0]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(col) // len(groups[n]) for col in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(cents)]
    return sorted(((i is None, i or 0, *near(v)[::-1]) for i, v in kept)), cents


def run(spark, rows, k, rounds, dim, nearest=3):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    out, cents, work = C.drake(df, k, rounds, dim, nearest=nearest)
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in out.collect()), cents.tolist(), work


@pytest.mark.parametrize("seed, k, nearest, spread", [(1, 8, 3, 1.0), (2, 20, 5, 0.05), (3, 3, 3, 0.002), (4, 1, 3, 1.0), (5, 8, 2, 90000.0)])
def test_against_plain_rounds(spark, seed, k, nearest, spread):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(6)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.3 * spread) for x in rng.choice(centres)]) for i in range(300)]
    rows = [(i, [max(-131072.0, min(131072.0, x)) for x in v]) for i, v in rows]
    rows += [(None, rows[0][1]), (1000, rows[1][1]), (1001, None), (1002, []), (1003, [1.0] * 5), (1004, [1.0, None] * 3), (1005, [math.nan] * 6), (1006, [math.inf] * 6), (1007, [0.0] * 6)]
    got, cents, work = run(spark, rows, k, 6, 6, nearest)
    want, plain_cents = plain(rows, k, 6, 6)
    assert cents == plain_cents and got == want
    if k == 20:
        assert sum(work[1:]) < 0.75 * 6 * k * len(want)  # bounds spare distances


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 5), float(i // 5 % 5)]) for i in range(100)]
    got, cents, _ = run(spark, rows, 4, 5, 2)
    want, plain_cents = plain(rows, 4, 5, 2)
    assert got == want and cents == plain_cents


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    assert run(spark, rows, 8, 3, 2)[:2] == plain(rows, 8, 3, 2)
    assert run(spark, [(1, None)], 8, 3, 2)[0] == []


def test_too_large_components_count_as_infinite(spark):
    rows = [(1, [1e30, 2.0]), (2, [3.0, 4.0]), (3, [131072.0, 0.0])]
    assert [r[1] for r in run(spark, rows, 2, 1, 2)[0]] == [2, 3]


def test_bounds_never_decide_wrongly():
    rng = np.random.default_rng(7)
    x = rng.integers(-40, 40, (500, 4))
    cents = rng.integers(-40, 40, (12, 4))
    state, bounds = C.scan(x, cents, 4), 4
    for step in range(30):
        new = cents + rng.integers(-3, 4, cents.shape) * (rng.random((12, 1)) < 0.4)
        moves = np.sqrt(((new - cents) ** 2).sum(1)) * (1 + C.MARGIN)
        cents, wanted = new, max(2, bounds - (step % 9 == 8))
        state, _, _ = C.advance(x, state, cents, moves, wanted)
        bounds = wanted
        d = ((x[:, None, :] - cents[None]) ** 2).sum(2)
        assert (state.cluster == d.argmin(1)).all()
        assert (state.upper >= np.sqrt(d.min(1)) * (1 - 1e-9)).all()
        for i in range(len(x)):
            for z in range(bounds + 1):
                others = set(range(12)) - {state.cluster[i]} - set(state.near[i, :z])
                assert state.low[i, z] <= math.sqrt(min(d[i, c] for c in others)) * (1 + 1e-9) + 1e-9


def test_packed_widths():
    import pyarrow as pa

    xs = [np.array([[1, -2], [3, 4]]), np.array([[1 << 20, 5]]), np.array([[1 << 40, -7]])]
    column = pa.concat_arrays([C._pack(x) for x in xs])
    assert (C._unpack(column, 2) == np.concatenate(xs)).all() and (C._unpack(column.slice(1, 2), 2) == np.concatenate(xs)[1:3]).all()
