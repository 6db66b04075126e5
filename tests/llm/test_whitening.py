"""Whitening against numpy on all rows at once, with exact whole numbers."""

import math

import numpy as np
import pytest

from formpulse.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, block string, at int, matrix string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "b", 1, "m", "k") for i, v in rows], SCHEMA)


def usable(rows):
    fine = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    size = max((len(v) for _, v in fine), key=lambda s: (sum(len(v) == s for _, v in fine), s))
    return [(i, v) for i, v in fine if len(v) == size]


def expected(rows):
    """Keys, exact deviations, and the covariance of all usable rows."""
    rows = usable(rows)
    x = np.floor(np.array([np.float32(v) for _, v in rows], dtype=np.float64) * 64).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    exact = n * x - sums
    centred = exact / n
    return rows, exact, centred, centred.T @ centred / n


def vectors(n, size, seed=1, rank=None):
    pick = np.random.default_rng(seed)
    mix = pick.normal(size=(rank or size, size))
    return [(i, [float(v) for v in row]) for i, row in enumerate((pick.normal(size=(n, rank or size)) @ mix + 3).astype(np.float32))]


def check(out, rows, components=32):
    kept, exact, centred, v = expected(rows)
    values = np.linalg.eigvalsh(v)[::-1]
    width = min(components, v.shape[0])
    got = {}
    for r in out:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert len(out) == width * len(kept) and sorted(got) == sorted({i for i, _ in kept})
    z = np.zeros((len(kept), width))
    for row, (i, _) in enumerate(kept):
        for k in range(width):
            r = got[i][k + 1]
            assert r.n == len(kept) and r.deviation == int((exact[row].astype(object) ** 2).sum())
            assert abs(r.explained - values[k] / values.sum()) <= 1e-4 * values[k] / values.sum() + 1e-12
            z[row, k] = r.whitened
    assert np.abs(z.T @ z / len(kept) - np.eye(width)).max() < 1e-9
    # Same rows up to the sign of each component: projecting back gives the centred rows.
    vec = v @ (centred.T @ z / len(kept)) / values[:width]
    assert np.abs(np.abs((centred.T @ z / len(kept)) / np.sqrt(values[:width])) - np.abs(vec / np.sqrt(values[:width]))).max() < 1e-8
    return z


def run(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = whitening.op11_whitening(spark, str(tmp_path))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return out.collect()


@pytest.mark.parametrize("size", [3, 40])
def test_many_blocks(spark, tmp_path, monkeypatch, size):
    """More than one block, a partly filled last one, and rows that are left out."""
    monkeypatch.setattr(whitening, "ROWS", 32)
    rows = vectors(333, size)
    rows += [(1000, None), (1001, []), (1002, [None] * size), (1003, [float("nan")] * size), (1004, [float("inf")] * size),
             (1005, [1.0] * (size + 1)), (1006, [0.5] * size), (1007, [0.5] * size)]
    out = run(spark, tmp_path, rows)
    check(out, rows)
    assert {r.identity_error for r in out if r.identity_error < 1e-9} == {r.identity_error for r in out}
    assert len({r.identity_error for r in out}) == 1
    assert whitening.whiten(spark.read.parquet(str(tmp_path / "embeddings.parquet")))[1].n == 335


def test_projection_on_eigenvectors(spark, monkeypatch):
    """The whitened rows are the centred rows times the unit vectors over the roots, in one sign."""
    monkeypatch.setattr(whitening, "ROWS", 16)
    rows = vectors(100, 6, seed=4)
    out, fit = whitening.whiten(frame(spark, rows), components=4)
    _, exact, centred, v = expected(rows)
    assert np.allclose(v @ fit.vectors, fit.vectors * fit.values) and np.allclose(fit.vectors.T @ fit.vectors, np.eye(6))
    z = centred @ fit.vectors[:, :4] / np.sqrt(fit.values[:4])
    for r in out.collect():
        assert np.allclose(r.whitened, z[r.vec_id], atol=1e-9) and r.deviation == int((exact[r.vec_id] ** 2).sum())


def test_missing_rank(spark, tmp_path):
    """Equal and dependent dimensions: components without variance have no whitened value."""
    rows = [(i, [a, a, 1.0, b]) for i, (a, b) in enumerate((float(i % 7), float(i % 5)) for i in range(70))]
    out = run(spark, tmp_path, rows)
    by = {k: [r for r in out if r.component == k] for k in (1, 2, 3, 4)}
    assert all(r.whitened is not None for k in (1, 2) for r in by[k]) and all(r.whitened is None for k in (3, 4) for r in by[k])
    assert all(r.identity_error < 1e-9 for r in out) and all(abs(r.explained) < 1e-9 for r in by[3] + by[4])


@pytest.mark.parametrize("rows", [[(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])]])
def test_no_variance(spark, tmp_path, rows):
    out = run(spark, tmp_path, rows)
    assert len(out) == 2 * len(rows)
    assert all((r.deviation, r.whitened, r.explained, r.identity_error) == (0, None, None, None) for r in out)


def test_large_values(spark, tmp_path):
    """Deviations beyond long are null, others exact."""
    rows = [(i, [float(2 ** 33) * (i % 2), float(i)]) for i in range(40)]
    out = run(spark, tmp_path, rows)
    assert all(r.deviation is None for r in out) and all(r.identity_error < 1e-4 for r in out)


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    out, fit = whitening.whiten(frame(spark, [(1, None), (2, [float("nan")])]))
    assert out.collect() == [] and fit is None
