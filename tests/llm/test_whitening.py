import numpy as np
import pytest

from stayline.llm import whitening

INF, NAN = float("inf"), float("nan")


def brute(vectors, components=4):
    """Rows (n, deviation, whitened, explained) by vector, from whole numbers and numpy's eigenvectors."""
    x = [[int(np.floor(256 * float(c))) for c in v] for v in vectors]
    fit = np.array(sorted({tuple(r) for r in x}), np.int64)
    n, s = len(fit), [int(c) for c in fit.sum(0)]
    centred = fit - np.array([c / n for c in s])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    z = (np.array(x) - np.array([c / n for c in s])) @ axes / np.sqrt(values)
    deviation = [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviation, z, values / np.trace(centred.T @ centred / n)


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, component string, n int").repartition(3)


@pytest.mark.parametrize("seed", range(8))
def test_inertia_counts(seed):
    r = np.random.default_rng(seed)
    m = r.standard_normal((30, 30))
    m = m + m.T
    if seed % 2:
        m[:, 5] = m[5] = 0.0
        np.fill_diagonal(m, 0.0)  # zero pivots: pairs are needed
    values = np.linalg.eigvalsh(m)
    for shift in [-20.0, *((values[:-1] + values[1:]) / 2), 20.0]:
        if np.abs(values - shift).min() > 1e-9:
            assert whitening.above(m, shift) == (values > shift).sum()


@pytest.mark.parametrize("spectrum", [[9, 5, 4, 3, 1, 0.5], [4, 4, 4, 4, 4, 1], [7, 7 - 1e-9, 2, 2, 1, 0], [1e9, 1, 1e-3, 1e-6, 0, 0], [3, 0, 0, 0, 0, 0], [0] * 6])
def test_leading_values_and_vectors(spectrum):
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((6, 6)))[0]
    m = q @ np.diag(spectrum) @ q.T
    m = (m + m.T) / 2
    values, vectors = whitening.leading(m)
    assert len(values) == min(4, sum(s > 1e-12 * sum(spectrum) for s in spectrum))
    assert np.allclose(values, spectrum[: len(values)], rtol=1e-9, atol=1e-12 * max(spectrum))
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-10)
    assert np.allclose(m @ vectors, vectors * values, atol=1e-12 * max(max(spectrum), 1))


def test_equals_brute_force(spark):
    r = np.random.default_rng(1)
    vectors = (r.standard_normal((400, 12)) * np.linspace(0.05, 0.5, 12)).astype(np.float32).tolist()
    vectors += vectors[:130] + [vectors[0]] * 200  # copies count once in the fit
    rows = [(i, v, "c", 1) for i, v in enumerate(vectors)] + [(None, vectors[7], "c", 1)]
    bad = [(9001, None, "c", 1), (9002, [None] * 12, "c", 1), (9003, [NAN] * 12, "c", 1), (9004, [INF] + [0.0] * 11, "c", 1), (9005, [-INF] + [0.0] * 11, "c", 1)]
    out = whitening.whiten(table(spark, rows + bad)).collect()
    assert len(out) == 4 * len(rows) and {x.component for x in out} == {1, 2, 3, 4}
    n, deviation, z, explained = brute(vectors)
    signs = {}
    for x in out:
        i, k = 7 if x.vec_id is None else x.vec_id, x.component - 1
        assert (x.n, x.deviation) == (n, deviation[i])
        assert x.explained == pytest.approx(explained[k], rel=1e-10) and x.identity_error < 1e-10
        signs.setdefault(k, np.sign(x.whitened * z[i, k]))
        assert x.whitened == pytest.approx(signs[k] * z[i, k], abs=1e-9)


def test_spaces_by_length_and_flat_ones(spark):
    r = np.random.default_rng(2)
    plane = r.standard_normal((50, 2)).tolist()
    solid = r.standard_normal((60, 5)).tolist()
    rows = [(i, v, "c", 1) for i, v in enumerate([*plane, *solid, [], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]])]
    out = whitening.whiten(table(spark, rows, "double")).collect()
    got = {}
    for x in out:
        got.setdefault(x.vec_id, []).append(x)
    assert {len(got[i]) for i in range(50)} == {2} and {len(got[i]) for i in range(50, 110)} == {4}
    assert sorted(got) == list(range(110))  # one distinct vector has no component, nor has an empty one
    assert {x.n for x in got[0]} == {50} and {x.n for x in got[60]} == {60}
    n, deviation, _, explained = brute(solid)
    assert got[53][0].deviation == deviation[3] and got[53][1].explained == pytest.approx(explained[1])


def test_large_entries(spark):
    rows = [(0, [3e38, 0.0], "c", 1), (1, [-3e38, 1.0], "c", 1), (2, [0.5, -0.0], "c", 1), (3, [2e6, 7.0], "c", 1)]
    out = whitening.whiten(table(spark, rows)).collect()
    assert len({x.vec_id for x in out}) == 4
    assert all(x.deviation is None for x in out if x.vec_id < 2)


def test_exact_beyond_double(spark):
    vectors = [[float(a), float(b)] for a, b in [(1 << 18, 3), (-(1 << 18), 5), (77, 1 << 17), (3, 3)]]
    out = whitening.whiten(table(spark, [(i, v, "c", 1) for i, v in enumerate(vectors)], "double")).collect()
    _, deviation, _, _ = brute(vectors)
    assert {x.vec_id: x.deviation for x in out} == dict(enumerate(deviation))


def test_empty_and_invalid_only(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None, "c", 1), (2, [NAN], "c", 1)])).collect() == []
