import numpy as np
import pytest

from stayline.llm import caps

KIND = "vec_id long, embedding array<double>, label string, vector int"


def brute(rows, cosine=0.9):
    """(vec_id, n_links, component) per row, in order."""
    sound = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows]
    unit = [np.array(v) / np.abs(v).max() if s else None for (_, v), s in zip(rows, sound)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    n = len(rows)
    linked = [[i != j and sound[i] and sound[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = [j for j in range(n) if linked[k][j] and j not in seen]
            seen.update(new)
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], sum(linked[i]), min(ids, default=None)))
    return out


def test_against_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(r.standard_normal((60, 64)))]
    for k in range(60, 160):  # copies scaled, near ones and chains
        base = np.array(rows[r.integers(0, k)][1])
        g = r.standard_normal(64)
        rows.append((1000 - k, (base * 2.0 if k % 4 == 0 else base + g * np.linalg.norm(base) / 8 * r.choice([0.05, 0.2, 0.42])).tolist()))
    rows += [(500, None), (501, []), (502, [0.0] * 64), (503, [1.0] * 63 + [None]), (504, [1.0] * 63 + [float("nan")]), (505, [1.0] * 63 + [float("inf")]), (506, [1e-300, 1e-300]), (507, [1e300, 1e300]), (508, [-0.0, 5.0]), (509, [0.0, 5.0]), (600, rows[0][1]), (600, rows[0][1]), (None, rows[0][1]), (None, None)]
    got = caps.near_duplicates(spark.createDataFrame([(*x, "l", 1) for x in rows], KIND).repartition(3)).collect()
    want = brute(rows)
    assert sorted(map(str, [(r.vec_id, r.n_links, r.component_id) for r in got])) == sorted(map(str, want))
    assert all(r.kept == (r.vec_id == r.component_id if r.vec_id is not None else r.n_links == 0) for r in got)


@pytest.mark.parametrize("dim", [2, 3, 16, 64, 200])
def test_recall_at_the_limit(dim):
    r = np.random.default_rng(dim)
    x = r.standard_normal((300, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = r.standard_normal(x.shape)
    g -= (g * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * g / np.linalg.norm(g, axis=1, keepdims=True)
    a, b = ([set() for _ in x], [set() for _ in x])
    for sets, z in ((a, x), (b, y)):
        for row, f in zip(*caps.decoded(z)):
            sets[row].add(f)
    assert np.mean([bool(p & q) for p, q in zip(a, b)]) > 0.95


def test_decoding_finds_exactly_the_filters_passed():
    r = np.random.default_rng(9)
    x = r.standard_normal((5, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    limit, sets = caps.filters(8)
    row, number = caps.decoded(x)
    want = set()
    for s, (turn, left, right) in enumerate(sets):
        z = x @ turn
        every = (z[:, :4] @ left.T)[:, :, None] + (z[:, 4:] @ right.T)[:, None, :]
        for i, a, b in zip(*np.nonzero(every >= limit)):
            want.add((i, (s * len(left) + a) * len(right) + b))
    assert set(zip(row.tolist(), number.tolist())) == want


def test_empty(spark):
    assert caps.near_duplicates(spark.createDataFrame([], KIND)).collect() == []
