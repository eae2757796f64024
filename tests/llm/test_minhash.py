import random

import numpy as np
import pytest

from stayline.llm import minhash
from stayline.llm.common import components
from tests.llm.samples import documents, empty, prose


def brute(rows, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None) if sets[i] else doc_id))
    return sorted(map(str, out))


def copies(seed, n, words, changes):
    r, base = random.Random(seed), prose(seed, words).split()
    out = []
    for i in range(n):
        own = base[:]
        for _ in range(r.randint(0, changes)):
            own[r.randrange(len(own))] = f"n{r.random()}"
        out.append((1000 * seed + i, " ".join(own)))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_against_brute_force(spark, percent):
    extra = copies(2, 150, 150, 5) + copies(3, 40, 60, 2) + copies(4, 30, 900, 30)
    docs = documents(spark, extra)
    got = minhash.near_duplicates(docs, percent=percent).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute([(r.doc_id, r.text) for r in docs.collect()], percent)
    assert all(r.kept == (r.doc_id == r.component_id if r.component_id is not None else True) for r in got)


def test_one_of_each_group_stays(spark):
    docs = documents(spark, copies(7, 50, 120, 0))
    kept = minhash.filtered(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 7000 in ids and not set(range(7001, 7050)) & set(ids)
    assert minhash.filtered(empty(spark)).collect() == [] == minhash.near_duplicates(empty(spark)).collect()


def test_signatures_estimate_similarity():
    memory = minhash._Hashes()
    a, b = (minhash.shingles(t, memory) for t in (prose(1, 600), " ".join(prose(1, 600).split()[:500] + prose(2, 100).split())))
    both = len(np.intersect1d(a, b))
    hit = (minhash.signature(a, 1024) == minhash.signature(b, 1024)).mean()
    assert abs(hit - both / (len(a) + len(b) - both)) < 0.05


def test_overlaps():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 9000, k).astype(np.uint64)) for k in (0, 1, 50, 5000, 7000)]
    assert minhash.overlaps(sets).tolist() == [[len(np.intersect1d(a, b)) if i != j else minhash.overlaps(sets)[i, i] for j, b in enumerate(sets)] for i, a in enumerate(sets)]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(200)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(want[x] == c for x, c in got.items())
    assert {x for x in want if sum(find(y) == find(x) for y in want) > 1} == set(got)
