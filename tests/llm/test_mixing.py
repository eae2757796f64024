from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.llm import mixing
from tests.llm.samples import documents, empty, prose


def brute_targets(sizes, weights, most=3):
    """Reshare the excess until none is above."""
    capped, total = set(), sum(sizes)
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        targets = [most * s if i in capped else left * weights[i] / weight for i, s in enumerate(sizes)]
        above = {i for i, t in enumerate(targets) if i not in capped and t > most * sizes[i]}
        if not above:
            return targets
        capped |= above


@pytest.mark.parametrize("seed", range(8))
def test_targets(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 25))
    sizes = [int(x) for x in r.lognormal(5, 2, n)]
    weights = [mixing.WEIGHTS[i % 3] for i in range(n)]
    assert mixing.water_filled(sizes, weights) == pytest.approx(brute_targets(sizes, weights))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutations(spark, n):
    for key in (1, 2):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(key).cast("long"))).collect()]
        assert sorted(got) == list(range(n))
        assert n < 17 or got != list(range(n))


def test_report(spark):
    docs = documents(spark, [(100 + i, prose(i, 300)) for i in range(60)])
    rows = mixing.report(docs).collect()
    assert len(rows) == docs.count()
    again = mixing.report(docs.repartition(7).orderBy(F.rand(1))).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = brute_targets([size[s] for s in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))])
    assert [target[s] for s in order] == pytest.approx(want)
    assert {r.source: r.source_size for r in rows} == dict(size)
    for s in order:
        assert abs(taken[s] - target[s]) <= 3 * mixing.BLOCK


def test_slots_meet_quotas_and_epochs_are_permutations(spark):
    found = [mixing.Source("a", 640, 0, 10, 30), mixing.Source("b", 6400, 0, 100, 45), mixing.Source(None, 64, 0, 1, 0), mixing.Source("c", 700, 0, 11, 20)]
    rows = mixing.slots(spark, found, 3, slots_per_shard=8).collect()
    for i, s in enumerate(found):
        own = [r for r in rows if r["source"] == i]
        assert sorted(r["number"] for r in own) == list(range(s.quota))
        for e in range(-(-s.quota // max(1, s.blocks))):
            blocks = [r["block"] for r in own if r["pass"] == e]
            assert len(set(blocks)) == len(blocks) and set(blocks) <= set(range(s.blocks))
    assert set(Counter(r["shard"] for r in rows).values()) <= {8, 95 % 8}


def test_mixed_texts_are_what_was_taken(spark):
    docs = documents(spark, [(100 + i, prose(i, 300).replace("w1", "\tw1")) for i in range(40)])
    taken = Counter()
    for r in mixing.report(docs).collect():
        taken[r.doc_id] += r.taken
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.schema["n_chars"] == docs.schema["n_chars"]
    got, texts = Counter(), {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    for r in mixed.collect():
        got[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
        assert any(all(w in t for w in r.text.split()[:50]) for t in texts[r.doc_id])
    assert +got == +taken


def test_empty(spark):
    assert mixing.report(empty(spark)).collect() == [] and mixing.mixed(empty(spark)).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.report(blank).collect()] == [(0, 0.0, 0)] * 2
