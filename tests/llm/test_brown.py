import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from stayline.llm import brown
from stayline.llm.common import words
from tests.llm.samples import documents, empty, prose


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def test_base_score_counts_and_split(spark):
    docs = documents(spark, [(i, prose(i, 40)) for i in range(100, 160)])
    got = brown.scored(docs).collect()
    assert len(got) == docs.count()
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b""]) for r in docs.select("doc_id", "text").collect()]
    counts = Counter(w for i, t in rows if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.perplexity >= 1 for r in got)


def test_model_is_a_distribution(spark):
    docs = documents(spark, [(i, prose(i, 60, 150)) for i in range(200, 260)])
    blocks = brown.encoded(docs)
    known = brown.vocabulary(blocks)
    model = brown.trained(blocks, known)
    words = known.collect()
    hashes, endings = (np.array([r[c] for r in words]) for c in ("hash", "ending"))
    classes = model.classes[model.units.of(hashes, endings)]
    emitted = np.bincount(classes, (np.array([r["c"] for r in words]) - model.discount[classes]) / model.total[classes], brown.CLASSES)
    live = model.total > 0
    assert np.allclose((emitted + model.free)[live], 1)
    assert np.allclose(model.transition.sum(1), 1)


def test_exchange_finds_alternating_classes(spark):
    # every text alternates between two vocabularies, so their words must part
    docs = spark.createDataFrame([(i, " ".join(f"a{(i * 7 + k) % 20}x b{(i * 5 + k) % 20}y" for k in range(60))) for i in range(60)], "doc_id long, text string")
    scored = brown.scored(docs).where("held_out").toPandas()
    assert scored.score.sum() > scored.base_score.sum()
    counts = np.zeros((4, 4))
    counts[0, 2:], counts[1, 2:], counts[2, :2], counts[3, :2] = 50, 50, 0, 0
    matrix = np.array([[0.0, 200.0], [10.0, 0.0]])
    assert brown.best_classes(np.array([[0, 5, 5, 0]]), np.array([0]), matrix).tolist() in ([0], [1])


def test_blocks_do_not_change_the_base(spark):
    docs = documents(spark).coalesce(1)
    sizes = [brown.encoded(docs, block).agg({"block": "count"}).first()[0] for block in (50, 10**9)]
    assert sizes[0] > sizes[1] == 1


def test_empty_and_untrained(spark):
    assert brown.scored(empty(spark)).collect() == []
    only = next(i for i in range(100) if held(i))
    row = brown.scored(spark.createDataFrame([(only, "never seen")], "doc_id long, text string")).first()
    assert row.train_tokens == 0 and row.n_known == 0 and row.score == row.base_score


def test_words_beyond_the_frequent_move_by_themselves(spark):
    # all words end alike and only the end token is frequent, so nothing but each word's own neighbours can part them
    docs = spark.createDataFrame([(i, " ".join(f"a{(i * 7 + k) % 20}xyz b{(i * 5 + k) % 20}xyz" for k in range(60))) for i in range(60)], "doc_id long, text string")
    gains = []
    for frequent in (1, 1000):
        held = brown.scored(docs, frequent=frequent).where("held_out").toPandas()
        gains.append((held.score - held.base_score).sum() / held.n_tokens.sum())
    assert min(gains) > 0.1


def test_few_and_many_neighbours_choose_alike():
    rng = np.random.default_rng(1)
    matrix = rng.integers(50, 400, (5, 5)).astype(float)
    counts, own = rng.integers(0, 4, (30, 10)), rng.integers(0, 5, 30)
    word, cell = np.nonzero(counts)
    assert brown.best_of_few(word, cell, counts[word, cell], own, matrix).tolist() == brown.best_classes(counts, own, matrix).tolist()


def test_classes_follow_the_vocabulary():
    assert brown.classes_for(1_000) == brown.CLASSES < brown.classes_for(400_000) < brown.classes_for(4_000_000)


def test_words_of_arrays_are_the_words_of_texts():
    r = random.Random(1)
    texts = ["", " ", "A  B\tC\n", "\u00dc\u0085x \x0b\x0c\u00c0B", "\x1cq \x1fz\x00", *("".join(r.choice("ab \t\n\u00c4Z") for _ in range(r.randrange(9))) for _ in range(300))]
    for part in (slice(0, None), slice(3, 90), slice(0, 2), slice(0, 0)):
        found, sizes = brown._words(pa.array(texts, pa.large_string()).cast(pa.large_binary())[part])
        want = [words(t) for t in texts[part]]
        assert found.to_pylist() == [w for t in want for w in t] and sizes.tolist() == [len(t) for t in want]


def test_half_turns_read_the_tokens_once(spark, monkeypatch):
    docs = documents(spark, [(i, prose(i, 60, 150)) for i in range(200, 230)])
    reads = []
    told, settle = brown.told, brown.settle_frequent
    monkeypatch.setattr(brown, "told", lambda *a: reads.append(1) or told(*a))

    def counting(*a):
        reads.clear()
        out = settle(*a)
        assert len(reads) == 1
        return out

    monkeypatch.setattr(brown, "settle_frequent", counting)
    blocks = brown.encoded(docs)
    brown.trained(blocks, brown.vocabulary(blocks))
    assert reads


def test_neighbours_are_counted_as_the_tokens_stand(spark):
    docs = spark.createDataFrame([(i, prose(i, 30, 40)) for i in range(40)], "doc_id long, text string")
    blocks = brown.encoded(docs, 200)
    top, k = brown.most_frequent(brown.vocabulary(blocks), 20), 5
    hashes = np.array([r["hash"] for r in top])
    order = np.argsort(hashes)
    units = brown.Units(hashes[order], order, len(top))
    head = np.random.default_rng(1).integers(0, k, len(top) + brown.ENDINGS)
    head[len(top) :: 2] = -1  # these words have a drawn class each
    place, own = {}, {}
    for w in {w for r in docs.collect() for w in [*words(r["text"]), b""]}:
        h = np.array([brown.xxhash.xxh64_intdigest(w)], np.uint64)
        place[w] = int(units.of(h.view(np.int64), np.array([brown.xxhash.xxh32_intdigest(w[-3:]) % brown.ENDINGS]))[0])
        own[w] = head[place[w]] if head[place[w]] >= 0 else int(h[0] >> np.uint64(20)) % k
    counts, matrix = np.zeros((len(head), 2 * k), int), np.zeros((k, k), int)
    for r in docs.collect():
        if not held(r["doc_id"]):
            text = [b"", *words(r["text"]), b""]
            for before, word in zip(text, text[1:]):
                matrix[own[before], own[word]] += 1
                counts[place[word], own[before]] += 1
                counts[place[before], k + own[word]] += 1
    sides = brown.beside(blocks, units, head, np.zeros(len(top), int), 1, k)
    for half in (0, 1, -1):
        got = {r["part"]: brown._unpack(r["n"], np.int64) for r in brown.neighbours(sides, head, k, half).collect()}
        assert (got.pop(-1).reshape(k, k) == matrix).all()
        if half >= 0:
            assert (np.concatenate([got[r] for r in sorted(got)]).reshape(-1, 2 * k) == counts[brown.halves(head, k)[half]]).all()
