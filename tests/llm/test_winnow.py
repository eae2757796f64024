import random
import re

import numpy as np
import pytest

from stayline.llm import winnow
from tests.llm.samples import documents, empty, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(texts, items, span):
    """By text: words, numbers of the words in windows, ids of items with a window."""
    held = {}
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            held.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(k) for k in held}
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in held:
                    hit.update(range(i, i + n))
                    found |= held[tuple(w[i : i + n])]
        out.append((len(w), sorted(hit), sorted(str(x) for x in found if x is not None)))
    return out


def table(spark, items):
    return spark.createDataFrame([(i, t, "r", 1) for i, t in items], "item_id long, text string, row string, print int").repartition(2)


def told(rows):
    return sorted((str(r.doc_id), r.n_words, [n for x in r.runs for n in range(x.first, x.last + 1)], list(r["items"])) for r in rows)


@pytest.mark.parametrize("span", [1, 2, 3, 5, 10, 13])
def test_every_window_has_its_fingerprint(span):
    r = np.random.default_rng(span)
    long = r.integers(0, 6, 400).astype(np.uint64)  # few words, so many ties
    prints, first, last = winnow.chosen(long, span)
    assert first[0] == 0 and (first[1:] == last[:-1] + 1).all() and last[-1] == len(long) - span
    for p, a, b in zip(prints, first, last):
        for start in {int(a), int(b)}:
            alone = winnow.chosen(long[start : start + span], span)
            assert len(alone[0]) == 1 and alone[0][0] == p


def test_few_words_are_kept():
    prints, first, _ = winnow.chosen(np.random.default_rng(0).integers(0, 1 << 62, 100_000).astype(np.uint64), 10)
    assert 0.25 < len(first) / 100_000 < 0.32


@pytest.mark.parametrize("span, together", [(10, winnow.TOGETHER), (4, 50), (1, 50)])
def test_equals_brute_force(spark, monkeypatch, span, together):
    monkeypatch.setattr(winnow, "TOGETHER", together)
    r = random.Random(span)
    items = [(i, prose(100 + i, r.randrange(1, 60), 30)) for i in range(25)]
    items += [(30, items[3][1]), (31, items[3][1].upper() + " more words here"), (30, "x y"), (None, prose(900, 14)), (40, None), (41, "  .. "), (42, "W1"), (43, "w1 w2 w1 w2 " * 8), (44, "Ünï-cødé wörds, ß")]
    texts = []
    for i in range(60):
        parts = [prose(500 + i, r.randrange(0, 40), 30)]
        for _ in range(r.randrange(0, 3)):
            w = words(r.choice(items)[1])
            cut = sorted(r.randrange(0, len(w) + 1) for _ in range(2)) if w else [0, 0]
            parts += [" - ".join(w[cut[0] : cut[1]]).upper(), prose(700 + i, r.randrange(0, 12), 30)]
        texts.append(r.choice(["; ", "\n", " "]).join(parts))
    texts += [prose(900, 14), "w1 w2 " * 300, "ünï cødé wörds ß", "Ünï cødé", "▁ x"]
    docs = documents(spark, [(100 + i, t) for i, t in enumerate(texts)])
    rows = docs.collect()
    want = sorted((str(d.doc_id), *x) for d, x in zip(rows, brute([d.text for d in rows], items, span)))
    assert told(winnow.matched(docs, table(spark, items), span).collect()) == want
    assert any(x[2] for x in want) and any(not x[2] for x in want)


def test_filter_only_spares_work(spark, monkeypatch):
    items = [(i, prose(i, 30, 50)) for i in range(40)]
    docs = documents(spark, [(100 + i, prose(i, 25, 50) + " " + prose(200 + i, 30, 50)) for i in range(30)])
    want = told(winnow.matched(docs, table(spark, items)).collect())
    monkeypatch.setattr(winnow, "FILTER", 6)
    assert told(winnow.matched(docs, table(spark, items)).collect()) == want


def test_passage_of_many_items_and_documents(spark):
    passage = prose(7, 60)
    items = table(spark, [(i, f"{prose(1000 + i, 5)} {passage}") for i in range(200)] + [(300, passage)] * 3)
    docs = documents(spark, [(1000 + i, f"{prose(3000 + i, 20).replace("w", "y")} {passage}") for i in range(100)])
    got = {r.doc_id: r for r in winnow.matched(docs, items).collect() if r.doc_id is not None and r.doc_id >= 1000}
    assert len(got) == 100
    for r in got.values():
        assert [tuple(x) for x in r.runs] == [(20, 79)] and list(r["items"]) == sorted(map(str, [*range(200), 300]))


def test_decontaminated_and_empty(spark):
    items = table(spark, [(1, prose(2, 200))])
    docs = documents(spark)
    kept = winnow.decontaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in docs.collect() if r.doc_id not in (7, 8, 9)) == sorted(r.doc_id or -1 for r in kept.collect())
    assert winnow.matched(empty(spark), items).collect() == []
    assert all(not r.runs and not r["items"] for r in winnow.matched(docs, table(spark, [])).collect())
