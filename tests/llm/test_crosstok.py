import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stayline.llm import crosstok
from tests.llm.samples import documents, empty, prose

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def reference():
    first = Tokenizer.from_file(FILES[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    alphabet = crosstok.byte_alphabet()

    def tokens(text):
        """Ids and bytes of both, by the libraries alone; nothing where they do not spell the text."""
        if not text:
            return [], []
        a = [(i, bytes(alphabet[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in second.encode(text):
            p = second.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        return (a, b) if b"".join(t for _, t in a) == want == b"".join(t for _, t in b) else ([], [])

    return tokens


def brute(texts, tokens):
    """(n_a, n_b, n_groups, groups, links) by text, cut token by token."""
    out = []
    for text in texts:
        a, b = tokens(text)
        ends = [dict(zip(itertools.accumulate(len(t) for _, t in x), range(len(x)))) for x in (a, b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, links, i, j = [], [], 0, 0
        for c in cuts:
            p, q = ends[0][c] + 1, ends[1][c] + 1
            groups.append(",".join(str(n) for n, _ in a[i:p]) + "|" + ",".join(str(n) for n, _ in b[j:q]))
            links.append((a[p - 1][0], b[q - 1][0]))
            i, j = p, q
        out.append((len(a), len(b), len(groups), ";".join(groups), links))
    return out


def sums(rows):
    """(n_links, n_best, count_sum) by text."""
    counts = Counter(x for *_, links in rows for x in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [(len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links)) for *_, links in rows]


def odd(seed, n):
    r = random.Random(seed)
    some = ["a", "ß", "'re", "'", " ", "  ", "\n", " x", "12", "!!", "　", "\U0001f600", " word", "\r\n", "é", " ", "<s>", "<|endoftext|>", "<0x41>", "日本語", "\t", "\x1f", "\x85"]
    return "".join(r.choice(some) for _ in range(n))


EXTRA = [(300 + i, odd(i, 150)) for i in range(40)] + [
    (400, " " * 90), (401, "a" * 900 + " b"), (402, "has ▁ inside"), (403, "▁"), (404, " lead"), (405, "trail "), (406, "\0 nul \0"), (407, "日本語" * 200),
    (408, "\nfoo bar\n"), (409, prose(9, 600) + "  " + odd(77, 300)), (410, odd(78, 300) + " ▁ " + prose(10, 300)), (411, " "), (412, "\n"),
]


@pytest.mark.parametrize("sizes", [{}, {"long": 200, "piece": 64, "width": 16, "fan": 2}, {"long": 0, "piece": 300, "width": 37, "fan": 3}, {"long": 100, "piece": 50, "width": 100_000}])
def test_equals_brute_force(spark, reference, sizes):
    docs = documents(spark, EXTRA)
    rows = docs.collect()
    want = brute([r.text for r in rows], reference)
    assert sum(x[0] == 0 for x in want) >= 5
    got = crosstok.aligned(docs, *FILES, **sizes)
    assert sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.groups) for r in got.collect()) == sorted((str(d.doc_id), *x[:4]) for d, x in zip(rows, want))
    for most in (crosstok.FREQUENT, 3, 0):
        scored = crosstok.scored(got.drop("groups"), crosstok.loaded(*FILES).width, most)
        assert scored.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
        assert sorted((str(r.doc_id), r.n_links, r.n_best, r.count_sum) for r in scored.collect()) == sorted((str(d.doc_id), *x) for d, x in zip(rows, sums(want)))


def test_forgetting_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(crosstok, "REMEMBERED", 40)
    monkeypatch.setattr(crosstok, "ENCODED", 7)
    memory = crosstok.Memory(crosstok.loaded(*FILES))
    for _, text in EXTRA:
        parts = crosstok.stretches(text)
        assert " ".join(parts) == text
        numbers = memory.numbers(parts)
        want = brute([text], reference)[0]
        assert (min(numbers) < 0) == (want[0] == 0)
        if want[0]:
            assert ";".join(memory.texts[n] for n in numbers) == want[3]


def fragments_of(data):
    """Random token rows that end together, as fragments of single bytes, and their groups."""
    pair = crosstok.loaded(*FILES)
    total = data.draw(st.integers(1, 24))
    ends = [np.array([*sorted(data.draw(st.sets(st.integers(1, total - 1)))), total]) if total > 1 else np.array([1]) for _ in (0, 1)]
    ids = [np.arange(1, len(e) + 1) + 100 * w for w, e in enumerate(ends)]
    out = []
    for at in range(1, total + 1):
        keep = [e == at for e in ends]
        out.append(crosstok.fragment(pair, ids[0][keep[0]], ends[0][keep[0]], ids[1][keep[1]], ends[1][keep[1]]))
    return out


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_fragments_are_a_monoid(data):
    parts = fragments_of(data)
    x, y, z = (data.draw(st.sampled_from(parts)) for _ in range(3))
    assert crosstok.composed(crosstok.composed(x, y), z) == crosstok.composed(x, crosstok.composed(y, z))
    assert crosstok.composed(crosstok.EMPTY, x) == x == crosstok.composed(x, crosstok.EMPTY)
    whole = crosstok.EMPTY
    for p in parts:
        whole = crosstok.composed(whole, p)
    tree = list(parts)
    while len(tree) > 1:  # any tree gives the same
        i = data.draw(st.integers(0, len(tree) - 2))
        tree[i : i + 2] = [crosstok.composed(tree[i], tree[i + 1])]
    assert tree[0] == whole and whole.cut and whole.suffix == ((), ())


def test_ranks_need_a_plain_file():
    with pytest.raises(ValueError):
        crosstok.ranks(public_tokenizers.path("word_bpe_49k.json"))


def test_empty(spark):
    assert crosstok.scored(crosstok.aligned(empty(spark), *FILES), 32_000).collect() == []
