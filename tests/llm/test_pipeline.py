"""Each stage of the pipeline, on what its predecessor kept, against a plain version."""

import base64
import itertools
import re
from collections import Counter

import pytest
import tiktoken

import corpus_pipeline
from stayline.llm import mixing, toxicity
from stayline.llm.common import written
from stayline.llm.queries import bpe_parameters

FOLDER = "/root/testdata/sf0.001"
BLANK = " \t\n\v\f\r"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], FOLDER)))
    return out


def words(text):
    return re.findall(f"[^{BLANK}]+", text or "")


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_toxic_documents_go(spark, stages):
    docs = stages[0]
    model = toxicity.fitted(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    weights = toxicity.Weights(model.accepted)

    def score(text):
        x = model.curve[0] + sum(a * b for a, b in zip(model.curve[1:], toxicity.features(text, weights))) if model.curve else -100
        return 1 / (1 + 2.718281828459045**-x)

    want = Counter(tuple(r) for r in docs.collect() if score(r.text) < toxicity.THRESHOLD)
    assert as_rows(stages[1]) == want and 0 < sum(want.values()) < docs.count()
    clean = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic = 0").collect()}
    marked = [r for r in (as_rows(docs) - as_rows(stages[1])).elements() if r[0] in clean]
    assert len(marked) <= 0.05 * len(clean)


def test_rejected_documents_go(stages):
    def kept(text):
        text, w = text or "", words(text)
        windows = Counter(zip(w, w[1:], w[2:]))
        marked = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        chars = sum(map(len, w))
        return not (
            len(w) < 50
            or 100 * len(marked) > 50 * len(w)
            or 100 * sum(c in "#*$%&|<>" for c in text) > 25 * len(w)
            or 100 * (len(lines) - len(set(lines))) > 50 * len(lines)
            or not 2 * len(w) <= chars <= 20 * len(w)
            or 100 * sum(len(x) > 1 and x.isupper() for x in w) > 50 * len(w)
            or 100 * sum(c in "!?" for c in text) > 50 * len(w)
        )

    want = Counter(r for r in as_rows(stages[1]).elements() if kept(r[1]))
    assert as_rows(stages[2]) == want and 0 < sum(want.values()) < stages[1].count()


def test_one_of_each_group_stays(stages):
    rows = sorted(as_rows(stages[2]).elements())
    sets = {}
    for doc_id, text, *_ in rows:
        w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    assert sorted(as_rows(stages[3]).elements()) == [r for r in rows if find(r[0]) == r[0]]
    assert len(rows) > stages[3].count() > 0


def test_mixture_takes_words_of_its_documents(stages):
    docs, mix = stages[3], stages[4]
    assert mix.columns == docs.columns
    source = {r.doc_id: r for r in docs.collect()}
    size, taken = Counter(), Counter()
    for r in source.values():
        size[r.source] += len(words(r.text))
    for r in mix.collect():
        whole, own = words(source[r.doc_id].text), words(r.text)
        assert own and (r.lang, r.source, r.n_chars) == (source[r.doc_id].lang, source[r.doc_id].source, len(r.text))
        at = 0  # its words are words of the document, in order
        for w in own:
            at = whole.index(w, at) + 1
        taken[r.source] += len(own)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    targets = mixing.water_filled([size[s] for s in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))])
    for s, target in zip(order, targets):
        assert abs(taken[s] - target) <= 3 * mixing.BLOCK


def test_tokens_are_those_of_the_library(stages):
    ranks, pattern = bpe_parameters()
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    want = Counter((r.doc_id, tuple(encoding.encode_ordinary(r.text))) for r in stages[4].collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in stages[5].collect()) == want
