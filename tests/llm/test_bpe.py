import base64
import random

import pytest
import tiktoken

from stayline.llm import bpe
from stayline.llm.queries import bpe_parameters
from tests.llm.samples import documents, empty


@pytest.fixture(scope="module")
def reference():
    ranks, pattern = bpe_parameters()
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def odd(seed, n):
    r = random.Random(seed)
    return "".join(r.choice(["a", "ß", "'re", "'", "  ", "\n", " ", "12", "!!", "　", "\U0001f600", "word", "\r\n", "́", "é"]) for _ in range(n))


@pytest.mark.parametrize("chunk, overlap", [(bpe.CHUNK, bpe.OVERLAP), (200, 60), (50, 20)])
def test_ids_and_round_trip(spark, reference, chunk, overlap):
    extra = [(300 + i, odd(i, 400)) for i in range(12)] + [(400, " " * 900), (401, "a" * 900 + " b"), (402, "'" * 500), (403, odd(3, 30) + "\n" * 300 + "x"), (404, "<|endoftext|>")]
    docs = documents(spark, extra)
    want = sorted((str(r.doc_id), reference.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect())
    coded = bpe.decode(bpe.encode(docs, *bpe_parameters(), chunk=chunk, overlap=overlap), *bpe_parameters())
    assert sorted((str(r.doc_id), list(r.ids), bytes(r.bytes)) for r in coded.collect()) == want


def test_empty(spark):
    assert bpe.decode(bpe.encode(empty(spark), *bpe_parameters()), *bpe_parameters()).collect() == []
