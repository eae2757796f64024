from collections import Counter

from stayline.llm import quality
from tests.llm.samples import documents, empty, prose


def verdict(text):
    """The rules in plain form."""
    text = text or ""
    words = text.encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = len({i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)})
    lines = [x for x in text.split("\n") if x.encode().split()]
    n, chars = len(words), sum(len(w.decode()) for w in words)
    symbols, same = sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    capitals, marks = sum(len(w) > 1 and w.isupper() for w in text.split()), sum(c in "!?" for c in text)
    bad = n < 50 or repeated > 0.5 * n or symbols > 0.25 * n or same > 0.5 * len(lines) or not 2 * n <= chars <= 20 * n or capitals > 0.5 * n or marks > 0.5 * n
    return n, chars, symbols, same, repeated, not bad


JUNK = [(200, "ABC!! DEF!! " * 40 + prose(1, 100)), (201, prose(2, 60).replace(" ", "%%% ")), (202, ("same line here\n" * 30) + prose(3, 60)), (203, prose(4, 200, 9)), (204, "x" * 3000 + " " + prose(5, 60).replace("w", "w" * 30)), (205, " ".join("AB%d" % i for i in range(80)))]


def test_measures_and_verdicts(spark):
    docs = documents(spark, JUNK)
    order = quality.ordered(docs, sample=0.9)
    assert sorted(r.name for r in order) == sorted(r.name for r in quality.RULES)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = quality.cascade(docs, order, measures=names).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (*(r[n] for n in names), r.kept) == verdict(r.text)
        assert (r.rejected_by is None) == r.kept


def test_order_changes_cost_not_verdict(spark):
    docs = documents(spark, JUNK)
    one = sorted((str(r.doc_id), r.kept, r.text or "") for r in quality.cascade(docs, list(quality.RULES)).collect())
    two = sorted((str(r.doc_id), r.kept, r.text or "") for r in quality.cascade(docs, list(quality.RULES)[::-1]).collect())
    assert one == two
    tried = [r.n_tried for r in quality.cascade(docs, list(quality.RULES)).where("text is null").collect()]
    assert set(tried) == {1}  # the first rule rejects, no other is tried


def test_cheap_and_strict_rules_come_first(spark):
    def slow(t):
        return sum(range(20_000)) < 0

    rules = (quality.Rule("slow", "n_words", slow), quality.Rule("strict", "n_words", lambda t: t.n_words < 100))
    docs = spark.createDataFrame([(i, prose(i, 20)) for i in range(50)], "doc_id long, text string")
    assert [r.name for r in quality.ordered(docs, rules, sample=1.0)] == ["strict", "slow"]


def test_filtered_and_empty(spark):
    docs = documents(spark, JUNK)
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in docs.collect() if verdict(r.text)[-1])
    assert quality.filtered(empty(spark)).collect() == []
