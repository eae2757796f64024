import random
import zlib

import pytest

from stayline.llm import toxicity
from tests.llm.samples import documents, empty, prose


@pytest.fixture(scope="module")
def learned(spark):
    rows = [(i, prose(i, 60) + (f" you are a vilex{i % 9} mudak. " if i % 5 == 0 else ". ") + prose(i + 5000, 30), int(i % 5 == 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(3, None), (0, 0), (9999, 1)], "doc_id long, toxic int")
    return docs, labels, toxicity.fitted(docs, labels)


def test_held_out_accuracy(learned):
    docs, _, model = learned
    wrong = 0
    for r in toxicity.scored(docs, model).collect():
        assert 0 <= r.score <= 1
        if zlib.crc32(str(r.doc_id).encode()) % 4 == 2:
            wrong += (r.score >= toxicity.THRESHOLD) != (r.doc_id % 5 == 0)
    assert wrong <= 2
    assert any(k.startswith("vile") for k in model.accepted)  # a beginning, seen with nine endings


def test_labels_held_out_are_not_learned(spark, learned):
    docs, labels, model = learned
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    assert toxicity.fitted(docs, turned) == model


def test_states_of_the_grammar():
    weights = toxicity.Weights({"=fool": 4.0})

    def weight(text):
        return toxicity.clause_weight(text.split(), weights)[0]

    plain, aimed = weight("he is a fool"), weight("you he knows is that fool")
    assert aimed > plain == weight("not that it was meant fool") == 4.0
    assert weight("you are a fool") > aimed  # addressed
    assert weight("he is not a fool") < plain and weight("she said he is a fool") < plain and weight('the word "fool" is old') < plain
    assert weight("a son of a fool") > plain
    assert toxicity.features("Not a fool. You he knows is that fool!", weights)[0] == aimed
    assert toxicity.features(None, weights) == toxicity.features("", weights) == toxicity.features("fine words", weights) == (0.0,) * 4


def test_threats_of_ordinary_words():
    weights = toxicity.Weights({})
    for said in ("I will hurt you badly", "ich werde dich verletzen", "je vais te frapper", "voy a golpear a ti"):
        assert toxicity.features(said, weights)[3] > 0, said
    hurt = toxicity.clause_weight("I will hurt you badly".split(), weights)
    assert hurt == (toxicity.PHRASE * toxicity.AIMED,) * 2
    assert toxicity.clause_weight("I will never hurt you".split(), weights)[0] < hurt[0]
    assert toxicity.clause_weight("he said I will hurt you".split(), weights)[0] < hurt[0]
    for said in ("I will help you", "hurt people will remember all that was said about you", "they hurt you", ""):
        assert toxicity.clause_weight(said.split(), weights)[0] == 0, said


@pytest.mark.parametrize("seed", range(20))
def test_composition_equals_its_parts(seed):
    """The five machines one after another: what is emitted, scaled by negation, by reports, at last by the target."""
    r = random.Random(seed)
    bits = 1 << len(toxicity.SYMBOLS)
    clause = [(r.choice([0, 0, r.randrange(bits), 1 << r.randrange(len(toxicity.SYMBOLS))]), r.choice([0.0, 1.0, 2.5])) for _ in range(r.randrange(1, 40))]
    insult, threat, negation, report, target = toxicity.machines()

    def run(machine):
        state, out = machine.start, []
        for symbol, _ in clause:
            state, x = machine.step(state, symbol)
            out.append(x)
        return state, out

    emitted = [w * x for (_, w), x in zip(clause, run(insult)[1])]
    emitted = [e + x for e, x in zip(emitted, run(threat)[1])]
    for machine in (negation, report):
        emitted = [e * x for e, x in zip(emitted, run(machine)[1])]
    want = sum(emitted) * target.final.get(run(target)[0], 1.0)
    one, state, got = toxicity.composed(), 0, 0.0
    for symbol, w in clause:
        state, scale, phrase = one[state + symbol]
        got += w * scale + phrase
    assert got * one.final(state) == pytest.approx(want)
    assert len(one.states) <= 4 * 25 * 4 * 2 * 2


def test_edge_rows(spark, learned):
    model = learned[2]
    docs = documents(spark, [(77, "vilex3 mudak " * 20_000)])
    got = toxicity.scored(docs, model, "score_").collect()
    assert len(got) == docs.count() and {r.score for r in got} == {"s"}
    low = {r.score_ for r in got if not (r.text or "").strip()}
    assert len(low) == 1 and low.pop() < toxicity.THRESHOLD
    kept = toxicity.filtered(docs, model)
    assert kept.columns == docs.columns and docs.count() - kept.count() == 1
    assert toxicity.filtered(empty(spark), model).collect() == []
    none = toxicity.fitted(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score_ for r in toxicity.scored(docs, none, "score_").collect()} == {0.0}
    assert toxicity.fitted(empty(spark), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")) == toxicity.Model()
