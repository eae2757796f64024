import pytest

from stayline.operators import text as X
from stayline.plans import survey
from stayline.sources import schemas, tables

ANSWERS = [
    ("Don't, it’s 3.5 of 1,000 home-time", None, 6, None),
    ("The PAY is low; the pay, the miles", "good pay", 61, 7),
    ("", "friendly people", 7, 6),
    (None, "driver", None, 61),
]


@pytest.fixture
def answers(spark):
    return spark.createDataFrame(ANSWERS, schemas.SURVEY)


@pytest.fixture
def stop(spark):
    return tables.small_table(spark, {"word": ["the", "of", "is"]})


def test_one_row_per_word_keeps_other_columns(answers):
    df = X.explode_words(answers.select("whyleft", "seniority"), "whyleft")
    assert df.columns == ["seniority", "word"]
    assert [r["word"] for r in df.where("seniority = 6").collect()] == [
        "don't", "it’s", "3.5", "of", "1,000", "home", "time",
    ]
    assert df.where("seniority = 7 OR seniority IS NULL").count() == 0


def test_counting_first_equals_dropping_first(answers, stop, rows):
    early = X.word_counts(survey.answer_words(answers, "whyleft", stop, ["low"]))
    late = survey.popular_words(answers, "whyleft", stop, ["low"])
    assert rows(early, "word", "n") == rows(late, "word", "n")


def test_anti_and_semi_join_make_up_the_input(answers, stop):
    words = X.explode_words(answers, "whyleft")
    kept = X.without_stop_words(words, stop).count()
    assert kept + words.join(stop, "word", "left_semi").count() == words.count()


def test_frequency_order_breaks_ties_by_word(answers, stop):
    got = [tuple(r) for r in survey.popular_words(answers, "whyleft", stop, []).collect()]
    assert got[0] == ("pay", 2)
    assert [w for w, _ in got[1:]] == sorted(w for w, _ in got[1:])


@pytest.fixture
def counts(spark):
    return spark.createDataFrame([("a", 10), ("b", 11), ("c", 2), ("d", 3), ("e", 11)], "word STRING, n BIGINT")


def test_frequent_terms_need_more_than_ten(counts):
    assert [r["word"] for r in X.frequent_terms(counts).collect()] == ["b", "e"]


def test_top_terms_need_three(counts):
    assert [r["word"] for r in X.top_terms(counts).collect()] == ["b", "e", "a", "d"]
    assert [r["word"] for r in X.top_terms(counts, k=1).collect()] == ["b"]


def test_themes(spark):
    words = ["home", "solo", "paid", "fleet", "training", "trainer", "other", None]
    df = spark.createDataFrame([(w,) for w in words], "word STRING").coalesce(1)
    assert [r[0] for r in X.recode_themes(df).collect()] == [
        "familyneeds", "teamissues", "expectations", "communication", "training", "training", "other", None,
    ]


def test_recoding_counts_equals_counting_recoded_words(answers, stop, rows):
    words = survey.answer_words(answers, "whyleft", stop, [])
    want = X.word_counts(X.recode_themes(words))
    assert rows(survey.reason_counts(answers, stop, []), "word", "n") == rows(want, "word", "n")


def test_themed_words_carry_tenure_bands(answers, stop, rows):
    got = rows(survey.themed_words(answers, stop).where("word = 'expectations'"), "seniority", "CVENtime")
    assert got == [("5+", "1 year")] * 3


def test_misspelt_band_as_written(answers, rows):
    df = answers.select("seniority", "CVENtime")
    written = rows(X.band_tenures(df, mode="as_written"))
    assert written == [("1 year", "<6"), ("<6", None), (None, "1 year"), (None, "5+")]
    assert ("5+", "1 year") in rows(X.band_tenures(df))


def test_domain_words_keep_missing_word(spark):
    df = spark.createDataFrame([("driver",), (None,), ("x",)], "word STRING")
    assert sorted(str(r[0]) for r in X.without_words(df, ["driver"]).collect()) == ["None", "x"]


def test_recoded_stop_word_is_taken_out_of_the_cloud(spark, stop):
    recoded = spark.createDataFrame([("the", 9), ("pay", 5)], "word STRING, n BIGINT")
    assert [r["word"] for r in survey.cloud_words(recoded, stop).collect()] == ["pay"]


# --- sentiment ---------------------------------------------------------------
@pytest.fixture
def felt(spark):
    counts = spark.createDataFrame([("good", 6), ("bad", 3), ("odd", 2), ("none", 9), ("even", 1)], "word STRING, n BIGINT")
    lexicon = tables.small_table(
        spark,
        {"word": ["good", "bad", "odd", "odd", "never"], "sentiment": ["positive", "negative", "positive", "negative", "positive"]},
    )
    return X.sentiment_counts(counts, lexicon)


def test_word_in_both_sentiments_counts_in_both(felt, rows):
    assert rows(felt, "word", "sentiment", "n") == [
        ("bad", "negative", 3), ("good", "positive", 6), ("odd", "negative", 2), ("odd", "positive", 2),
    ]


def test_sentiment_matrix_fills_zero(felt, rows):
    assert rows(X.sentiment_matrix(felt)) == [("bad", 3, 0), ("good", 0, 6), ("odd", 2, 2)]


def test_comparative_terms(felt):
    got = [(r["word"], r["sentiment"], round(r["excess"], 9)) for r in X.comparative_terms(felt).collect()]
    # shares: negative bad 3/5 odd 2/5, positive good 6/8 odd 2/8
    assert got == [("good", "positive", 0.375), ("bad", "negative", 0.3), ("odd", "negative", 0.075)]
    assert X.comparative_terms(felt, k=1).count() == 1


def test_equal_shares_go_to_the_first_class(spark):
    df = spark.createDataFrame([("w", "negative", 2), ("w", "positive", 4)], "word STRING, sentiment STRING, n BIGINT")
    assert X.comparative_terms(df).first()["sentiment"] == "negative"


def test_long_text_is_read_to_its_end(spark):
    text = " ".join(["filler"] * 20000) + " last"
    df = spark.createDataFrame([(text,)], "whyleft STRING")
    got = {r["word"]: r["n"] for r in X.word_counts(X.explode_words(df, "whyleft")).collect()}
    assert got == {"filler": 20000, "last": 1}


@pytest.mark.parametrize("tracked", [8, 64, 1000, 10_000])
@pytest.mark.parametrize("k, min_freq", [(5, 3), (40, 1), (3000, 1)])
def test_top_words_equal_all_counts(spark, rows, tracked, k, min_freq):
    import random

    r = random.Random(5)
    words = [f"w{int(r.paretovariate(0.7)) % 4000}" for _ in range(20_000)] + [None] * 500
    df = spark.createDataFrame([(w,) for w in words], "word STRING").repartition(6)
    want = rows(X.top_terms(X.word_counts(df.where("word IS NOT NULL")), k, min_freq))
    assert rows(X.top_words(df, k, min_freq, tracked)) == want


def test_tracked_words_alone_are_shuffled(spark):
    df = spark.range(200_000).selectExpr("CASE WHEN id % 4 = 0 THEN concat('hot', id % 100) ELSE concat('w', id) END AS word")
    got = X.top_words(df, 10, 3, 2_000)
    assert got.count() == 10
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "approx_top_k" in plan and "BroadcastHashJoin" in plan
    assert X.top_words(df.limit(0)).collect() == []
