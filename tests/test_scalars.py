from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from stayline.functions import scalars as S


@pytest.fixture
def one(spark):
    row = spark.range(1)

    def value(col):
        return row.select(col.alias("v")).first()[0]

    return value


def ts(*args):
    return S.ntz(datetime(*args))


def test_months_before_keeps_time_and_clamps_day(one):
    assert one(S.months_before(ts(2018, 8, 31, 13, 45), 6)) == datetime(2018, 2, 28, 13, 45)


@pytest.mark.parametrize(
    "start, end, months",
    [((2000, 1, 31), (2000, 2, 1), 1), ((2000, 1, 1), (2000, 1, 31), 0), ((1999, 12, 31), (2001, 1, 1), 13)],
)
def test_month_boundaries(one, start, end, months):
    assert one(S.month_boundaries(ts(*start), ts(*end))) == months


def test_day_boundaries_count_midnights(one):
    assert one(S.day_boundaries(ts(2000, 1, 1, 23, 59), ts(2000, 1, 2, 0, 1))) == 1


def test_literal_ignores_session_zone(spark, one):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert one(S.ntz(date(2018, 1, 1))) == datetime(2018, 1, 1)
        assert one(S.monday_of(ts(2018, 3, 11, 2, 30))) == datetime(2018, 3, 5)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_shift_hours(one):
    assert one(S.shift_hours(ts(2018, 1, 1, 1), F.lit(6) - 4)) == datetime(2018, 1, 1, 3)
    assert one(S.shift_hours(ts(2018, 1, 1, 1), F.lit(2) - 4)) == datetime(2017, 12, 31, 23)


def test_hours_between_keeps_fraction(one):
    assert one(S.hours_between(ts(2018, 1, 1, 0), ts(2018, 1, 1, 1, 30))) == 1.5
    assert one(S.hours_between(ts(2018, 1, 2, 0), ts(2018, 1, 1, 22, 0))) == -2
    assert one(S.hours_between(ts(2018, 1, 1, 0), ts(2018, 1, 3, 0, 0, 36))) == pytest.approx(48.01)


def test_hours_between_ignores_summer_time(spark, one):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert one(S.hours_between(ts(2018, 3, 11, 0), ts(2018, 3, 11, 6))) == 6
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_integer_division_truncates(one):
    assert one(S.int_div(F.lit(7), F.lit(2))) == 3
    assert one(S.int_div(F.lit(-7), F.lit(2))) == -3


def test_int_avg(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "n INT")
    assert df.select(S.int_avg(F.col("n"))).first()[0] == 1


def test_wide_division_is_exact(one):
    big = 10**30 + 5
    assert one(S.wide_div(F.lit(str(big)), F.lit(7))) == big // 7
    assert one(S.wide_div(F.lit(6), F.lit(7))) == 0


def test_int_avg_of_nothing_is_missing(spark):
    df = spark.createDataFrame([(None,)], "n INT")
    assert df.select(S.int_avg(F.col("n"))).first()[0] is None


@pytest.mark.parametrize(
    "a, b, divide, want", [(7, 2, S.int_div, 3), (7, 2, S.wide_div, 3), (7, 2, None, 3.5), (7, 0, None, 0), (0, 2, S.int_div, 0)]
)
def test_ratio_if_positive(one, a, b, divide, want):
    assert one(S.ratio_if_positive(F.lit(a), F.lit(b), divide)) == want


def test_ratio_of_missing_is_zero(one):
    assert one(S.ratio_if_positive(F.lit(3), F.lit(None).cast("int"))) == 0


def test_trim_ws_takes_tabs_and_line_ends(one):
    assert one(S.trim_ws(F.lit("\t D 1 \r\n"))) == "D 1"


@pytest.mark.parametrize("value, numeric, want", [(12.0, True, "12"), (12, True, "12"), ("12.0", False, "12"), ("A1", False, "A1")])
def test_text_key(one, value, numeric, want):
    assert one(S.text_key(F.lit(value), numeric)) == want


def test_joined_name(one):
    assert one(S.joined_name(F.lit("A"), F.lit("B"))) == "A B"
    assert one(S.joined_name(F.lit(None).cast("string"), F.lit("B"))) == "UNKNOWN"


def test_lacks_keeps_missing(one):
    assert one(S.lacks(F.lit("xUNKx"), "UNK")) is False
    assert one(S.lacks(F.lit(None).cast("string"), "UNK")) is True


TENURES = [0, 6, 7, 12, 13, 24, 25, 60, 61, None]


def test_tenure_bands(spark):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(TENURES)], "i INT, m INT").orderBy("i")
    got = [tuple(r) for r in df.select(S.profile_tenure(F.col("m")), S.survey_tenure(F.col("m"))).collect()]
    assert [g[0] for g in got] == [
        "6 months", "6 months", "6m- 1 year", "6m- 1 year", "1-2 years", "1-2 years", "2-5", "2-5", "5+", "UNKNOWN",
    ]
    assert [g[1] for g in got] == [
        "<6", "<6", "1 year", "1 year", "2 year", "2 year", "2-5 years", "2-5 years", "5+", None,
    ]


def test_dependents_band_modes(spark):
    df = spark.createDataFrame([(n,) for n in [0, 1, 2, 3, 8, 9, 10, 11]], "n BIGINT").coalesce(1)
    got = df.select(F.expr(S.dependents_band("n")), F.expr(S.dependents_band("n", "as_written"))).collect()
    assert [r[0] for r in got] == ["UNKNOWN", "none", "1", "2+", "2+", "2+", "2+", "2+"]
    assert [r[1] for r in got] == ["UNKNOWN", "none", "1", "2+", "2+", "9", "2+", "11"]


def test_relabel_keeps_unlabelled(spark):
    df = spark.createDataFrame([(1,), (9,)], "c INT").coalesce(1)
    assert [r[0] for r in df.select(F.expr(S.relabel("c", {1: "it's"}))).collect()] == ["it's", "9"]


def test_words_of(one):
    text = "Don't stop, it’s 3.5 or 1,000 home-time a_b É. x,y  'quoted'"
    assert one(S.words_of(F.lit(text))) == [
        "don't", "stop", "it’s", "3.5", "or", "1,000", "home", "time", "a_b", "é", "x", "y", "quoted",
    ]
    assert one(S.words_of(F.lit(""))) == []


def test_ids_that_are_no_number(spark):
    df = spark.createDataFrame([(12.0,), (float("nan"),), (None,)], "id DOUBLE")
    assert [r[0] for r in df.select(S.text_key(F.col("id"), True)).collect()] == ["12", None, None]


def test_unknown_mode_is_refused():
    with pytest.raises(ValueError, match="typo"):
        S.as_written("typo")


@pytest.mark.parametrize(
    "text, words",
    [
        ("Can’t o'clock l·l", ["can’t", "o'clock", "l·l"]),
        ("rock''n'roll 'x' y.", ["rock", "n'roll", "x", "y"]),
        ("3.5 1,000 1;2 1'000", ["3.5", "1,000", "1;2", "1'000"]),
        ("a.5 5.a a,b 1:2 a:b", ["a", "5", "5", "a", "a", "b", "1", "2", "a:b"]),
        ("a1b2.c3 v1.2b x_y _", ["a1b2", "c3", "v1.2b", "x_y", "_"]),
        ("a1.b a.1b e.g. a_.b", ["a1", "b", "a", "1b", "e.g", "a_", "b"]),
        ("日本 テスト ガッコー かな", ["日", "本", "テスト", "ガッコー", "か", "な"]),
        ("word中2 한국어", ["word", "中", "2", "한국어"]),
        ("café é'é co­op", ["café", "é'é", "co­op"]),
        ("\U0001f600 \U0001f468‍\U0001f469 x\U0001f600y", ["x", "y"]),
        ("", []),
        (" ’ . , ", []),
    ],
)
def test_unicode_words(spark, text, words):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.select(S.unicode_words(F.col("t"))).first()[0] == words


def test_very_long_words_do_not_overflow(spark):
    df = spark.range(1).select(F.expr("repeat('a1', 300000)").alias("a"), F.expr("repeat('a.', 300000)").alias("b"), F.expr("repeat('é', 300000)").alias("c"))
    got = df.select(*[F.transform(S.unicode_words(F.col(c)), F.length).alias(c) for c in "abc"]).first()
    assert got["a"] == [600000] and got["b"] == [599999] and got["c"] == [600000]
