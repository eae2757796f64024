"""Why people left and what they liked: words, themes and sentiment."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline import constants as K
from stayline.operators import text as X

WHY_LEFT = "whyleft"
WHATS_GOOD = "whatsgood"


def answer_words(
    survey: DataFrame, question: str, stop_words: DataFrame, domain_words: Sequence[str] = tuple(K.DOMAIN_WORDS)
) -> DataFrame:
    """One row per word of an answer, without stop and domain words."""
    return X.without_words(X.without_stop_words(X.explode_words(survey, question), stop_words), domain_words)


def themed_words(
    survey: DataFrame,
    stop_words: DataFrame,
    domain_words: Sequence[str] = tuple(K.DOMAIN_WORDS),
    themes: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Words of the leaving reasons, recoded to themes, with tenure bands."""
    asked = survey.select(WHY_LEFT, "seniority", "CVENtime")
    return X.band_tenures(X.recode_themes(answer_words(asked, WHY_LEFT, stop_words, domain_words), themes))


def themed_counts(
    survey: DataFrame,
    stop_words: DataFrame,
    domain_words: Sequence[str] = tuple(K.DOMAIN_WORDS),
    themes: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """`themed_words` counted by word and bands.

    Words are counted before any is dropped or recoded: the stop words meet one
    row per word and band instead of every word of every answer.
    """
    asked = X.explode_words(survey.select(WHY_LEFT, "seniority", "CVENtime"), WHY_LEFT)
    counts = X.word_counts(X.band_tenures(asked), "seniority", "CVENtime")
    kept = X.without_stop_words(X.without_words(counts, domain_words), stop_words)
    return X.recode_themes(kept, themes).groupBy("word", "seniority", "CVENtime").agg(F.sum("n").alias("n"))


def popular_words(
    survey: DataFrame, question: str, stop_words: DataFrame, domain_words: Sequence[str] = tuple(K.DOMAIN_WORDS)
) -> DataFrame:
    return X.term_frequency(survey, question, stop_words, domain_words)


def reason_counts(
    survey: DataFrame,
    stop_words: DataFrame,
    domain_words: Sequence[str] = tuple(K.DOMAIN_WORDS),
    themes: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Counts of the leaving reasons after the theme recode."""
    return X.recode_counts(popular_words(survey, WHY_LEFT, stop_words, domain_words), themes)


def cloud_words(counts: DataFrame, stop_words: DataFrame, k: int = 50, min_freq: int = 3) -> DataFrame:
    """What a word cloud shows. Stop words are taken out once more, since a
    recode may have produced one."""
    return X.top_terms(X.without_stop_words(counts, stop_words), k, min_freq)


def cloud_words_of(
    survey: DataFrame, question: str, stop_words: DataFrame, domain_words: Sequence[str] = tuple(K.DOMAIN_WORDS), k: int = 50, min_freq: int = 3
) -> DataFrame:
    """The cloud of an answer that is not recoded, without counting all its words."""
    return X.top_words(answer_words(survey.select(question), question, stop_words, domain_words), k, min_freq)


def sentiment(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    return X.sentiment_counts(counts, lexicon)
