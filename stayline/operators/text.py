"""Survey answers: words, themes and sentiment."""

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline import constants as K
from stayline.functions import scalars as S
from stayline.operators.ordering import numbered


#: Words that are tracked for the most frequent ones; a bound on the share of an untracked word, times their number.
TRACKED, UNTRACKED = 10_000, 3.5


# --- words -------------------------------------------------------------------
def explode_words(df: DataFrame, text: str, words: Callable[[Column], Column] = S.words_of) -> DataFrame:
    """One row per word; the text column goes, the others stay.

    Texts without a word, or missing, give no row. `words`: what a word is, `S.words_of` or `S.unicode_words`.
    """
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.explode(words(F.col(text))).alias("word"))


def without_words(df: DataFrame, words: Sequence[str]) -> DataFrame:
    """Drop the listed words; a missing word stays."""
    return df.where(f"coalesce(NOT {S.in_list('word', words)}, true)") if words else df


def without_stop_words(df: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Drop every word of the list, by anti join on the word.

    Not hinted: Spark broadcasts the list when its size allows. Where only
    counts are wanted, `term_frequency` joins after counting, so that each word
    is one row and no frequent word weighs on the join.
    """
    return df.join(stop_words.select("word"), "word", "left_anti")


# --- counts ------------------------------------------------------------------
def word_counts(words: DataFrame, *by: str) -> DataFrame:
    return words.groupBy("word", *by).agg(F.count(F.lit(1)).alias("n"))


def by_frequency(counts: DataFrame) -> DataFrame:
    rest = [c for c in counts.columns if c not in ("word", "n")]
    return counts.orderBy(F.desc("n"), "word", *rest)


def term_counts(
    df: DataFrame, text: str, stop_words: DataFrame, domain_words: Sequence[str] = ()
) -> DataFrame:
    """Words of a text column with their counts, without stop and domain words.

    Dropping a word before or after counting is the same; counting first
    leaves one row per word to join.
    """
    counts = word_counts(explode_words(df.select(text), text))
    return without_stop_words(without_words(counts, domain_words), stop_words)


def term_frequency(
    df: DataFrame, text: str, stop_words: DataFrame, domain_words: Sequence[str] = ()
) -> DataFrame:
    """`term_counts`, the most frequent words first."""
    return by_frequency(term_counts(df, text, stop_words, domain_words))


def numbered_by_frequency(counts: DataFrame, rarest_first: bool = False) -> DataFrame:
    """Counts with their place (`order`) among all words: by count, the word deciding ties."""
    rest = [F.col(c) for c in counts.columns if c not in ("word", "n")]
    return numbered(counts, [F.col("n") if rarest_first else -F.col("n"), F.col("word"), *rest])


def frequent_terms(counts: DataFrame, above: int = 10) -> DataFrame:
    """Words counted more than `above` times, rarest first as on a bar chart."""
    return counts.where(F.col("n") > above).orderBy("n", "word")


def top_terms(counts: DataFrame, k: int = 50, min_freq: int = 3) -> DataFrame:
    """The k most frequent words that occur at least min_freq times."""
    return counts.where(F.col("n") >= min_freq).orderBy(F.desc("n"), "word").limit(k)


def top_words(words: DataFrame, k: int = 50, min_freq: int = 3, tracked: int = TRACKED) -> DataFrame:
    """The k most frequent words of rows of words, as `top_terms` of all counts has them, without counting all words.

    A sketch of fixed size first tracks the words that may be frequent: one that it does not track occurs in less than
    `UNTRACKED / tracked` of the rows. The tracked ones alone are then counted, so what is shuffled does not grow with the
    vocabulary. Where the k-th count does not lie above what an untracked word may reach, all words are counted after all;
    else that branch reads rows and keeps none.
    """
    words = words.select("word").where("word IS NOT NULL")
    top = words.agg(F.call_function("approx_top_k", F.col("word"), F.lit(tracked), F.lit(tracked)).alias("top"), F.count(F.lit(1)).alias("rows"))
    likely = top.select(F.explode("top.item").alias("word"))
    best = top_terms(word_counts(words.join(F.broadcast(likely), "word", "left_semi")), k, min_freq)
    # what an untracked word would have to exceed to be among them
    least = best.agg(F.when(F.count(F.lit(1)) >= k, F.min("n")).otherwise(F.lit(min_freq - 1))).scalar()
    certain = top.select(F.col("rows") * (UNTRACKED / tracked)).scalar() < least
    every = top_terms(word_counts(words.where(~certain)), k, min_freq)
    return best.where(certain).unionByName(every)


# --- themes ------------------------------------------------------------------
def recode_themes(df: DataFrame, themes: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Replace the words of a theme by its name; other words stay."""
    themes = K.THEMES if themes is None else themes
    return df.withColumn("word", S.theme_of("word", themes))


def recode_counts(counts: DataFrame, themes: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Theme recode of a count table: one lookup per word, counts added up."""
    return recode_themes(counts, themes).groupBy("word").agg(F.sum("n").alias("n"))


def band_tenures(df: DataFrame, mode: str = "as_intended") -> DataFrame:
    """Tenure in the trade and in the company as bands.

    As written, a misspelt column leaves the longest tenures in the trade
    without a band.
    """
    trade = S.survey_tenure(F.col("seniority"))
    if S.as_written(mode):
        trade = F.when(F.col("seniority") <= K.SURVEY_TENURE[-1][0], trade)
    return df.withColumns({"seniority": trade, "CVENtime": S.survey_tenure(F.col("CVENtime"))})


# --- sentiment ---------------------------------------------------------------
def sentiment_counts(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Counts per word and sentiment; a word listed under two counts in both."""
    return by_frequency(counts.join(lexicon.select("word", "sentiment"), "word"))


def sentiment_matrix(by_sentiment: DataFrame, sentiments: Sequence[str] = tuple(K.SENTIMENTS)) -> DataFrame:
    """One row per word, one column per sentiment, 0 where there is none."""
    return (
        by_sentiment.groupBy("word")
        .pivot("sentiment", list(sentiments))
        .agg(F.sum("n"))
        .na.fill(0, list(sentiments))
    )


def comparative_terms(
    by_sentiment: DataFrame, sentiments: Sequence[str] = tuple(K.SENTIMENTS), k: int = 100
) -> DataFrame:
    """Words by how far their share in one class exceeds their mean share.

    Each word goes to the class in which it exceeds most, the first on a tie.
    The class totals are one row per listed sentiment, which bounds what is
    broadcast; no window gathers the words of a class.
    """
    counted = by_sentiment.where(F.col("sentiment").isin(list(sentiments)))
    totals = counted.groupBy("sentiment").agg(F.sum("n").alias("total"))
    shares = (
        counted.join(F.broadcast(totals), "sentiment")
        .withColumn("share", F.col("n").cast("double") / F.col("total").cast("double"))
        .groupBy("word")
        .pivot("sentiment", list(sentiments))
        .agg(F.sum("share"))
        .na.fill(0.0, list(sentiments))
    )
    mean = sum((F.col(s) for s in sentiments[1:]), F.col(sentiments[0])) / F.lit(float(len(sentiments)))
    over = shares.select("word", *[(F.col(s) - mean).alias(s) for s in sentiments])
    best = F.greatest(*[F.col(s) for s in sentiments]) if len(sentiments) > 1 else F.col(sentiments[0])
    named = None
    for s in sentiments:
        test = F.col(s) == best
        named = F.when(test, s) if named is None else named.when(test, s)
    return (
        over.select("word", named.alias("sentiment"), best.alias("excess"))
        .orderBy(F.desc("excess"), "word")
        .limit(k)
    )
