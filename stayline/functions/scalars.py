"""Column helpers for the dialect rules the operators depend on.

All of them return plain Catalyst expressions; nothing here runs Python per row.
"""

from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from stayline import constants as K
from stayline.sources.schemas import COLLATION


# --- constants and defaults --------------------------------------------------
def ntz(moment: date | datetime) -> Column:
    """A zone-free timestamp literal, whatever the session time zone is."""
    if not isinstance(moment, datetime):
        moment = datetime(moment.year, moment.month, moment.day)
    text = moment.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp_ntz")


MODES = ("as_written", "as_intended")


def as_written(mode: str) -> bool:
    """Whether a definition is taken by its letter; any mode but the two is an error."""
    if mode not in MODES:
        raise ValueError(f"mode is {mode!r}, not one of {', '.join(MODES)}")
    return mode == "as_written"


def moment_or_now(as_of: date | datetime | None) -> Column:
    return ntz(as_of) if as_of is not None else F.localtimestamp()


def if_null(col: Column, default, dtype: str) -> Column:
    """ISNULL: the replacement takes the type of the checked column."""
    return F.coalesce(col, F.lit(default).cast(dtype))


# --- arithmetic --------------------------------------------------------------
def int_div(a: Column, b: Column) -> Column:
    """Whole-number division, truncating toward zero."""
    return F.call_function("div", a, b)


def wide_div(a: Column, b: Column) -> Column:
    """Whole-number division of counts that may not fit a BIGINT."""
    a = a.cast("decimal(38,0)")
    return ((a - a % b) / b).cast("decimal(38,0)")


def int_avg(col: Column, divide: Callable[[Column, Column], Column] = int_div) -> Column:
    """Average of an integer column, truncated as integer dialects do."""
    n = F.count(col)
    return divide(F.sum(col), F.when(n > 0, n))


def ratio_if_positive(
    a: Column, b: Column, divide: Callable[[Column, Column], Column] | None = None
) -> Column:
    """a / b where both are positive, otherwise 0; by the given division."""
    quotient = a / b if divide is None else divide(a, b)
    return F.when((a > 0) & (b > 0), quotient).otherwise(F.lit(0))


# --- dates -------------------------------------------------------------------
def months_before(moment: Column, months: int) -> Column:
    """Shift back by whole months, keeping the time of day and clamping the day."""
    return moment - F.make_ym_interval(F.lit(0), F.lit(months))


def month_boundaries(start: Column, end: Column) -> Column:
    """Number of month starts crossed between two moments."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def day_boundaries(start: Column, end: Column) -> Column:
    """Number of midnights crossed between two moments."""
    return F.datediff(end.cast("date"), start.cast("date"))


def shift_hours(moment: Column, hours: Column) -> Column:
    return moment + F.expr("INTERVAL '1' HOUR") * hours.cast("int")


def hours_between(start: Column, end: Column) -> Column:
    """Elapsed hours, fractions kept.

    Taken from the interval between the zone-free times: the built-in
    differences would read both on the session's clock and its summer time.
    """
    gap = end - start
    part = {unit: F.extract(F.lit(unit), gap).cast("double") for unit in ("DAY", "HOUR", "MINUTE", "SECOND")}
    return part["DAY"] * 24 + part["HOUR"] + part["MINUTE"] / 60 + part["SECOND"] / 3600


def monday_of(moment: Column) -> Column:
    """Start of the ISO week, computed on dates so no time zone is involved."""
    day = moment.cast("date")
    return F.date_sub(day, F.weekday(day)).cast("timestamp_ntz")


# --- text --------------------------------------------------------------------
def trim_ws(col: Column) -> Column:
    """Trim blanks, tabs and line ends (the SQL trim only removes blanks)."""
    return F.btrim(col, F.lit(" \t\r\n"))


def code(col: Column) -> Column:
    """A code that compares without case and end blanks, whatever type it came with."""
    return F.collate(col, COLLATION)


def code_key(col: Column) -> Column:
    """One plain spelling for all spellings of a code, to group by.

    Grouping by a collated column sorts the rows first; equal spellings of plain text are hashed.
    """
    return F.lower(F.rtrim(col)).cast("string")


def text_key(col: Column, numeric: bool = False) -> Column:
    """Ids as text without a fraction: 12, 12.0 and '12.0' all give '12'; what is no number gives NULL."""
    if numeric:
        return col.try_cast("bigint").cast("string")
    return F.regexp_replace(col.cast("string"), r"\.0+$", "")


def joined_name(first: Column, last: Column) -> Column:
    """'first last', UNKNOWN as soon as one part is missing."""
    return F.coalesce(F.concat(first, F.lit(" "), last), F.lit("UNKNOWN"))


def lacks(col: Column, part: str) -> Column:
    """Does not contain `part`; a missing value counts as not containing it."""
    return F.coalesce(~F.contains(col, F.lit(part)), F.lit(True))


TOKEN_PATTERN = r"[\p{L}\p{N}_]+(?:['’.][\p{L}\p{N}_]+|,\p{N}+)*"


def words_of(text: Column) -> Column:
    """Lower-cased words of a text; don't, 3.5 and 1,000 stay whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


# The default word boundaries of Unicode (UAX 29): fixed values, the classes of characters by name.
_MARKS = r"\p{M}\p{Cf}"
#: Between letters; between digits. Both hold the dots and single quotes.
_BOTH = r"'.\x{2018}\x{2019}\x{2024}\x{FE52}\x{FF07}\x{FF0E}"
MID_LETTER = r":\x{B7}\x{387}\x{55F}\x{5F4}\x{2027}\x{FE13}\x{FE55}\x{FF1A}" + _BOTH
MID_NUMBER = r",;\x{37E}\x{589}\x{60C}\x{60D}\x{66C}\x{7F8}\x{2044}\x{FE10}\x{FE14}\x{FE50}\x{FE54}\x{FF0C}\x{FF1B}" + _BOTH
#: Scripts without blanks between words, in which each character stands alone; a run of the last one is a word.
_ALONE = ["Han", "Hiragana", "Thai", "Lao", "Khmer", "Myanmar"]
_KATAKANA = r"\x{30FC}\x{FF70}"


def word_classes(script: Callable[[str], str]) -> dict[str, str]:
    """Insides of the character classes of the word rules; `script` writes the class of a script."""
    alone = "".join(script(s) for s in _ALONE)
    kana = script("Katakana") + _KATAKANA
    return {"letter": rf"^\P{{L}}{alone}{kana}", "alone": alone, "kana": kana}


_JAVA = word_classes(lambda s: rf"\p{{Is{s}}}")
_LETTER, _DIGIT, _JOIN = f"[{_JAVA['letter']}]", r"\p{Nd}", r"\p{Pc}"
#: A mark between two words' characters that does not join them: one that has not the same kind on both sides.
LOOSE_MARK = (
    rf"(?!(?<={_LETTER}[{_MARKS}]{{0,9}})[{MID_LETTER}](?=[{_MARKS}]*{_LETTER})"
    rf"|(?<={_DIGIT}[{_MARKS}]{{0,9}})[{MID_NUMBER}](?=[{_MARKS}]*{_DIGIT}))[{MID_LETTER}{MID_NUMBER}]"
)
#: With only joining marks left, words are runs of one class, which no pattern has to go back in.
UNICODE_WORD = (
    rf"[{_LETTER}{_DIGIT}{_JOIN}][{_LETTER}{_DIGIT}{_JOIN}{_MARKS}{MID_LETTER}{MID_NUMBER}]*"
    rf"|[{_JAVA['kana']}][{_JAVA['kana']}{_MARKS}]*|[{_JAVA['alone']}][{_MARKS}]*"
)


def unicode_words(text: Column) -> Column:
    """Lower-cased words by the default Unicode word boundaries, without punctuation, symbols and emoji.

    Letters, digits and connectors hang together, letters across one apostrophe, dot or middle dot, digits across one
    comma or dot; combining marks go with what they stand on. Han, Hiragana and South-East Asian characters are words by
    themselves, as the rules have it without a dictionary; Katakana runs are words. More than nine marks on the
    character in front of a joining mark part the word there.
    """
    bare = F.regexp_replace(F.lower(text), F.lit(LOOSE_MARK), F.lit(" "))
    return F.regexp_extract_all(bare, F.lit(UNICODE_WORD), F.lit(0))


# --- recoding ----------------------------------------------------------------
# Built as one SQL text per expression: the code lists are long, and a text is
# one call where a chain of column objects is one per code.
def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_list(name: str, values: Sequence[str], collation: str = "") -> str:
    """SQL test that a column holds one of the values."""
    column = f"`{name}` COLLATE {collation}" if collation else f"`{name}`"
    return f"{column} IN ({', '.join(quoted(v) for v in values)})"


def first_match(name: str, groups: Mapping[str, Sequence[str]], default: str, collation: str = "") -> str:
    """SQL label of the group whose code list holds the column's value, compared by a collation if one is given."""
    arms = " ".join(f"WHEN {in_list(name, codes, collation)} THEN {quoted(label)}" for label, codes in groups.items() if codes)
    return f"CASE {arms} ELSE {default} END" if arms else default


def driver_class(name: str) -> Column:
    # OTR is both a listed class and the fallback, so only the others need a test
    listed = {k: v for k, v in K.DRIVER_CLASSES.items() if k != K.DEFAULT_DRIVER_CLASS}
    return F.expr(first_match(name, listed, quoted(K.DEFAULT_DRIVER_CLASS), COLLATION))


def pay_bucket(name: str) -> Column:
    """Bucket of a pay code; NULL for a missing code, which is in no bucket."""
    listed = first_match(name, K.PAY_BUCKETS, quoted(K.OTHER_BUCKET))
    return F.expr(f"CASE WHEN `{name}` IS NOT NULL THEN {listed} END")


def theme_of(name: str, themes: Mapping[str, Sequence[str]]) -> Column:
    """Theme a word belongs to; the word itself when it has none."""
    return F.expr(first_match(name, themes, f"`{name}`"))


def band(value: Column, edges: Sequence[tuple[int, str]], above: str, null: str | None = None) -> Column:
    """Label of the first band whose inclusive upper edge covers the value."""
    expr = F.when(value.isNull(), F.lit(null).cast("string"))
    for edge, label in edges:
        expr = expr.when(value <= edge, label)
    return expr.otherwise(above)


def profile_tenure(months: Column) -> Column:
    return band(months, K.PROFILE_TENURE, K.PROFILE_TENURE_ABOVE, K.PROFILE_TENURE_NULL)


def survey_tenure(months: Column) -> Column:
    return band(months, K.SURVEY_TENURE, K.SURVEY_TENURE_ABOVE)


def relabel(name: str, labels: Mapping[int, str]) -> str:
    """SQL label of an integer code; a code without a label stays, as text."""
    arms = " ".join(f"WHEN {value} THEN {quoted(label)}" for value, label in labels.items())
    return f"CASE `{name}` {arms} ELSE CAST(`{name}` AS STRING) END"


def dependents_band(name: str, mode: str = "as_intended") -> str:
    """SQL for dependants to none / 1 / 2+ (the person's own row is counted).

    As written, 9 and everything above 10 were forgotten and stay numbers.
    """
    listed = relabel(name, K.DEPENDENT_LABELS)
    return listed if as_written(mode) else f"CASE WHEN `{name}` >= 3 THEN '2+' ELSE {listed} END"
