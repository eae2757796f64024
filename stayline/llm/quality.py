"""Quality rules as a short-circuit cascade.

Each rule reads one measure of a text and rejects on it. On a sample, every rule is tried on every text: its cost is the
time its measure takes, its selectivity the texts it rejects. The rules are then ordered by rejections per cost, each
counted among the texts that the rules before it leave over, and applied to all rows; a text leaves at its first
rejection and later measures are not taken. The order changes the cost, never the verdict.

Defined results: null and empty texts have no words and are rejected by `few_words`; repeated rows are judged one by one;
an empty table gives an empty table; other columns are carried along unread.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
#: Texts a worker takes from a batch at once.
TEXTS = 256
#: The sample that costs and selectivities are estimated on.
SAMPLE = 0.01


class Text:
    """One text; a measure is taken when first asked for and kept."""

    def __init__(self, text: str | None):
        self.text = text or ""

    def __getattr__(self, name: str):
        value = MEASURES[name](self)
        setattr(self, name, value)
        return value


def _repeated_words(t: Text) -> int:
    words = t.words
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found, marked = Counter(windows), bytearray(len(words))
    for i, window in enumerate(windows):
        if found[window] > 1:
            marked[i] = marked[i + 1] = marked[i + 2] = 1
    return sum(marked)


def _duplicate_lines(t: Text) -> int:
    lines = t.lines
    return len(lines) - len(set(lines))


MEASURES: dict[str, Callable[[Text], object]] = {
    "words": lambda t: t.text.encode("utf-8", "replace").split(),
    "n_words": lambda t: len(t.words),
    "word_chars": lambda t: len(t.text) - sum(t.text.count(c) for c in " \t\n\v\f\r"),
    "n_symbols": lambda t: sum(t.text.count(c) for c in SYMBOLS),
    "lines": lambda t: [x for x in t.text.split("\n") if x.strip(" \t\n\v\f\r")],
    "n_dup_lines": _duplicate_lines,
    "n_repeat_words": _repeated_words,
    "n_capitals": lambda t: sum(1 for w in (x.decode("utf-8", "replace") for x in t.words) if len(w) > 1 and w.isupper()),
    "n_marks": lambda t: t.text.count("!") + t.text.count("?"),
}


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    rejects: Callable[[Text], bool]


RULES = (
    Rule("few_words", "n_words", lambda t: t.n_words < 50),
    Rule("repeated_words", "n_repeat_words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
    Rule("symbols", "n_symbols", lambda t: 100 * t.n_symbols > 25 * t.n_words),
    Rule("duplicate_lines", "n_dup_lines", lambda t: 100 * t.n_dup_lines > 50 * len(t.lines)),
    Rule("word_length", "word_chars", lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
    Rule("capitals", "n_capitals", lambda t: 100 * t.n_capitals > 50 * t.n_words),
    Rule("marks", "n_marks", lambda t: 100 * t.n_marks > 50 * t.n_words),
)


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample: float = SAMPLE, seed: int = 11) -> list[Rule]:
    """The rules by rejections per cost, estimated on a Bernoulli sample of the rows.

    What reaches the driver is one row per combination of verdicts, 2 to the power of the rules at most. A sample without
    rows leaves the rules as given.
    """

    def trial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for value in batch[text]:
                verdicts, seconds = 0, []
                shared = Text(value)
                for i, rule in enumerate(rules):
                    start = time.perf_counter()
                    verdicts |= rule.rejects(shared) << i
                    seconds.append(time.perf_counter() - start)
                out.append((verdicts, seconds))
            yield pd.DataFrame(out, columns=["verdicts", "seconds"])

    tried = docs.select(text).sample(fraction=sample, seed=seed).mapInPandas(trial, "verdicts long, seconds array<double>")
    rows = tried.groupBy("verdicts").agg(F.count("*").alias("n"), *[F.sum(F.col("seconds")[i]).alias(f"s{i}") for i in range(len(rules))]).collect()
    if not rows:
        return list(rules)
    total = sum(r["n"] for r in rows)
    cost = [sum(r[f"s{i}"] for r in rows) / total + 1e-9 for i in range(len(rules))]
    left, order, remaining = rows, [], list(range(len(rules)))
    while remaining:
        rejected = {i: sum(r["n"] for r in left if r["verdicts"] >> i & 1) for i in remaining}
        best = max(remaining, key=lambda i: (rejected[i] / cost[i], -cost[i]))
        order.append(rules[best])
        remaining.remove(best)
        left = [r for r in left if not r["verdicts"] >> best & 1]
    return order


def cascade(docs: DataFrame, rules: list[Rule], text: str = "text", measures: tuple[str, ...] = ()) -> DataFrame:
    """All rows with `kept`, `rejected_by` (null if kept), `n_tried` (rules tried), and the measures asked for, as longs.

    Measures asked for are taken of every text; what the rules have measured already is not measured again.
    """
    from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

    added = [StructField("kept", BooleanType()), StructField("rejected_by", StringType()), StructField("n_tried", IntegerType())]
    added += [StructField(m, LongType()) for m in measures]
    carried = docs.drop(*[f.name for f in added])
    schema = StructType([*carried.schema.fields, *added])

    kinds = [pa.bool_(), pa.string(), pa.int32(), *[pa.int64()] * len(measures)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # other columns stay in the batch; texts become Python's a few at a time
            for part in (batch.slice(low, TEXTS) for low in range(0, batch.num_rows, TEXTS)):
                out = []
                for value in part.column(text):
                    t, by, n = Text(value.as_py()), None, 0
                    for n, rule in enumerate(rules, 1):
                        if rule.rejects(t):
                            by = rule.name
                            break
                    out.append((by is None, by, n, *(getattr(t, m) for m in measures)))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], schema.fieldNames())

    return carried.mapInArrow(judge, schema)


def filtered(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that no rule rejects, with the columns they came with."""
    judged = cascade(docs.select("doc_id", "text", *[c for c in docs.columns if c not in ("doc_id", "text")]), ordered(docs, rules))
    return judged.where("kept").select(*docs.columns)
