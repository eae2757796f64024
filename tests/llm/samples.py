"""Small documents with the cases every operator must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, print string, size int, copy int, score string, kept string"


def prose(seed, words, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(words))


def documents(spark, extra=()):
    """Null, empty, blank, one-word, very long, repeated and near texts; null ids and sources; clashing extra columns."""
    long = prose(1, 30_000, 5_000)
    near = prose(2, 200)
    rows = [
        (0, None), (1, ""), (2, " \t\n "), (3, "Word"), (4, long), (5, prose(3, 120)), (6, prose(3, 120)), (6, prose(3, 120)),
        (7, near), (8, near + " tail"), (9, near.upper()), (10, "ünïcødé  x \u0085y ß \U0001f600 end"), (None, prose(4, 80)), (None, None),
        (11, prose(5, 60) + "\n" + prose(6, 60)), (12, "a b c d"), (13, "a b c d e"), (14, "word"),
    ]
    rows = [(i, t, "en", None if k % 5 == 4 else f"s{k % 3}", len(t or ""), "p", 1, 1, "s", "k") for k, (i, t) in enumerate([*rows, *extra])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
