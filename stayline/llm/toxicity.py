"""Toxicity by a weighted finite-state grammar of clauses.

Five transducers read the words of a clause as symbols: what a word can be in a pattern (`SYMBOLS`).

* insult: emits the weight of an insulting word, more after an address ("you are such a ...") or a compound's head
  ("son of a ...") a few words before;
* threat: emits a phrase's weight when intent, harm and target have come within a few words, in any order
  ("I will hurt you", "werde dich verletzen"); none of its words need weigh anything;
* negation and reported speech: scale what is emitted within a few words of a negation, and until a report's clause
  ends or its quotation closes;
* target: scales a clause that names the second person.

Each is a table of states. They are composed into one machine (`composed`), whose states are the reachable tuples of
theirs, and this one alone is run. A text is scored by its matched clauses, not by its words as such: the strongest, the sum,
how many of all clauses they are, and the threats that are phrases.

Which words insult is learned: an acceptor of word beginnings and whole words gives each its log odds between toxic and other
texts, kept where a likelihood-ratio test finds it far from chance and no longer beginning explains it better; a word has the
weight of the strongest beginning that accepts it. A logistic curve over the clause features gives the score; its weights
are fitted on features from which each training text's own contribution to the acceptor has been taken out.

Both are fitted on about SAMPLE labelled texts at most, chosen by a hash of the id. Nothing but the text enters a score.

Defined results: null and empty texts have no clause and get the curve's value at zero; repeated rows are scored one by one;
rows with a null id are scored, not learned from; of several labels of one id the highest counts, null labels are left
out; without labels of both kinds every score is 0; an empty table gives an empty table; other columns are carried unread.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled texts to learn from (expected number, if there are more) and beginnings to keep, at most.
SAMPLE, ACCEPTED = 20_000, 50_000
#: Words that a negation, an address or a begun threat reaches; factors; weight of a threat that is a phrase.
#: Lengths of word beginnings; least toxic texts with one; least log odds; chance beginnings to be expected, as a log.
LENGTHS, SUPPORT, ODDS, CHANCE = (3, 4, 5, 6, 7), 4, 2.0, -3.0
#: Raw tokens a worker remembers the weight of; texts it takes from a batch at once.
REMEMBERED, TEXTS = 100_000, 256
NEAR = 3
NEGATED, REPORTED, AIMED, ADDRESSED, PHRASE = 0.4, 0.6, 1.25, 1.2, 3.0
THRESHOLD = 0.3

THREATS = {w: 3.0 for w in "kill murder shoot stab strangle tuer étrangler töten umbringen erschießen matar".split()}
HARMS = set(THREATS) | set("hurt harm beat burn break hang smash punch choke drown stabbing frapper blesser brûler pendre battre crever verletzen schlagen verbrennen hängen herir golpear quemar pegar ahorcar".split())
INTENTS = set("will gonna going shall must should want i'll we'll ought werde werden wird will sollte muss müsste vais va allons veux doit devrait voy vamos quiero debe debería".split())
HEADS = set("son daughter piece bunch pack fils fille sac bande tas stück haufen sohn pedazo hijo hija montón".split())
TARGETS = set("you your yours yourself u tu te toi vous ton votre du dich dir dein deine ihr euch usted ustedes ti tus".split())
NEGATIONS = set("not never no don't isn't aren't wasn't won't can't cannot ne pas jamais nicht nie kein keine nunca jamás".split())
REPORTS = set("said says say called calls claimed wrote quoted according dit disait déclare sagte sagt nannte dijo dice llamó".split())

_CLAUSE = re.compile(r"[^.!?;:\n|]+")
_QUOTES = "\"“”„«»"
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def bare(token: str) -> str:
    return _EDGES.sub("", token.lower())


def beginnings(word: str) -> list[str]:
    """What may accept a word: its beginnings, and `=` with all of it."""
    return [word[:k] for k in LENGTHS if len(word) >= k] + ["=" + word] if word else []


def least_ratio(tried: int) -> float:
    """The likelihood ratio that leaves exp(CHANCE) chance beginnings among those tried."""
    return 2 * (math.log(max(1, tried)) - CHANCE)


def log_odds(t: float, n: float, toxic: int, other: int, least: float) -> float:
    """Weight of a beginning in t of the toxic and n of the other texts; 0 where chance may explain it."""
    if t < SUPPORT:
        return 0.0
    p, q, both = t / toxic, n / other, (t + n) / (toxic + other)
    if p <= q:
        return 0.0

    def fit(k: float, size: int, rate: float) -> float:
        return (k * math.log(rate) if k else 0.0) + ((size - k) * math.log1p(-rate) if size > k else 0.0)

    ratio = 2 * (fit(t, toxic, p) + fit(n, other, q) - fit(t, toxic, both) - fit(n, other, both))
    odds = math.log((t + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (other + 1))
    return odds if ratio >= least and odds >= ODDS else 0.0


def loose(counts: dict[str, tuple[int, int]]) -> set[str]:
    """Beginnings whose toxic texts nearly all come from a longer one that other texts show more rarely: the longer one says it all."""
    found = set()
    for part, (t, n) in counts.items():
        word = part.removeprefix("=")
        for k in LENGTHS:
            if word[:k] in counts and word[:k] != part:
                above_t, above_n = counts[word[:k]]
                if n < above_n and t >= 0.9 * above_t:
                    found.add(word[:k])
    return found


#: What a word can be, as bits of a symbol.
SYMBOLS = ("negation", "report", "target", "intent", "harm", "insult", "head", "opens", "closes")
_BIT = {name: 1 << i for i, name in enumerate(SYMBOLS)}
_WORDS = {"negation": NEGATIONS, "report": REPORTS, "target": TARGETS, "intent": INTENTS, "harm": HARMS, "head": HEADS}


@dataclass(frozen=True)
class Machine:
    """A table of states: reads some of a symbol's bits; for each state and combination of these, the next state and a number.

    The number scales what is emitted (`scales`) or is emitted itself; `final` scales all of a clause by the state it ends in.
    """

    reads: tuple[str, ...]
    table: dict[tuple[object, tuple[bool, ...]], tuple[object, float]]
    start: object = 0
    scales: bool = True
    final: dict[object, float] = field(default_factory=dict)

    def step(self, state, symbol: int) -> tuple[object, float]:
        return self.table[state, tuple(bool(symbol & _BIT[name]) for name in self.reads)]


def _combinations(names: tuple[str, ...]) -> list[tuple[bool, ...]]:
    return list(itertools.product((False, True), repeat=len(names)))


def negation() -> Machine:
    """State: words left that the last negation reaches."""
    table = {(s, (n,)): (NEAR if n else max(0, s - 1), NEGATED if s else 1.0) for s in range(NEAR + 1) for n in (False, True)}
    return Machine(("negation",), table)


def report() -> Machine:
    """State: whether speech is reported. A quotation mark opens it for its own word, and closes it behind its word."""
    reads = ("opens", "report", "closes")
    table = {(s, c): (int((s or c[0] or c[1]) and not c[2]), REPORTED if s or c[0] else 1.0) for s in (0, 1) for c in _combinations(reads)}
    return Machine(reads, table)


def target() -> Machine:
    """State: whether the second person has been named."""
    return Machine(("target",), {(s, (t,)): (int(s or t), 1.0) for s in (0, 1) for t in (False, True)}, final={1: AIMED})


def insult() -> Machine:
    """State: words left in which an insult is addressed, or the rest of a compound."""
    reads = ("target", "head", "insult")
    table = {(s, c): (NEAR if c[0] or c[1] else max(0, s - 1), (ADDRESSED if s else 1.0) if c[2] else 0.0) for s in range(NEAR + 1) for c in _combinations(reads)}
    return Machine(reads, table)


def threat() -> Machine:
    """State: words left for a phrase that has begun, and which of intent, harm and target it has; the last one emits PHRASE."""
    reads = ("intent", "harm", "target")
    table = {}
    states = [(0, frozenset())] + [(left, frozenset(has)) for left in range(1, NEAR + 2) for k in (1, 2) for has in itertools.combinations(reads, k)]
    for state in states:
        for c in _combinations(reads):
            new = {name for name, there in zip(reads, c) if there}
            has = (state[1] if state[0] else frozenset()) | new
            left = NEAR + 1 if new else state[0] - 1
            if len(has) == 3:
                table[state, c] = (0, frozenset()), PHRASE
            elif left <= 0 or not has:
                table[state, c] = (0, frozenset()), 0.0
            else:
                table[state, c] = (left, frozenset(has)), 0.0
    return Machine(reads, table, start=(0, frozenset()), scales=False)


def machines() -> tuple[Machine, ...]:
    return insult(), threat(), negation(), report(), target()


class Composed(dict):
    """One machine for all five. By state times number of symbols plus symbol: the next state (times number of symbols), what
    a word's weight is scaled by, and what is emitted besides. The product is taken lazily, as far as texts reach it."""

    symbols = 1 << len(SYMBOLS)

    def __init__(self):
        super().__init__()
        self.parts = machines()
        start = tuple(m.start for m in self.parts)
        self.states, self.numbers = [start], {start: 0}

    def __missing__(self, at: int) -> tuple[int, float, float]:
        number, symbol = divmod(at, self.symbols)
        moves = [m.step(s, symbol) for m, s in zip(self.parts, self.states[number])]
        to = tuple(s for s, _ in moves)
        if to not in self.numbers:
            self.numbers[to] = len(self.states)
            self.states.append(to)
        scale = math.prod(x for m, (_, x) in zip(self.parts[2:], moves[2:]) if m.scales)
        self[at] = found = self.numbers[to] * self.symbols, moves[0][1] * scale, moves[1][1] * scale
        return found

    def final(self, at: int) -> float:
        """What a clause that ends in a state is scaled by."""
        return math.prod(m.final.get(s, 1.0) for m, s in zip(self.parts, self.states[at // self.symbols]))


@lru_cache(maxsize=1)
def composed() -> Composed:
    return Composed()


class Weights(dict):
    """Weight of a raw token, as an insult or alone as a threat; remembers what it has seen, up to a bound, with its symbol."""

    def __init__(self, accepted: dict[str, float]):
        self.accepted = accepted
        self.symbols: dict[str, int] = {}
        self.harms: set[str] = set()

    def __missing__(self, token: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
            self.symbols.clear()
            self.harms.clear()
        word = bare(token)
        found = max([self.accepted.get(b, 0.0) for b in beginnings(word)], default=0.0)
        self[token] = found = max(found, THREATS.get(word, 0.0))
        symbol = sum(_BIT[name] for name, listed in _WORDS.items() if word in listed)
        symbol |= (found > 0 and _BIT["insult"]) | (token[:1] in _QUOTES and _BIT["opens"]) | (token[-1:] in _QUOTES and _BIT["closes"])
        self.symbols[token] = symbol
        if symbol & _BIT["harm"]:
            self.harms.add(token)
        return found


def clause_weight(tokens: list[str], weights) -> tuple[float, float]:
    """Run the composed machine over a clause: what it emits, and how much of that are phrases."""
    machine, state, emitted, phrases = composed(), 0, 0.0, 0.0
    for token in tokens:
        weight = weights[token]
        state, scale, phrase = machine[state + weights.symbols[token]]
        if weight:
            emitted += weight * scale
        if phrase:
            emitted += phrase
            phrases += phrase
    last = machine.final(state)
    return emitted * last, phrases * last


FEATURES = ("strongest", "total", "share", "phrases")


def features(text: str | None, weights) -> tuple[float, ...]:
    """FEATURES of a text from its matched clauses; all 0 without a match."""
    tokens = (text or "").split()
    if not any(map(weights.__getitem__, tokens)) and weights.harms.isdisjoint(tokens):
        return (0.0,) * len(FEATURES)
    clauses = [c for c in (m[0].split() for m in _CLAUSE.finditer(text)) if c]
    found = [w for w in (clause_weight(c, weights) for c in clauses) if w[0]]
    if not found:
        return (0.0,) * len(FEATURES)
    return max(w for w, _ in found), math.log1p(sum(w for w, _ in found)), len(found) / len(clauses), math.log1p(sum(p for _, p in found))


@dataclass(frozen=True)
class Model:
    accepted: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = ()  # intercept, then a weight per feature


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """About `sample` labelled texts to learn from, all if there are fewer: those whose id hashes below a bound. Both sides
    are cut to the bound before they are joined, so the texts that stay behind are not shuffled."""
    learnt = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    marked = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(learnt)
    share = min(1.0, sample / max(1, marked.count()))
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40))
    marked = marked.where(low).select(F.col("doc_id").alias("of"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    return docs.select("doc_id", "text").where(low).where(learnt).join(marked, F.col("doc_id") == F.col("of")).select("text", "toxic")


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn the acceptor and the curve; what reaches the driver is bounded by ACCEPTED and `sample` rows of numbers."""
    from stayline.llm.common import shuffled, written

    # a text that occurs often is learned once
    known = written(_labelled(docs, labels, sample).dropDuplicates(["text", "toxic"]).repartition(shuffled(docs.sparkSession)))
    sizes = known.agg(F.sum("toxic"), F.count("*")).first()
    toxic, other = int(sizes[0] or 0), int(sizes[1]) - int(sizes[0] or 0)
    if not toxic or not other:
        return Model()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[low : low + TEXTS * 4] for b in batches for low in range(0, len(b), TEXTS * 4)):
            found = Counter(), Counter()
            for text, y in zip(batch["text"], batch["toxic"]):
                found[y].update({b for w in {bare(t) for t in (text or "").split()} for b in beginnings(w)})
            keys = list(found[0].keys() | found[1].keys())
            yield pd.DataFrame({"part": keys, "t": [found[1][k] for k in keys], "n": [found[0][k] for k in keys]})

    counted = known.mapInPandas(count, "part string, t long, n long").groupBy("part").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    likely = counted.where((F.col("t") >= SUPPORT) & (F.col("t") * other > F.col("n") * toxic * 2))
    rows = likely.orderBy(F.desc(F.col("t") / toxic - F.col("n") / other), "part").limit(ACCEPTED).collect()
    counts = {r["part"]: (r["t"], r["n"]) for r in rows}
    less, least = loose(counts), least_ratio(len(counts))
    counts = {k: v for k, v in counts.items() if k not in less}
    accepted = {k: w for k, (t, n) in counts.items() if (w := log_odds(t, n, toxic, other, least))}
    near = {k: v for k, v in counts.items() if k in accepted}
    without = tuple({k: w for k, (t, n) in near.items() if (w := log_odds(t - y, max(0, n - (1 - y)), toxic - y, other - (1 - y), least))} for y in (0, 1))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = Weights(without[0]), Weights(without[1])
        for batch in batches:
            out = [(*features(text, memory[y]), float(y)) for text, y in zip(batch["text"], batch["toxic"])]
            yield pd.DataFrame(out, columns=[*FEATURES, "toxic"])

    # a text's own beginnings carry its label, so they are weighed as if it were not there
    table = known.mapInPandas(measure, ", ".join(f"{f} double" for f in (*FEATURES, "toxic"))).toPandas().to_numpy()
    return Model(accepted, tuple(curve(table[:, :-1], table[:, -1])))


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps, weights of the features shrunk."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All rows with their score from 0 to 1."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    carried = docs.drop(name)
    schema = StructType([*carried.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, line = Weights(model.accepted), np.array(model.curve)
        for batch in batches:
            # other columns stay in the batch; texts become Python's a few at a time
            for part in (batch.slice(low, TEXTS) for low in range(0, batch.num_rows, TEXTS)):
                score = np.zeros(part.num_rows)
                if len(line):
                    x = np.array([features(text.as_py(), weights) for text in part.column("text")]).reshape(part.num_rows, len(FEATURES))
                    score = 1 / (1 + np.exp(-np.clip(line[0] + x @ line[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, name])

    return carried.mapInArrow(run, schema)


def filtered(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows below the threshold, with the columns they came with."""
    score = "score" if "score" not in docs.columns else "score_"
    return scored(docs, model, score).where(F.col(score) < threshold).select(*docs.columns)
