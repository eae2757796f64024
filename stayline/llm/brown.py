"""Class-based n-gram scoring: exchange clustering, class transitions, word emissions.

The probability of a word after another is P(class | class before) * P(word | class), smoothed. Classes are found by
exchange: every word is moved to the class that raises the likelihood of the training bigrams most, over some rounds,
half of the words at a time so that neighbours do not swap past each other.

Texts are encoded once, in blocks of whole documents with a dictionary each, and written in buckets. Every known word
moves by itself, in two stages. First the FREQUENT most frequent words move until the likelihood hardly rises (at most ROUNDS
half turns), and with them all other words by their ending (one of ENDINGS, from the last three bytes); these classes travel
with the tasks, and a half turn is one pass over lists, written once, of what the training tokens of each such place follow and
precede. Then all other words move one by one (at most SINGLE half turns), from their ending's class, or a drawn one where an
ending holds more than a class's share of the words. Their classes lie in the shared folder, in parts by the word's hash: the
blocks send their counts of (word, neighbour class) to the words' parts, which choose the classes and tell the blocks that hold the words. So
nothing that grows with the vocabulary passes through the driver. The number of classes follows the number of words. An
unknown word takes the class of its ending. Emissions are of words.

Smoothing: transitions are mixed with class frequencies; emissions are discounted by the share of a class's words seen
once, and what that frees is the class's unknown word (one type, as in the base score); the whole is mixed with the base.

Words are compared by 64-bit hashes. Defined results: null and empty texts are the end token alone; rows with a null id
are training texts; repeated rows are counted and scored each; without training tokens score and base are equal; an empty
table gives an empty table; other columns than the id and the text are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import bucketed, streamed, written

CLASSES, FREQUENT, ENDINGS, ROUNDS, SINGLE = 32, 32_768, 8_192, 7, 6
#: Rise of the log likelihood per token, over two half turns, below which the exchange has settled; that for single moves, which
#: cost more, by one half turn.
STILL, STILL_SINGLE = 0.02, 0.1
#: Tokens of a block; frequent words of a range, and other words of a part, of exchanged counts.
BLOCK, RANGE, PART = 1_000_000, 512, 32_768
BASE_SHARE = 0.02
HELD = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 7 = 2, false)"
BLOCKS = "block long, ids array<long>, held array<boolean>, lengths array<int>, tokens binary, hashes binary, endings binary, counts binary"


_INSIDE = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _words(texts: pa.LargeBinaryArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words of texts without nulls, lower-cased, one after another, and how many each text has."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = _LOWER[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    full = np.flatnonzero(np.diff(offsets))
    inside = _INSIDE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    for marks, at in ((first, offsets[full]), (last, offsets[full + 1] - 1)):  # no word goes on in the next text
        marks[at] = inside[at]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    # words and what is between them in turn; every other one is a word
    turns = pa.py_buffer(np.stack([begin, end], 1).astype(np.int32).tobytes() if len(begin) else bytes(4))
    found = pa.Array.from_buffers(pa.binary(), max(2 * len(begin) - 1, 0), [None, turns, pa.py_buffer(data.tobytes())])
    return found.take(pa.array(np.arange(0, len(found), 2))), np.diff(np.searchsorted(begin, offsets))


def encoded(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per block: its documents, their tokens as numbers of its dictionary, and the dictionary with the words' hashes,
    endings and counts in training texts. The end token, an empty word, has number 0."""

    def packed(ids: list, held: list, found: list[pa.BinaryArray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        coded, sizes, held = pa.concat_arrays(found).dictionary_encode(), np.concatenate(sizes), np.array(held, bool)
        numbers = [b"", *coded.dictionary.to_pylist()]
        lengths = sizes + 1
        tokens = np.zeros(lengths.sum(), np.int32)
        tokens[np.arange(len(coded)) + np.repeat(np.arange(len(sizes)), sizes)] = coded.indices.to_numpy() + 1
        counts = np.bincount(tokens[~np.repeat(held, lengths)], minlength=len(numbers))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
        endings = np.fromiter((xxhash.xxh32_intdigest(w[-3:]) % ENDINGS for w in numbers), np.int32, len(numbers))
        row = [uuid.uuid4().int >> 65, ids, held, lengths.astype(np.int32), _pack(tokens, np.int32), hashes.tobytes(), _pack(endings, np.int32), _pack(counts, np.int32)]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, found, sizes, size = [], [], [], [], 0
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
            bytes_to = np.cumsum(pc.binary_length(texts).to_numpy())
            low = 0
            while low < batch.num_rows:
                # as many texts as cannot have more tokens than a block, one at least
                high = max(low + 1, int(np.searchsorted(bytes_to, (bytes_to[low - 1] if low else 0) + block, "right")))
                some, n = _words(texts.slice(low, high - low))
                ids += batch.column("doc_id").slice(low, high - low).to_pylist()
                held += batch.column("held").slice(low, high - low).to_pylist()
                found.append(some)
                sizes.append(n)
                size += len(some) + len(n)
                low = high
                if size >= block:
                    yield packed(ids, held, found, sizes)
                    ids, held, found, sizes, size = [], [], [], [], 0
        if ids:
            yield packed(ids, held, found, sizes)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.expr(HELD).alias("held"))
    return bucketed(rows.mapInArrow(run, BLOCKS), "block")


def vocabulary(blocks: DataFrame) -> DataFrame:
    """(hash, ending, c) of the words of the training texts."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, endings, counts in zip(*(c.to_pylist() for c in batch.columns)):
                n = _unpack(counts, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x[n > 0]) for x in (np.frombuffer(hashes, np.int64), _unpack(endings, np.int32), n)], ["hash", "ending", "n"])

    each = blocks.select("hashes", "endings", "counts").mapInArrow(entries, "hash long, ending int, n int")
    return written(each.groupBy("hash").agg(F.first("ending").alias("ending"), F.sum("n").alias("c")))


@dataclass(frozen=True)
class Units:
    """Places of the frequent words by their hashes, sorted; the class of any other word is looked up by its hash, or by its
    ending (from place `first` on) if it is unknown."""

    hashes: np.ndarray
    units: np.ndarray
    first: int

    def of(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return self.first + endings
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.units[at], self.first + endings)


@dataclass(frozen=True)
class Model:
    units: Units
    head: np.ndarray  # class of each frequent word, then of each ending, -1 where its words have a drawn class each
    classes: np.ndarray  # the same, with a class for the unknown words of every ending
    counts: np.ndarray  # of each frequent word
    transition: np.ndarray  # log10-free: P(class | class before)
    discount: np.ndarray  # per class, off each word's count
    free: np.ndarray  # per class, probability of the unknown word
    total: np.ndarray  # tokens per class
    tokens: int
    types: int
    parts: int


@dataclass(frozen=True)
class Block:
    """One block and what it was told: its words' places, counts in all training texts (0: unknown) and classes."""

    number: int
    tokens: np.ndarray
    lengths: np.ndarray
    held: np.ndarray
    hashes: np.ndarray
    endings: np.ndarray
    units: np.ndarray
    rare: np.ndarray  # whether a word is not among the frequent ones
    part: np.ndarray  # of the shortest kind: such numbers sort by digits
    counts: np.ndarray
    classes: np.ndarray

    def training(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the training tokens and of those before them; every text ends in the end token, which is also what the
        next one follows."""
        own = self.tokens[~np.repeat(self.held, self.lengths)]
        return own, np.concatenate([own[-1:], own[:-1]])

    def pieces(self, of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(part, numbers of its words) for the words of a mask, by part and number."""
        at = np.flatnonzero(of)
        at = at[np.argsort(self.part[at], kind="stable")]
        ends = np.flatnonzero(self.part[at][1:] != self.part[at][:-1]) + 1
        for piece in np.split(at, ends) if len(at) else []:
            yield int(self.part[piece[0]]), piece


def _pack(values: np.ndarray, kind: type) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _half(hashes: np.ndarray) -> np.ndarray:
    """The half turn, 0 or 1, in which a word that is not frequent may move."""
    return (hashes >> 9) & 1


COUNTS = 2
TOLD = "block long, kind int, part int, data binary"


def told(blocks: DataFrame, news: list[DataFrame]) -> DataFrame:
    """The blocks with all that the parts told them. Blocks lie in buckets, so only the news are shuffled."""
    columns = blocks.select("block", "ids", "held", "lengths", "tokens", "hashes", "endings", "counts")
    if not news:
        return columns.withColumn("news", F.lit(None).cast("array<struct<kind:int,part:int,data:binary>>"))
    every = news[0]
    for more in news[1:]:
        every = every.unionByName(more)
    by_block = every.groupBy("block").agg(F.collect_list(F.struct("kind", "part", "data")).alias("news"))
    return columns.join(by_block.hint("merge"), "block", "left")


def _blocks(batch: pa.RecordBatch, units: Units, head: np.ndarray, counts: np.ndarray, parts: int, k: int) -> Iterator[tuple[int, Block]]:
    """The blocks of a batch, their words' classes and counts filled in."""
    for i in range(batch.num_rows):

        def list_of(name: str) -> np.ndarray:
            return batch.column(name)[i].values.to_numpy(zero_copy_only=False)

        hashes, endings = np.frombuffer(batch.column("hashes")[i].as_py(), np.int64), _unpack(batch.column("endings")[i].as_py(), np.int32)
        at = units.of(hashes, endings)
        rare = at >= units.first
        part = (hashes.view(np.uint64) % np.uint64(parts)).astype(np.min_scalar_type(parts))
        known = np.where(rare, 0, counts[np.where(rare, 0, at)]) if len(counts) else np.zeros(len(hashes), np.int64)
        classes = ((hashes.view(np.uint64) >> np.uint64(20)) % np.uint64(k)).astype(np.int64)
        if len(head):
            classes = np.where(head[at] >= 0, head[at], classes)
        block = Block(batch.column("block")[i].as_py(), _unpack(batch.column("tokens")[i].as_py(), np.int32), list_of("lengths"), list_of("held"), hashes, endings, at, rare, part, known, classes)
        news = {(x["kind"], x["part"]): x["data"] for x in batch.column("news")[i].as_py() or []}
        for kind in {kind for kind, _ in news}:
            for p, piece in block.pieces(rare if kind == COUNTS else rare & (_half(hashes) == kind)):
                if kind == COUNTS:
                    known[piece] = _unpack(news[kind, p], np.int64)
                else:
                    classes[piece] = _unpack(news[kind, p], np.uint16)
        yield i, block


def counted(blocks: DataFrame, units: Units, parts: int) -> DataFrame:
    """What tells every block how often its words that are not frequent stand in all training texts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            for i, b in _blocks(batch, units, none, none, parts, 1):
                own = _unpack(batch.column("counts")[i].as_py(), np.int32)
                rows = [(p, b.number, b.hashes[at].tobytes(), _pack(own[at], np.int32)) for p, at in b.pieces(b.rare)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["part", "block", "hashes", "n"])

    def answer(asked: pa.Table) -> Iterator[pa.RecordBatch]:
        hashes = [np.frombuffer(x, np.int64) for x in asked.column("hashes").to_pylist()]
        n = np.concatenate([_unpack(x, np.int32) for x in asked.column("n").to_pylist()])
        _, at = np.unique(np.concatenate(hashes), return_inverse=True)
        c = np.bincount(at, n).astype(np.int64)[at]
        yield _news(asked, COUNTS, np.split(c, np.cumsum([len(h) for h in hashes])[:-1]), np.int64)

    asked = told(blocks, []).mapInArrow(ask, "part int, block long, hashes binary, n binary")
    return written(streamed(asked, ["part"], answer, TOLD))


def _news(asked: pa.Table, kind: int, data: list[np.ndarray], as_kind: type) -> pa.RecordBatch:
    columns = [asked.column("block").to_pylist(), [kind] * len(data), asked.column("part").to_pylist(), [_pack(x, as_kind) for x in data]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["block", "kind", "part", "data"])


def bigrams(blocks: DataFrame, units: Units, head: np.ndarray, counts: np.ndarray, parts: int, k: int) -> np.ndarray:
    """Class bigrams of the training texts; one small matrix per task reaches the driver."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for _, b in _blocks(batch, units, head, counts, parts, k):
                own, before = b.training()
                total += np.bincount(b.classes[before] * k + b.classes[own], minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["cell", "n"])

    matrix = np.zeros(k * k)
    for row in blocks.mapInArrow(fold, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        matrix[row["cell"]] = row["n"]
    return matrix.reshape(k, k)


BESIDE = "half int, n_after binary, after binary, n_before binary, before binary"


def halves(head: np.ndarray, k: int) -> list[np.ndarray]:
    """The places that may move in even half turns, those that may in odd ones, and one place per drawn class, which follow
    all others and stay."""
    places = np.arange(len(head))
    return [*(places[((places // 2 + places) % 2 == half) & (head >= 0)] for half in (0, 1)), np.arange(len(head), len(head) + k)]


def beside(blocks: DataFrame, units: Units, head: np.ndarray, counts: np.ndarray, parts: int, k: int) -> DataFrame:
    """BESIDE: per block and half of the places, what places the training tokens of each place follow and precede, and how many
    those are. Written once: half turns change the classes of places, never these."""
    sets = halves(head, k)
    rank = np.zeros(len(head) + k, np.int64)
    rank[np.concatenate(sets)] = np.arange(sum(map(len, sets)))
    ends = np.cumsum([len(x) for x in sets])

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, b in _blocks(batch, units, head, counts, parts, k):
                own, before = b.training()
                place = np.where(head[b.units] >= 0, b.units, len(head) + b.classes)
                rows = [[half] for half in range(len(sets))]
                for word, other in ((own, before), (before, own)):
                    keys = rank[place][word] << 32 | place[other]
                    keys.sort()
                    n = np.bincount(keys >> 32, minlength=ends[-1])
                    stops = np.concatenate([[0], np.cumsum(n)])[ends]
                    for row, low, high, start, stop in zip(rows, [0, *ends], ends, [0, *stops], stops):
                        row += _pack(n[low:high], np.int32), _pack(keys[start:stop] & 0xFFFFFFFF, np.min_scalar_type(len(rank)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], [c.split()[0] for c in BESIDE.split(", ")])

    return written(told(blocks, []).mapInArrow(sides, BESIDE))


def neighbours(sides: DataFrame, head: np.ndarray, k: int, half: int) -> DataFrame:
    """(part, n): per range of the places that move in a half turn, how often each stands after and before each class; part -1:
    the class bigrams, which are all there is if no half is given (-1).

    Each task sums its blocks and hands on one packed matrix per range; those of a range are summed as they arrive.
    """
    kinds, names = (pa.int32(), pa.binary()), ["part", "n"]
    sets, now = halves(head, k), np.concatenate([head, np.arange(k)])
    moving = len(sets[half]) if half >= 0 else 0

    def kind_of(part: int) -> type:
        return np.int64 if part < 0 else np.int32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, matrix = np.zeros((2, moving * k), np.int32), np.zeros(k * k, np.int64)
        for batch in batches:
            for own, *data in zip(*(c.to_pylist() for c in batch.columns)):
                for side in (0, 1) if own == half else (0,):
                    n, other = _unpack(data[2 * side], np.int32), now[_unpack(data[2 * side + 1], np.min_scalar_type(len(now)))]
                    if not side:
                        matrix += np.bincount(np.repeat(now[sets[own]], n) + other * k, minlength=k * k)
                    if own == half:
                        cells = np.bincount(np.repeat(np.arange(moving) * k, n) + other, minlength=moving * k)
                        np.add(total[side], cells, out=total[side], casting="unsafe")
        if matrix.any():
            both = np.concatenate([t.reshape(moving, k) for t in total], axis=1)
            sums = {-1: matrix} | {r: both[r * RANGE : (r + 1) * RANGE] for r in range(-(-moving // RANGE))}
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), kinds[0]), pa.array([_pack(m, kind_of(p)) for p, m in sums.items()], kinds[1])], names)

    def add(asked: pa.Table) -> Iterator[pa.RecordBatch]:
        part, total = asked.column("part")[0].as_py(), 0
        for n in asked.column("n"):
            total = total + _unpack(n.as_py(), kind_of(part)).astype(np.int64, copy=False)
        yield pa.RecordBatch.from_arrays([pa.array([part], kinds[0]), pa.array([_pack(total, np.int64)], kinds[1])], names)

    return written(streamed(sides.mapInArrow(count, "part int, n binary"), ["part"], add, "part int, n binary"))


def settle_frequent(blocks: DataFrame, units: Units, head: np.ndarray, counts: np.ndarray, parts: int, k: int, n: int, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Classes of the frequent words and endings after they have moved, half of them at a time, the class bigrams and their
    likelihood. A place of class -1 stays out: its words have a drawn class each."""
    sides = beside(blocks, units, head, counts, parts, k)
    sets = halves(head, k)
    reached, best = [], (head, np.zeros((k, k)), -np.inf)
    for turn in range(rounds + 1):
        sums = neighbours(sides, head, k, turn % 2 if turn < rounds else -1)
        packed = sums.where("part = -1").first()
        matrix = (_unpack(packed["n"], np.int64) if packed else np.zeros(k * k)).reshape(k, k).astype(float)
        reached.append(likelihood(matrix, n))
        if reached[-1] > best[2]:
            best = head, matrix, reached[-1]
        if turn == rounds or turn > 1 and reached[-1] < reached[-3] + STILL:
            break

        def move(batches: Iterator[pa.RecordBatch], head=head, matrix=matrix, moving=sets[turn % 2]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    places = moving[r * RANGE : (r + 1) * RANGE]
                    to = best_classes(_unpack(n, np.int64).reshape(-1, 2 * k), head[places], matrix)
                    yield pa.RecordBatch.from_arrays([pa.array(places[to != head[places]], pa.int32()), pa.array(to[to != head[places]], pa.int32())], ["place", "class"])

        head = head.copy()
        for row in sums.where("part >= 0").mapInArrow(move, "place int, class int").collect():
            head[row["place"]] = row["class"]
    return best


def likelihood(matrix: np.ndarray, n: int) -> float:
    """Log likelihood of the class bigrams, per token."""
    return float((_phi(matrix).sum() - _phi(matrix.sum(0)).sum() - _phi(matrix.sum(1)).sum()) / max(n, 1))


ASKED = "part int, block long, hashes binary, classes binary, words binary, cells binary, n binary"


def exchanged(blocks: DataFrame, units: Units, head: np.ndarray, counts: np.ndarray, parts: int, matrix: np.ndarray, turn: int) -> DataFrame:
    """TOLD with the classes after the words of this half turn that are not frequent have moved.

    Each block sends its counts of (word, class before or after) to the word's part. There they are summed, each word takes
    its best class, and the blocks that hold it are told.
    """
    k = len(matrix)
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
    names = [c.split()[0] for c in ASKED.split(", ")]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, b in _blocks(batch, units, head, counts, parts, k):
                own, before = b.training()
                sent = b.rare & (_half(b.hashes) == turn % 2)
                moves = sent & (b.counts > 0)
                keys = np.concatenate([own[moves[own]] * np.int64(2 * k) + b.classes[before[moves[own]]], before[moves[before]] * np.int64(2 * k) + k + b.classes[own[moves[before]]]])
                keys, n = np.unique(keys, return_counts=True)
                word = keys // (2 * k)
                rows = []
                order = np.argsort(b.part[word], kind="stable")
                word, cell, n = word[order], (keys % (2 * k))[order], n[order]
                low = np.searchsorted(b.part[word], np.arange(parts + 1))
                for p, at in b.pieces(sent):
                    part = slice(low[p], low[p + 1])
                    places = np.searchsorted(at, word[part])
                    rows.append((p, b.number, b.hashes[at].tobytes(), _pack(b.classes[at], np.uint16), _pack(np.diff(places, prepend=0), np.int32), _pack(cell[part], np.uint16), _pack(n[part], np.int32)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def move(asked: pa.Table) -> Iterator[pa.RecordBatch]:
        hashes = [np.frombuffer(x, np.int64) for x in asked.column("hashes").to_pylist()]
        sizes = np.cumsum([0, *(len(h) for h in hashes)])
        every, first, at = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        own = np.concatenate([_unpack(x, np.uint16) for x in asked.column("classes").to_pylist()]).astype(np.int64)[first]
        words = np.concatenate([at[low + np.cumsum(_unpack(x, np.int32))] for low, x in zip(sizes, asked.column("words").to_pylist())])
        cells, n = (np.concatenate([_unpack(x, t) for x in asked.column(c).to_pylist()]).astype(np.int64) for c, t in (("cells", np.uint16), ("n", np.int32)))
        keys, where = np.unique(words * (2 * k) + cells, return_inverse=True)
        n = np.bincount(where, n, len(keys)).astype(np.int64)
        best = best_of_few(keys // (2 * k), keys % (2 * k), n, own, matrix)
        yield _news(asked, turn % 2, np.split(best[at], sizes[1:-1]), np.uint16)

    asked = blocks.mapInArrow(ask, ASKED)
    return written(streamed(asked, ["part"], move, TOLD))


def _phi(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 0.0)
    return x * np.log(np.maximum(x, 1.0))


def best_classes(counts: np.ndarray, own: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The class for each unit that raises the likelihood of the class bigrams most, the others staying where they are.

    counts: after and before each class, side by side; own: the units' classes; matrix: class bigrams.
    """
    k = len(matrix)
    after, before = counts[:, :k].astype(float), counts[:, k:].astype(float)
    n_in, n_out = after.sum(1)[:, None], before.sum(1)[:, None]
    rows, columns = matrix.sum(1), matrix.sum(0)
    gain = np.empty((len(counts), k))
    for low in range(0, len(counts), 4):  # few at a time, so that the arrays in between stay in the processor's cache
        part = slice(low, low + 4)
        gain[part] = _phi(matrix[None] + before[part, None, :]).sum(2) + _phi(matrix.T[None] + after[part, None, :]).sum(2)
    gain -= _phi(matrix).sum(1) + _phi(matrix.T).sum(1)
    gain -= _phi(rows + n_out) - _phi(rows) + _phi(columns + n_in) - _phi(columns)
    i = np.arange(len(counts))
    stay = _phi(matrix[own]).sum(1) - _phi(matrix[own] - before).sum(1) + _phi(matrix.T[own]).sum(1) - _phi(matrix.T[own] - after).sum(1)
    stay -= _phi(rows[own]) - _phi(rows[own] - n_out[:, 0]) + _phi(columns[own]) - _phi(columns[own] - n_in[:, 0])
    gain[i, own] = stay
    best = gain.argmax(1)
    return np.where((gain[i, best] > stay + 1e-9) & (n_in[:, 0] > 0), best, own)


def best_of_few(words: np.ndarray, cells: np.ndarray, n: np.ndarray, own: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The same as best_classes for words of few neighbour classes: counts as triples (word, cell, n), sorted by word, a cell
    being the class before, or the number of classes and the class after."""
    k, best = len(matrix), own.copy()
    rows, columns = matrix.sum(1), matrix.sum(0)
    wide = np.concatenate([matrix, matrix.T])  # by cell, a column per class
    kinds, kind = np.unique(cells * (n.max(initial=0) + 1) + n, return_inverse=True)
    cell, times = kinds // (n.max(initial=0) + 1), (kinds % (n.max(initial=0) + 1))[:, None]
    now = wide[cell]
    plus, minus = _phi(now + times) - _phi(now), _phi(now) - _phi(now - times)
    starts = np.flatnonzero(np.diff(words, prepend=-1))
    ends = np.append(starts[1:], len(words))
    after, before = (np.add.reduceat(np.where(side, n, 0), starts) if len(starts) else starts for side in (cells < k, cells >= k))
    # what a number of words more or less does to the totals of each class, by number
    (many_in, into), (many_out, out) = (np.unique(x, return_inverse=True) for x in (after, before))
    out_plus, in_plus = _phi(rows + many_out[:, None]) - _phi(rows), _phi(columns + many_in[:, None])
    columns_now = _phi(columns)
    for low in range(0, len(starts), 256):
        begin, end = starts[low : low + 256], ends[low : low + 256]
        part = slice(begin[0], end[-1])
        at, these = words[begin], slice(low, low + 256)
        i, old = np.arange(len(at)), own[at]
        gain = np.add.reduceat(plus[kind[part]], begin - begin[0])
        gain -= out_plus[out[these]] + in_plus[into[these]] - columns_now
        stay = np.add.reduceat(minus[kind[part], own[words[part]]], begin - begin[0])
        stay -= _phi(rows[old]) - _phi(rows[old] - before[these]) + _phi(columns[old]) - _phi(columns[old] - after[these])
        gain[i, old] = stay
        to = gain.argmax(1)
        best[at] = np.where((gain[i, to] > stay + 1e-9) & (after[these] > 0), to, old)
    return best


def most_frequent(known: DataFrame, frequent: int = FREQUENT) -> list:
    """The words with the largest counts, ties by hash.

    Counts are first gathered in narrow classes, a few hundred numbers; only words of the classes that can be among the
    most frequent are sorted, so no task hands on more than are left.
    """
    step = F.floor(F.log("c") * 20).cast("int")
    left, least = frequent, 0
    for row in known.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        least, left = row["step"], left - row["n"]
        if left <= 0:
            break
    return known.where(step >= least).orderBy(F.desc("c"), "hash").limit(frequent).collect()


def settled(blocks: DataFrame, units: Units, head: np.ndarray, counts: np.ndarray, parts: int, k: int) -> DataFrame:
    """(ending, class, tokens, types, once) of the words that are not frequent, each counted once."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, b in _blocks(batch, units, head, counts, parts, k):
                rows = []
                for p, at in b.pieces(b.rare & (b.counts > 0)):
                    rows.append((p, b.hashes[at].tobytes(), _pack(b.endings[at], np.int32), _pack(b.classes[at], np.int32), _pack(b.counts[at], np.int64)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], ["part", "hashes", "endings", "classes", "c"])

    def once(asked: pa.Table) -> Iterator[pa.RecordBatch]:
        _, first = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in asked.column("hashes").to_pylist()]), return_index=True)
        ending, own, c = (np.concatenate([_unpack(x, t) for x in asked.column(n).to_pylist()])[first] for n, t in (("endings", np.int32), ("classes", np.int32), ("c", np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(ending), pa.array(own), pa.array(c)], ["ending", "class", "c"])

    asked = blocks.mapInArrow(ask, "part int, hashes binary, endings binary, classes binary, c binary")
    words = streamed(asked, ["part"], once, "ending int, class int, c long")
    return written(words.groupBy("ending", "class").agg(F.sum("c").alias("tokens"), F.count("*").alias("types"), F.count(F.when(F.col("c") == 1, 1)).alias("once")))


def classes_for(types: int) -> int:
    """Number of classes: the cube root of the number of words, CLASSES at least."""
    return max(CLASSES, round(types ** (1 / 3)))


def trained(blocks: DataFrame, known: DataFrame, rounds: int = ROUNDS, frequent: int = FREQUENT) -> Model:
    return fitted(blocks, known, rounds, frequent)[0]


def fitted(blocks: DataFrame, known: DataFrame, rounds: int = ROUNDS, frequent: int = FREQUENT) -> tuple[Model, DataFrame]:
    """Exchange the classes and estimate the model; returns it and the blocks with their words' counts and classes.

    The driver sees the frequent words, a class per ending and a few numbers per pair of classes; the classes of all other words
    stay in the shared folder.
    """
    n, types = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = most_frequent(known, frequent)
    k, parts = classes_for(types), 1 + max(0, types - len(top)) // PART
    hashes, counts = np.array([r["hash"] for r in top], np.int64), np.array([r["c"] for r in top], np.int64)
    order = np.argsort(hashes)
    units = Units(hashes[order], order.astype(np.int64), len(top))
    # tokens of each ending but those of frequent words
    held = np.zeros(ENDINGS, np.int64)
    for row in known.groupBy("ending").agg(F.sum("c").alias("c")).collect():
        held[row["ending"]] = row["c"]
    for r in top:
        held[r["ending"]] -= r["c"]
    places = np.argsort(-np.concatenate([counts, held]), kind="stable")
    head = np.empty(len(places), np.int64)
    head[places] = np.arange(len(places)) % k
    head[len(top) :][held * k > max(held.sum(), 1)] = -1

    head, matrix, reached = settle_frequent(blocks, units, head, counts, parts, k, int(n), rounds)
    number = counted(blocks, units, parts)
    now, halves, last = told(blocks, [number]), {}, -np.inf
    for turn in range(SINGLE if types > len(top) else 0):
        halves[turn % 2] = exchanged(now, units, head, counts, parts, matrix, turn)
        after = told(blocks, [number, *halves.values()])
        moved = bigrams(after, units, head, counts, parts, k)
        if likelihood(moved, n) <= reached:
            break
        now, matrix, last, reached = after, moved, reached, likelihood(moved, n)
        if turn and reached < last + STILL_SINGLE:
            break

    total, each, once = (np.bincount(head[: len(top)], x, k) for x in (counts, np.ones(len(top)), counts == 1))
    rest = settled(now, units, head, counts, parts, k)
    for row in rest.groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"), F.sum("once").alias("once")).collect():
        total[row["class"]] += row["tokens"]
        each[row["class"]] += row["types"]
        once[row["class"]] += row["once"]
    # where an ending has no class, an unknown word is taken for what its rarest words are
    ending = np.where(held > 0, head[len(top) :], -1)
    for row in rest.groupBy("ending").agg(F.max_by("class", F.struct("once", "types", "class")).alias("class")).collect():
        if ending[row["ending"]] < 0:
            ending[row["ending"]] = row["class"]
    ending[ending < 0] = once.argmax()
    share = total / n if n else total
    discount = np.where(each > 0, np.clip(once / np.maximum(each, 1), 0.05, 0.95), 0.0)
    free = np.where(total > 0, discount * each / np.maximum(total, 1), 0.0)
    transition = (matrix + k * share) / (matrix.sum(1, keepdims=True) + k)
    return Model(units, head, np.concatenate([head[: len(top)], ending]), counts, transition, discount, free, total, int(n), int(types), parts), now


def log_probabilities(model: Model, tokens: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of base and model probability of each token; classes and counts by the number of a word. The end token precedes."""
    base = (counts + 1.0) / (model.tokens + model.types + 1.0)
    total = np.maximum(model.total[classes], 1.0)
    emitted = np.where(counts > 0, (counts - model.discount[classes]) / total, model.free[classes])
    own = classes[tokens]
    before = np.concatenate([[classes[0]], own[:-1]])
    both = (1 - BASE_SHARE) * model.transition[before, own] * emitted[tokens] + BASE_SHARE * base[tokens]
    return np.log10(base)[tokens], np.log10(both) if model.tokens else np.log10(base)[tokens]


def scored(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) per row of (doc_id, text)."""
    blocks = encoded(docs)
    model, now = fitted(blocks, vocabulary(blocks), frequent=frequent)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, b in _blocks(batch, model.units, model.head, model.counts, model.parts, len(model.total)):
                lengths, counts = b.lengths, b.counts
                base, own = log_probabilities(model, b.tokens, np.where(counts > 0, b.classes, model.classes[b.units]), counts)
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
                total = np.add.reduceat(own, starts)
                columns = [
                    pa.array(batch.column("ids")[i].as_py(), pa.int64()),
                    pa.array(b.held, pa.bool_()),
                    pa.array(lengths.astype(np.int64)),
                    pa.array(np.add.reduceat((counts > 0)[b.tokens].astype(np.int64), starts)),
                    pa.array(np.full(len(lengths), model.tokens, np.int64)),
                    pa.array(np.add.reduceat(base, starts)),
                    pa.array(total),
                    pa.array(10 ** np.minimum(-total / lengths, 300.0)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return now.mapInArrow(score, schema)
