"""Alignment of two tokenisers' tokens, with an associative fragment monoid for very long texts.

Both token rows of a text spell the same bytes, a blank and the text. Byte offsets where tokens of both end cut them into
groups; the tokens that end at a cut are linked.

A range of bytes, with the tokens that end in it, is a fragment: an open prefix up to its first cut, closed groups, and an open
suffix after its last cut; without a cut it is one open stretch. Neighbouring fragments compose, a suffix and the prefix after
it closing to a group, and composing is associative, so the fragments of a text can be put together in any tree.

* A long text is cut into pieces that can be encoded by themselves, for either tokeniser at its own places. Pieces are spread
  over tasks; their tokens are dealt to ranges of RANGE bytes, each range becomes a fragment, and FAN neighbours at a time are
  composed until a text is one fragment, which holds no more than the result does.
* A text of at most LONG code points is one fragment. Its stretches between single blanks are encoded once for all texts of
  a batch and remembered, as generated and natural texts repeat words.

Where a text may be cut: before a blank with no white space on either side. The first tokeniser's pattern starts a piece there
whatever stands before; the second has no entry that goes on after a blank, so no merge crosses. Both are checked on the
files when these are loaded. The first is run by its merge ranks, which is checked to be the same thing (`ranks`).

Counts of linked pairs are added up per batch before they are shuffled. The counts of at most FREQUENT pairs, the most
frequent ones, then travel with the tasks; links of all others are joined, so a hot pair is no hot key.

Defined results: null and empty texts, and texts whose tokens spell other bytes (as with U+2581, which the second writes for
a blank), have no tokens; repeated rows count and are returned each; a null id stays null; an empty table gives an empty
table; other columns than the id and the text are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import streamed, written

#: Code points of a text that is encoded in one task, bytes of a piece and of a range of a longer one, fragments composed at once.
LONG, PIECE, RANGE, FAN = 65_536, 32_768, 16_384, 8
#: Stretches a worker remembers, and encodes together; code points it looks at together.
REMEMBERED, ENCODED, TOGETHER = 300_000, 4_096, 2_000_000
#: Linked pairs whose counts travel with the tasks.
FREQUENT = 65_536
#: Split pattern of byte-level tokenisers of that kind ("use_regex"); fixed.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space that no cut may touch: two in a row, or one at either end of the text.
_KEPT = re.compile(r"\s\s+|\A\s|\s\Z")
_EDGE = re.compile(r"\A\s|\s\Z")
_BLANK = "▁"


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(moved)}


def ranks(path: str) -> dict[bytes, int]:
    """Merge ranks of a tokenizers file: ids by bytes, if the file is plain byte-level BPE whose ids follow its merges."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, split = told["model"], told["pre_tokenizer"] or {}
    alphabet = byte_alphabet()
    vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocabulary[a + b] for a, b in merges]
    plain = told["normalizer"] is None and (told["post_processor"] or split).get("type") == "ByteLevel"
    plain &= (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)
    plain &= model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain &= all(x < y for x, y in zip(made, made[1:])) and {n for t, n in vocabulary.items() if len(t) > 1} == set(made)
    if not plain:
        raise ValueError(f"{path} is not byte-level BPE with ids in the order of its merges")
    return {bytes(alphabet[c] for c in token): n for token, n in vocabulary.items()}


class Pair:
    """Both tokenisers: texts to ids, ids to bytes."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        import tiktoken

        found = ranks(first)
        self.first = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=found, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        a: list[bytes] = [b""] * (1 + max(found.values()))
        for token, n in found.items():
            a[n] = token
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        if any(_BLANK in p.lstrip(_BLANK) for p in pieces) or self.second.decode(self.second.encode(" a  b")) != " a  b":
            raise ValueError(f"{second} has entries across blanks or changes texts")
        b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.bytes = a, b
        self.sizes = tuple(np.array([len(t) for t in table], np.int64) for table in self.bytes)
        self.width = len(b)
        self.texts = np.array([f"{i}{s}" for s in (",", "|", ";", "\n") for i in range(max(len(a), len(b)))], object)
        self.memory = Memory(self)

    def encode(self, which: int, text: str) -> np.ndarray | None:
        """Ids of a blank and the text; None if they spell something else."""
        ids = self.first.encode_ordinary(" " + text) if which == 0 else self.second.encode(text)
        table = self.bytes[which]
        return np.array(ids, np.int64) if b"".join([table[i] for i in ids]) == b" " + text.encode("utf-8", "replace") else None


@lru_cache(maxsize=2)
def loaded(first: str, second: str) -> Pair:
    """The tokenisers, once per Python worker."""
    return Pair(first, second)


# --- groups of tokens ----------------------------------------------------------
def spelled(pair: Pair, a: np.ndarray, b: np.ndarray, last: np.ndarray | None = None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Groups of two token rows that spell the same bytes.

    Returns the groups as text, the linked pairs (first id times the second's number of ids, plus second id), and by part the
    number of groups and where the links end; `last` are the byte offsets at which parts end, all of them cuts.
    """
    ends_a, ends_b = np.cumsum(pair.sizes[0][a]), np.cumsum(pair.sizes[1][b])
    cuts, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
    links = a[at_a] * pair.width + b[at_b]
    of = np.concatenate([np.searchsorted(cuts, ends_a) * 2, np.searchsorted(cuts, ends_b) * 2 + 1])
    order = np.argsort(of, kind="stable")
    of, ids = of[order], np.concatenate([a, b])[order]
    after = np.append(of[1:], -1)
    mark = np.where(of == after, 0, np.where(of % 2 == 0, 1, 2))
    parts = np.searchsorted(cuts, last, "right") if last is not None else np.array([len(cuts)])
    mark[np.searchsorted(of, parts * 2) - 1] = 3
    texts = "".join(pair.texts[mark * (len(pair.texts) // 4) + ids].tolist()).split("\n")[:-1]
    return texts, links, np.diff(parts, prepend=0), parts


class Memory(dict):
    """Number of a stretch by the stretch; what it holds in flat arrays. -1: its tokens spell something else."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.texts: list[str] = []
        self.counts = np.zeros((0, 3), np.int64)  # tokens of either, groups
        self.links, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learned(self, new: list[str]) -> Iterator[tuple]:
        """(stretches, their groups as text, tokens and groups, links), for stretches that are encoded together as they are by
        themselves; without the last three for one that spells something else, which is found by halving."""
        ids = [self.pair.encode(w, " ".join(new)) for w in (0, 1)]
        if any(x is None for x in ids):
            if len(new) == 1:
                yield new, None, None, None
                return
            yield from self.learned(new[: len(new) // 2])
            yield from self.learned(new[len(new) // 2 :])
            return
        last = np.cumsum([1 + len(s.encode()) for s in new])
        texts, links, groups, _ = spelled(self.pair, *ids, last)
        tokens = [np.diff(np.searchsorted(np.cumsum(self.pair.sizes[w][ids[w]]), last, "right"), prepend=0) for w in (0, 1)]
        yield new, texts, np.stack([*tokens, groups], 1), links

    def numbers(self, stretches: list[str]) -> np.ndarray:
        missing = {s for s in stretches if s not in self}
        if missing:
            if len(self) + len(missing) > REMEMBERED:
                self.reset()
                missing = set(stretches)
            # white space at an end goes with what stands next to it, so such stretches, at the ends of texts, stay alone
            alone = [s for s in missing if _EDGE.search(s)]
            others = list(missing.difference(alone))
            counts, links = [self.counts], [self.links]
            for group in [[s] for s in alone] + [others[i : i + ENCODED] for i in range(0, len(others), ENCODED)]:
                for new, texts, own, linked in self.learned(group):
                    if texts is None:
                        self[new[0]] = -1
                        continue
                    self.update(zip(new, range(len(self.texts), len(self.texts) + len(new))))
                    self.texts += texts
                    counts.append(own)
                    links.append(linked)
            self.counts, self.links = np.concatenate(counts), np.concatenate(links)
            self.ends = np.concatenate([[0], np.cumsum(self.counts[:, 2])])
        return np.fromiter(map(self.__getitem__, stretches), np.int64, len(stretches))


def stretches(text: str) -> list[str]:
    """The parts of a text between blanks that have no white space on either side."""
    if "\0" in text:
        return _CUT.split(text)
    kept = _KEPT.sub(lambda m: m.group().replace(" ", "\0"), text)
    parts = kept.split(" ")
    return [p.replace("\0", " ") for p in parts] if "\0" in kept else parts


def _packed(links: np.ndarray) -> bytes:
    """Distinct pairs and how often each occurs."""
    pairs, times = np.unique(links, return_counts=True)
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([np.diff(pairs, prepend=0), times]).astype(np.int64).tobytes())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


# --- fragments of long texts ---------------------------------------------------
@dataclass(frozen=True)
class Fragment:
    """Tokens that end in a range of bytes. Without a cut all of them are in the prefix."""

    sound: bool  # whether the tokens spell the text
    cut: bool
    prefix: tuple[tuple[int, ...], tuple[int, ...]]
    groups: str
    n: tuple[int, int, int]  # tokens of either and groups, open ones left out of the last
    suffix: tuple[tuple[int, ...], tuple[int, ...]]
    links: tuple[int, ...]


NONE: tuple[tuple[int, ...], tuple[int, ...]] = ((), ())
#: The neutral element, and the start of a text: nothing, after a cut.
EMPTY = Fragment(True, False, NONE, "", (0, 0, 0), NONE, ())
START = replace(EMPTY, cut=True)


def _group(a: tuple[int, ...], b: tuple[int, ...]) -> str:
    return ",".join(map(str, a)) + "|" + ",".join(map(str, b))


def composed(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""

    def chained(p, q):
        return p[0] + q[0], p[1] + q[1]

    groups, n = x.n[2] + y.n[2], (x.n[0] + y.n[0], x.n[1] + y.n[1])
    prefix, text, suffix = x.prefix, x.groups, y.suffix
    if not x.cut:
        prefix, text = chained(x.prefix, y.prefix), y.groups
    elif not y.cut:
        suffix = chained(x.suffix, y.prefix)
    else:  # the suffix and the prefix up to the cut close to a group
        text = ";".join(filter(None, (x.groups, _group(*chained(x.suffix, y.prefix)), y.groups)))
        groups += 1
    return Fragment(x.sound and y.sound, x.cut or y.cut, prefix, text, (*n, groups), suffix, x.links + y.links)


def fragment(pair: Pair, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> Fragment:
    """The fragment of a range from the tokens that end in it and the offsets where they do."""
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    n = len(a), len(b)
    if not len(cuts):
        return Fragment(True, False, (tuple(a.tolist()), tuple(b.tolist())), "", (*n, 0), NONE, ())
    la, lb = (np.searchsorted(e, cuts, "right") for e in (ends_a, ends_b))
    links = a[la - 1] * pair.width + b[lb - 1]
    texts = [_group(a[i:j].tolist(), b[p:q].tolist()) for i, j, p, q in zip(la, la[1:], lb, lb[1:])]
    prefix, suffix = (tuple(tuple(x.tolist()) for x in p) for p in ((a[: la[0]], b[: lb[0]]), (a[la[-1] :], b[lb[-1] :])))
    return Fragment(True, True, prefix, ";".join(texts), (*n, len(texts)), suffix, tuple(links.tolist()))


FIELDS = "row long, at long, sound boolean, cut boolean, prefix_a array<long>, prefix_b array<long>, groups string, n_a long, n_b long, n_groups long, suffix_a array<long>, suffix_b array<long>, links array<long>"
_KINDS = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.list_(pa.int64())] * 2, pa.string(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 3]
_NAMES = [c.split()[0] for c in FIELDS.split(", ")]


def _as_batch(row: int, at: int, f: Fragment) -> pa.RecordBatch:
    values = (row, at, f.sound, f.cut, *map(list, f.prefix), f.groups, *f.n, *map(list, f.suffix), list(f.links))
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _KINDS)], _NAMES)


def _from_row(r: dict) -> Fragment:
    return Fragment(r["sound"], r["cut"], (tuple(r["prefix_a"]), tuple(r["prefix_b"])), r["groups"], (r["n_a"], r["n_b"], r["n_groups"]), (tuple(r["suffix_a"]), tuple(r["suffix_b"])), tuple(r["links"]))


def pieces(texts: DataFrame, piece: int) -> DataFrame:
    """(row, which, start, text): parts of (row, text) that either tokeniser can encode by itself; start in bytes.

    The second tokeniser's pieces are cut half a piece away from the first one's. A text without a place to cut is one piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(*(c.to_pylist() for c in batch.columns)):
                places = [m.start() for m in _CUT.finditer(text)]
                for which in (0, 1):
                    start, low, due = 0, 0, piece >> which
                    for place in [*places, len(text)]:
                        if place < due and place < len(text):
                            continue
                        part = text[low:place]
                        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([which], pa.int32()), pa.array([start], pa.int64()), pa.array([part], pa.string())], ["row", "which", "start", "text"])
                        start += 1 + len(part.encode())  # the blank in front of it
                        low, due = place + 1, place + piece

    return texts.select("row", "text").mapInArrow(run, "row long, which int, start long, text string")


def fragments(parts: DataFrame, files: tuple[str, str], width: int = RANGE) -> DataFrame:
    """A fragment (FIELDS) per row and range of `width` bytes, from its pieces; `at` is the range's number."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(*files)
        for batch in batches:
            for row, which, start, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = pair.encode(which, text)
                if ids is None:
                    columns = [[row], [start // width], [which], [None], [None]]
                else:
                    ends = start + np.cumsum(pair.sizes[which][ids])
                    at, first = np.unique((ends - 1) // width, return_index=True)
                    limits = [*first, len(ids)]
                    columns = [[row] * len(at), at, [which] * len(at), [ids[i:j] for i, j in zip(limits, limits[1:])], [ends[i:j] for i, j in zip(limits, limits[1:])]]
                kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 2)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["row", "at", "which", "ids", "ends"])

    def meet(group: pa.Table) -> Iterator[pa.RecordBatch]:
        pair, rows = loaded(*files), group.to_pylist()
        row, at = rows[0]["row"], rows[0]["at"]
        if any(r["ids"] is None for r in rows):
            yield _as_batch(row, at, replace(EMPTY, sound=False))
            return
        both = []
        for which in (0, 1):
            own = sorted((r["ends"], r["ids"]) for r in rows if r["which"] == which)
            both += [np.array([i for _, ids in own for i in ids], np.int64), np.array([e for ends, _ in own for e in ends], np.int64)]
        yield _as_batch(row, at, fragment(pair, *both))

    dealt = parts.repartition("row", "which", "start").mapInArrow(deal, "row long, at long, which int, ids array<long>, ends array<long>")
    return streamed(dealt, ["row", "at"], meet, FIELDS)


def reduced(parts: DataFrame, ranges: int, fan: int = FAN) -> DataFrame:
    """One fragment per row: neighbours are composed `fan` at a time; `ranges` is the largest number of ranges of a row."""

    def compose(group: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = sorted(group.drop_columns(["up"]).to_pylist(), key=lambda r: r["at"])
        whole = EMPTY
        for r in rows:
            whole = composed(whole, _from_row(r))
        yield _as_batch(rows[0]["row"], rows[0]["at"] // fan, whole)

    while ranges > 1:
        parts = written(streamed(parts.withColumn("up", F.expr(f"at div {fan}")), ["row", "up"], compose, FIELDS))
        ranges = -(-ranges // fan)
    return parts


ALIGNED = "n_a long, n_b long, n_groups long, groups string, links binary"


def aligned(docs: DataFrame, first: str, second: str, long: int = LONG, piece: int = PIECE, width: int = RANGE, fan: int = FAN) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, links) per row of (doc_id, text).

    first, second: paths, on every machine, of a byte-level BPE file and a sentencepiece model. groups: `a1,a2|b1;a3|b2,b3`;
    links: the distinct linked pairs and their numbers, packed.
    """
    files = first, second
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    names = ["doc_id", *(c.split()[0] for c in ALIGNED.split(", "))]

    def batch_of(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (*[pa.int64()] * 3, pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = loaded(*files).memory
        nothing = 0, 0, 0, "", _packed(np.zeros(0, np.int64))
        for batch in batches:
            start, size, of = 0, 0, []
            texts = batch.column("text").to_pylist()
            for i, text in enumerate(texts):
                of.append(stretches(text) if text else [])
                size += len(text)
                if size < TOGETHER and i + 1 < len(texts):
                    continue
                numbers, rows, low = memory.numbers([s for part in of for s in part]), [], 0
                for part in of:
                    own = numbers[low : low + len(part)]
                    low += len(part)
                    if not len(own) or own.min() < 0:
                        rows.append(nothing)
                        continue
                    begin, sizes = memory.ends[own], memory.counts[own, 2]
                    at = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                    rows.append((*memory.counts[own].sum(0).tolist(), ";".join([memory.texts[n] for n in own]), _packed(memory.links[at])))
                yield batch_of(batch.column("doc_id").slice(start, len(of)), rows)
                start, size, of = i + 1, 0, []

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                f = composed(START, _from_row(r))
                sound = f.sound and not any(f.suffix)
                links = _packed(np.array(f.links if sound else [], np.int64))
                values = (*f.n, f.groups) if sound else (0, 0, 0, "")
                yield batch_of(pa.array([r["doc_id"]], batch.schema.field("doc_id").type), [(*values, links)])

    schema = f"doc_id {kind}, {ALIGNED}"
    few = docs.where(F.length("text") <= long).mapInArrow(short, schema)
    # long texts are written with their row numbers before anything refers to these
    many = written(docs.where(F.length("text") > long).select(F.monotonically_increasing_id().alias("row"), "*"))
    ranges = many.agg(F.max(F.octet_length("text"))).first()[0]
    if ranges is None:
        return few
    whole = reduced(written(fragments(pieces(many, piece), files, width)), ranges // width + 1, fan)
    return few.union(whole.join(many.select(F.col("row").alias("of"), "doc_id"), F.col("row") == F.col("of")).drop("of").mapInArrow(closed, schema))


def counted(rows: DataFrame, width: int) -> DataFrame:
    """(pair, n, best) of all linked pairs of rows with `links`: how often a pair is linked, and whether no other of its second
    id is linked more often."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [_unpacked(x) for x in batch.column("links").to_pylist()] or [(np.zeros(0, np.int64),) * 2]
            pairs, at = np.unique(np.concatenate([p for p, _ in both]), return_inverse=True)
            n = np.bincount(at, np.concatenate([t for _, t in both]), len(pairs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    counts = written(rows.select("links").mapInArrow(fold, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    counts = counts.withColumn("b", F.col("pair") % width)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return written(counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def frequent(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, n, best) of the pairs linked most often, at most `most` of them, sorted by pair.

    Counts fall into a few hundred classes; whole classes are taken from the top while there is room.
    """
    step, taken, least = F.floor(F.log("n") * 20).cast("int"), 0, None
    for row in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        taken += row["n"]
        if taken > most:
            break
        least = row["step"]
    rows = sorted(counts.where(step >= least).collect()) if least is not None else []
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], bool)


def scored(rows: DataFrame, width: int, most: int = FREQUENT) -> DataFrame:
    """The rows of an alignment without `links`, with n_links, n_best and count_sum; other columns are kept.

    width: number of the second tokeniser's ids.
    """
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "*"))
    counts = counted(rows, width)
    pairs, n, best = frequent(counts, most)
    kept = [f for f in rows.schema.fields if f.name != "links"]

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, rest = [], []
            for data in batch.column("links").to_pylist():
                own, times = _unpacked(data)
                at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
                hit = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
                at = at[hit]
                sums.append((int(times.sum()), int((times[hit] * best[at]).sum()) if len(at) else 0, int((times[hit] * n[at]).sum()) if len(at) else 0))
                rest.append([{"pair": p, "times": t} for p, t in zip(own[~hit].tolist(), times[~hit].tolist())])
            columns = [batch.column(f.name) for f in kept] + [pa.array(c, pa.int64()) for c in (zip(*sums) if sums else ((),) * 3)]
            columns.append(pa.array(rest, pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "n_links", "n_best", "count_sum", "rest"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    told = written(rows.mapInArrow(known, f"{kinds}, n_links long, n_best long, count_sum long, rest array<struct<pair:bigint,times:bigint>>"))
    rare = told.select(F.col("row").alias("of"), F.explode("rest").alias("r")).select("of", "r.pair", "r.times").join(counts, "pair")
    more = rare.groupBy("of").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    out = told.drop("rest").join(more, F.col("row") == F.col("of"), "left")
    return out.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).drop("row", "of", "more_best", "more_sum")
