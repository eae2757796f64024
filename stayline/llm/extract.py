"""Main text of web pages by a tree-structured graphical model.

The nodes are a page's block elements, each main text or not; the edges join parent and child. A node's own evidence comes
from its tag, the words of its class, id and role, its text's length, links and marks, and the kinds of its parent and
children; an edge's potential says how the labels of a parent and a child with these tags go together. Sum-product message passing, once upward and once downward,
gives every node's exact marginal, and the text directly in the nodes with a marginal above one half is the main text. The
page itself is a node too, so text outside of all elements is judged like any other.

Both potentials are trained on labelled pages (`pages.py`), a sample of documented size: their nodes are counted and the
node weights fitted there; the model is a few hundred numbers. Pages are then extracted partition by partition.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined by one space in
page order. Scripts, styles, templates, form controls, comments and markup are never text. A line break element is white
space. Nothing is capped.

Defined results: a null or empty page has an empty text; markup that is cut off or unbalanced is read as far as it goes
(elements left open end with the page); repeated rows are extracted each; null ids and URLs are returned as they are; an
empty table gives an empty table; other columns are carried unread.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

from stayline.llm.pages import Writer, flat, html

#: Labelled pages to train on.
LABELLED = 1_200
TAU = 0.5

# Groups of HTML element names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript iframe textarea title template svg math xmp noembed noframes select option datalist object canvas audio video".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var label".split())
CLOSES_P = set("address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li".split())
SCOPE = set("table td th caption button html body".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "option": ("option",)}
ENDS_AT = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",)}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    words: tuple[str, ...] = ()
    text: list[str] = field(default_factory=list)
    linked: int = 0  # characters of text inside links


def _names(attributes: str) -> tuple[str, ...]:
    """Words of the attributes that name a part: parts of class, id and role names, lowered, without plural endings."""
    found = []
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden" or kind == "style" and re.search(r"display\s*:\s*none", value):
            found.append("hidden")
        elif kind != "style":
            found += [w.lower().removesuffix("s") for w in _NAME.findall(value)]
    return tuple(dict.fromkeys(found))


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The tree of block elements in page order (node 0 is the page), and the text runs (node, text); a run of node -1 parts blocks."""
    nodes, runs, stack, links = [Node("#page", -1)], [], [0], 0
    at, size = 0, len(page)
    # how many of each element are open, and open paragraphs by scope: what is not open is not looked for
    opened, paragraphs = Counter(), [0]

    def close(depth: int) -> None:
        nonlocal links
        for i in stack[depth:][::-1]:
            tag = nodes[i].tag
            opened[tag] -= 1
            if tag in SCOPE:
                paragraphs.pop()
            elif tag == "p":
                paragraphs[-1] -= 1
        del stack[depth:]
        links = 0
        runs.append((-1, " "))

    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[7] is not None:
            text = references.unescape(m[7]) if "&" in m[7] else m[7]
            node = nodes[stack[-1]]
            node.text.append(text)
            if links:
                node.linked += len(text)
            runs.append((stack[-1], text))
            continue
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, ending, attributes = tag.lower(), m[1] or m[4], (m[3] or m[6] or "")
        if ending:
            if tag == "a":
                links = max(0, links - 1)
            elif opened[tag]:
                for depth in range(len(stack) - 1, 0, -1):
                    if nodes[stack[depth]].tag == tag:
                        close(depth)
                        break
        elif tag in VOID:
            if tag in ("br", "hr"):
                runs.append((-1, " "))
        elif tag in RAW:
            runs.append((-1, " ") if tag not in ("script", "style", "template", "noscript") else (stack[-1], ""))
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
        elif tag == "a":
            links += 1
        else:
            words = _names(attributes) if attributes else ()
            if tag in INLINE and not words:
                continue
            if tag in CLOSES_P and paragraphs[-1]:
                for depth in range(len(stack) - 1, 0, -1):
                    if nodes[stack[depth]].tag == "p":
                        close(depth)
                        break
                    if nodes[stack[depth]].tag in SCOPE:
                        break
            if tag in SELF_CLOSING and any(opened[x] for x in SELF_CLOSING[tag]):
                for depth in range(len(stack) - 1, 0, -1):
                    inner = nodes[stack[depth]].tag
                    if inner in SELF_CLOSING[tag]:
                        close(depth)
                        break
                    if inner in ENDS_AT.get(tag, ()):
                        break
            nodes.append(Node(tag, stack[-1], words))
            opened[tag] += 1
            if tag in SCOPE:
                paragraphs.append(0)
            elif tag == "p":
                paragraphs[-1] += 1
            if tag not in INLINE:
                runs.append((-1, " "))
            stack.append(len(nodes) - 1)
    return nodes, runs


def evidence(nodes: list[Node]) -> list[list[str]]:
    """What each node shows: itself, the kind of its parent, and which kinds its children are."""
    held = [Counter() for _ in nodes]
    for x in nodes[1:]:
        held[x.parent][x.tag] += 1
    out = []
    for x, children in zip(nodes, held):
        text = "".join(x.text).strip()
        size, share = len(text), x.linked / max(1, len(text))
        length = 0 if not size else 1 if size < 25 else 2 if size < 80 else 3 if size < 250 else 4
        linked = 0 if not x.linked else 1 if share < 0.5 else 2
        ends = bool(text) and (text[-1] in ".!?…:;\"”" or ". " in text)
        above = nodes[x.parent] if x.parent >= 0 else x
        paragraphs = min(children["p"], 3)
        found = [f"tag {x.tag}", f"length {length}", f"linked {linked}", f"tag {x.tag} length {length} linked {linked}", f"ends {ends}"]
        found += [f"tag {x.tag} under {above.tag}", f"tag {x.tag} holds {paragraphs} p {bool(children['h1'])} h1 {bool(children['a'] or children['li'])} li"]
        if "©" in text:
            found.append("copyright")
        if not x.words:
            found.append(f"tag {x.tag} unnamed")
        out.append(found + [f"name {w}" for w in x.words] + [f"under name {w}" for w in above.words])
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    edges: dict[str, tuple[float, float, float, float]]  # by the tags of parent and child, or the child's alone: (parent, child) 00, 01, 10, 11
    other: tuple[float, float, float, float]


def marginals(nodes: list[Node], model: Model) -> list[float]:
    """Probability of being main text, per node, by one upward and one downward pass."""
    n = len(nodes)
    own1 = [0.0] * n
    weights = model.weights
    shown = evidence(nodes)
    for i in range(n):
        z = sum([weights.get(e, 0.0) for e in shown[i]], weights["bias"])
        own1[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    # up0, up1: evidence of a subtree for its root's label; to0, to1: its message to the parent
    up0, up1 = [1 - p for p in own1], own1[:]
    to0, to1 = [1.0] * n, [1.0] * n
    edge = [model.edges.get(f"{nodes[x.parent].tag} {x.tag}") or model.edges.get(x.tag, model.other) for x in nodes]
    for i in range(n - 1, 0, -1):
        e = edge[i]
        a, b = e[0] * up0[i] + e[1] * up1[i], e[2] * up0[i] + e[3] * up1[i]
        to0[i], to1[i] = a / (a + b), b / (a + b)
        p = nodes[i].parent
        x, y = up0[p] * to0[i], up1[p] * to1[i]
        up0[p], up1[p] = x / (x + y), y / (x + y)
    all0, all1 = up0[:1] + [1.0] * (n - 1), up1[:1] + [0.0] * (n - 1)
    for i in range(1, n):
        p, e = nodes[i].parent, edge[i]
        # what the parent knows without this child
        x, y = all0[p] / max(to0[i], 1e-300), all1[p] / max(to1[i], 1e-300)
        a, b = (x * e[0] + y * e[2]) * up0[i], (x * e[1] + y * e[3]) * up1[i]
        all0[i], all1[i] = a / (a + b), b / (a + b)
    return all1


def main_text(page: str | None, model: Model, tau: float = TAU) -> str:
    if not page:
        return ""
    nodes, runs = parse(page)
    likely = marginals(nodes, model)
    return " ".join("".join([text if i < 0 or likely[i] > tau else " " for i, text in runs]).split())


def labelled(spark: SparkSession, pages: int, seed: int) -> DataFrame:
    """One row per node of the labelled pages: page, node, its evidence, its tag and its parent's, both their labels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for number in batch["id"]:
                drawn = Writer(seed * 1_000_003 + int(number)).page()
                nodes, _ = parse(html(drawn))
                labels = [*([] if drawn.tag == "#page" else [0]), *flat(drawn)]
                # controls and plain spans are no nodes; their parts carry no main text and are skipped in step
                kept = [0, *_kept(drawn)]
                if len(kept) != len(nodes):
                    raise ValueError("a labelled page does not parse into its own parts")
                shown = evidence(nodes)
                for i, x in enumerate(nodes):
                    above = x.parent if i else 0
                    out.append((number, i, shown[i], x.tag, nodes[above].tag, labels[kept[i]], labels[kept[above]]))
            yield pd.DataFrame(out, columns=["page", "node", "evidence", "tag", "under", "label", "above"])

    return spark.range(pages).mapInPandas(run, "page long, node long, evidence array<string>, tag string, under string, label int, above int")


def _kept(part) -> list[int]:
    """Places, among all parts in page order (from 1), of those that are nodes; the page itself is none of them."""
    out, at = [], -1 if part.tag == "#page" else 0

    def walk(x) -> None:
        nonlocal at
        at += 1
        if at and not (x.tag in RAW or x.tag in INLINE and not _names(x.attributes)):
            out.append(at)
        for c in x.children:
            if not isinstance(c, str):
                walk(c)

    walk(part)
    return out


def trained(spark: SparkSession, pages: int = LABELLED, seed: int = 3) -> Model:
    """Node weights by logistic regression, edge potentials by counts, on the nodes of a bounded sample of labelled pages."""
    rows = labelled(spark, pages, seed).orderBy("page", "node").collect()
    seen = Counter(e for r in rows for e in r["evidence"])
    names = sorted(e for e, n in seen.items() if n >= 5)
    place = {e: i + 1 for i, e in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1), np.float32)
    x[:, 0] = 1
    for i, r in enumerate(rows):
        for e in r["evidence"]:
            if e in place:
                x[i, place[e]] = 1
    y = np.array([r["label"] for r in rows], np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(12):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None].astype(np.float32)).T @ x + np.eye(len(w))
        step = np.linalg.solve(hessian.astype(np.float64), x.T @ (y - p) - w)
        w = w + step
        if np.abs(step).max() < 1e-5:
            break

    def potential(counts: Counter) -> tuple[float, float, float, float]:
        n = {(a, b): counts[a, b] + 0.5 for a in (0, 1) for b in (0, 1)}
        total = sum(n.values())
        return tuple(n[a, b] * total / (sum(n[a, c] for c in (0, 1)) * sum(n[c, b] for c in (0, 1))) for a in (0, 1) for b in (0, 1))

    by_tag, every = defaultdict(Counter), Counter()
    for r in rows:
        if not r["node"]:
            continue  # no edge leads to the page
        by_tag[r["tag"]][r["above"], r["label"]] += 1
        by_tag[f"{r['under']} {r['tag']}"][r["above"], r["label"]] += 1
        every[r["above"], r["label"]] += 1
    return Model({"bias": float(w[0])} | {e: float(w[i]) for e, i in place.items()}, {t: potential(c) for t, c in by_tag.items() if sum(c.values()) >= 20}, potential(every))


def extracted(pages: DataFrame, model: Model, page: str = "html") -> DataFrame:
    """All rows with `text` and `n_chars`, without the page itself."""
    carried = pages.drop("text", "n_chars")
    schema = StructType([*(f for f in carried.schema.fields if f.name != page), StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(p, model) for p in batch[page]]
            yield batch.drop(columns=[page]).assign(text=texts, n_chars=[len(t) for t in texts])

    return carried.mapInPandas(run, schema)
