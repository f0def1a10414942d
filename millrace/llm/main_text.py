"""HTML extraction: boosted trees score the blocks of a page's tree, and one consistent choice of subtrees is decoded.

A page becomes a tree of block elements (loose text beside blocks counts as one); inline elements belong to their block.
Features of a node are the density of text, links and controls in its subtree, its contrast with its siblings and their
repetition, its depth and place, where the page's densest text lies, its tag, and the words in its class, id, role, itemprop
and aria-label and in those of its ancestors, hashed to BUCKETS; no word has a meaning of its own. Trees boosted on generated
pages (made_pages), whose parts are known, give each node the probability of being main text. The fitted trees are
main_text_model.json beside this file, which "python -m millrace.llm.main_text" makes again from PAGES and SEED.

Decoding gives each node one of three states: above (it may hold main text further down), in, or cut. Below cut all is cut;
below in all is in or cut; so no choice contradicts that of an ancestor. The states with the largest total log-probability
(weighted by the text's length, with a price for a cut inside main text) are found by dynamic programming over the tree.
Where that leaves nothing although a block has PROSE words or more outside links, the likeliest such block counts as in.

Null and empty pages give an empty text; pages of any length and depth are read whole; malformed markup is repaired as far
as blocks are concerned; repeated rows stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser
from importlib import resources
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, common, made_pages

#: Elements that are not rendered as text, blocks, and those that a new one of the same group closes.
SKIPPED = frozenset("script style noscript template iframe object svg canvas select button textarea title datalist audio video map label legend option".split())
BLOCKS = frozenset(
    "html body main article section header footer nav aside div p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre table thead tbody tfoot tr td th caption form fieldset figure figcaption details summary address center hgroup dialog menu".split()
)
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
_SCOPES = frozenset("table ul ol dl body html".split())
_CONTROLS = frozenset("input select textarea button label option".split())

#: Hash buckets of the words in names; the attributes that have such words.
BUCKETS = 256
_NAMED = frozenset("class id role itemprop aria-label".split())
_TAGS = ("p", "div", "section", "article", "main", "nav", "header", "footer", "aside", "list", "li", "heading", "quote", "table", "form", "body", "figure", "#run")
_TAG = {"ul": "list", "ol": "list", "dl": "list", "menu": "list", "dt": "li", "dd": "li", "blockquote": "quote", "pre": "quote", "html": "body", "figcaption": "figure", "fieldset": "form"}
_TAG |= {f"h{k}": "heading" for k in range(1, 7)} | dict.fromkeys("thead tbody tfoot tr td th caption".split(), "table")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@lru_cache(maxsize=1 << 16)
def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS


class _Tree(HTMLParser):
    """Block nodes with their parents, and the page's text as (node, text) in order; node -1 marks a break."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.depth, self.names, self.gold = ["body"], [-1], [0], [()], [""]
        self.links, self.tags, self.controls = [0], [0], [0]
        self.pieces: list[tuple[int, str]] = []
        self.stack, self.skipping, self.link = [0], [], 0

    def _open(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found = {_bucket(w) for k, v in attrs if k in _NAMED and v for w in map(str.lower, _WORD.findall(v))}
        at = self._node(tag, self.stack[-1], tuple(sorted(found)), next((v or "" for k, v in attrs if k == "data-gold"), ""))
        self.stack.append(at)

    def _node(self, tag: str, parent: int, names: tuple[int, ...] = (), gold: str = "") -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.names.append(names)
        self.gold.append(gold or self.gold[parent])
        for x in (self.links, self.tags, self.controls):
            x.append(0)
        return len(self.tag) - 1

    def _pop(self, to: int) -> None:
        del self.stack[to:]
        self.link = 0
        self.pieces.append((-1, ""))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skipping:
            if tag == self.skipping[0]:
                self.skipping.append(tag)
            return
        at = self.stack[-1]
        self.tags[at] += 1
        if tag in _CONTROLS:
            self.controls[at] += 1
        if tag in SKIPPED:
            self.skipping.append(tag)
        elif tag in ("html", "body"):
            if any(k in ("class", "id", "data-gold") for k, _ in attrs):
                self._open("body", attrs)
        elif tag in BLOCKS:
            self._imply(tag)
            self.pieces.append((-1, ""))
            self.link = 0
            self._open(tag, attrs)
        elif tag == "a":
            self.link += 1
        elif tag in ("br", "hr"):
            self.pieces.append((-1, ""))

    def _imply(self, tag: str) -> None:
        """Close what the new block cannot be inside of."""
        if self.tag[self.stack[-1]] == "p" or tag not in _CLOSES:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.tag[self.stack[k]] == "p":
                    self._pop(k)
                    break
                if self.tag[self.stack[k]] in _SCOPES:
                    break
        closes = _CLOSES.get(tag, ())
        while closes:
            for k in range(len(self.stack) - 1, 0, -1):
                own = self.tag[self.stack[k]]
                if own in closes:
                    self._pop(k)
                    break
                if own in _SCOPES or own in ("div", "section", "article"):
                    return
            else:
                return

    def handle_endtag(self, tag: str) -> None:
        if self.skipping:
            if tag == self.skipping[-1]:
                self.skipping.pop()
            elif tag in ("body", "html") or (tag in BLOCKS and self.skipping[0] not in ("script", "style", "svg", "template", "noscript") and any(self.tag[n] == tag for n in self.stack)):
                self.skipping.clear()
            if self.skipping or tag in SKIPPED:
                return
        if tag == "a":
            self.link = max(0, self.link - 1)
        elif tag in BLOCKS:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.tag[self.stack[k]] == tag:
                    self._pop(k)
                    return

    def handle_data(self, data: str) -> None:
        if not self.skipping and data:
            at = self.stack[-1]
            self.pieces.append((at, data))
            if self.link:
                self.links[at] += len(data.strip())

    def finish(self) -> None:
        """Text beside block children becomes nodes of its own, one for each run between breaks."""
        inner = set(self.parent)
        run, out = {}, []
        for at, text in self.pieces:
            if at < 0:
                run = {}
            elif at in inner and text.strip():
                if at not in run:
                    run[at] = self._node("#run", at)
                    share = min(self.links[at], len(text.strip()))
                    self.links[at] -= share
                    self.links[run[at]] += share
                at = run[at]
            elif at in run:
                at = run[at]
            out.append((at, text))
        self.pieces = out


def parse(html: str) -> _Tree:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    tree.finish()
    return tree


_SEMANTIC = ("nav", "footer", "header", "aside", "form", "article", "main")
_ALL = tuple(range(BUCKETS))


def _beside(parent: np.ndarray, value: np.ndarray, step: int, first: float) -> np.ndarray:
    """The value of each node's previous (-1) or next (1) sibling."""
    out, last = np.full(len(parent), first), {}
    for k in range(len(parent))[::-step]:
        p = int(parent[k])
        if p in last:
            out[k] = value[last[p]]
        last[p] = k
    return out


def features(t: _Tree, own_names: tuple[int, ...] = _ALL, above_names: tuple[int, ...] = _ALL) -> tuple[np.ndarray, np.ndarray]:
    """(features, text length of the subtree) of each node; only the given buckets of names become columns."""
    n = len(t.tag)
    own, marks, rights, first = np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, -1.0)
    done = 0
    for at, text in t.pieces:
        if at >= 0:
            size = len(text.strip())
            own[at] += size
            marks[at] += sum(map(text.count, ".,;:!?"))
            rights[at] += text.count("\u00a9")
            if first[at] < 0 and size:
                first[at] = done
            done += size
    parent, links = np.array(t.parent), np.array(t.links, float)
    kind = [_TAG.get(x, x) for x in t.tag]
    is_p = np.array([x in ("p", "#run", "quote") for x in kind], float)
    sums = np.stack([own, marks, links, np.array(t.tags, float), np.array(t.controls, float)] + [np.array([k == x for k in kind], float) for x in ("p", "li", "heading")] + [own * np.array([k == "p" for k in kind]), rights], axis=1)
    begin = np.where(first < 0, np.inf, first)
    children, direct = np.zeros(n), np.maximum(0, own - links)
    text = direct * is_p
    twins: dict[int, Counter] = {}
    for k in range(n - 1, 0, -1):  # children come after their parents
        p = parent[k]
        sums[p] += sums[k]
        begin[p] = min(begin[p], begin[k])
        children[p] += 1
        direct[p] += text[k]
        twins.setdefault(int(p), Counter())[t.tag[k], t.names[k]] += 1
    same = np.array([0] + [twins[t.parent[k]][t.tag[k], t.names[k]] for k in range(1, n)], float)
    copies = np.array([max((c for (tag, _), c in twins[k].items() if tag not in ("p", "#run")), default=0) if k in twins else 0 for k in range(n)], float)
    length, total = sums[:, 0], max(1.0, sums[0, 0])
    order, seen, longest = np.zeros(n), np.zeros(n), np.zeros(n)
    densest = int(direct.argmax())
    near, k = np.zeros(n), densest
    while k >= 0:
        near[k], k = 2, parent[k]
    near[densest] = 1
    own_columns, above_columns = ({b: j for j, b in enumerate(x)} for x in (own_names, above_names))
    mine, above = np.zeros((n, len(own_names))), np.zeros((n, len(above_names)))
    tags_above = np.zeros((n, len(_SEMANTIC)))
    for k in range(n):
        for b in t.names[k]:
            if b in own_columns:
                mine[k, own_columns[b]] = 1
        if k:
            p = parent[k]
            order[k], seen[p] = seen[p], seen[p] + 1
            longest[p] = max(longest[p], length[k])
            above[k], tags_above[k] = above[p], tags_above[p]
            for b in t.names[p]:
                if b in above_columns:
                    above[k, above_columns[b]] = 1
            if t.tag[p] in _SEMANTIC:
                tags_above[k, _SEMANTIC.index(t.tag[p])] = 1
            if near[k] == 0 and near[p] in (1, 3):
                near[k] = 3
    up = np.maximum(parent, 0)
    siblings = np.maximum(1, children[up])
    beside = np.maximum(0, length[up] - length) / np.maximum(1, siblings - 1)
    safe = np.maximum(1.0, length)
    linked, prose = sums[:, 2] / safe, sums[:, 8] / safe
    size, best = np.log1p(length), direct / max(1.0, direct[densest])
    base = [
        np.array(t.depth, float), size, linked, np.log1p(length / (sums[:, 3] + 1)), np.log1p(sums[:, 5]), prose, 100 * sums[:, 1] / safe, order / siblings, np.log1p(siblings),
        length / np.maximum(1.0, length[up]), length / total, np.log1p(beside), np.log1p(sums[:, 6]), np.log1p(sums[:, 7]), np.log1p(sums[:, 4]), np.where(np.isfinite(begin), begin, total) / total, np.log1p(children),
        np.log1p(same), np.log1p(copies), length / np.maximum(1.0, longest[up]), size - _beside(parent, size, -1, 0.0), size - _beside(parent, size, 1, 0.0), _beside(parent, linked, -1, -1.0), _beside(parent, linked, 1, -1.0),
        best, near, best[up], linked[up], prose[up], (length / total)[up], np.log1p(same)[up], np.log1p(copies)[up], (sums[:, 9] > 0).astype(float), np.log1p(sums[up, 4]),
    ]
    tags = np.array([[k == x for x in _TAGS] for k in kind], float)
    return np.hstack([np.stack(base, axis=1), tags, tags[up], tags_above, mine, above]), length


#: Columns before those of names.
_PLAIN = 34 + 2 * len(_TAGS) + len(_SEMANTIC)


#: What a cut inside main text costs, in nats.
CUT = 3.0
_ABOVE, _IN, _CUT = range(3)


def decode(parent: list[int], p: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The state of each node; parents come before their children."""
    n = len(parent)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    weight = 1 + np.log1p(length)
    yes, no = (weight * np.log(p)).tolist(), (weight * np.log(1 - p)).tolist()
    best = [[a, b, a] for a, b in zip(no, yes, strict=True)]
    for k in range(n - 1, 0, -1):
        up, own = best[parent[k]], best[k]
        up[_ABOVE] += max(own)
        up[_IN] += max(own[_IN], own[_CUT] - CUT)
        up[_CUT] += own[_CUT]
    state = np.zeros(n, np.int8)
    state[0] = int(np.argmax(best[0][:2]))
    for k in range(1, n):
        up, own = state[parent[k]], best[k]
        if up == _CUT:
            state[k] = _CUT
        elif up == _IN:
            state[k] = _IN if own[_IN] >= own[_CUT] - CUT else _CUT
        else:
            state[k] = max((_ABOVE, _CUT, _IN), key=own.__getitem__)
    return state


def text_of(t: _Tree, state: np.ndarray) -> str:
    """The text of the nodes that are in, blocks joined by one space, white space inside them made one space."""
    keep = state == _IN
    return " ".join("".join(" " if at < 0 else text for at, text in t.pieces if at < 0 or keep[at]).split())


#: Words outside links that a block needs to be taken where nothing else is.
PROSE = 12


def _likeliest(t: _Tree, p: np.ndarray) -> np.ndarray:
    """The states where decoding found no main text: the likeliest block that has PROSE words of its own, if there is one."""
    words, n = np.zeros(len(t.tag)), len(t.tag)
    for at, text in t.pieces:
        if at >= 0:
            words[at] += len(text.split())
    loose = [k for k in range(n) if words[k] >= PROSE and 2 * t.links[k] < sum(map(len, (x for at, x in t.pieces if at == k)))]
    state = np.full(n, _CUT)
    if loose:
        state[max(loose, key=lambda k: (p[k], words[k], -k))] = _IN
    return state


def gold_text(t: _Tree) -> str:
    return text_of(t, np.array([_IN if g == "in" else _CUT for g in t.gold]))


PAGES, SEED = 2400, 20
MODEL = Path(__file__).with_name("main_text_model.json")


@dataclass(frozen=True)
class Trees:
    """Boosted trees and the buckets of names that they look at."""

    boosted: boosting.Boosted
    own_names: tuple[int, ...]
    above_names: tuple[int, ...]

    def dump(self) -> str:
        b = self.boosted
        return json.dumps({"pages": PAGES, "seed": SEED, "start": b.start, "own_names": self.own_names, "above_names": self.above_names, "feature": b.feature.tolist(), "threshold": [[None if np.isinf(x) else x for x in row] for row in b.threshold.tolist()], "leaf": b.leaf.round(6).tolist()})


def train(pages: int = PAGES, seed: int = SEED, trees: int = 120) -> Trees:
    """Trees trained on so many generated pages; a node's label is what most of its subtree's text is."""
    rng = random.Random(seed)
    xs, ys, ws = [], [], []
    for _ in range(pages):
        t = parse(made_pages.made_page(rng))
        x, length = features(t)
        main = np.zeros(len(t.tag))
        for at, text in t.pieces:
            if at >= 0 and t.gold[at] == "in":
                main[at] += len(text.strip())
        for k in range(len(t.tag) - 1, 0, -1):
            main[t.parent[k]] += main[k]
        used = length > 0
        xs.append(x[used])
        ys.append((main[used] / length[used] > 0.9).astype(float))
        ws.append(1 + np.log1p(length[used]))
    fitted = boosting.fit(np.vstack(xs), np.concatenate(ys), np.concatenate(ws), trees=trees, rate=0.2)
    looked = {int(f) - _PLAIN for f in fitted.feature.reshape(-1) if f >= _PLAIN}
    own, above = tuple(sorted(k for k in looked if k < BUCKETS)), tuple(sorted(k - BUCKETS for k in looked if k >= BUCKETS))
    place = {_PLAIN + b: _PLAIN + j for j, b in enumerate(own)} | {_PLAIN + BUCKETS + b: _PLAIN + len(own) + j for j, b in enumerate(above)}
    moved = np.vectorize(lambda f: place.get(f, f), otypes=[np.int64])(fitted.feature)
    return Trees(boosting.Boosted(moved, fitted.threshold, fitted.leaf, fitted.start), own, above)


@lru_cache(maxsize=1)
def model() -> Trees:
    """The fitted trees, as they are stored."""
    raw = json.loads(resources.files(__package__).joinpath(MODEL.name).read_text())  # from a zip file too
    threshold = np.array([[np.inf if x is None else x for x in row] for row in raw["threshold"]])
    return Trees(boosting.Boosted(np.array(raw["feature"]), threshold, np.array(raw["leaf"]), raw["start"]), tuple(raw["own_names"]), tuple(raw["above_names"]))


def extract_all(pages: list[str], trees: Trees) -> list[str]:
    """The main texts of some pages; their nodes are scored together."""
    parsed = [parse(p) for p in pages]
    made = [features(t, trees.own_names, trees.above_names) for t in parsed]
    if not made:
        return []
    p = trees.boosted.probability(np.vstack([x for x, _ in made]))
    out, at = [], 0
    for t, (x, length) in zip(parsed, made, strict=True):
        own = p[at : at + len(x)]
        text = text_of(t, decode(t.parent, own, length))
        out.append(text or text_of(t, _likeliest(t, own)))
        at += len(x)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", trees: Trees | None = None) -> DataFrame:
    """(id, url, text): the main text of each page."""
    common.bounded(pages.sparkSession)
    trees = trees or model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = extract_all([x.decode("utf-8", "replace") for x in b.column(2).to_pylist()], trees)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), common.utf8(html_col).alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string")


if __name__ == "__main__":
    MODEL.write_text(train().dump() + "\n")
