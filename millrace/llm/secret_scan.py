"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials.

The base kinds are assign, access and hex (see BASE). Beyond them, candidates are scored by automata that were inferred from
labelled credentials of one format each: a prefix tree of the examples is folded by merging states whose continuation
frequencies agree within Hoeffding bounds, red states first, so that random bodies become loops; what all examples begin with
stays literal. A candidate starts where a format's literal part occurs (without one, where no letter or digit precedes) and
ends, not in a dot, where no letter or digit follows, so a credential after or before a separator counts by itself; it is no
shorter than the shortest labelled value and no longer than the longest one by more than they vary (formats of FEW_LENGTHS
lengths or fewer have these only). Every such run of
characters is scored, inside base spans too. It is reported under a format whose automaton gives it a likelihood that exceeds
that under a model of ordinary identifiers by at least MARGIN a symbol; of candidates that overlap, the longest and then the
one with the largest excess. Base spans stay beside those of formats, which say what kind of credential the base one holds.

Labelled credentials are (kind, value) pairs; the default ones are generated from public formats, EXAMPLES of each. At
most LIMIT labelled rows of a kind are used, the ones whose hash is smallest, when a table of them is given. The models
are a few hundred states and go to the workers in the closure.

Null and empty texts have no spans; whole texts of any length are read; ids may be null or repeat; an empty table gives an
empty result; other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import math
import os
import random
import re
import string
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The base kinds in their order, their patterns and least lengths.
BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones never hide a longer one
LEAST_VALUE, LEAST_ACCESS = 8, 16

_WORD = frozenset(string.ascii_letters + string.digits)
EXAMPLES, LIMIT, LITERAL = 400, 2000, 8
#: Formats with no more different lengths than this have those lengths only.
FEW_LENGTHS = 8
ALPHA = 0.02
#: Nats a symbol by which a format must be likelier than ordinary text.
MARGIN = 0.5

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base kinds, by start and then kind."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], BASE.index(x[2])))


# Symbols: the first characters are literal, later ones stand for their class.

_CLASSES = {"l": "ghijklmnopqrstuvwxyz", "u": "GHIJKLMNOPQRSTUVWXYZ", "x": "abcdef", "X": "ABCDEF", "9": string.digits, "-": "-_", "+": "+/", "=": "=", ".": "."}
_CLASS = {c: k for k, chars in _CLASSES.items() for c in chars}
_SPREAD = {k: math.log(len(chars)) for k, chars in _CLASSES.items()}


def symbols(value: str, literal: int) -> list[str]:
    return [f"'{c}" if i < literal else _CLASS.get(c, "?") for i, c in enumerate(value)]


def _cost(symbol: str) -> float:
    """Nats for the choice of a character within its class."""
    return 0.0 if symbol[0] == "'" else _SPREAD.get(symbol, 4.0)


@dataclass(frozen=True)
class Automaton:
    """moves[state][symbol] = (next state, log probability); stops[state] = log probability of ending there.

    literal: so many characters at the start stand for themselves. least, most: bounds of a value's length; lengths: the
    only ones, where the labelled values have few different ones."""

    literal: int
    least: int
    most: int
    lengths: frozenset[int]
    moves: tuple[dict[str, tuple[int, float]], ...]
    stops: tuple[float, ...]

    def fits(self, n: int) -> bool:
        return n in self.lengths if self.lengths else self.least <= n <= self.most

    def score(self, value: str) -> float:
        """The log-likelihood of a value; minus infinity if no path has it."""
        if not self.fits(len(value)):
            return -math.inf
        at, total = 0, 0.0
        for s in symbols(value, self.literal):
            step = self.moves[at].get(s)
            if step is None:
                return -math.inf
            at, total = step[0], total + step[1] - _cost(s)
        return total + self.stops[at]


class _Tree:
    """A prefix tree of values with visit counts, folded in place."""

    def __init__(self, values: list[str], literal: int) -> None:
        self.ends: list[int] = [0]
        self.next: list[dict[str, list[int]]] = [{}]  # symbol -> [state, count]
        for v in values:
            at = 0
            for s in symbols(v, literal):
                if s not in self.next[at]:
                    self.next[at][s] = [self._new(), 0]
                edge = self.next[at][s]
                edge[1] += 1
                at = edge[0]
            self.ends[at] += 1

    def _new(self) -> int:
        self.ends.append(0)
        self.next.append({})
        return len(self.ends) - 1

    def seen(self, q: int) -> int:
        return self.ends[q] + sum(n for _, n in self.next[q].values())

    def alike(self, a: int, b: int, width: float) -> bool:
        """Whether the continuations of two states agree, all the way down the second one's tree."""
        work = [(a, b)]
        while work:
            p, q = work.pop()
            n, m = self.seen(p), self.seen(q)
            if not n or not m:
                continue
            bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[p] / n - self.ends[q] / m) > bound:
                return False
            for s in self.next[p].keys() | self.next[q].keys():
                x, y = self.next[p].get(s), self.next[q].get(s)
                if abs((x[1] if x else 0) / n - (y[1] if y else 0) / m) > bound:
                    return False
                if x and y:
                    work.append((x[0], y[0]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree below b to the automaton at a."""
        work = [(a, b)]
        while work:
            p, q = work.pop()
            self.ends[p] += self.ends[q]
            for s, (to, n) in self.next[q].items():
                if s in self.next[p]:
                    self.next[p][s][1] += n
                    work.append((self.next[p][s][0], to))
                else:
                    self.next[p][s] = [to, n]


def infer(values: list[str], alpha: float = ALPHA) -> Automaton:
    """The automaton of one format: blue states are merged into the first compatible red state, or become red.

    What all values begin with, up to LITERAL characters, stays literal."""
    literal = min(LITERAL, len(os.path.commonprefix(values)))
    tree = _Tree(values, literal)
    width = math.sqrt(0.5 * math.log(2 / alpha))
    red = [0]
    while True:
        blue = [(q, s, to) for q in red for s, (to, _) in tree.next[q].items() if to not in red]
        if not blue:
            break
        q, s, to = max(blue, key=lambda x: (tree.next[x[0]][x[1]][1], -x[2]))
        for r in red:
            # a literal symbol belongs to its place: only states past the literal part loop
            if s[0] != "'" and not any(k[0] == "'" for k in tree.next[r]) and tree.alike(r, to, width):
                tree.next[q][s][0] = r
                tree.fold(r, to)
                break
        else:
            red.append(to)
    number = {q: k for k, q in enumerate(red)}
    moves, stops = [], []
    for q in red:
        n = tree.seen(q)
        moves.append({s: (number[to], math.log(c / n)) for s, (to, c) in tree.next[q].items()})
        stops.append(math.log(tree.ends[q] / n) if tree.ends[q] else -math.inf)
    lengths = frozenset(map(len, values))
    least, most = min(lengths), max(lengths)
    few = len(lengths) <= FEW_LENGTHS
    return Automaton(literal, least, most if few else 2 * most - least, lengths if few else frozenset(), tuple(moves), tuple(stops))


def examples(seed: int = 7, each: int = EXAMPLES) -> list[tuple[str, str]]:
    """Labelled credentials of public formats: (kind, value)."""
    rng = random.Random(seed)
    low, word = string.ascii_lowercase + string.digits, string.ascii_letters + string.digits
    draw = lambda chars, n: "".join(rng.choices(chars, k=n))
    formats = {
        "ghp": lambda: "ghp_" + draw(word, 36),
        "glpat": lambda: "glpat-" + draw(word + "-_", 20),
        "slack": lambda: f"xoxb-{draw(string.digits, 12)}-{draw(string.digits, 12)}-{draw(word, 24)}",
        "stripe": lambda: "sk_live_" + draw(word, 24),
        "google": lambda: "AIza" + draw(word + "-_", 35),
        "npm": lambda: "npm_" + draw(word, 36),
        "jwt": lambda: "eyJh" + draw(word, rng.randint(16, 60)) + (f".eyJ{draw(word + '-_', rng.randint(30, 200))}.{draw(word + '-_', 43)}" if rng.random() < 0.8 else ""),
        "aws": lambda: "AKIA" + draw(string.ascii_uppercase + "234567", 16),
        "hexkey": lambda: draw(string.digits + "abcdef", rng.choice((32, 40, 64))),
        "upperhex": lambda: draw(string.digits + "ABCDEF", rng.choice((32, 40, 64))),
        "uuidkey": lambda: "key-" + draw(low, 32),
    }
    return [(kind, make()) for kind, make in formats.items() for _ in range(each)]


def ordinary(seed: int = 11, n: int = 3000) -> list[str]:
    """Identifiers, paths and numbers as text has them: what a credential must differ from."""
    rng = random.Random(seed)
    parts = "the and for tion with data user file test page index time ver ing able name list item view code main form part node".split()
    out = []
    for _ in range(n):
        words = [rng.choice(parts) for _ in range(rng.randint(3, 7))]
        style = rng.randrange(6)
        if style == 0:
            v = "".join(w.title() for w in words) + str(rng.randint(0, 9999))
        elif style == 1:
            v = "_".join(words).upper() + f"_{rng.randint(0, 99)}"
        elif style == 2:
            v = "/".join([*words, str(rng.randint(1, 3000))])
        elif style == 3:
            v = "-".join([str(rng.randint(1990, 2030)), *words])
        elif style == 4:
            v = "".join(words) + str(rng.randint(0, 10**6))
        else:
            v = "-".join(str(rng.randint(0, 10 ** rng.randint(1, 6))) for _ in words) + rng.choice(parts)
        out.append(v)
    return out


@dataclass(frozen=True)
class Background:
    """A smoothed Markov chain over character classes: the likelihood of ordinary identifiers."""

    steps: dict[tuple[str, str], float]
    other: float

    def fits(self, n: int) -> bool:
        return n in self.lengths if self.lengths else self.least <= n <= self.most

    def score(self, value: str) -> float:
        kinds = ["^", *(_CLASS.get(c, "?") for c in value), "$"]
        return sum(self.steps.get(p, self.other) for p in zip(kinds, kinds[1:], strict=False)) - sum(_cost(k) for k in kinds[1:-1])


def background(values: Iterable[str]) -> Background:
    pairs: dict[tuple[str, str], int] = defaultdict(int)
    outs: dict[str, int] = defaultdict(int)
    for v in values:
        kinds = ["^", *(_CLASS.get(c, "?") for c in v), "$"]
        for p in zip(kinds, kinds[1:], strict=False):
            pairs[p] += 1
            outs[p[0]] += 1
    size = len(_CLASSES) + 1
    return Background({p: math.log((n + 0.5) / (outs[p[0]] + 0.5 * size)) for p, n in pairs.items()}, math.log(0.5 / (max(outs.values()) / size)))


@dataclass(frozen=True)
class Scanner:
    """Everything a worker needs: the formats' automata and the model of ordinary identifiers."""

    formats: dict[str, Automaton]
    plain: Background
    margin: float = MARGIN

    def classify(self, value: str) -> str | None:
        """The format that a candidate is likeliest to have, or None."""
        scores = [(a.score(value), kind) for kind, a in self.formats.items()]
        best, kind = max(scores, default=(-math.inf, ""))
        if best == -math.inf or best - self.plain.score(value) < self.margin * len(value):
            return None
        return kind

    def scan(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, further spans)."""
        base, taken = base_spans(text), _Taken(())
        found = [(x, s, e, kind) for kind in self.formats for x, s, e in self._candidates(kind, text)]
        return base, sorted((s, e, kind) for _, s, e, kind in sorted(found, key=lambda c: (c[1] - c[2], -c[0], c[1:])) if taken.add(s, e))

    def _starts(self, kind: str, text: str) -> Iterator[int]:
        """Where candidates of a format may start."""
        lead, run = self._leads[kind]
        if lead:
            at = text.find(lead)
            while at >= 0:
                yield at
                at = text.find(lead, at + 1)
        else:
            for m in run.finditer(text):
                yield from (k for k in range(m.start(), m.end()) if not k or text[k - 1] not in _WORD)

    def _candidates(self, kind: str, text: str) -> Iterator[tuple[float, int, int]]:
        """(excess, start, end) of the candidates of a format that are likely enough.

        All starts advance together; at most one is in a state at a length, so no more are under way than states times lengths."""
        a, steps, other = self.formats[kind], self.plain.steps, self.plain.other
        starts, at = self._starts(kind, text), -1
        start, live = next(starts, None), {}  # (state, length) -> (excess, start)
        while live or start is not None:
            at = at if live else start
            c = text[at] if at < len(text) else ""
            k, before = _CLASS.get(c), live
            if at == start:
                before = live | {(0, 0): (0.0, at)}
                start = next(starts, None)
            live = {}
            if k is None:
                continue
            last = _CLASS[text[at - 1]] if at and text[at - 1] in _CLASS else ""
            ends = c != "." and text[at + 1 : at + 2] not in _WORD
            for (q, n), (x, s) in before.items():
                move = a.moves[q].get(f"'{c}") or a.moves[q].get(k)
                if move is None or n == a.most:
                    continue
                cost = 0.0 if f"'{c}" in a.moves[q] else _cost(k)
                x += move[1] - cost - steps.get((last if n else "^", k), other) + _cost(k) - self.margin
                key = (move[0], n + 1)
                if key not in live or (x, -s) > (live[key][0], -live[key][1]):
                    live[key] = (x, s)
            if ends:
                for (q, n), (x, s) in live.items():
                    if a.fits(n) and (x := x + a.stops[q] - steps.get((k, "$"), other)) >= 0:
                        yield x, s, at + 1
            at += 1

    @cached_property
    def _leads(self) -> dict[str, tuple[str, re.Pattern[str]]]:
        """The literal part of each format, and a pattern of the runs that one without it can be in."""
        out = {}
        for kind, a in self.formats.items():
            lead, q = "", 0
            for _ in range(a.literal):
                (s, (q, _)), = a.moves[q].items()
                lead += s[1:]
            chars = "".join(sorted({c for m in a.moves for s in m for c in _CLASSES.get(s, "")}))
            out[kind] = lead, re.compile(f"[{re.escape(chars)}]{{{a.least},}}" if chars else r"(?!)")
        return out


class _Taken:
    """Spans that are given away: later ones that touch any of them are refused."""

    def __init__(self, spans: Iterable[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):  # these may overlap
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def add(self, s: int, e: int) -> bool:
        k = bisect.bisect_right(self.ends, s)
        if k < len(self.starts) and self.starts[k] < e:
            return False
        self.starts.insert(k, s)
        self.ends.insert(k, e)
        return True


def train(labelled: Iterable[tuple[str, str]] | None = None) -> Scanner:
    by: dict[str, list[str]] = defaultdict(list)
    for kind, value in examples() if labelled is None else labelled:
        if kind and value:
            by[kind].append(value)
    return Scanner({kind: infer(values) for kind, values in sorted(by.items())}, background(ordinary()))


def labelled_sample(table: DataFrame, limit: int = LIMIT) -> list[tuple[str, str]]:
    """At most limit rows of each kind of a labelled table (kind, value), those with the smallest hashes."""
    ranked = table.filter("kind is not null and value is not null").select("kind", "value", F.xxhash64("value").alias("h")).distinct()
    order = Window.partitionBy("kind").orderBy("h", "value")
    kept = ranked.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= limit)
    return [(r.kind, r.value) for r in kept.select("kind", "value").collect()]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """(id, base, spans): lists of (start, stop, kind); spans holds the base ones and those that the automata add."""
    common.bounded(docs.sparkSession)
    model = scanner or train()
    item = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, every = [], []
            for raw in b.column(1).to_pylist():
                first, more = model.scan(raw.decode("utf-8", "replace"))
                base.append(first)
                every.append(sorted(first + more, key=lambda x: (x[0], BASE.index(x[2]) if x[2] in BASE else len(BASE), x[2])))
            lists = [pa.array([[{"start": s, "stop": e, "kind": k} for s, e, k in x] for x in col], pa.list_(item)) for col in (base, every)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["id", "base", "spans"])

    spans = "array<struct<start:bigint,stop:bigint,kind:string>>"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), common.utf8(text_col).alias("t"))
    return rows.mapInArrow(run, f"id long, base {spans}, spans {spans}")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", scanner: Scanner | None = None) -> DataFrame:
    """docs with every span of the text replaced by a mark; overlapping spans count as one. Nulls stay."""
    common.bounded(docs.sparkSession)
    model = scanner or train()
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base, more = model.scan(text)
        if not base and not more:
            return text
        out, last, end = [], 0, -1
        for s, e, _ in sorted(base + more):
            if s > end:
                out += [text[last:s], mark]
            end = max(end, e)
            last = max(last, end)
        return "".join([*out, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([clean(t) for t in b.column(at).to_pylist()], b.column(at).type)
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(b.columns)], b.schema.names)

    return docs.mapInArrow(run, docs.schema)
