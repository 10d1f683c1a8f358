"""Secret scan by one combined deterministic automaton.

Rule expressions are parsed, joined into one nondeterministic automaton that may begin anywhere, determinised by subset
construction over byte classes and minimised into a transition array. A scan reads each byte once, many stretches of the
text side by side; stretches that began in a wrong state are read again until both readings agree. It
accepts as soon as a rule has its shortest match; the spans are then found as a leftmost-longest search would, by the
rule's own automaton, from the last place at which no rule was under way.

Spans are in code points, end exclusive. Null is an empty text and has none; whole texts of any length are read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import extend, utf8

PART = 4 << 20
LANES = 2048


@dataclass(frozen=True)
class Rule:
    """least: code points that the match must have; value_least: that must follow the separator."""

    kind: str
    pattern: str
    ignore_case: bool = False
    least: int = 1
    value_least: int = 0


BASE = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", value_least=12, ignore_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16}[0-9a-f]*", least=16),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=30),
    Rule("private", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE + MORE


class _Parser:
    """A small regular-expression grammar: literals, escapes, classes, groups, |, and ? * + {m}."""

    def __init__(self, text: str, fold: bool):
        self.s, self.i, self.fold = text, 0, fold

    def parse(self):
        tree = self.either()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} in {self.s!r}")
        return tree

    def peek(self):
        return self.s[self.i] if self.i < len(self.s) else ""

    def either(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.sequence())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            item = self.item()
            c = self.peek()
            if c and c in "?*+":
                self.i += 1
                item = (c, item)
            elif c == "{":
                end = self.s.index("}", self.i)
                item = ("cat", [item] * int(self.s[self.i + 1 : end]))
                self.i = end + 1
            parts.append(item)
        return ("cat", parts)

    def char(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c == "\\":
            c = self.s[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.s[self.i - 2 : self.i], 16)
        if ord(c) > 127:
            raise ValueError("rules are ASCII")
        return ord(c)

    def item(self):
        c = self.peek()
        if c == "(":
            self.i += 1
            tree = self.either()
            self.i += 1
            return tree
        chosen = set()
        if c == "[":
            self.i += 1
            while self.peek() != "]":
                a = self.char()
                if self.peek() == "-" and self.s[self.i + 1] != "]":
                    self.i += 1
                    chosen |= set(range(a, self.char() + 1))
                else:
                    chosen.add(a)
            self.i += 1
        else:
            chosen.add(self.char())
        if self.fold:
            chosen |= {ord(x) for a in chosen for x in (chr(a).lower(), chr(a).upper())}
        return ("set", frozenset(chosen))


def _shortest(tree):
    """The rule without what only prolongs a match at its end."""
    kind, arg = tree
    if kind == "cat" and arg:
        last = arg[-1]
        return _shortest(("cat", arg[:-1])) if last[0] in "?*" else ("cat", [*arg[:-1], _shortest(last)])
    return arg if kind == "+" else tree


class _Nfa:
    def __init__(self):
        self.free, self.on = [], []

    def state(self):
        self.free.append([])
        self.on.append([])
        return len(self.free) - 1

    def add(self, tree):
        kind, arg = tree
        a, z = self.state(), self.state()
        if kind == "set":
            self.on[a].append((arg, z))
        elif kind == "cat":
            at = a
            for part in arg:
                x, y = self.add(part)
                self.free[at].append(x)
                at = y
            self.free[at].append(z)
        elif kind == "or":
            for part in arg:
                x, y = self.add(part)
                self.free[a].append(x)
                self.free[y].append(z)
        else:
            x, y = self.add(arg)
            self.free[a].append(x)
            self.free[y].append(z)
            if kind in "?*":
                self.free[a].append(z)
            if kind in "*+":
                self.free[y].append(x)
        return a, z


class Automaton:
    """table[state * width + class] = next state * width; accepts[state]: bits of the rules that end there. State 0 begins.

    search: whether matches may begin anywhere. The last class is the edge between texts; every state leaves by it to 0.
    """

    def __init__(self, rules, search: bool):
        nfa, starts, ends = _Nfa(), [], {}
        for k, r in enumerate(rules):
            tree = _Parser(r.pattern, r.ignore_case).parse()
            a, z = nfa.add(_shortest(tree) if search else tree)
            starts.append(a)
            ends[z] = k
        sets = {s for on in nfa.on for s, _ in on}
        marks = {}
        self.byte_class = np.zeros(256, np.uint8)
        for b in range(256):
            self.byte_class[b] = marks.setdefault(tuple(b in s for s in sets), len(marks))
        sample = [int(np.flatnonzero(self.byte_class == k)[0]) for k in range(len(marks))]

        def closure(states):
            todo, seen = list(states), set(states)
            while todo:
                for t in nfa.free[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(s for s in seen if nfa.on[s] or s in ends)

        begin = closure(starts)
        number, todo, rows = {begin: 0}, [begin], []
        while len(rows) < len(todo):
            here, row = todo[len(rows)], []
            for b in sample:
                to = {t for s in here for chosen, t in nfa.on[s] if b in chosen}
                to = closure(to | set(starts) if search else to)
                if to not in number:
                    number[to] = len(todo)
                    todo.append(to)
                row.append(number[to])
            rows.append(row)
        table = np.array(rows, np.int64)
        accepts = np.array([sum({1 << ends[s] for s in x if s in ends}) for x in todo], np.int64)
        # Minimisation: states stay together while their accepted rules and the groups of their successors agree.
        group = np.unique(accepts, return_inverse=True)[1]
        while True:
            key = np.concatenate([group[:, None], group[table]], axis=1)
            finer = np.unique(key, axis=0, return_inverse=True)[1].ravel()
            if finer.max() == group.max():
                break
            group = finer
        first = {}
        for s, g in enumerate(group.tolist()):
            first.setdefault(g, s)
        rank = {g: i for i, g in enumerate(sorted(first, key=lambda g: first[g]))}
        pick = [first[g] for g in sorted(first, key=lambda g: first[g])]
        self.width = len(sample) + 1
        small = np.array([[rank[int(group[t])] for t in table[s]] + [0] for s in pick], np.int32) * self.width
        self.table, self.accepts = small.ravel(), accepts[pick]
        self.dead = {i for i, s in enumerate(pick) if not todo[s]}

    def states(self, data: np.ndarray, offsets: np.ndarray):
        """(state after each byte, times width; place of each text's first byte). One symbol for the edge follows each text."""
        n, texts = len(data), len(offsets) - 1
        place = offsets[:-1] + np.arange(texts)
        steps = max(1, -(-(n + texts) // LANES))
        lanes = -(-(n + texts) // steps)
        symbols = np.full(steps * lanes, self.width - 1, np.uint8)
        inside = np.ones(n + texts, bool)
        inside[offsets[1:] + np.arange(texts)] = False
        symbols[: n + texts][inside] = self.byte_class[data]
        symbols = np.ascontiguousarray(symbols.reshape(lanes, steps).T)
        out = np.empty((steps, lanes), np.int32)
        s = np.zeros(lanes, np.int32)
        for k in range(steps):
            s = self.table[s + symbols[k]]
            out[k] = s
        # A lane that the one before leaves in another state than 0 is read again, as far as that changes anything.
        lane = np.arange(1, lanes)
        while len(lane):
            s, wrong = out[-1, lane - 1], lane
            moved = s != 0 if len(lane) == lanes - 1 else np.ones(len(lane), bool)
            s, wrong = s[moved], wrong[moved]
            for k in range(steps):
                s = self.table[s + symbols[k, wrong]]
                differs = out[k, wrong] != s
                s, wrong = s[differs], wrong[differs]
                if not len(wrong):
                    break
                out[k, wrong] = s
            lane = wrong[wrong + 1 < lanes] + 1
        return out.T.ravel()[: n + texts], place

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match of the one rule that begins at `at`, or -1."""
        table, classes, width, accepts, dead = self._lists()
        s, end = 0, -1
        for k in range(at, len(data)):
            s = table[s + classes[data[k]]]
            if s in dead:
                break
            if accepts[s // width]:
                end = k + 1
        return end

    def _lists(self):
        if not hasattr(self, "_kept"):
            self._kept = (self.table.tolist(), self.byte_class.tolist(), self.width, self.accepts.tolist(), {d * self.width for d in self.dead})
        return self._kept


@lru_cache(maxsize=4)
def _compiled(rules):
    return Automaton(rules, True), [Automaton((r,), False) for r in rules]


_LEAD = re.compile(r"[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?")


def _passes(rule: Rule, match: str) -> bool:
    return len(match) >= rule.least and (not rule.value_least or len(match) - _LEAD.match(match).end() >= rule.value_least)


def scan(data: np.ndarray, offsets: np.ndarray, rules=RULES) -> dict[int, list[tuple[int, int, int]]]:
    """{text: [(start, number of the rule, end)] by start, then rule} for the texts that have any; in code points."""
    combined, single = _compiled(rules)
    found: dict[int, list[tuple[int, int, int]]] = {}
    a, n = 0, len(offsets) - 1
    flags = (combined.accepts != 0).repeat(combined.width)
    while a < n:
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PART, "right")) - 1)
        part, cuts = data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
        states, place = combined.states(part, cuts)
        hits = np.flatnonzero(flags[states])
        owner = np.searchsorted(place, hits, "right") - 1
        for t in np.unique(owner).tolist():
            own = states[place[t] : place[t] + int(cuts[t + 1] - cuts[t])]
            raw = part[cuts[t] : cuts[t + 1]].tobytes()
            ends = hits[np.searchsorted(owner, t) : np.searchsorted(owner, t, "right")] - place[t]
            bits = combined.accepts[own[ends] // combined.width]
            idle = np.flatnonzero(own == 0)
            spans = []
            for k, r in enumerate(rules):
                done = 0
                mine = ends[(bits >> k) & 1 == 1]
                i = 0
                while i < len(mine):
                    e = int(mine[i])
                    j = int(np.searchsorted(idle, e)) - 1
                    end = -1
                    for start in range(max(done, int(idle[j]) + 1 if j >= 0 else 0), e + 1):
                        end = single[k].longest(raw, start)
                        if end >= 0:
                            if _passes(r, raw[start:end].decode("latin-1")):
                                spans.append((start, k, end))
                            break
                    done = max(done, end)
                    i = max(i + 1, int(np.searchsorted(mine, done)))
            if spans:
                at = np.concatenate([[0], np.cumsum((part[cuts[t] : cuts[t + 1]] & 0xC0) != 0x80)])
                found[a + t] = sorted((int(at[s]), k, int(at[e])) for s, k, e in spans)
        a = z
    return found


def _joined(spans, rules) -> str:
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in spans)


def _scan(rules, base: int):
    def run(batches):
        for b in batches:
            found = scan(*utf8(b.column(b.num_columns - 1)), rules)
            n = b.num_rows
            counts = np.zeros((base, n), np.int64)
            digest = [hashlib.sha256(b"").hexdigest()] * n
            text = [""] * n
            for t, spans in found.items():
                for _, k, _ in spans:
                    if k < base:
                        counts[k, t] += 1
                digest[t] = hashlib.sha256(_joined([x for x in spans if x[1] < base], rules).encode()).hexdigest()
                text[t] = _joined(spans, rules)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), *(pa.array(c) for c in counts), pa.array(digest), pa.array(text)], [*b.schema.names[:-1], *(f"n_{r.kind}" for r in rules[:base]), "base_sha256", "spans"])

    return run


def secret_scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """The columns in keep (default: all but the text), then n_assign, n_access, n_hex, base_sha256, spans: one row per row.

    base_sha256 digests the spans of the three base rules, spans lists these and those of `more`, by start, then rule.
    Columns of docs that have the name of a result are left out.
    """
    rules = BASE + tuple(more)
    new = [*(f"n_{r.kind}" for r in BASE), "base_sha256", "spans"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*new, text_col)]
    src = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias("__text"))
    ddl = ", ".join(f"{c} {'string' if c in new[-2:] else 'bigint'}" for c in new)
    return src.mapInArrow(_scan(rules, len(BASE)), extend(src.drop("__text").schema, ddl))
