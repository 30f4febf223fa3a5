"""Secret scan with one combined automaton.

The rules are regular expressions over bytes. They are joined into one NFA
that may start anywhere, made deterministic by subset construction and
minimised; the result is a list of transition rows over byte classes. A text
is scanned in one pass over its bytes for all rules. Where a rule first
accepts, the reversed rule's automaton gives the leftmost start and the rule's
own automaton the longest end; candidates that fail a rule's test are dropped.
Where that start would lie in the rule's match before, the rule's own search goes on
behind that match, so that no byte is read more than a few times for a rule.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depscope.llm.arrow import long_id, released
from depscope.llm.pii import SCHEMA


@dataclass(frozen=True)
class Rule:
    """pattern: literals, classes, groups, alternatives and repeats. check(bytes of the match) says if it stays."""

    kind: str
    pattern: str
    ignore_case: bool = False
    check: Callable[[bytes], bool] | None = None


def _assigned(m: bytes) -> bool:
    value = re.match(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?(.+)\Z", m, re.S)
    return value is not None and len(value[1]) >= 6


RULES = (
    Rule("assign", r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", True, _assigned),
    # one counted repeat at most: the states of several would multiply in the combined automaton
    Rule("access", r"AKIA[A-Z0-9]+", check=lambda m: len(m) >= 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]+", check=lambda m: len(m) >= 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")


class Nfa:
    """Thompson construction. moves[s]: (byte set as int bit mask, target); free[s]: targets without a byte."""

    def __init__(self):
        self.moves: list[list[tuple[int, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, items: list[tuple], at: int, back: bool) -> int:
        """Appends parsed items (see parse) after state at, last item first if back; returns the state behind them."""
        for item in reversed(items) if back else items:
            if item[0] == "set":
                to = self.state()
                self.moves[at].append((item[1], to))
                at = to
            elif item[0] == "or":
                end = self.state()
                for way in item[1]:
                    begin = self.state()
                    self.free[at].append(begin)
                    self.free[self.add(way, begin, back)].append(end)
                at = end
            else:
                _, lo, hi, sub = item
                for _ in range(lo):
                    at = self.add(sub, at, back)
                if hi is None:
                    loop = self.state()
                    self.free[at].append(loop)
                    self.free[self.add(sub, loop, back)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    for _ in range(hi - lo):
                        self.free[at].append(end)
                        at = self.add(sub, at, back)
                    self.free[at].append(end)
                    at = end
        return at

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def parse(pattern: str, fold: bool) -> list[tuple]:
    """Items of a rule's pattern: ("set", bytes as bit mask), ("or", ways), ("repeat", least, most or None, items).

    Literals, escapes of signs and \\xHH, classes, groups, alternatives, and the repeats * + ? {m} {m,} {m,n}.
    """
    at = 0

    def fail(what: str) -> ValueError:
        return ValueError(f"a rule uses {what}, which an automaton of this kind can't hold: {pattern}")

    def char() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        if c.isalnum():
            raise fail(f"\\{c}")
        return ord(c)

    def folded(mask: int) -> int:
        for c in range(65, 91) if fold else ():
            if mask >> c & 1 or mask >> (c + 32) & 1:
                mask |= 1 << c | 1 << (c + 32)
        return mask

    def group_of_bytes() -> int:
        nonlocal at
        negate, mask = pattern[at] == "^", 0
        at += negate
        while pattern[at] != "]":
            low = high = char()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                high = char()
            mask |= (1 << high + 1) - (1 << low)
        at += 1
        return folded(mask) ^ ((1 << 256) - 1) if negate else folded(mask)

    def sequence() -> list[tuple]:
        nonlocal at
        items: list[tuple] = []
        while at < len(pattern) and pattern[at] not in "|)":
            c = pattern[at]
            if c == "(":
                at += 1
                if pattern.startswith("?", at):
                    if not pattern.startswith("?:", at):
                        raise fail("(?")
                    at += 2
                one = ways()
                at += 1
            elif c == "[":
                at += 1
                one = [("set", group_of_bytes())]
            elif c in "^$.*+?{":
                raise fail(c)
            else:
                one = [("set", folded(1 << char()))]
            if m := re.compile(r"\*|\+|\?|\{(\d+)(,?)(\d*)\}").match(pattern, at):
                at = m.end()
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(m[0]) or (int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1]))
                one = [("repeat", least, most, one)]
            items += one
        return items

    def ways() -> list[tuple]:
        nonlocal at
        found = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            found.append(sequence())
        return found[0] if len(found) == 1 else [("or", found)]

    items = ways()
    if at < len(pattern):
        raise fail(pattern[at])
    return items


@dataclass
class Dfa:
    """rows[s][class of the byte] is the next state; accepts[s] a tuple of rule numbers. State 0 is dead unless it searches."""

    classes: bytes
    rows: list[bytes | tuple[int, ...]]
    accepts: list[tuple[int, ...]]
    start: int


def compile_rules(rules: tuple[Rule, ...], search: bool, back: bool = False) -> Dfa:
    """Subset construction, then minimisation. search: a match may start at any byte."""
    nfa = Nfa()
    root = nfa.state()
    ends = {}
    for k, r in enumerate(rules):
        begin = nfa.state()
        nfa.free[root].append(begin)
        ends[nfa.add(parse(r.pattern, r.ignore_case), begin, back)] = k
    # bytes that no rule tells apart form one class
    masks = sorted({m for moves in nfa.moves for m, _ in moves})
    sign = [tuple(m >> b & 1 for m in masks) for b in range(256)]
    names = {s: k for k, s in enumerate(dict.fromkeys(sign))}
    classes = bytes(names[s] for s in sign)
    sample = [classes.index(k) for k in range(len(names))]

    first = nfa.closure([root])
    sets, order, table = {frozenset(): 0, first: 1}, [frozenset(), first], []
    for now in order:
        row = []
        for b in sample:
            to = {t for s in now for m, t in nfa.moves[s] if m >> b & 1}
            nxt = nfa.closure(to | ({root} if search else set()))
            if nxt not in sets:
                sets[nxt] = len(order)
                order.append(nxt)
            row.append(sets[nxt])
        table.append(row)
    accepts = [tuple(sorted({ends[s] for s in now if s in ends})) for now in order]
    # minimisation: split states until those of a part go to the same parts
    part = {a: k for k, a in enumerate(dict.fromkeys(accepts))}
    part = [part[a] for a in accepts]
    while True:
        keys = [(part[s], *[part[t] for t in table[s]]) for s in range(len(order))]
        names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        new = [names[k] for k in keys]
        if len(names) == len(set(part)):
            break
        part = new
    # states by number of accepted rules: those that accept come last
    reps = {p: s for s, p in reversed(list(enumerate(part)))}
    dead = part[0]
    by = sorted(reps, key=lambda p: (bool(accepts[reps[p]]), p != dead, reps[p]))
    number = {p: k for k, p in enumerate(by)}
    rows = [tuple(number[part[t]] for t in table[reps[p]]) for p in by]
    if len(rows) <= 256:
        rows = [bytes(r) for r in rows]
    return Dfa(classes, rows, [accepts[reps[p]] for p in by], number[part[1]])


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = compile_rules(rules, search=True)
        self.first_accept = next((s for s, a in enumerate(self.all.accepts) if a), len(self.all.rows))
        self.forth = [compile_rules((r,), search=False) for r in rules]
        self.back = [compile_rules((r,), search=False, back=True) for r in rules]
        self.search = [compile_rules((r,), search=True) for r in rules]

    @staticmethod
    def _longest(dfa: Dfa, data: bytes, at: int, step: int, stop: int) -> int | None:
        """Where the longest match ends that starts at byte at and goes by step; None if there is none."""
        s, best, rows, classes = dfa.start, None, dfa.rows, dfa.classes
        while at != stop:
            s = rows[s][classes[data[at]]]
            if not s and not dfa.accepts[0]:
                break
            at += step
            if dfa.accepts[s]:
                best = at
        return best

    @staticmethod
    def _first(dfa: Dfa, data: bytes, at: int) -> int:
        """The first byte from at on where a search that begins there accepts; the end if there is none."""
        s, rows, accepts, size = dfa.start, dfa.rows, dfa.accepts, 64
        while at < len(data):
            for k, c in enumerate(data[at : at + size].translate(dfa.classes)):
                s = rows[s][c]
                if accepts[s]:
                    return at + k
            at += size
            size = min(2 * size, 1 << 16)
        return len(data)

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(byte start, rule number, byte end) by start, then rule."""
        rows, first = self.all.rows, self.first_accept
        s = self.all.start
        hits = []  # (state, byte) wherever some rule accepts
        for at, c in enumerate(data.translate(self.all.classes)):
            s = rows[s][c]
            if s >= first:
                hits.append((s, at))
        found, done, nxt = [], [0] * len(self.rules), [0] * len(self.rules)
        for s, at in hits:
            for k in self.all.accepts[s]:
                if at < nxt[k]:
                    continue
                start = self._longest(self.back[k], data, at, -1, done[k] - 1)
                if start is None:  # it would overlap the match before
                    nxt[k] = self._first(self.search[k], data, done[k])
                    continue
                start += 1
                end = self._longest(self.forth[k], data, start, 1, len(data))
                done[k] = nxt[k] = end
                rule = self.rules[k]
                if rule.check is None or rule.check(data[start:end]):
                    found.append((start, k, end))
        found.sort()
        return found


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for each row: kind, start and end in code points, by start, then rule order.

    Per rule, matches are leftmost and do not overlap. This holds for rules in
    which no match can end before a match that encloses it first accepts.
    Null text counts as empty; ids may be null or repeat (a row each); whole
    texts are read. An empty table gives an empty result. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            out = []
            for text in b.column("text"):
                data = bytes(text.as_buffer()) if text.is_valid else b""
                spans, at, chars = [], 0, 0
                for s, k, e in scanner.spans(data):
                    if s < at:
                        at = chars = 0
                    chars += len(data[at:s].decode())
                    at = s
                    spans.append({"kind": rules[k].kind, "start": chars, "end": chars + len(data[s:e].decode())})
                out.append(spans)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, kind)], ["id", "spans"])

    rows = docs.select(long_id(docs, id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(run), SCHEMA)
