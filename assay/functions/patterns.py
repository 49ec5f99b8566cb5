"""Patterns that users give are refused before a row is read if a backtracking matcher can take exponential time on them
(P33, P34, X2, X3).

A pattern becomes its position automaton: one state for each character that it names, an edge for each way in which one can
follow another. It is exponentially ambiguous if some state can come back to itself along two different paths that read
the same text. That is so if an edge of a cycle exists twice, or if in the product of a cycle with itself a pair of equal
states reaches a pair of different ones and comes back. Such a pattern tries all combinations of these paths on a
text that does not match in the end. Ambiguity that grows as a power alone is let through.

Characters are told apart by samples: those that the pattern names, their neighbours, and one or two of each kind.
Lookarounds and atomic groups are judged for themselves; back-references count as empty. Counted repeats up to
``COPIES`` are written out, larger ones are taken as unbounded.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from re import _constants as op
from re import _parser as parser

from assay.config import UsageError

COPIES = 4
#: Positions of a pattern, repeats written out.
LONGEST = 2000
SAMPLES = "a_5é٣  \n!\U0001f642"


@dataclass
class Part:
    """What a part of a pattern can begin with and end with, and whether it can be empty."""

    empty: bool
    first: Counter = field(default_factory=Counter)
    last: Counter = field(default_factory=Counter)


class Positions:
    """The position automaton of a pattern: ``chars`` of each state, ``follow`` with how many ways lead on."""

    def __init__(self, source: str, flags: int = 0):
        self.flags = flags
        tree = parser.parse(told_apart(source), flags)
        named = {chr(c) for c in self.named(tree)}
        near = {chr(ord(c) + d) for c in named for d in (-1, 1) if 0 <= ord(c) + d < 0x110000}
        self.samples = sorted({x for c in named | near | set(SAMPLES) for x in (c, *((c.swapcase(),) if len(c.swapcase()) == 1 else ()))})
        self.chars: list[frozenset[str]] = []
        self.follow: list[Counter] = []
        self.known: dict[str, frozenset[str]] = {}
        self.inner: list[Positions] = []
        self.whole = self.sequence(tree)

    def named(self, tree):
        """The code points that a parsed pattern names."""
        for kind, arg in tree:
            if kind in (op.LITERAL, op.NOT_LITERAL):
                yield arg
            elif kind is op.RANGE:
                yield from arg
            elif kind is op.IN:
                yield from self.named(arg)
            elif kind is op.BRANCH:
                for x in arg[1]:
                    yield from self.named(x)
            elif kind is op.SUBPATTERN:
                yield from self.named(arg[3])
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
                yield from self.named(arg[2])
            elif kind is op.ATOMIC_GROUP:
                yield from self.named(arg)
            elif kind in (op.ASSERT, op.ASSERT_NOT):
                yield from self.named(arg[1])

    def matching(self, kind, arg) -> frozenset[str]:
        """The samples that one character of the pattern stands for."""
        key = repr((kind, arg, self.flags & (re.I | re.S)))
        if key not in self.known:
            fold = bool(self.flags & re.I)

            def is_in(c: str, items) -> bool:
                found, negated = False, False
                for k, a in items:
                    if k is op.NEGATE:
                        negated = True
                    elif k is op.LITERAL:
                        found |= ord(c) == a
                    elif k is op.RANGE:
                        found |= a[0] <= ord(c) <= a[1]
                    elif k is op.CATEGORY:
                        sort, no = str(a).lower(), "not" in str(a).lower()
                        hit = c.isdigit() if "digit" in sort else c.isspace() if "space" in sort else c.isalnum() or c == "_"
                        found |= hit != no
                return found != negated

            def fits(c: str) -> bool:
                if kind is op.ANY:
                    return bool(self.flags & re.S) or c != "\n"
                if kind is op.NOT_LITERAL:
                    return ord(c) != arg
                return is_in(c, [(kind, arg)] if kind is op.LITERAL else arg)

            self.known[key] = frozenset(c for c in self.samples if fits(c) or fold and len(c.swapcase()) == 1 and fits(c.swapcase()))
        return self.known[key]

    def position(self, kind, arg) -> Part:
        if len(self.chars) >= LONGEST:
            raise UsageError("the pattern is too long to be judged")
        self.chars.append(self.matching(kind, arg))
        self.follow.append(Counter())
        at = Counter({len(self.chars) - 1: 1})
        return Part(False, at, Counter(at))

    def link(self, last: Counter, first: Counter):
        for p, n in last.items():
            for q, m in first.items():
                self.follow[p][q] += n * m

    def then(self, a: Part, b: Part) -> Part:
        self.link(a.last, b.first)
        return Part(a.empty and b.empty, a.first + b.first if a.empty else a.first, a.last + b.last if b.empty else b.last)

    def sequence(self, tree) -> Part:
        out = Part(True)
        for kind, arg in tree:
            out = self.then(out, self.item(kind, arg))
        return out

    def alone(self, tree):
        """A part that is matched without the rest being tried again: judged for itself, empty to the rest."""
        inner = object.__new__(Positions)
        inner.flags, inner.samples, inner.known, inner.inner, inner.chars, inner.follow = self.flags, self.samples, self.known, self.inner, [], []
        inner.whole = inner.sequence(tree)
        self.inner.append(inner)
        return Part(True)

    def item(self, kind, arg) -> Part:
        if kind in (op.LITERAL, op.NOT_LITERAL, op.ANY, op.IN):
            return self.position(kind, arg)
        if kind is op.BRANCH:
            parts = [self.sequence(x) for x in arg[1]]
            return Part(any(p.empty for p in parts), sum((p.first for p in parts), Counter()), sum((p.last for p in parts), Counter()))
        if kind is op.SUBPATTERN:
            before = self.flags
            self.flags = (self.flags | arg[1]) & ~arg[2]
            out = self.sequence(arg[3])
            self.flags = before
            return out
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            return self.repeat(*arg)
        if kind is op.POSSESSIVE_REPEAT:
            return self.alone([(op.MAX_REPEAT, arg)])
        if kind is op.ATOMIC_GROUP:
            return self.alone(arg)
        if kind in (op.ASSERT, op.ASSERT_NOT):
            return self.alone(arg[1])
        return Part(True)  # anchors, back-references

    def repeat(self, least: int, most: int, tree) -> Part:
        out = Part(True)
        for _ in range(min(least, COPIES)):
            out = self.then(out, self.sequence(tree))
        if most is not op.MAXREPEAT and most <= COPIES:
            for _ in range(most - least):
                more = self.sequence(tree)
                out = self.then(out, Part(True, more.first, more.last))
            return out
        more = self.sequence(tree)
        self.link(more.last, more.first)
        return self.then(out, Part(True, more.first, more.last))

    def cycles(self) -> list[list[int]]:
        return components(range(len(self.chars)), lambda p: self.follow[p])

    def exponential(self) -> bool:
        for cycle in self.cycles():
            inside = set(cycle)
            out = {p: [q for q in self.follow[p] if q in inside] for p in cycle}
            if any(self.follow[p][q] > 1 for p in cycle for q in out[p]):
                return True
            if all(len(x) == 1 for x in out.values()):
                continue  # one way round
            pairs, todo = {}, [(p, p) for p in cycle]
            while todo:
                p, q = pair = todo.pop()
                if pair not in pairs:
                    pairs[pair] = [(a, b) for a in out[p] for b in out[q] if self.chars[a] & self.chars[b]]
                    todo += pairs[pair]
            for same in components(pairs, pairs.__getitem__):
                if any(p == q for p, q in same) and any(p != q for p, q in same):
                    return True
        return False


def told_apart(source: str) -> str:
    """The pattern with a mark before each alternative, none like another: the parser would join alternatives that begin
    alike or are single characters, which the matcher tries one after the other."""
    out, at, inside, marks = [], 0, False, 0
    while at < len(source):
        c = source[at]
        if c == "\\":
            out.append(source[at : at + 2])
            at += 2
            continue
        out.append(c)
        at += 1
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            head = re.match(r"\^?\]?", source[at:])[0]
            out.append(head)
            at += len(head)
        elif c == "|":
            out.append(f"(?<!{chr(0xE000 + marks)})")
            marks += 1
    return "".join(out)


def components(nodes, out) -> list[list]:
    """Groups of nodes that reach each other, of more than one node or with an edge to itself."""
    index, low, on, stack, found = {}, {}, set(), [], []
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(out(root)))]
        index[root] = low[root] = len(index)
        stack.append(root), on.add(root)
        while work:
            node, rest = work[-1]
            for other in rest:
                if other not in index:
                    index[other] = low[other] = len(index)
                    stack.append(other), on.add(other)
                    work.append((other, iter(out(other))))
                    break
                if other in on:
                    low[node] = min(low[node], index[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    group = []
                    while True:
                        top = stack.pop()
                        on.discard(top)
                        group.append(top)
                        if top == node:
                            break
                    if len(group) > 1 or node in out(node):
                        found.append(group)
    return found


def refuse_runaway(source: str, flags: str = "") -> None:
    """A UsageError for a pattern that is none, or that can take exponential time."""
    given = 0
    for letter in flags:
        given |= {"i": re.I, "m": re.M, "s": re.S}.get(letter, 0)
    try:
        whole = Positions(source, given)
        runaway = any(x.exponential() for x in (whole, *whole.inner))
    except (re.error, OverflowError, RecursionError) as e:
        raise UsageError(f"no pattern: {source!r}: {e}") from None
    if runaway:
        raise UsageError(f"the pattern can take exponential time: {source!r}")


def literal_core(source: str) -> tuple[str, bool] | None:
    """The longest text that stands in whatever a pattern matches, and whether case is ignored in it; None if none is certain.

    A text without its core need not be shown to the matcher. Only what follows one another at the top of the pattern
    counts. Where case is ignored the core is ASCII in lower case and the text is to be lowered: of other letters the
    engines differ.
    """
    if re.search(r"\(\?[a-zA-Z]*[ux]|\\[QE]", source):
        return None
    try:
        parsed = parser.parse(source)
    except (re.error, OverflowError, RecursionError):
        return None
    folds = bool(parsed.state.flags & re.IGNORECASE)
    runs, run = [""], ""
    for kind, value in [*parsed, (None, None)]:
        if kind is op.LITERAL and not (folds and value > 127):
            run += chr(value)
        else:
            runs, run = [*runs, run], ""
    core = max(runs, key=len)
    return ((core.lower() if folds else core), folds) if core else None
