"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class.

Candidate strings are runs of token characters. A window slides over each one; the counts of its
characters change by one in and one out, so each step costs a constant. Windows above their
class's threshold join into spans; what a fixed pattern already covers is cut out of them. The
allow list suppresses windows and no more: those that touch a word of examples, those that lie for a
half or more in a plain ascending run, and all of a candidate that is a known digest or an
identifier. Fixed-pattern spans are never suppressed.

Texts: null and "" have no spans; offsets are code points, ends exclusive; repeated rows are
scanned each for itself; extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import frugal, slices

# The patterns of the three kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Words of examples; ascending runs; digests of nothing and identifiers.
EXAMPLES = re.compile(r"(?i)example|sample|dummy|placeholder|changeme")
ASCENDING = re.compile(r"(?i)0?1234567(?:8(?:9a?b?c?d?e?f?)?)?|abcdefgh?i?j?k?l?m?n?o?p?q?r?s?t?u?v?w?x?y?z?")
KNOWN = re.compile(r"(?i)d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")


@dataclass(frozen=True)
class EntropyRule:
    """A character class, its window, the bits per character from which a window is suspicious, and what it must have
    besides: digits, letters, and places where the case of neighbouring letters changes."""

    name: str
    alphabet: frozenset[str]
    window: int
    bits: float
    digits: int = 0
    letters: int = 0
    changes: int = 0


# Words have no digits, numbers no letters, and names written in camel case few changes of case.
HEX_RULE = EntropyRule("hex", frozenset("0123456789abcdefABCDEF"), 20, 2.9, 3, 3)
BASE64_RULE = EntropyRule("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 20, 3.8, 3, 3)
LETTER_RULE = EntropyRule("letters", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), 20, 3.7, 0, 20, 7)


@dataclass(frozen=True)
class Settings:
    rules: tuple[EntropyRule, ...] = (HEX_RULE, BASE64_RULE, LETTER_RULE)
    examples: re.Pattern = field(default=EXAMPLES)
    ascending: re.Pattern = field(default=ASCENDING)
    known: re.Pattern = field(default=KNOWN)


def allowed_starts(run: str, window: int, settings: Settings) -> list[tuple[int, int]]:
    """Ranges of window starts that the allow list suppresses, ends exclusive, apart and in order."""
    if settings.known.fullmatch(run):
        return [(0, len(run))]
    out = [(m.start() - window + 1, m.end()) for m in settings.examples.finditer(run)]
    half = window // 2
    out += [(m.start() - half, m.end() - half + 1) for m in settings.ascending.finditer(run) if m.end() - m.start() >= half]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    return merged


def hot_windows(text: str, rule: EntropyRule, allowed: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Joined spans of windows whose entropy reaches the rule's bits; counts move with the window."""
    w = rule.window
    part = [0.0] + [c * math.log2(c) for c in range(1, w + 1)]
    counts: dict[str, int] = {}
    total, held, nums, letters, changes = 0.0, 0, 0, 0, 0  # total: sum of c log2 c; entropy = log2 w - total / w
    top, at = math.log2(w), 0
    turn = [False, *((a.isupper() and b.islower()) or (a.islower() and b.isupper()) for a, b in zip(text, text[1:], strict=False))]
    spans: list[list[int]] = []
    for i, c in enumerate(text):
        if c not in rule.alphabet:
            counts.clear()
            total, held, nums, letters, changes = 0.0, 0, 0, 0, 0
            continue
        if held == w:
            old = text[i - w]
            k = counts[old]
            total += part[k - 1] - part[k]
            counts[old] = k - 1
            nums -= old.isdigit()
            letters -= old.isalpha()
            changes -= turn[i - w + 1]
        else:
            held += 1
        k = counts.get(c, 0)
        total += part[k + 1] - part[k]
        counts[c] = k + 1
        nums += c.isdigit()
        letters += c.isalpha()
        changes += turn[i] and held > 1
        if held == w and nums >= rule.digits and letters >= rule.letters and changes >= rule.changes and top - total / w >= rule.bits:
            start = i - w + 1
            while at < len(allowed) and allowed[at][1] <= start:
                at += 1
            if at < len(allowed) and allowed[at][0] <= start:
                continue
            if spans and start <= spans[-1][1]:
                spans[-1][1] = i + 1
            else:
                spans.append([start, i + 1])
    return [(a, b) for a, b in spans]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def entropy_spans(text: str, base: list[tuple[int, int, int]], settings: Settings) -> list[tuple[int, int, int]]:
    found: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        for rule in settings.rules:
            found += [(m.start() + a, m.start() + b) for a, b in hot_windows(run, rule, allowed_starts(run, rule.window, settings))]
    joined: list[list[int]] = []
    for a, b in sorted(found):
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    covered: list[list[int]] = []
    for x, y, _ in base:  # by start
        if covered and x <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], y)
        else:
            covered.append([x, y])
    left: list[tuple[int, int, int]] = []
    at = 0
    for a, b in joined:  # both lists ascend, so neither is walked twice
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        k = at
        while k < len(covered) and covered[k][0] < b:
            x, y = covered[k]
            if a < x:
                left.append((a, x, 3))
            a = max(a, y)
            k += 1
        if a < b:
            left.append((a, b, 3))
    return left


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"


def scan(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: counts by kind, the digest of the fixed-pattern spans and all spans. Narrow."""

    def run(batches):
        for part in slices(batches, 1):
            rows = []
            for text in part.column(1).to_pylist():
                base = base_spans(text or "")
                more = entropy_spans(text or "", base, settings)
                count = [sum(k == kind for _, _, k in base) for kind in range(3)]
                rows.append((*count, len(more), hashlib.sha256(spell(base).encode()).hexdigest(), spell(sorted([*base, *more], key=lambda s: (s[0], s[2])))))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns, kinds)], ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(frugal(run), SCHEMA)


MASK = "[SECRET]"


def mask_text(text: str, settings: Settings = Settings()) -> str:
    base = base_spans(text)
    spans = sorted((a, b) for a, b, _ in [*base, *entropy_spans(text, base, settings)])
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def redact(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents with every found secret replaced in the text; every other column is kept as it is."""

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else mask_text(t, settings) for t in texts.to_pylist()], pa.string())

    return docs.withColumn("text", masked("text"))
