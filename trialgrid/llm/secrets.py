"""Secret scans: fixed patterns, and sliding-window entropy per character class over candidate strings."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order of kinds that start at the same place.
KINDS = ("assign", "access", "hex", "entropy")
SPANS = "array<struct<kind:string,start:int,end:int>>"
MARK = "[SECRET]"

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Runs that can hold a random string at all.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Character classes: a run of the class, the window in characters, and the bits per character and turns of kind that
#: make it random. Under 1 in 100 random windows of the smallest alphabet of a class (16, 32, 32, 62 signs) have fewer
#: bits. Words joined to long strings reach such bits too, but turn less often; from 3.9 bits on turns are not asked.
CLASSES = (
    (re.compile(r"[0-9A-Fa-f]{20,}"), 20, 2.9, 0),
    (re.compile(r"[a-z0-9]{20,}"), 20, 3.34, 3),
    (re.compile(r"[A-Z0-9]{20,}"), 20, 3.34, 3),
    (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.64, 5),
    (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.9, 0),
)
#: A random string mixes digits and letters; words, rules, numbers and paths do not.
MIXED = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])")
#: Candidates that look random and are known to be harmless.
ALLOWED = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # identifiers
    r"sha(1|256|384|512)-.*",  # integrity marks
    r".*EXAMPLE.*",
    r"[a-z]+([-_/][a-z]+)*[-_/]?[0-9]{1,6}",  # slugs with a number
)


def _turns(run: str) -> list[int]:
    """For each place how often the kind (digit, lower, upper case) has turned so far.

    Other signs have no kind; a capital before small letters is no turn of its own.
    """
    found, last, n = [], "", 0
    for char in run:
        kind = "d" if char.isdigit() else "l" if char.islower() else "u" if char.isupper() else last
        n += last not in ("", kind) and last + kind != "ul"
        last = kind
        found.append(n)
    return found


def _flagged(run: str, window: int, bits: float, turns: int = 0) -> Iterator[tuple[int, int]]:
    """The merged windows of `run` whose Shannon entropy reaches `bits` and whose kind turns `turns` times or more.

    Counts move with the window.
    """
    turned = _turns(run) if turns else [0] * len(run)
    # The entropy is log2(window) - sum(c * log2(c)) / window; one step changes two counts of that sum.
    cost = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    most = window * (math.log2(window) - bits) + 1e-9
    counts: dict[str, int] = {}
    total, begin, end = 0.0, -1, -1
    for i, char in enumerate(run):
        c = counts.get(char, 0)
        total += cost[c + 1] - cost[c] if i < window or c < window else 0.0
        counts[char] = c + 1
        if i >= window:
            old = run[i - window]
            c = counts[old]
            total += cost[c - 1] - cost[min(c, window)]
            counts[old] = c - 1
        if i >= window - 1 and total <= most and turned[i] - turned[i + 1 - window] >= turns:
            if end < i + 1 - window:
                if begin >= 0:
                    yield begin, end
                begin = i + 1 - window
            end = i + 1
    if begin >= 0:
        yield begin, end


def entropy_spans(text: str, allowed: re.Pattern) -> list[tuple[int, int]]:
    """Spans of random-looking strings; a candidate that matches the allow-list as a whole is left out."""
    found = []
    for candidate in CANDIDATE.finditer(text):
        whole = candidate.group()
        if not MIXED.match(whole) or allowed.fullmatch(whole):
            continue
        spans = set()
        for kind, window, bits, turns in CLASSES:
            for run in kind.finditer(whole):
                if MIXED.match(run.group()):
                    at = candidate.start() + run.start()
                    spans.update((at + a, at + b) for a, b in _flagged(run.group(), window, bits, turns))
        merged: list[tuple[int, int]] = []
        for start, end in sorted(spans):  # classes overlap: one string, one span
            if merged and start < merged[-1][1]:
                start, end = merged[-1][0], max(end, merged.pop()[1])
            merged.append((start, end))
        found += merged
    return found


def secret_spans(text: str, allowed: re.Pattern) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind. Base spans always stay; random spans inside one do not."""
    base = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    base += [("access", *m.span()) for m in ACCESS.finditer(text)]
    base += [("hex", *m.span()) for m in HEX.finditer(text)]
    base.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    covered, last = [], -1  # base spans that end after all earlier ones
    for _, start, end in base:
        if end > last:
            covered.append((start, end))
            last = end
    more, i = [], 0
    for start, end in entropy_spans(text, allowed):
        while i < len(covered) and covered[i][1] < end:
            i += 1
        if i == len(covered) or covered[i][0] > start:
            more.append(("entropy", start, end))
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]))) if more else base


def redact_text(text: str, allowed: re.Pattern, mark: str = MARK) -> str:
    parts, last = [], 0
    for _, start, end in secret_spans(text, allowed):
        if start >= last:
            parts += [text[last:start], mark]
        last = max(last, end)
    return "".join([*parts, text[last:]])


def _allow(allow: Sequence[str]) -> re.Pattern:
    return re.compile("|".join(f"(?:{pattern})" for pattern in allow) or r"(?!)", re.DOTALL)


def scan_secrets(text: Column, allow: Sequence[str] = ALLOWED) -> Column:
    """All secret spans of a text: array of (kind, start, end), in code points, end exclusive; empty for null.

    Kinds `assign`, `access` and `hex` are fixed patterns. `entropy` are windows of candidate strings whose Shannon
    entropy is high for their character class, unless the candidate matches one of the `allow` patterns as a whole.
    Every text is scanned as a whole, in time linear in its length.
    """
    allowed = _allow(allow)

    @F.pandas_udf(SPANS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in secret_spans(t, allowed)] for t in texts]
            yield pd.Series(found, dtype="object")

    return scan(F.coalesce(text, F.lit("")))


def redact_secrets(text: Column, mark: str = MARK, allow: Sequence[str] = ALLOWED) -> Column:
    """The text with each run of overlapping secret spans replaced by `mark`; null stays null."""
    allowed = _allow(allow)

    @F.pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else redact_text(t, allowed, mark) for t in texts], dtype="object")

    return redact(text)


def span_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
