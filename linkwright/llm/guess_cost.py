"""Operator 6, secret scans: patterns, and a guess-cost dynamic programme for values in credential contexts.

The base patterns find assigned secrets, access keys and long hexadecimal runs. Beyond them, any
value assigned to a credential-like name is split at minimum cost into dictionary words, dates,
repeats, keyboard walks, sequences and brute-force spans, each with a number of guesses; if
even the cheapest split takes at least 10 ** ``least_cost`` guesses, the value is a secret.

The dictionary is learnt from the corpus itself: a word that stands in at least ``share`` of all
documents takes as many guesses as its rank by documents, after the few fixed words. So it holds at
most the mean number of different words in a document, divided by ``share``, and the driver sends it
to the tasks. The first pass counts words in the tasks that read the texts, the second scans whole
texts; only counts are shuffled. A value is split from its start and no further than the least cost,
which any value reaches, or passes, within some hundred characters.

Defined cases: a null or empty text has no spans; repeated rows are scanned alike; spans are code
points, end exclusive; other columns than the text are not used.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document_counts, map_texts

KINDS = ("assign", "access", "hex", "guess")
SPANS = "spans array<struct<kind:string,start:int,end:int,base:boolean>>"
#: The base patterns and the least characters of group 2, of the match, and of the run.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18}
#: Names whose assigned value is looked at, however it is quoted. A value ends at white space, a quote, or
#: what parts it from the next one, and the search goes on there.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|bearer)["'`]?[ \t]{0,4}(?:=>|:=|[:=])[ \t]{0,4}["'`]?((?:(?![&;,<>"'`])[!-~]){8,})""",
    re.ASCII | re.IGNORECASE,
)
#: Often chosen passwords and words, most frequent first; the rank is the number of guesses.
FREQUENT = (
    "password 123456 qwerty admin welcome letmein monkey dragon master login princess football baseball shadow sunshine superman "
    "iloveyou trustno1 starwars abc123 hello freedom whatever ninja access secret test guest changeme default root user pass "
    "love baby angel summer winter spring autumn january february march april june july august september october november december "
    "example sample dummy your key token here insert replace none null true false value placeholder string data server client "
    "public private database mysql postgres oracle google github amazon azure"
).split()
#: log10 of the guesses of each.
WORDS = {w: math.log10(r) for r, w in enumerate(FREQUENT, 1)}
LEET = str.maketrans("4301$5@7!", "aeoissati")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
KEY_AT = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])(?:[-/._]?(?:0?[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d", re.ASCII)


def segments(value: str, i: int, words: dict[str, float], max_segment: int) -> Iterator[tuple[int, float]]:
    """end and log10 guesses of each span from i on that has a pattern."""
    n = min(len(value), i + max_segment)
    lower = value[i:n].lower()
    plain = lower.translate(LEET)
    for j in range(3, n - i + 1):
        for text, extra in ((lower, 0.0), (plain, 0.3)):
            if text[:j] in words:
                yield i + j, words[text[:j]] + extra + (0.3 if value[i : i + j] != text[:j] else 0.0)
                break
    date = DATE.match(value, i, n)
    if date:
        yield date.end(), math.log10(365 * 100)
    for unit in (1, 2, 3, 4):
        j = i + unit
        while j < n and value[j] == value[j - unit]:
            j += 1
        if j - i >= max(3, 2 * unit):
            yield j, unit + math.log10((j - i) / unit)
    for step in (1, -1):
        j = i + 1
        while j < n and ord(value[j]) - ord(value[j - 1]) == step and value[j].isalnum():
            j += 1
        if j - i >= 3:
            yield j, math.log10(4 * 26 * (j - i))
    j, turns, last = 1, 0, None
    while j < n - i and lower[j] in KEY_AT and lower[j - 1] in KEY_AT:
        (r0, c0), (r1, c1) = KEY_AT[lower[j - 1]], KEY_AT[lower[j]]
        way = (r1 - r0, c1 - c0)
        if abs(way[0]) > 1 or abs(way[1]) > 1 or way == (0, 0):
            break
        turns += way != last
        last = way
        j += 1
    if j >= 4:
        yield i + j, math.log10(47 * j) + 0.7 * turns


def guess_cost(value: str, words: dict[str, float] = WORDS, most: float = math.inf, max_segment: int = 32) -> float:
    """log10 of the guesses of the cheapest split, or a number from ``most`` on as soon as that is sure.

    A brute-force character costs 1, a new segment 0.2 beside its own cost. Every split has a cut in
    each ``max_segment`` places in a row, so it costs no less than the cheapest way to one of them.
    """
    best = [0.0] + [math.inf] * len(value)
    for i in range(len(value)):
        if i >= max_segment and best[i] >= most and (sure := min(best[i - max_segment + 1 : i + 1])) >= most:
            return sure
        best[i + 1] = min(best[i + 1], best[i] + 1)
        for j, c in segments(value, i, words, max_segment):
            best[j] = min(best[j], best[i] + c + 0.2)
    return best[-1]


def find_secrets(text: str | None, words: dict[str, float] = WORDS, least_cost: float = 10.0, max_segment: int = 32) -> list[tuple[int, int, int, bool]]:
    """start, number of the kind, end, base or not; in order."""
    if not text:
        return []
    out = [(m.start(), 0, m.end(), True) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end(), True) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end(), True) for m in HEX.finditer(text)]
    out += [(m.start(1), 3, m.end(1), False) for m in CONTEXT.finditer(text) if guess_cost(m.group(1), words, least_cost, max_segment) >= least_cost]
    return sorted(out)


def dictionary(docs: DataFrame, text: str = "text", share: float = 0.001, least_docs: int = 5) -> dict[str, float]:
    """Words of at least ``share`` of the documents, and no less than ``least_docs``, with log10 of their rank.

    The values in credential contexts are left out, so a secret that is copied stays as costly to guess.
    """
    n = docs.count()
    rows = document_counts(docs, text, hide=CONTEXT).where(F.col("n") >= max(least_docs, share * n)).collect()
    ranked = sorted((-r.n, r.w) for r in rows)
    return {w: math.log10(r) for r, (_, w) in enumerate(ranked, len(FREQUENT) + 1)} | WORDS


def scan_secrets(docs: DataFrame, words: dict[str, float] | None = None, least_cost: float = 10.0, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and SPANS; without ``words`` the dictionary is learnt from the documents."""
    known = dictionary(docs, text) if words is None else words

    def make():
        def one(t):
            return [{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, k, b, base in find_secrets(t, known, least_cost)]

        return lambda texts: {"spans": [one(t) for t in texts]}

    return map_texts(docs, make, SPANS, text, keep)
