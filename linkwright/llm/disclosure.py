"""Operator 9, PII: patterns, and information-theoretic sanitisation of the terms that reveal an entity.

The base patterns find e-mail and IP addresses, card and phone numbers: the protected entities.
A term is a word of letters within ``window`` words of a mention. Over the whole corpus, N
documents, c(w) those with the term, c(e) those with the entity, and c(e, w) those with the term
beside the entity give what the term discloses: log2(N c(e, w) / (c(e) c(w))) bits, and the
probability c(e, w) / c(w) that the term means the entity. A term that exceeds both thresholds for
some entity, beside it in ``least_docs`` different texts, reveals it wherever it stands, so all its places
are spans to sanitise, beside the base spans: each is generalised to its kind. Copies of a document are one
text, and so no evidence however many they are; in the ratios they count on all sides. Words under ``least_chars`` letters, or not of letters
alone, are no terms, and an entity in fewer texts than ``least_docs`` has none: both are parameters, since
short words and single mentions are mostly chance.

Three passes read whole texts in the tasks that scan them: for mentions and their surroundings, for
words, and for the spans. Counts are combined in the task before the shuffle; entities, terms and
counts stay distributed and meet by joins, which a term or an entity of very many documents only
makes longer by one counted row. Revealing terms go to the shared folder, from which tasks read them
in blocks of ``block_bytes``; more terms make more blocks. Texts are never shuffled.

Defined cases: a null text has no spans and stays null, an empty one has none; repeated rows count
as documents, but are one text; spans are code points, end exclusive; of spans that overlap, all
characters go under the first one's kind; columns other than the text are not used.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import Spool, checkpointed
from .common import LOWER_STR, WORD_RE, document_counts, map_texts, utf8

KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)
#: The base patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
SPANS = "spans array<struct<start:int,rank:int,end:int,kind:string,base:boolean>>, sanitised string"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain, from each @ outwards: a long run without one costs nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1) if at >= end else None
        if domain:
            begin = at
            while begin > end and text[begin - 1] in LOCAL:
                begin -= 1
            if begin < at:
                end = domain.end()
                yield begin, end
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """start, number of the kind, end; in order."""
    if not text:
        return []
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity_of(kind: int, value: str) -> int:
    """A signed hash of a mention: its digits, or its characters in lower case."""
    same = value.translate(LOWER_STR) if kind < 2 else NOT_DIGIT.sub("", value)
    h = xxhash.xxh64_intdigest(utf8(f"{kind}:{same}"), 7)
    return h - (1 << 64) if h >> 63 else h


def words_apart(lower: str, bases: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], set[int]]:
    """The words of a text, and which of them lie in a base span."""
    words = [m.span() for m in WORD_RE.finditer(lower)]
    starts = [a for a, _ in words]
    covered = set()
    for a, _, b in bases:
        i = max(bisect_left(starts, a) - 1, 0)
        while i < len(words) and words[i][0] < b:
            if words[i][1] > a:
                covered.add(i)
            i += 1
    return words, covered


def is_term(word: str, least_chars: int) -> bool:
    return len(word) >= least_chars and word.isalpha()


def surroundings(text: str, bases: list[tuple[int, int, int]], window: int, least_chars: int) -> dict[int, set[str]]:
    """For each entity the terms near its mentions."""
    lower = text.translate(LOWER_STR)
    words, covered = words_apart(lower, bases)
    starts = [a for a, _ in words]
    out: dict[int, set[str]] = {}
    for a, kind, b in bases:
        before, after = bisect_left(starts, a), bisect_left(starts, b)
        near = (lower[slice(*words[i])] for i in [*range(max(0, before - window), before), *range(after, min(len(words), after + window))] if i not in covered)
        out.setdefault(entity_of(kind, text[a:b]), set()).update(word for word in near if is_term(word, least_chars))
    return out


def mentions(docs: DataFrame, text: str = "text", window: int = 5, least_chars: int = 5) -> DataFrame:
    """pairs, entities: the distinct (entity, term) and entities of each text with a mention; x is a hash of the text."""

    def make():
        def fn(texts: list) -> dict:
            bases = [base_spans(t) for t in texts]
            near = [surroundings(t, b, window, least_chars) if b else {} for t, b in zip(texts, bases, strict=True)]
            pairs = [[{"e": e, "w": w} for e, ws in x.items() for w in ws] for x in near]
            return {"pairs": pairs, "entities": [sorted(x) for x in near], "x": [xxhash.xxh64_intdigest(utf8(t), 9) >> 1 if b else 0 for t, b in zip(texts, bases, strict=True)]}

        return fn

    found = map_texts(docs.select(text), make, "pairs array<struct<e:long,w:string>>, entities array<long>, x long", text, [])
    return found.where("size(entities) > 0")


def revealing_terms(docs: DataFrame, text: str, window: int, least_chars: int, least_docs: int, least_bits: float, least_share: float) -> DataFrame:
    """w: the distinct terms that disclose some entity."""
    found = checkpointed(mentions(docs, text, window, least_chars))
    each = found.select(F.inline("pairs"), "x").groupBy("e", "w", "x").agg(F.count("*").alias("n"))
    joint = each.groupBy("e", "w").agg(F.sum("n").alias("n_ew"), F.count("*").alias("kinds")).where(F.col("kinds") >= least_docs).drop("kinds")
    per_entity = found.select(F.explode("entities").alias("e")).groupBy("e").agg(F.count("*").alias("n_e"))
    bits = F.log2(F.col("n_ew") * F.lit(float(docs.count())) / (F.col("n_e") * F.col("n")))
    told = joint.join(per_entity, "e").join(document_counts(docs, text, least_chars), "w")
    return told.where((bits >= least_bits) & (F.col("n_ew") / F.col("n") >= least_share)).select("w").distinct()


def find_disclosures(
    docs: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    window: int = 5,
    least_chars: int = 5,
    least_docs: int = 3,
    least_bits: float = 6.0,
    least_share: float = 0.5,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """The kept columns (all, if None) and SPANS: base spans, those of revealing terms, kind ``term``, and
    the text without them."""
    terms = Spool(revealing_terms(docs, text, window, least_chars, least_docs, least_bits, least_share), block_bytes)

    def make():
        def fn(texts: list) -> dict:
            distinct = [set(WORD_RE.findall(t.translate(LOWER_STR))) if t else set() for t in texts]
            met: list[set[str]] = [set() for _ in texts]
            for block in terms.blocks(lambda t: frozenset(t.column(0).to_pylist())):
                for words, here in zip(distinct, met, strict=True):
                    here |= words & block
            spans = [spans_of(t, here) for t, here in zip(texts, met, strict=True)]
            named = [[{"start": a, "rank": k, "end": b, "kind": "term" if k == TERM else KINDS[k], "base": k != TERM} for a, k, b in x] for x in spans]
            return {"spans": named, "sanitised": [generalised(t, x) for t, x in zip(texts, spans, strict=True)]}

        return fn

    return map_texts(docs, make, SPANS, text, keep)


def spans_of(text: str | None, terms: set[str]) -> list[tuple[int, int, int]]:
    """start, number of the kind, end, of base spans and of the terms outside them; in order."""
    bases = base_spans(text)
    if not terms:
        return bases
    lower = text.translate(LOWER_STR)
    words, covered = words_apart(lower, bases)
    return sorted(bases + [(a, TERM, b) for i, (a, b) in enumerate(words) if lower[a:b] in terms and i not in covered])


def generalised(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """text with each span (start, kind, end; in order) put as its kind in angle brackets."""
    if text is None:
        return None
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"<{'TERM' if kind == TERM else KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, text: str = "text", **thresholds) -> DataFrame:
    """docs with what reveals an entity generalised in their texts; all other columns as they are."""
    packed = docs.select(F.struct("*").alias("doc"), F.col(text).alias("text"))
    found = find_disclosures(packed, "text", ["doc"], **thresholds)
    return found.select(*(F.col("sanitised").alias(c) if c == text else F.col(f"doc.`{c}`") for c in docs.columns))
