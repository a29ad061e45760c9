"""Brute-force versions of what the queries of the ten operators return, in plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import xxhash

LOWER = {b: b + 32 for b in range(65, 91)}
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RUNS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def item_words(text):
    return WORDS.findall((text or "").translate(LOWER))


def decontaminated(docs, items, width=10):
    """doc rows (id, text) in order: n_words, n_hit, n_items, sha of the items."""
    windows = defaultdict(set)
    for item, text in items:
        words = item_words(text)
        size = min(width, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows[tuple(words[i : i + size])].add(None if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for _, text in docs:
        words, hit, met = item_words(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if found := windows.get(tuple(words[i : i + size])):
                    hit.update(range(i, i + size))
                    met |= found
        out.append((len(words), len(hit), len(met), sha(",".join(sorted(met - {None})))))
    return out


def without_passages(text, items, width=10):
    """text with each stretch of words that stand in occurring windows put as one space."""
    places, words = [m.span() for m in WORDS.finditer(text.translate(LOWER))], item_words(text)
    hit = set()
    for _, item in items:
        mine = item_words(item)
        size = min(width, len(mine))
        windows = {tuple(mine[i : i + size]) for i in range(len(mine) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in windows:
                hit.add((i, i + size))
    spans = []
    for a, b in sorted(hit):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    for a, b in reversed(spans):
        text = f"{text[: places[a][0]]} {text[places[b - 1][1] :]}"
    return text


def fingerprint(text, width=4):
    words = RUNS.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(docs, bits=4):
    """(fingerprint, component) of each doc, by comparing all pairs of distinct fingerprints."""
    fps = [fingerprint(t) for _, t in docs]
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    for (d, _), f in zip(docs, fps, strict=True):
        r = find(f)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return [(f"{f:016x}", least[find(f)]) for f in fps]


def base_licenses(text):
    words = item_words(text)
    places, labels = [], set()
    for phrase, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items():
        p = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += here
        labels |= {label} if here else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def token_rows(docs, path, end_id=2):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    out, start = [], 0
    for d, text in sorted(docs, key=lambda r: (r[0] is not None, r[0])):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def quality(text):
    text = text or ""
    words = RUNS.findall(text)
    lines = [x for x in text.split("\n") if RUNS.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    again = {i + d for i, w in enumerate(windows) if seen[w] > 1 for d in range(8)}
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


def spans_of(text, patterns):
    """Spans of the patterns in the order of start and kind, and how many each kind has."""
    found = []
    for k, (kind, pattern, good) in enumerate(patterns):
        found += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text or "") if good(m)]
    found.sort()
    counts = Counter(kind for _, _, kind, _ in found)
    joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)
    return [counts[kind] for kind, _, _ in patterns], joined


SECRETS = [
    ("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 12),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 18),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 16),
]


def digits(m):
    return re.sub(r"[^0-9]", "", m.group())


def luhn(number):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(number))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]


def license_labels(texts, templates, base, common, rarest=16, agree=0.5, least=3):
    """labels and score of each text, by counting votes in dictionaries."""
    split = [(label, t.split(), keys) for label, t, keys in templates]
    vocab = sorted({w for _, ws, _ in split for w in ws} - common)
    number = {w: i for i, w in enumerate(vocab)}
    files = [item_words(t) for t in texts]
    df = Counter(w for ws in files for w in set(ws) & number.keys())
    idf = {w: round(1000 * math.log((len(files) + 1) / (df[w] + 1))) + 1 for w in vocab}
    weight = [sum(idf[w] for w in ws if w in number) for _, ws, _ in split]
    size = [sum(w in number for w in ws) for _, ws, _ in split]
    out = []
    for words in files:
        top = sorted(set(words) & number.keys(), key=lambda w: (-idf[w], -number[w]))[:rarest]
        votes, counts, keyed = Counter(), Counter(), set()
        posts = {w: [(t, p) for t, (_, ws, _) in enumerate(split) for p, x in enumerate(ws) if x == w] for w in top}
        for i, w in enumerate(words):
            for t, p in posts.get(w, ()):
                votes[t, i - p] += idf[w]
                counts[t, i - p] += 1
        for t, (_, ws, keys) in enumerate(split):
            for k in map(str.split, keys):
                for p in range(len(ws)):
                    if ws[p : p + len(k)] == k and top:
                        keyed |= {(t, i - p) for i in range(len(words)) if words[i] == k[0] and words[i : i + len(k)] == k}
        shares = {v: n / weight[v[0]] for v, n in votes.items()}
        sure = {split[t][0] for (t, o), x in shares.items() if x >= agree and counts[t, o] >= min(least, size[t]) and (t, o) in keyed}
        here = {label for phrase, label in base.items() if any(words[i : i + len(phrase.split())] == phrase.split() for i in range(len(words)))}
        out.append((",".join(sorted(sure | here)), round(min(max(shares.values(), default=0.0), 1.0), 6)))
    return out


def line_rows(text):
    """The features of each line with a word, one by one, and its bytes."""
    lines = [x for x in text.split("\n") if RUNS.search(x)]
    before, rows = None, []
    for x in lines:
        words, raw = RUNS.findall(x), x.encode()
        n, size = len(words), len(raw)
        same = 0
        for w in words:
            same += w == before
            before = w
        upper, other = len(re.findall("[A-Z]", x)), sum(b >= 128 or 97 <= b <= 122 for b in raw)
        bare = raw.strip(b" \t\n\v\f\r")
        rows.append([
            1, math.log1p(n) / 4, min(size / n, 40) / 10, len(re.findall(r"[#*$%&|<>]", x)) / size, upper / max(upper + other, 1), len(re.findall("[0-9]", x)) / size, min(len(re.findall(r"[!?*#$%&]", x)) / n, 3),
            bare[-1:] in b".!?:;", min(x.count("|") / n, 2), lines.count(x) > 1, same / n, n <= 3, bare[:1].islower(),
        ])
    return rows, [len(x.encode()) for x in lines]


def best_labels(scores, moves):
    """Of all label sequences the best, by the best way to each label of each line; ties go to content."""
    ways = {0: (0.0, [0]), 1: (scores[0], [1])}
    for e in scores[1:]:
        ways = {y: max(((ways[z][0] + moves[z][y] + (e if y else 0), z, ways[z][1]) for z in (1, 0)), key=lambda w: (w[0], w[1])) for y in (0, 1)}
        ways = {y: (v, [*path, y]) for y, (v, _, path) in ways.items()}
    return max(ways.values(), key=lambda w: (w[0], w[1][-1]))[1]


def personal_spans(texts, window=5, least_chars=5, least_docs=3, least_bits=6.0, least_share=0.5):
    """All spans of each text, those of revealing terms too, joined; and the text without them."""
    def bases(t):
        found = []
        for k, (kind, pattern, good) in enumerate(PERSONAL):
            found += [(m.start(), k, m.end()) for m in re.finditer(pattern, t or "") if good(m)]
        return sorted(found)

    def places(t):
        return [m.span() for m in WORDS.finditer((t or "").translate(LOWER))]

    apart = lambda span, spans: all(span[1] <= a or b <= span[0] for a, _, b in spans)
    term = lambda w: len(w) >= least_chars and w.isalpha()
    n_w, n_e, n_ew, beside = Counter(), Counter(), Counter(), defaultdict(set)
    for t in texts:
        low, found, words = (t or "").translate(LOWER), bases(t), places(t)
        n_w.update({low[a:b] for a, b in words})
        starts = [a for a, _ in words]
        pairs = set()
        for a, k, b in found:
            e = (k, low[a:b] if k < 2 else re.sub("[^0-9]", "", low[a:b]))
            i, j = bisect_left(starts, a), bisect_left(starts, b)
            before, after = words[max(0, i - window) : i], words[j : j + window]
            pairs |= {(e, low[x:y]) for x, y in before + after if apart((x, y), found) and term(low[x:y])}
            pairs.add((e, None))
        n_ew.update(pairs)
        for pair in pairs:
            beside[pair].add(t)
    for (e, w), n in n_ew.items():
        if w is None:
            n_e[e] = n
    told = {w for (e, w), n in n_ew.items() if w and len(beside[e, w]) >= least_docs and math.log2(n * len(texts) / (n_e[e] * n_w[w])) >= least_bits and n / n_w[w] >= least_share}
    out = []
    for t in texts:
        found, low = bases(t), (t or "").translate(LOWER)
        spans = sorted(found + [(a, len(PERSONAL), b) for a, b in places(t) if low[a:b] in told and apart((a, b), found)])
        names = [*(k for k, _, _ in PERSONAL), "term"]
        clean, at = "", 0
        for a, k, b in spans:
            clean += (t[at:a] + f"<{names[k].upper()}>") if a >= at else ""
            at = max(at, b)
        out.append((",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans), None if t is None else clean + t[at:]))
    return out


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def integers(vector):
    return [math.floor(256 * x) for x in vector]


def clusters(rows, k=40, rounds=5, dims=64):
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid hash of (vec_id, vector) rows, in their order."""
    kept = [(i, integers(v)) for i, v in rows if usable(v) and len(v) == dims and max(map(abs, v), default=0) < 2**19]
    order = sorted(kept, key=lambda r: (r[0] is None, sha(f"2:{r[0]}"), r[1]))
    centers = [list(v) for _, v in order[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers)) for _, v in kept]

    for _ in range(rounds):
        members = defaultdict(list)
        for (_, v), (_, j) in zip(kept, assigned(), strict=True):
            members[j].append(v)
        for j, vs in members.items():
            centers[j] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    last = assigned()
    inertia = Counter()
    for d, j in last:
        inertia[j] += d
    return [(i, j, d, inertia[j], sum(inertia.values()), sha(",".join(map(str, centers[j])))) for (i, _), (d, j) in zip(kept, last, strict=True)]


def vector_links(rows, least=0.95):
    """vec_id, n_links, component_id, kept of (vec_id, vector) rows, by comparing all pairs."""

    def unit(v):
        if not usable(v) or not any(v):
            return None
        top = max(map(abs, v))
        v = [x / top for x in v]
        size = math.sqrt(math.fsum(x * x for x in v))
        return [x / size for x in v]

    units = [unit(v) for _, v in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a and b and len(a) == len(b) and math.fsum(x * y for x, y in zip(a, b, strict=True)) >= least:
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    least_id = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least_id[top(i)] = min(key, least_id.get(top(i), key))
    found = [least_id.get(top(i)) for i in range(len(rows))]
    return [(key, n, c, key == c) for (key, _), n, c in zip(rows, links, found, strict=True)]


def negatives(rows, positives=5, k=10):
    """anchor_id, positive_id, rank, negative_id, both scores, of (vec_id, vector, label) rows."""
    kept = []
    for i, v, label in rows:
        if label is not None and usable(v) and max(map(abs, v), default=0) < 2**18:
            kept.append((i, integers(v), (label + 1) % 10 if i is not None and i % 7 == 0 else label))

    def order(scored):
        return sorted(scored, key=lambda x: (-x[0], x[1] is None, x[1]))

    out = []
    for a, q, label in kept:
        if a is not None and a % 100 == 0:
            scored = [(sum(x * y for x, y in zip(q, v)), i, other) for i, v, other in kept]
            for score, p, _ in order(s for s in scored if s[2] == label and s[1] != a)[:positives]:
                fit = order(s for s in scored if s[2] != label and 30 * score <= 100 * s[0] <= 90 * score)
                out += [(a, p, n, i, score, s) for n, (s, i, _) in enumerate(fit[:k], 1)]
    return out
