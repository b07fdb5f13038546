"""Plain Python versions of the corpus operators, for small tables: rows are (doc_id, text)."""

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words(lowered(text or ""))
    if not w:
        return frozenset()
    if len(w) < 5:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def near(rows, percent=75):
    """[(doc_id, n_shingles, component_id)] by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = Counter()
    for i, s in enumerate(sets):
        seen = Counter(j for x in s for j in holders[x] if j < i)
        common.update({(i, j): n for j, n in seen.items()})
    for (i, j), n in common.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, doc), doc)
    return [(doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)]


def exact(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc))
    out = []
    for doc, text in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best = min(groups[norm])[1]
        out.append((doc, best, len(groups[norm]), doc == best, hashlib.sha256(norm.encode()).hexdigest()))
    return out


def suffix(rows, length=200):
    counts = Counter()
    data = [(doc, (text or "").encode()) for doc, text in rows]
    for _, b in data:
        counts.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for doc, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def line_key(line):
    return lowered(line.strip(SPACE))


def lines(rows, min_chars=40, min_docs=5):
    """[(doc_id, n_lines, n_dropped, kept text)]"""
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= min_chars:
                holders[line_key(line)].add(doc)
    out = []
    for doc, text in rows:
        every = (text or "").split("\n")
        kept = [x for x in every if len(holders.get(line_key(x), ())) < min_docs or max(holders[line_key(x)]) == doc]
        out.append((doc, len(every), len(every) - len(kept), "\n".join(kept)))
    return out


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    in_window = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(in_window) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(in_window), failed


def mix_targets(sizes):
    """{source: target} for {source: size}."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        each = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * each > 2 * sizes[s]]
        if not over:
            return target | {s: weight[s] * each for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def warc(pages):
    """[(page_id, payload_bytes, digest, type, refers_to)] for (page_id, html)."""
    first = {}
    for page, html in pages:
        first[html or ""] = max(first.get(html or "", page), page)
    out = []
    for page, html in pages:
        data = (html or "").encode()
        again = first[html or ""] != page
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None))
    return out


def ppm(texts, order=3):
    """A function from bytes to bits, for one language's texts: method C, counts frozen, texts after `order` zero bytes."""
    seen = defaultdict(Counter)
    for t in texts:
        b = bytes(order) + t
        for i in range(order, len(b)):
            for k in range(order + 1):
                seen[b[i - k : i]][b[i]] += 1

    def chance(context, x):
        after = seen.get(context)
        if after is None:
            return chance(context[1:], x) if context else 1 / 256
        n, d = sum(after.values()), len(after)
        return after[x] / (n + d) if x in after else d / (n + d) * (chance(context[1:], x) if context else 1 / 256)

    def bits(t):
        b = bytes(order) + t
        return -sum(math.log2(chance(b[i - order : i], b[i])) for i in range(order, len(b)))

    return bits


def entropy_rates(docs, target):
    """Rates of documents (their sizes) that give `target`, by bisection of the dual's slope."""
    mean = sum(docs) / len(docs)
    rate = lambda lam, x: 2 / (1 + math.exp(min(700, -lam * x / mean)))
    low, high = -1e5, 1e5
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(x * rate(mid, x) for x in docs) < target else (low, mid)
    return [rate(low, x) for x in docs]
