"""Brute-force versions of the operators, over plain lists."""

import hashlib
import math
import re
from collections import Counter
from fractions import Fraction

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=SPACED):
    return pattern.findall((text or "").encode().lower())


def near_duplicates(rows, per_cent=85):
    """doc_id -> (set size, component)."""
    sets, parent = [], list(range(len(rows)))
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= per_cent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows)]


def contamination(rows, items):
    windows = {}
    for item, text in items:
        w = words(text, ALNUM)
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(str(item))
    out = {}
    for doc, text in rows:
        w, hit, found = words(text, ALNUM), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    found |= windows[tuple(w[a : a + n])]
                    hit |= set(range(a, a + n))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def boilerplate(rows, ratio, least):
    """(doc, cleaned text) of (doc, host, text)."""
    total, seen = Counter(h for _, h, _ in rows), Counter()
    bare = lambda x: x.strip(" \t\r")
    for _, h, t in rows:
        seen.update((h, x) for x in {bare(x) for x in (t or "").split("\n")} - {""})
    bad = {k for k, n in seen.items() if n >= least and n > ratio * total[k[0]]}
    return [(d, None if t is None else "\n".join(x for x in t.split("\n") if (h, bare(x)) not in bad)) for d, h, t in rows]


def kneser_ney(texts):
    """log10 of the probability of a text's words and end, by interpolated modified Kneser-Ney trigrams of these texts."""
    streams = [["<", "<", *words(t), ">"] for t in texts]
    c3 = Counter(tuple(s[i - 2 : i + 1]) for s in streams for i in range(2, len(s)))
    c2 = Counter(k[1:] for k in c3)  # words before each pair
    c1 = Counter(k[1] for k in c2)

    def discounts(counts):
        n = Counter(min(c, 5) for c in counts)
        if min(n[i] for i in (1, 2, 3, 4)) == 0:
            return [0, 0.5, 0.75, 0.9]
        y = n[1] / (n[1] + 2 * n[2])
        d = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
        return [min(max(x, a), b) for x, a, b in zip(d, [0, 0.05, 0.1, 0.1], [0, 0.95, 1.9, 2.9], strict=True)]

    def spread(counts):
        d, total, left = discounts(counts.values()), Counter(), Counter()
        for k, c in counts.items():
            total[k[:-1]] += c
            left[k[:-1]] += d[min(c, 3)]
        return {k: (c - d[min(c, 3)]) / total[k[:-1]] for k, c in counts.items()}, {h: x / total[h] for h, x in left.items()}

    d1, whole = discounts(c1.values()), sum(c1.values())
    uniform = sum(d1[min(c, 3)] for c in c1.values()) / whole / (len(c1) + 1)
    p1 = {w: (c - d1[min(c, 3)]) / whole + uniform for w, c in c1.items()}
    (share2, left2), (share3, left3) = spread(c2), spread(c3)

    def two(a, w):
        return share2.get((a, w), 0) + left2.get((a,), 1) * p1.get(w, uniform)

    def log_probability(text):
        s = ["<", "<", *words(text), ">"]
        return sum(math.log10(share3.get(tuple(s[i - 2 : i + 1]), 0) + left3.get(tuple(s[i - 2 : i]), 1) * two(s[i - 1], s[i])) for i in range(2, len(s)))

    return log_probability


def base_spans(text):
    """(start, kind, end) of the base kinds of personal data."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(d[::-1][::2]) + sum(2 * x - 9 * (x > 4) for x in d[::-1][1::2]) in range(0, 200, 10):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def disclosing(texts, support=2, disclosure=0.7):
    """For each text the (start, end) of its disclosing terms."""
    low = lambda x: x.encode().lower().decode()
    name = lambda t, s: (s[1], low(t[s[0] : s[2]]) if s[1] == 0 else t[s[0] : s[2]] if s[1] == 1 else re.sub("[^0-9]", "", t[s[0] : s[2]]))
    texts = [t or "" for t in texts]
    spans = [base_spans(t) for t in texts]
    owns = [{name(t, s) for s in ss} for t, ss in zip(texts, spans, strict=True)]
    often = {e for e, n in Counter(e for x in owns for e in x).items() if n >= support}
    owns = [x & often for x in owns]
    holders = [i for i, x in enumerate(owns) if x]
    copies = {d for d, _, c in near_duplicates([(i, texts[i]) for i in holders]) if d != c}
    places = [[(low(m[0]), m.span()) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]{3,}", t) if not any(a < m.end() and m.start() < b for a, _, b in ss)] for t, ss in zip(texts, spans, strict=True)]
    has = [{w for w, _ in p} for p in places]
    total = len(texts) - len(copies)
    n_t = Counter(w for i, x in enumerate(has) if i not in copies for w in x)
    n_e = Counter(e for i in holders if i not in copies for e in owns[i])
    both = Counter((e, w) for i in holders if i not in copies for e in owns[i] for w in has[i])
    tells = {k for k, n in both.items() if n >= support and support <= n_e[k[0]] < total and math.log2(total * n / (n_t[k[1]] * n_e[k[0]])) >= disclosure * math.log2(total / n_e[k[0]])}
    return [[s for w, s in places[i] if any((e, w) in tells for e in owns[i])] for i in range(len(texts))]


def feature(payload):
    """The feature of a stored payload, sign by sign."""
    rows = [payload[i : i + 192] for i in range(0, len(payload), 192)]
    luma = [[sum(r[3 * x : 3 * x + 3]) for x in range(64)] for r in rows]
    starts = [min(i * len(luma) // 8, len(luma) - 1) for i in range(8)]
    bits = ""
    for i, a in enumerate(starts):
        b = starts[i + 1] if i < 7 else len(luma)
        band = luma[a : max(b, a + 1)]
        cut = [j * 64 // 9 for j in range(10)]
        means = [Fraction(sum(sum(r[c:d]) for r in band), (d - c) * len(band)) for c, d in zip(cut[:-1], cut[1:], strict=True)]
        bits += "".join("1" if y > x else "0" for x, y in zip(means[:-1], means[1:], strict=True))
    n, total = len(payload), sum(payload)
    return f"rgb 64x{len(rows)} mean {total / n:.4f} var {sum(x * x for x in payload) / n - (total / n) ** 2:.4f} dhash {int(bits, 2):016x}"
