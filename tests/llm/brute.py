"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def near(rows, shingle=4, percent=80):
    """doc_id -> (shingles, component) by comparing all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = collections.defaultdict(list)
    for i, s in sets.items():
        met = collections.Counter(k for g in s for k in where[g])
        for k, n in met.items():
            if 100 * n >= percent * (len(s) + len(sets[k]) - n):
                a, b = find(i), find(k)
                root[max(a, b)] = min(a, b)
        for g in s:
            where[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def substrings(rows, window=20):
    """doc_id -> (words, removed, digest)."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = words(t)
        gone = set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def leaks(docs, items, window=10):
    """doc_id -> (words, hit, items)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    wins = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        for s in range(max(1, len(w) - window + 1)) if w else ():
            wins[tuple(w[s : s + window])].add(str(i))
    sizes = {len(k) for k in wins}
    out = {}
    for i, t in docs:
        w, hit, owners = split(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (key := tuple(w[s : s + n])) in wins:
                    hit.update(range(s, s + n))
                    owners |= wins[key]
        out[i] = (len(w), len(hit), ",".join(sorted(owners)))
    return out


def lm(rows, least, discount, alpha, levels=3):
    """The backoff model by dictionaries of tuples: scores, tokens, and the sums of some states' probabilities."""
    tokens = {i: words((t or "").translate(LOW)) + [None] for i, t in rows}
    counts = [collections.Counter() for _ in range(levels + 1)]
    for i in tokens:
        if zlib.crc32(str(i).encode()) % 10:
            for n in range(1, levels + 1):
                counts[n].update(zip(*(tokens[i][k:] for k in range(n)), strict=False))
    total, one = sum(counts[1].values()), counts[1]
    den = total + alpha * (len(one) + 1)
    arcs = collections.defaultdict(dict)
    for n in range(2, levels + 1):
        for gram, c in counts[n].items():
            if c >= least:
                arcs[gram[:-1]][gram[-1]] = c
    left = {h: 1 - sum(c - discount for c in x.values()) / counts[len(h)][h] for h, x in arcs.items()}

    def p(w, h):
        """The probability of w after the words h, which are as many as count."""
        if not h:
            return (one[(w,)] + alpha) / den
        if h not in arcs:
            return p(w, h[1:])
        return max(arcs[h].get(w, discount) - discount, 0) / counts[len(h)][h] + left[h] * p(w, h[1:])

    def score(t):
        return sum(math.log10(p(w, tuple(t[max(0, k - levels + 1) : k]))) for k, w in enumerate(t))

    sums = [sum(p(w, h) for (w,) in one) + alpha / den * math.prod(left.get(h[k:], 1) for k in range(len(h))) for h in sorted(arcs, key=str)[:: max(1, len(arcs) // 5)]]
    return {i: (len(t), sum(one[(w,)] > 0 for w in t), sum(math.log10(p(w, ())) for w in t), score(t)) for i, t in tokens.items()}, total, sums


def language(rows, dim, numbers, vectors, scale):
    """doc_id -> predicted language, from (doc_id, text, lang) by adding up vectors gram by gram. numbers gives a code
    point's letter number, vectors a letter's vector."""

    def vector(text):
        c = [0]
        for ch in text or "":
            k = int(numbers[ord(ch)])
            if k >= 0 or c[-1]:
                c.append(max(k, 0))
        c += [0] * (c[-1] != 0)
        out = [0] * dim
        for a, b, d in zip(c, c[1:], c[2:], strict=False):
            if b or d:
                x, y, z = vectors(a), vectors(b), vectors(d)
                out = [v + x[(k - 2) % dim] * y[(k - 1) % dim] * z[k] for k, v in enumerate(out)]
        size = math.sqrt(sum(v * v for v in out))
        return [v / max(size, 1e-9) for v in out], len(c) > 1

    made = {i: vector(t) for i, t, _ in rows}
    sums = collections.defaultdict(lambda: [0.0] * dim)
    for i, _, lang in rows:
        if lang is not None and made[i][1] and zlib.crc32(str(i).encode()) % 5:
            sums[lang] = [s + round(v * scale) for s, v in zip(sums[lang], made[i][0], strict=True)]
    unit = lambda x: [v / math.sqrt(sum(w * w for w in x)) for v in x]
    prototypes = {lang: unit(v) for lang, v in sums.items()}
    mean = [sum(p[k] for p in prototypes.values()) / len(prototypes) for k in range(dim)]
    prototypes = {lang: unit([v - m for v, m in zip(p, mean, strict=True)]) for lang, p in prototypes.items()}
    cosine = lambda x, p: sum(a * b for a, b in zip(x, p, strict=True))
    return {i: max(sorted(prototypes), key=lambda lang: cosine(made[i][0], prototypes[lang])) if made[i][1] else "und" for i, _, _ in rows}


def distances(word, term):
    """Edit distances of the term to every beginning of the word."""
    row = list(range(len(word) + 1))
    for i, x in enumerate(term, 1):
        row, old = [i], row
        for j, y in enumerate(word, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row


def toxic_hits(terms, clean, words, fuzzy):
    """word -> (term, errors) of the words that a lexicon matches, by the distance to every term."""
    out = {}
    for w in set(words):
        best = None
        for term, stem in terms:
            d = distances(w, term)
            ends = range(len(w)) if stem else [len(w)]
            for errors in (0, 1) if len(term) >= fuzzy else (0,):
                at = [e for e in ends if d[e] <= errors]
                if at:
                    end = len(term) if stem and len(term) in at else at[-1]
                    rank = (errors, -len(term), term)
                    if (best is None or rank < best) and not (errors and w[:end] in clean):
                        best = rank
                    break
        if best is not None:
            out[w] = (best[2], best[0])
    return out
