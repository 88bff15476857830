"""Plain versions of the corpus operators, for small tables only."""

import collections
import hashlib
import re

import numpy as np
import xxhash

from lapforge.llm.urls import BASE, ORDER, UNIT

SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split((text or "").encode()) if w]


def exact(rows):
    """{row number: (keep_id, size, sha)} for (id, text) rows."""
    bare = [SPACE.sub(b"", (t or "").encode()) for _, t in rows]
    groups = collections.defaultdict(list)
    for i, b in enumerate(bare):
        groups[b].append(i)
    best = {b: min(g, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0)) for b, g in groups.items()}
    return [(rows[i][0], rows[best[b]][0], len(groups[b]), hashlib.sha256(b).hexdigest()) for i, b in enumerate(bare)]


def repeats(rows, length):
    split = [(i, words(t)) for i, t in rows]
    seen = collections.Counter(tuple(w[s:s + length]) for _, w in split for s in range(len(w) - length + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if seen[tuple(w[s:s + length])] > 1:
                gone[s:s + length] = [True] * length
        stay = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), len(w) - len(stay), hashlib.sha256(b" ".join(stay)).hexdigest()))
    return out


def fingerprint(text, k=4):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), seed=42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(rows, bits=4):
    """(id, fingerprint, component) for (id, text) rows."""
    fp = np.array([fingerprint(t) for _, t in rows], np.uint64)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp) <= bits):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [(rows[i][0], f"{int(fp[i]):016x}", least.get(find(i))) for i in range(len(rows))]


def similar(rows, least=0.8, k=5):
    """The ids that stay of (id, text) rows: one of each component of pairs with Jaccard similarity ``least``."""
    sets = []
    for _, text in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    holders, shared = collections.defaultdict(list), collections.Counter()
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for held in holders.values():
        shared.update((a, b) for n, a in enumerate(held) for b in held[n + 1:])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    blank = [i for i, s in enumerate(sets) if not s]
    near_pairs = [(a, b) for (a, b), n in shared.items() if n >= least * (len(sets[a]) + len(sets[b]) - n)]
    for a, b in near_pairs + [(blank[0], i) for i in blank[1:]]:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[find(i)].append((key is None, key or 0))
    return sorted((min(g) for g in groups.values()))


def shared_runs(docs, items, least=13):
    """(document, item) pairs with ``least`` equal words in a row."""
    norm = lambda s: re.findall(r"[^\W_]+", (s or "").lower())
    index = collections.defaultdict(set)
    for i, t in items:
        w = norm(t)
        n = min(least, len(w))
        for s in range(len(w) - n + 1):
            index[tuple(w[s:s + n])].add(i)
    sizes = {len(k) for k in index}
    return {(d, i) for d, t in docs for w in [norm(t)] for n in sizes for s in range(len(w) - n + 1) for i in index.get(tuple(w[s:s + n]), ())}


def url_scores(urls, learned, order=ORDER):
    """Scores of the two language models, character by character."""
    from math import log

    pad = lambda u: "\x02" * (order - 1) + "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in u) + "\x03"
    seen = {True: collections.Counter(), False: collections.Counter()}
    for url, good in learned:
        padded = pad(url)
        seen[good].update(padded[i - k:i + 1] for i in range(order - 1, len(padded)) for k in range(order))
    after = {True: {}, False: {}}
    for good, counts in seen.items():
        for gram, n in counts.items():
            total, kinds = after[good].get(gram[:-1], (0, 0))
            after[good][gram[:-1]] = (total + n, kinds + 1)

    def p(gram, good):
        n, t = after[good].get(gram[:-1], (0, 0))
        shorter = p(gram[1:], good) if len(gram) > 1 else BASE
        return (seen[good][gram] + t * shorter) / (n + t) if n else shorter

    out = []
    for url in urls:
        padded = pad(url)
        grams = [padded[i - order + 1:i + 1] for i in range(order - 1, len(padded))]
        out.append(sum(round((log(p(g, True)) - log(p(g, False))) * UNIT) for g in grams) / len(grams) / UNIT)
    return out
