"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

TR = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(TR))


def spans(rows, t):
    """doc_id: (n_bytes, n_removed, n_spans, kept_sha256)"""
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        dead = [0] * len(b)
        for p in range(len(b) - t + 1):
            if b[p : p + t] in seen:
                dead[p : p + t] = [1] * t
            seen.add(b[p : p + t])
        left = bytes(x for x, y in zip(b, dead, strict=True) if not y)
        out[d] = (len(b), sum(dead), sum(1 for i in range(len(b)) if dead[i] and (i == 0 or not dead[i - 1])), hashlib.sha256(left).hexdigest())
    return out


def jaccard(rows, n, percent):
    """doc_id: (n_shingles, component_id)"""
    sets = {}
    for d, text in rows:
        w = words(text)
        sets[d] = set(zip(*[w[i:] for i in range(n)], strict=False)) if len(w) >= n else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def kneser_ney(rows, order):
    """doc_id: (held_out, n_tokens, n_known, train_tokens, base_score, score)"""
    toks = {d: [*words(t), "</s>"] for d, t in rows}
    train = [s for d, s in toks.items() if zlib.crc32(str(d).encode()) % 5 != 1]
    uni = Counter(t for s in train for t in s)
    n, v = sum(uni.values()), len(uni)
    level = {order: Counter(tuple((["<s>"] * (order - 1) + s)[i : i + order]) for s in train for i in range(len(s)))}
    for k in range(order - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    disc, stats = {}, {}
    for k, counts in level.items():
        c = Counter(counts.values())
        n1, n2, n3, n4 = (c[i] for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        disc[k] = [0, *[min(max(x, 0.01), i + 0.99) for i, x in enumerate(d)]]
        stats[k] = defaultdict(lambda: [0, 0, 0, 0])
        for g, m in counts.items():
            stats[k][g[:-1]][0] += m
            stats[k][g[:-1]][min(m, 3)] += 1

    def prob(g, k):
        if k == 0:
            return 1 / (v + 1)
        g = g[-k:]
        if g[:-1] not in stats[k]:
            return prob(g, k - 1)
        s, d, c = stats[k][g[:-1]], disc[k], level[k].get(g, 0)
        return max(c - d[min(c, 3)], 0) / s[0] + (d[1] * s[1] + d[2] * s[2] + d[3] * s[3]) / s[0] * prob(g, k - 1)

    out = {}
    for d, s in toks.items():
        q = ["<s>"] * (order - 1) + [t if t in uni else "<unk>" for t in s]
        total = sum(math.log10(prob(tuple(q[i : i + order]), order)) for i in range(len(s)))
        base = sum(math.log10((uni[t] + 0.5) / (n + 0.5 * (v + 1))) for t in s)
        out[d] = (zlib.crc32(str(d).encode()) % 5 == 1, len(s), sum(uni[t] > 0 for t in s), n, base, total)
    return out


def leak_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(TR))


def leaks(docs, items):
    """doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)"""
    spans_ = defaultdict(set)
    for i, text in items:
        w = leak_words(text)
        if i is not None and w:
            for s in [tuple(w)] if len(w) < 13 else [tuple(w[j : j + 13]) for j in range(len(w) - 12)]:
                spans_[s].add(str(i))
    lens, out = {len(s) for s in spans_}, {}
    for d, text in docs:
        w, hit, own = leak_words(text), set(), set()
        for m in lens:
            for j in range(len(w) - m + 1):
                if (s := tuple(w[j : j + m])) in spans_:
                    hit |= set(range(j, j + m))
                    own |= spans_[s]
        out[d] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out
