"""The same results by the plainest means, in Python."""

import collections
import hashlib
import re


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    by = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        shared = collections.Counter(j for x in sets[i] for j in by[x] if j < i)
        for j, o in shared.items():
            if 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def substrings(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    out = {}
    for i, b in texts:
        runs = []
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                if runs and p <= runs[-1][1]:
                    runs[-1][1] = p + length
                else:
                    runs.append([p, p + length])
        kept, end = b"", 0
        for x, y in runs:
            kept, end = kept + b[end:x], y
        kept += b[end:]
        out[i] = (len(b), len(b) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
    return out


def passages(rows, n):
    """Words in runs of n that another row has too."""
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", lower(t))) for i, t in rows]
    of = collections.defaultdict(set)
    for k, (_, w) in enumerate(texts):
        for p in range(len(w) - n + 1):
            of[tuple(w[p : p + n])].add(k)
    return {i: len({q for p in range(len(w) - n + 1) if len(of[tuple(w[p : p + n])]) > 1 for q in range(p, p + n)}) for i, w in texts}


def contaminated(rows, items, window=10):
    def words(t):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]

    bad = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        for p in range(len(w) - n + 1 if n else 0):
            bad[tuple(w[p : p + n])].add(i)
    sizes = {len(g) for g in bad}
    out = {}
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if g := bad.get(tuple(w[p : p + n])):
                    hit.update(range(p, p + n))
                    found |= g
        out[i] = (len(w), len(hit), sorted(map(str, found)))
    return out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def alignment(rows, a, b, bytes_a, bytes_b):
    """Per row n_a, n_b, n_groups, n_links, n_best, count_sum and digest. a, b: encoders; bytes_a, bytes_b: bytes of an id."""
    found = []
    for i, t in rows:
        want = b" " + (t or "").encode()
        x, y = (a(" " + t), b(t)) if t else ([], [])
        if b"".join(map(bytes_a, x)) != want or b"".join(map(bytes_b, y)) != want:
            x, y = [], []
        ends = []
        for ids, of in ((x, bytes_a), (y, bytes_b)):
            at, out = 0, []
            for k in ids:
                at += len(of(k))
                out.append(at)
            ends.append(out)
        groups, links, p, q = [], [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            here = [ends[0].index(cut, p) + 1, ends[1].index(cut, q) + 1]
            groups.append(",".join(map(str, x[p : here[0]])) + "|" + ",".join(map(str, y[q : here[1]])))
            p, q = here
            links.append((x[p - 1], y[q - 1]))
        found.append((i, x, y, groups, links))
    count = collections.Counter(p for *_, links in found for p in links)
    most = collections.Counter()
    for (_, m), c in count.items():
        most[m] = max(most[m], c)
    return [
        (i, len(x), len(y), len(g), len(ls), sum(count[p] == most[p[1]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "")
        for i, x, y, g, ls in found
    ]


def mixture(rows, quality, key, weights=(3, 1, 2)):
    """id, source: (size, target, taken) by sorting each source whole. key: of id, text and weight."""
    from fractions import Fraction

    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    of = collections.Counter()
    for (_, _, s), n in zip(rows, size, strict=True):
        of[s] += n
    names = sorted(of, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, target = Fraction(3 * sum(size), 2), set(names), {}
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 2 * of[s]}
        if not above:
            break
        for s in above:
            target[s] = Fraction(2 * of[s])
            left -= target[s]
        free -= above
    target |= share
    out = []
    for s in names:
        goal = int(float(target[s]) + 0.5)
        whole = goal // of[s] if of[s] else 0
        rest = goal - whole * of[s]
        mine = sorted((key(i, t, quality.get(i, 1.0)), i, n) for (i, t, x), n in zip(rows, size, strict=True) if x == s)
        for _, i, n in mine:
            some = max(0, min(n, rest))
            rest -= some
            out.append((i, s, n, of[s], float(target[s]), whole * n + some))
    return out


def search(docs, items, k=10):
    """(item, rank, doc, score) by scoring every document."""
    import math

    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))

    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, b in bags:
            size = sum(b.values())
            m = 25 + 75 * size * n_docs // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if b[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return out
