"""Plain versions of the operators, for small inputs."""

import hashlib
import math
from collections import defaultdict

import xxhash


class Union:
    def __init__(self, n):
        self.p = list(range(n))

    def find(self, x):
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def dropped_lines(docs, k=7, threshold=0.8, least=20):
    """{doc_id: set of dropped line numbers} of [(doc_id, text)]."""
    places, forms = [], {}
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        for n, line in enumerate((text or "").encode().lower().split(b"\n")):
            form = b" ".join(line.split())
            if len(form) >= least:
                places.append((doc_id, n, forms.setdefault(form, len(forms))))
    sets = [{f[i : i + k] for i in range(len(f) - k + 1)} for f in forms]
    u = Union(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) >= threshold * max(len(sets[i]), len(sets[j])) and jaccard(sets[i], sets[j]) >= threshold - 1e-9:
                u.join(i, j)
    first, out = {}, defaultdict(set)
    for doc_id, n, f in places:
        if first.setdefault(u.find(f), (doc_id, n)) != (doc_id, n):
            out[doc_id].add(n)
    return dict(out)


def dropped_of_rows(rows, k=7, threshold=0.8):
    """Set of dropped line numbers of each of [(order, text)], all lines but blank ones taken; a line of under k bytes is one shingle."""
    places, forms = [], {}
    for at in sorted(range(len(rows)), key=lambda i: (rows[i][0], i)):
        for n, line in enumerate((rows[at][1] or "").encode().lower().split(b"\n")):
            form = b" ".join(line.split())
            if form:
                places.append((at, n, forms.setdefault(form, len(forms))))
    sets = [{f[i : i + k] for i in range(max(1, len(f) - k + 1))} for f in forms]
    having = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            having[x].append(i)
    u = Union(len(sets))
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in having[x]:
                shared[j] += 1
        for j, n in shared.items():
            if j < i and n >= threshold * (len(s) + len(sets[j]) - n) - 1e-9:
                u.join(i, j)
    first, out = {}, [set() for _ in rows]
    for at, n, f in places:
        if first.setdefault(u.find(f), (at, n)) != (at, n):
            out[at].add(n)
    return out


def simhash(text, k=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(keys, linked):
    """Root index of each key under the predicate on pairs."""
    u = Union(len(keys))
    for i in range(len(keys)):
        for j in range(i):
            if linked(keys[i], keys[j]):
                u.join(i, j)
    return [u.find(i) for i in range(len(keys))]


def word_shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def near_copies(docs, threshold=0.8):
    """ids that go: all but the smallest of each group of near copies."""
    rows = sorted(docs)
    sets = [word_shingles(t) for _, t in rows]
    roots = components(sets, lambda a, b: jaccard(a, b) >= threshold - 1e-9)
    return {d for (d, _), r in zip(rows, roots, strict=True) if rows[r][0] != d}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def edited(docs):
    """{doc_id: (n_chars, edited text, id of the next document)} with distinct ids."""
    rows = sorted(docs, reverse=True)
    out = {}
    for i, (d, text) in enumerate(rows):
        n, half = len(text), len(text) // 2
        after = rows[(i + 1) % len(rows)]
        out[d] = n, text[: n - half] + after[1][:half], after[0]
    return out


def mixed(docs):
    """{doc_id: (size, source_size, target, taken)} by the definition: reshare until no target is above its bound."""
    sizes = {d: len((t or "").encode().split()) for d, t, _ in docs}
    sources = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(sizes[d] for d, _, x in docs if x == s) for s in sources}
    weight = {s: 1 + i % 3 for i, s in enumerate(sources)}
    target, free, left = {}, set(sources), float(sum(total.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
            free.discard(s)
    out = {}
    for s in sources:
        budget, done = int(target[s] + 0.5), 0
        epochs, rest = divmod(budget, total[s]) if total[s] else (0, 0)
        key = lambda d: int(hashlib.md5(f"mix:{d}".encode()).hexdigest()[:15], 16)
        for d in sorted((d for d, _, x in docs if x == s), key=key):
            out[d] = sizes[d], total[s], target[s], epochs * sizes[d] + max(0, min(sizes[d], rest - done))
            done += sizes[d]
    return out


def pieces(text):
    """Pieces of a text for Order MinHash, by a walk over it."""
    white = " \t\n\x0b\x0c\r"
    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and (text[j] in white) == (text[i] in white):
            j += 1
        run = text[i:j]
        if text[i] in white:
            out += [run] if run != " " else []
        else:
            out += [run[a : a + 8] for a in range(max(1, len(run) - 7))]
        i = j
    return out


def _mix(*longs):
    h = 42
    for x in longs:
        h = xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), h)
    return h


def _mix_int(x, n):
    return xxhash.xxh64_intdigest(n.to_bytes(4, "little"), _mix(x))


def order_minhash(text, bins=64):
    """For each bin the two smallest elements over all rounds, in text order, hashed."""
    p = pieces(text)
    kmers = [p[i : i + 2] for i in range(max(1, len(p) - 1))] if p else []
    seen, found = defaultdict(int), []
    for at, kmer in enumerate(kmers):
        h = 42
        for piece in kmer:
            h = xxhash.xxh64_intdigest(piece.encode(), h)
        h = h >> 31 << 31
        n = seen[h]
        seen[h] += 1
        found.append(((_mix_int(h, n) if n else h) >> 31, at))
    n = len(found)
    out = []
    for b in [*range(bins // 2, bins), *range(bins // 2)]:
        if n <= 2:
            pair = sorted(found, key=lambda f: f[1])
        else:
            falls = [(0, e & (1 << 26) - 1, e, at) for e, at in found if e >> 27 == b]
            for r in range(1, math.ceil(bins * (math.log(n + 1) + 11.5) / (n - 1))):
                falls += [(r, h >> 31 & 0xFFFF, e, at) for e, at in found for h in [_mix_int(e, r)] if h >> 58 == b]
            first = {}
            for r, rank, e, at in falls:
                first[e, at] = min(first.get((e, at), (r, rank)), (r, rank))
            pair = sorted(sorted(first, key=lambda f: first[f])[:2], key=lambda f: f[1])
        if pair or n <= 2:
            out.append(_mix(b, *[e for e, _ in pair]))
    return out
