"""Plain Python statements of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(len(w) - size + 1, 1)))


def near_groups(rows, size, percent=80):
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def without_repeats(rows, width=50):
    """[(doc_id, n_bytes, n_removed, n_spans, sha256)] from [(doc_id, text)]."""
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        if i is not None:
            for p in range(len(b) - width + 1):
                k = b[p:p + width]
                first[k] = min(first.get(k, i), i)
    out = []
    for i, b in data:
        gone = [False] * len(b)
        if i is not None:
            for p in range(len(b) - width + 1):
                if first[b[p:p + width]] < i:
                    gone[p:p + width] = [True] * width
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def base_spans(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def unigram(text, pieces, unknown):
    """(best score, pieces) by trying every segmentation place by place, longest first on ties;
    an unknown character is one piece of its own here."""
    best = [(0.0, 0)] + [None] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(e):
            piece = text[s:e]
            score = pieces.get(piece)
            if score is None:
                if e - s > 1:
                    continue
                score = unknown
            total = best[s][0] + score
            if best[e] is None or total > best[e][0]:
                best[e] = (total, best[s][1] + 1)
    return best[-1]


def merkle(rows):
    """Sorted op11 rows from [(doc_id, source, lang, n_chars, text)], by whole re-hashing."""
    import zlib

    def H(parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(values):
        return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def climb(tree, i, own):
        siblings = []
        for nodes in tree[:-1]:
            a = i - i % 8
            run = nodes[a:a + 8]
            siblings += run[:i - a] + run[i - a + 1:]
            own, i = H(run[:i - a] + [own] + run[i - a + 1:]), i // 8
        return own, siblings

    first = lambda v: (v is not None, v or 0)
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((first(r[0]), leaf(r), r))
    langs = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    made = {v: levels([x[1] for x in sorted(trees[v], key=lambda x: x[:2])]) for v in langs}
    over = levels([made[v][-1][0] for v in langs])
    out = []
    for place, v in enumerate(langs):
        for i, (_, digest, r) in enumerate(sorted(trees[v], key=lambda x: x[:2])):
            doc_id, text = r[0], r[4]
            changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None
            probe = leaf((*r[:4], text.translate(LOWER))) if changed else digest
            sub, low = climb(made[v], i, digest)
            root, high = climb(over, place, sub)
            assert root == over[-1][0] and sub == made[v][-1][0]
            folded = climb(over, place, climb(made[v], i, probe)[0])[0]
            out.append((doc_id, digest, sub, root, H(low + high), folded, folded == root))
    return sorted(out, key=repr)


def divergence(rows, min_docs=3, top=200):
    """Sorted op13 rows from [(lang, source, text)], in Python's whole numbers."""
    from collections import Counter

    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    count, docs, groups = {}, {}, {}
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = Counter(term.findall((text or "").translate(LOWER)))
        count.setdefault((lang, source), Counter()).update(words)
        docs.setdefault(lang, Counter()).update(words.keys())
        groups.setdefault(lang, set()).add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        whole = sum((count[lang, s] for s in sources), Counter())

        def shares(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // total for t in kept}

        p, q = {s: shares(count[lang, s]) for s in sources}, shares(whole)
        cost = lambda x, y: (x - y) * (x - y) // y
        for s in sources:
            pairs = [(-sum(cost(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-cost(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)
