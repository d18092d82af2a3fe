"""Plain Python forms of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BY_SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
ALPHANUMERIC = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=BY_SPACE):
    return pattern.findall((text or "").encode().translate(LOWER))


def crc(number) -> int:
    return zlib.crc32(str(number).encode())


def shingles(text, k=5):
    w = words(text)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def smallest_reachable(ids, links):
    """The smallest id each id can reach."""
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def jaccard_components(rows, percent=80):
    """{id: (set size, component)} for rows of (id, text)."""
    sets = {i: shingles(t) for i, t in rows}
    ids = [i for i in sets if sets[i]]
    links = []
    for n, a in enumerate(ids):
        for b in ids[:n]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 100 * small < percent * large:
                continue
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (small + large - common):
                links.append((a, b))
    component = smallest_reachable(sets, links)
    return {i: (len(sets[i]), component[i]) for i in sets}


def contamination(docs, items, window=10):
    """{id: (words, hit words, sorted items)} for documents and items of (id, text)."""
    windows = []
    for item, text in items:
        w = words(text, ALPHANUMERIC)
        size = min(window, len(w))
        if w:
            windows += [(str(item), w[i : i + size]) for i in range(len(w) - size + 1)]
    out = {}
    for doc, text in docs:
        w = words(text, ALPHANUMERIC)
        hit, found = set(), set()
        for item, phrase in windows:
            for i in range(len(w) - len(phrase) + 1):
                if w[i] == phrase[0] and w[i : i + len(phrase)] == phrase:
                    hit |= set(range(i, i + len(phrase)))
                    found.add(item)
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def base_scores(rows):
    """{id: (tokens, known, all training tokens, base score)} for rows of (id, text, train)."""
    end = None
    tokens = {i: [*words(t), end] for i, t, _ in rows}
    counts = Counter(w for i, _, train in rows if train for w in tokens[i])
    total, distinct = sum(counts.values()), len(counts)
    return {
        i: (
            len(w), sum(counts[x] > 0 for x in w), total,
            sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w),
        )
        for i, w in tokens.items()
    }


def prefix_trie(rows, rebuilt=True):
    """The trie's rows for turns of (conversation, turn, role, text), as a set."""
    found = {}
    for c, turn, role, text in rows:
        if c is not None:
            found.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    found = {c: [t[2:] for t in sorted(turns)] for c, turns in found.items()}
    if rebuilt:
        heads = {c: crc(c) % 6 for c in found}
        found = {c: found.get(c - c % 100, [])[: heads[c]] + t[heads[c] :] for c, t in found.items()}
    nodes, children = {}, {}
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved, out = {}, {}, set()
    for k in sorted(nodes, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = sum(saved[x] for x in below) + ((len(nodes[k]) - 1) * len(k[-1][1]) if k else 0)
        ends = ",".join(str(c) for c in sorted(nodes[k]) if len(found[c]) == len(k))
        parent = min(nodes[k[:-1]]) if k else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.add((min(nodes[k]), len(k), parent, len(nodes[k]), len(below), leaves[k], saved[k], digest))
    return out


def whitened(rows, components=32):
    """{(id, component): (n, deviation, whitened, explained)} for rows of (id, vector)."""
    rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in rows], float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    z = centred @ vectors[:, :components] / np.sqrt(values[:components])
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    return {
        (i, k + 1): (n, int(deviation[r]), z[r, k], values[k] / values.sum())
        for r, (i, _) in enumerate(rows)
        for k in range(z.shape[1])
    }


def compare_whitened(got, expected):
    """Rows by (id, component) against ``whitened``; each component may have the other sign."""
    assert set(got) == set(expected)
    for k in {k for _, k in expected}:
        keys = sorted(key for key in expected if key[1] == k)
        a = np.array([got[key]["whitened"] for key in keys])
        b = np.array([expected[key][2] for key in keys])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
    for key, (n, deviation, _, explained) in expected.items():
        row = got[key]
        assert (row["n"], row["deviation"]) == (n, deviation) and row["identity_error"] < 1e-9
        assert abs(row["explained"] / explained - 1) < 1e-6
