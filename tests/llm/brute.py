"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def kept_words(docs, width=13):
    own, ws = {}, {}
    for i, t in docs:
        ws[i] = w = words(t)
        for k in range(len(w) - width + 1):
            own.setdefault(tuple(w[k : k + width]), []).append(i)
    own = {k: min(v) for k, v in own.items()}
    out = {}
    for i, w in ws.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if own[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def shingle_sets(docs, n=5):
    out = {}
    for i, t in docs:
        w = words(lower(t))
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    return out


def jaccard_components(docs, percent=75):
    sets = shingle_sets(docs)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def cosine_links(vectors, threshold=0.9):
    x = np.array(vectors, float)
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = n @ n.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(x))])
        if (new == label).all():
            return near.sum(axis=1), label
        label = new


def diagonal_overlaps(docs, items, masks_for, least=13, share=0.8, penalty=3, seeded=True):
    """Best (matching words, -words, -start, item start) of each document row and item id, over all diagonals one by one."""
    out = {}
    for row, (doc, text) in enumerate(docs):
        a = words(lower(text))
        for item, item_text in items:
            b = words(lower(item_text))
            best = None
            for shift in range(-len(b) + 1, len(a)) if a and b else []:
                same = [0 <= j + shift < len(a) and a[j + shift] == b[j] for j in range(len(b))]
                hit = any(0 <= j + shift and j + shift + len(m) <= len(a) and all(same[j + k] for k in range(len(m)) if m[k] == "1") for m in masks_for(len(b)) for j in range(len(b) - len(m) + 1))
                if seeded and not hit:
                    continue
                top, got = 0, None
                for i in range(len(b)):
                    score = 0
                    for j in range(i, len(b)):
                        score += 1 if same[j] else -penalty
                        if score > top or (score == top and got and j - i < got[1] - got[0] and j + 1 == got[1]):
                            top, got = score, (i, j + 1)
                if got is None:
                    continue
                i, j = got
                n = sum(same[i:j])
                if n >= max(1, min(least, -int(-share * len(b) // 1))):
                    cand = (n, i - j, -(i + shift), i)
                    best = cand if best is None or cand > best else best
            if best and (out.get((row, item)) is None or best > out[row, item]):
                out[row, item] = best
    return out
