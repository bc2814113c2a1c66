"""Plain versions of the operators, by definition, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from functools import cache

import numpy as np

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SIGNED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@cache
def tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def shingles(text: str | None, size: int) -> frozenset:
    w = SPACED.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def components(docs, size: int = 4):
    """doc_id to (size of the set, component)."""
    sets = {i: shingles(t, size) for i, t in docs}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    by = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            by[s].append(i)
    pairs = {(a, b) for group in by.values() for k, a in enumerate(group) for b in group[k + 1 :]}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def kept(docs, window: int = 50):
    """doc_id to (words, removed, kept text)."""
    words = {i: SPACED.findall(t or "") for i, t in docs}
    owner: dict = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            owner.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if owner[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def decontaminated(docs, items, window: int = 13):
    """doc_id to (words, hit, items)."""
    index = defaultdict(set)
    for i, t in items:
        w = SIGNED.findall((t or "").translate(FOLD))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            index[tuple(w[k : k + n])].add(i)
    out = {}
    for d, t in docs:
        w = SIGNED.findall((t or "").translate(FOLD))
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in index}:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in index:
                    found |= index[key]
                    hit[k : k + n] = [True] * n
        out[d] = (len(w), sum(hit), sorted(found))
    return out
