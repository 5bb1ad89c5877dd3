"""Plain versions of what the operators compute, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def base_secrets(text):
    """(start, kind, end) of the three base patterns."""
    text = text or ""
    assign = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
    )
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def hits(docs, items, width=10):
    """Per document: number of words, which are hit, and items."""
    windows = defaultdict(set)
    for name, text in items:
        words = PLAIN.findall(low(text))
        for k in range(max(1, len(words) - width + 1)) if words else ():
            windows[tuple(words[k : k + width])].add(str(name))
    out = []
    for _, text in docs:
        words = PLAIN.findall(low(text))
        hit, names = [False] * len(words), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if own := windows.get(tuple(words[k : k + size])):
                    names |= own
                    hit[k : k + size] = [True] * size
        out.append((len(words), sum(hit), sorted(names)))
    return out


def kept(docs, width=20):
    """Per document, in order of ids: number of words, number removed, and the kept text."""
    seen, out = {}, []
    for doc, text in sorted(docs):
        words = SPACED.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - width + 1):
            if seen.setdefault(tuple(words[k : k + width]), (doc, k)) != (doc, k):
                gone[k : k + width] = [True] * width
        out.append((doc, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def linked(docs, width, percent):
    """Per document: set size and component."""
    sets, inverted, parent = {}, defaultdict(list), {}
    for doc, text in docs:
        words = SPACED.findall(low(text))
        sets[doc] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
        parent[doc] = doc
        for shingle in sets[doc]:
            inverted[shingle].append(doc)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for doc, own in sets.items():
        for other, n in Counter(o for s in own for o in inverted[s] if o > doc).items():
            if 100 * n >= percent * (len(own) + len(sets[other]) - n):
                a, b = sorted((root(doc), root(other)))
                parent[b] = a
    return {doc: (len(own), root(doc)) for doc, own in sets.items()}
