"""Brute-force answers for small fixtures: every pair of units in order, nothing clever."""

import hashlib
from difflib import SequenceMatcher


def sketch(tokens):
    if len(tokens) < 25:
        return frozenset()
    windows = (" ".join(tokens[i : i + 5]) for i in range(len(tokens) - 4))
    return frozenset(sorted(hashlib.md5(w.encode()).hexdigest() for w in windows)[:50])


def gated(sketches):
    """``(a, b, jaccard)`` of all unit pairs at or above the gate, ``a < b``."""
    keys = sorted(k for k in sketches if sketches[k])
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            j = len(sketches[a] & sketches[b]) / len(sketches[a] | sketches[b])
            if j >= 0.3:
                yield a, b, j


def best(scored_pairs):
    found = {}
    for a, b, score in sorted(scored_pairs, key=lambda p: (p[0], p[1])):
        for me, other in ((a, b), (b, a)):
            known = found.get(me, (0.0, None))
            if score > known[0] or (score == known[0] and score > 0 and other < known[1]):
                found[me] = (score, other)
    return found


def best_by_jaccard(sketches):
    return best(gated(sketches))


def best_by_ratio(sketches, sources, autojunk=True):
    return best((a, b, SequenceMatcher(None, sources[a], sources[b], autojunk).ratio()) for a, b, _ in gated(sketches))
