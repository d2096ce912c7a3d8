"""Plain-Python versions of the corpus operators, for small inputs."""

import hashlib
from collections import Counter

import regex
import xxhash


def covered(seqs, width):
    """Of each sequence, which symbols lie under a window that starts more than once."""
    seen = Counter(tuple(s[i : i + width]) for s in seqs for i in range(len(s) - width + 1))
    out = []
    for s in seqs:
        flags = [False] * len(s)
        for i in range(len(s) - width + 1):
            if seen[tuple(s[i : i + width])] > 1:
                flags[i : i + width] = [True] * width
        out.append(flags)
    return out


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, linked):
    """Smallest index reachable from each, over all pairs."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def sha(x):
    return hashlib.sha256(x).hexdigest()


def rule_statistics(text):
    text = text or ""
    words = regex.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            repeated.update(range(i, i + 8))
    n = len(words)
    return n, sum(map(len, words)), len(regex.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), n < 20 or 100 * len(repeated) > 30 * n
