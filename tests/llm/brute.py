"""Plain versions of what operators compute, for small tables."""

import hashlib


def windows(texts, window=35):
    """(words, removed words, digest of the kept) for each text, by a dictionary of all windows."""
    docs = [(t or "").encode().split() for t in texts]
    places: dict[tuple, int] = {}
    for d in docs:
        for i in range(len(d) - window + 1):
            places[tuple(d[i : i + window])] = places.get(tuple(d[i : i + window]), 0) + 1
    out = []
    for d in docs:
        gone = set()
        for i in range(len(d) - window + 1):
            if places[tuple(d[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(d) if i not in gone)
        out.append((len(d), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def thue_morse(n):
    """Two words of 2^n letters that sums of powers modulo 2^64 don't tell apart from n = 10 or so."""
    x, swap = "a", str.maketrans("ab", "ba")
    for _ in range(n):
        x += x.translate(swap)
    return x, x.translate(swap)
