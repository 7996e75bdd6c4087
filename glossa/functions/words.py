"""The word rules of morph and relations for one word in plain Python: what kernels over Arrow batches ask once a
distinct word. Each function gives what the column expression of the same name gives."""

from __future__ import annotations

import re
from unicodedata import category

from glossa.functions.dims import COMPARATIVES, IDENTITY, IRREGULAR, POS_TAGS, SUPERLATIVES, TAG_SUFFIXES, TAGGER, coordinates

_PAST = {v: k for k, v in IRREGULAR.items()}
_IDENTITY = frozenset(IDENTITY)
_KNOWN = frozenset(coordinates())
_NUMBER = re.compile(r"[0-9]+([.,][0-9]+)*")
_SHORT = re.compile(r"[^aeiou]*[aeiou][bdgklmnprt]")
_HISS = ("s", "x", "z", "ch", "sh")
_ES = tuple(x + "es" for x in _HISS)
_TAG = {t: i for i, t in enumerate(POS_TAGS)}
_LISTED = {w: _TAG[t] for t, ws in reversed(TAGGER.items()) for w in ws.split()}
_ENDS = [(e, _TAG[t]) for t, ends in TAG_SUFFIXES.items() for e in ends]


def _single(w: str) -> str:
    return w[:-1] if len(w) > 1 and w[-1] == w[-2] and w[-1].isalpha() else w


def _y(w: str) -> str:
    return w[:-1] + "y" if w.endswith("i") else w


def analysed(word: str) -> tuple[str, int]:
    """Root and code."""
    w = word.lower()
    n = len(w)
    if not any(map(str.isalpha, w)) or w in _IDENTITY:
        return w, 0
    if w in _PAST:
        return _PAST[w], 12
    if n > 2 and w.startswith("un"):
        return w[2:], 9
    if n > 4 and w.endswith("ing"):
        return _single(w[:-3]), 3
    if n > 3 and w.endswith("ied"):
        return w[:-3] + "y", 2
    if n > 3 and w.endswith("ed"):
        return _single(w[:-2]), 2
    if n > 3 and w.endswith("ies"):
        return w[:-3] + "y", 1
    if w.endswith(_ES):
        return w[:-2], 1
    if n > 2 and w.endswith("s"):
        return w[:-1], 1
    if n > 3 and w.endswith("ly"):
        return _y(w[:-2]), 8
    if n > 4 and w.endswith("est"):
        return _y(_single(w[:-3])), 7
    if n > 3 and w.endswith("er"):
        return _y(_single(w[:-2])), 6
    return w, 0


def _sounds(c: str) -> bool:
    """A letter or a number."""
    return c.isalnum() if c.isascii() else category(c)[0] in "LN"


def bare(word: str) -> str:
    w = word.lower()
    a, b = 0, len(w)
    while a < b and not _sounds(w[a]):
        a += 1
    while b > a and not _sounds(w[b - 1]):
        b -= 1
    return w[a:b]


def tagged(word: str, w: str) -> tuple[int, int]:
    """Numbers of the tags at a sentence's start and elsewhere; w: the bare word."""
    if not w:
        return (_TAG["PUNCT"],) * 2
    if _NUMBER.fullmatch(w):
        return (_TAG["NUM"],) * 2
    t = _LISTED.get(w)
    if t is None:
        t = next((k for e, k in _ENDS if w.endswith(e) and len(w) >= len(e) + 2), None)
    if t is not None:
        return t, t
    first = next((c for c in word if _sounds(c)), "")
    return _TAG["NOUN"], _TAG["PROPN" if first and category(first) == "Lu" else "NOUN"]


def known_only(root: str) -> str:
    return root if _KNOWN.issuperset(root) else "".join(c for c in root if c in _KNOWN)


def inflected(root: str, tag: str) -> str:
    y = len(root) > 1 and root[-1] == "y" and root[-2] not in "aeiou"
    if tag in ("NNS", "VBZ"):
        return root[:-1] + "ies" if y else root + ("es" if root.endswith(_HISS) else "s")
    stem = root + root[-1:] if _SHORT.fullmatch(root) else root[:-1] if root.endswith("e") else root
    if tag == "VBG":
        return stem + "ing"
    return IRREGULAR.get(root) or (root[:-1] + "ied" if y else stem + "ed")


def applied(root: str, code: int) -> str:
    """The surface of a root under a morph code."""
    y, e, minus = root.endswith("y"), root.endswith("e"), root[:-1]
    if code == 12:
        return root if root in _IDENTITY else inflected(root, "VBD")
    if code == 9:
        return root if root.startswith("un") else "un" + root
    if code == 10:
        return root + ("r" if e else "er")
    if code == 11:
        return minus + "iness" if y else minus + "eness" if e else root + "ness"
    if code == 8:
        if root.endswith("ly"):
            return root
        return minus + "ily" if y and len(root) > 1 else root[:-2] + "ly" if root.endswith("le") and len(root) > 2 else root + "ly"
    if code in (6, 7):
        table, end = (COMPARATIVES, "er") if code == 6 else (SUPERLATIVES, "est")
        return table.get(root) or (minus + "i" + end if y and len(root) > 1 else root + end[e:])
    if code in (1, 5):
        return inflected(root, "NNS")
    if code in (2, 4):
        return inflected(root, "VBD")
    return inflected(root, "VBG") if code == 3 else root
