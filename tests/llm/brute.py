"""Plain single-machine versions of the contracts, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def luhn(number):
    total = 0
    for i, d in enumerate(map(int, reversed(number))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text):
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text or "") if ok(m.group())]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def removed(docs):
    """(doc_id, words, flags of removed words) by the 13-word rule."""
    first = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        w = words(t)
        for s in range(len(w) - 12):
            first.setdefault(tuple(w[s : s + 13]), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - 12):
            if first[tuple(w[s : s + 13])] < i:
                gone[s : s + 13] = [True] * 13
        out.append((i, w, gone))
    return out
