"""Plain Python forms of what the operators compute, for small inputs."""

from __future__ import annotations

import re
import unicodedata


def words(text, normalize=True):
    if text is None:
        return set()
    if normalize:
        kept = [c if c == "_" or unicodedata.category(c)[0] in "LN" else " " for c in text]
        text = "".join(kept).lower()
    return set(re.split(r"\s+", text)) - {""}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def token_set(a, b, normalize=True):
    wa, wb = words(a, normalize), words(b, normalize)
    if not wa or not wb:
        return 0.0
    common = wa & wb
    x, y = " ".join(sorted(wa - wb)), " ".join(sorted(wb - wa))
    s, e = len(" ".join(sorted(common))), 1 if common else 0
    if common and (not x or not y):
        return 100.0
    sa, sb = s + e + len(x), s + e + len(y)
    scores = [100 - 100 * (len(x) + len(y) - 2 * lcs(x, y)) / (sa + sb)]
    if common:
        scores += [100 - 100 * (e + len(x)) / (s + sa), 100 - 100 * (e + len(y)) / (s + sb)]
    return max(scores)


def flatten(value, sep="__", name=None):
    if isinstance(value, dict):
        items = value.items()
    elif isinstance(value, list):
        items = ((str(i), v) for i, v in enumerate(value))
    else:
        return [(name or "", value)]
    out = []
    for key, child in items:
        out += flatten(child, sep, key if name is None else f"{name}{sep}{key}")
    return out
