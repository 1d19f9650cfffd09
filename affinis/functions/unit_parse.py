"""Reading of unit strings.

A unit string is segmented by dynamic programming over three tries (prefixes, roots, exponents) plus separators.
Every segmentation has a dimension, a factor and a cost; the cheapest one wins, where the prior of the field
(what a concentration or a half-life is usually measured in) decides between readings such as ``nm`` = nanometre or
nanomolar.  Only distinct strings are parsed: :func:`parse_unit` is memoised and pure.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

# SI prefixes and their powers of ten.
PREFIXES = {
    "f": -15, "p": -12, "n": -9, "u": -6, "µ": -6, "μ": -6, "m": -3, "c": -2, "k": 3,
    "femto": -15, "pico": -12, "nano": -9, "micro": -6, "milli": -3, "centi": -2, "kilo": 3,
}
# Roots with (dimension, factor to the base unit); a dimension counts mole, gram, litre, second, metre.
ROOTS = {
    "M": ((1, 0, -1, 0, 0), 1.0), "molar": ((1, 0, -1, 0, 0), 1.0),
    "mol": ((1, 0, 0, 0, 0), 1.0), "mole": ((1, 0, 0, 0, 0), 1.0), "moles": ((1, 0, 0, 0, 0), 1.0),
    "g": ((0, 1, 0, 0, 0), 1.0), "gram": ((0, 1, 0, 0, 0), 1.0), "grams": ((0, 1, 0, 0, 0), 1.0),
    "L": ((0, 0, 1, 0, 0), 1.0), "l": ((0, 0, 1, 0, 0), 1.0), "liter": ((0, 0, 1, 0, 0), 1.0), "litre": ((0, 0, 1, 0, 0), 1.0),
    "s": ((0, 0, 0, 1, 0), 1.0), "sec": ((0, 0, 0, 1, 0), 1.0), "secs": ((0, 0, 0, 1, 0), 1.0), "second": ((0, 0, 0, 1, 0), 1.0), "seconds": ((0, 0, 0, 1, 0), 1.0),
    "min": ((0, 0, 0, 1, 0), 60.0), "mins": ((0, 0, 0, 1, 0), 60.0), "minute": ((0, 0, 0, 1, 0), 60.0), "minutes": ((0, 0, 0, 1, 0), 60.0),
    "h": ((0, 0, 0, 1, 0), 3600.0), "hr": ((0, 0, 0, 1, 0), 3600.0), "hrs": ((0, 0, 0, 1, 0), 3600.0), "hour": ((0, 0, 0, 1, 0), 3600.0), "hours": ((0, 0, 0, 1, 0), 3600.0),
    "d": ((0, 0, 0, 1, 0), 86400.0), "day": ((0, 0, 0, 1, 0), 86400.0), "days": ((0, 0, 0, 1, 0), 86400.0),
    "week": ((0, 0, 0, 1, 0), 604800.0), "weeks": ((0, 0, 0, 1, 0), 604800.0),
    "m": ((0, 0, 0, 0, 1), 1.0), "meter": ((0, 0, 0, 0, 1), 1.0), "metre": ((0, 0, 0, 0, 1), 1.0),
}
# Spelled exponents after a root.
EXPONENTS = {f"{mark}{sign}{n}": (-n if sign in ("-", "−") else n) for mark in ("", "^", "**") for sign in ("-", "−", "+", "") for n in (1, 2, 3)}
SUPERSCRIPT = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")
MOLAR, MASS, TIME = (1, 0, -1, 0, 0), (0, 1, -1, 0, 0), (0, 0, 0, 1, 0)
#: Prior cost of a dimension by field; a dimension not named costs UNUSUAL and is then not a reading of the field.
FIELD_PRIOR = {"concentration": {MOLAR: 0.0, MASS: 0.5}, "time": {TIME: 0.0}}
UNUSUAL = 50.0
#: Costs: a letter read in the other case, a prefix, a root, an exponent.
CASE, PREFIX, ROOT, EXPONENT = 1.5, 0.6, 1.0, 0.2
_POWER = re.compile(r"^(?:1\s*[x×*]\s*)?10\s*(?:\^|\*\*|'|\s|e)?\s*([-−+]?\d{1,2})\s*[·.*x×]?\s*(?=[A-Za-zµμ])")


class Unit(NamedTuple):
    dimension: tuple[int, ...]
    factor: float
    cost: float


def _trie(words) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = w
    return root


_PREFIX_TRIE, _ROOT_TRIE, _EXPONENT_TRIE = _trie(PREFIXES), _trie(ROOTS), _trie(EXPONENTS)


def _walk(trie: dict, s: str, i: int, fold: bool):
    """(word, end, letters read in the other case) of each word of the trie that starts at i."""
    stack = [(trie, i, 0)]
    while stack:
        node, j, miss = stack.pop()
        if "" in node:
            yield node[""], j, miss
        if j < len(s):
            for ch in {s[j], s[j].swapcase()} if fold else {s[j]}:
                if len(ch) == 1 and ch in node:
                    stack.append((node[ch], j + 1, miss + (ch != s[j])))


@lru_cache(maxsize=65536)
def parse_unit(text: str, field: str) -> Unit | None:
    """The cheapest reading of a unit string in a field (``concentration`` or ``time``), or None if there is none.

    NULL is for the caller to handle; blank text, a bare number and unknown words give None.
    """
    s = text.strip().translate(SUPERSCRIPT).rstrip(".").strip("()[] ")
    power = 0
    if m := _POWER.match(s):
        power, s = int(m[1].replace("−", "-")), s[m.end() :]
    s = re.sub(r"\s+", " ", s)
    if not s:
        return None
    # best[i][(dimension, sign)] = (cost, log10 power, factor): the cheapest way to read s[:i]
    best: list[dict] = [{} for _ in range(len(s) + 1)]
    best[0][((0, 0, 0, 0, 0), 1, True)] = (0.0, 0, 1.0)
    for i in range(len(s)):
        for (dim, sign, fresh), (cost, ten, factor) in best[i].items():
            def put(j, key, value):
                if key not in best[j] or value[0] < best[j][key][0]:
                    best[j][key] = value
            ch = s[i]
            if ch in " .·*" and i:
                put(i + 1, (dim, sign, True), (cost + 0.1, ten, factor))
                continue
            if ch == "/" and i:
                put(i + 1, (dim, -1, True), (cost + 0.1, ten, factor))
                continue
            if s[i : i + 4].lower() == "per " and i:
                put(i + 4, (dim, -1, True), (cost + 0.1, ten, factor))
            if not fresh:
                continue
            starts = [("", i, 0), *_walk(_PREFIX_TRIE, s, i, True)]
            for prefix, j, miss_p in starts:
                for root, k, miss_r in _walk(_ROOT_TRIE, s, j, True):
                    unit, size = ROOTS[root]
                    for exponent, e, _ in [("", k, 0), *_walk(_EXPONENT_TRIE, s, k, False)]:
                        times = sign * (EXPONENTS[exponent] if exponent else 1)
                        if e < len(s) and s[e].isalnum():
                            continue
                        put(
                            e,
                            (tuple(a + times * b for a, b in zip(dim, unit)), sign, False),
                            (
                                cost + ROOT + (PREFIX if prefix else 0) + (EXPONENT if exponent else 0) + CASE * (miss_p + miss_r) / len(s[i:k]),
                                ten + times * (PREFIXES[prefix] if prefix else 0),
                                factor * size**times,
                            ),
                        )
    prior = FIELD_PRIOR[field]
    readings = [Unit(d, f * 10.0 ** (t + power), c + prior.get(d, UNUSUAL)) for (d, _, fresh), (c, t, f) in best[len(s)].items() if not fresh]
    found = min(readings, key=lambda u: u.cost, default=None)
    return found if found and found.cost < UNUSUAL else None
