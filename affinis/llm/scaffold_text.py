"""Scaffold strings in one writing, and their atoms."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\[[^\]]*\]|Br|Cl|%\d\d|.", re.S)
_STEREO = str.maketrans("", "", "@/\\")
_BARE = re.compile(r"^\[(?:\d+)?([BCNOPSFI]|Br|Cl|[bcnops])(H\d?)?\]$")
_ATOM = re.compile(r"^(?:\[|Br$|Cl$|[A-Za-z*]$)")
#: A carbon six-ring with alternating double bonds, in both ways of writing it; 'd' stands for its ring number.
_KEKULE = (["C", "d", "=", "C", "C", "=", "C", "C", "=", "C", "d"], ["C", "=", "d", "C", "C", "=", "C", "C", "=", "C", "C", "d"])
_AROMATIC = ["c", "d", "c", "c", "c", "c", "c", "d"]


def _components(text: str) -> list[str]:
    return [p for p in text.split(".") if p]


def _ring(token: str) -> bool:
    return token.isdigit() or token[0] == "%"


def _kekule_rings(tokens: list[str]) -> list[str]:
    """Replaces Kekulé benzene rings by aromatic ones where the ring is written in one stretch."""
    out, i = [], 0
    while i < len(tokens):
        for form in _KEKULE:
            part = tokens[i : i + len(form)]
            if len(part) == len(form):
                digits = {p for p, f in zip(part, form) if f == "d"}
                if len(digits) == 1 and _ring(next(iter(digits))) and all(f == "d" or p == f for p, f in zip(part, form)):
                    d = next(iter(digits))
                    out += [d if f == "d" else f for f in _AROMATIC]
                    i += len(form)
                    break
        else:
            out.append(tokens[i])
            i += 1
    return out


def canonical_tokens(text: str | None) -> list[str]:
    """Tokens of the largest component without stereo marks, with ring numbers in order of use; [] for nothing.

    White space is dropped, bracket atoms that only carried stereo marks lose their brackets, counter-ions and
    solvents (all but the component of most atoms) are left out, Kekulé benzene becomes aromatic.
    """
    if text is None:
        return []
    s = "".join(text.split()).translate(_STEREO)
    parts = _components(s)
    if not parts:
        return []
    best = max((_TOKEN.findall(p) for p in parts), key=lambda t: sum(map(bool, map(_ATOM.match, t))))
    tokens = []
    for t in best:
        m = _BARE.match(t)
        # only carbon may lose its hydrogens: [nH] says something about the ring
        tokens.append(m[1] if m and (not m[2] or m[1] == "C") else t)
    tokens = _kekule_rings(tokens)
    free, used, out = list(range(99, 0, -1)), {}, []
    for t in tokens:
        if _ring(t):
            if t in used:
                n = used.pop(t)
                free.append(n)
                free.sort(reverse=True)
            else:
                n = free.pop() if free else 99
                used[t] = n
            out.append(str(n))
        else:
            out.append(t)
    return out


def atoms(tokens: list[str]) -> list[str]:
    """The atoms of a token list, without bonds, branches and ring numbers."""
    return [t for t in tokens if _ATOM.match(t)]


_BOND = set("=#$:-")


def elements(tokens: list[str]) -> tuple[list[str], list[str]]:
    """(elements and ring numbers in their order, ring numbers): an element is an atom with the bond before it.

    Branches are left out: an atom that hangs on another place was moved, which is a change of atoms like any other.
    """
    body, rings, bond = [], [], ""
    for t in tokens:
        if t in _BOND:
            bond = t
        elif _ATOM.match(t):
            body.append(bond + t)
            bond = ""
        elif _ring(t):
            body.append(f"{bond}@{t}")  # no atom has this mark
            rings.append(body[-1])
            bond = ""
    return body, rings
