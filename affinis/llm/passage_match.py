"""Words of a text in one form, and the exact test whether a text holds a passage of an item."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np

_JOINER = re.compile(r"['’ʼ‘`´­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")
#: Words of a text that are aligned at once; more where the item is long.
STRETCH = 8192
#: Numbers of one table of the alignment.
CELLS = 4_000_000
# Letters that decomposition leaves as they are.
_PLAIN = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ı": "i"})


def words(text: str | None) -> list[str]:
    """Words without case, accents and punctuation; apostrophes join, HTML entities and tags are read as in a browser."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = re.sub(r"</?[A-Za-z][^<>]*>", " ", text)
    t = unicodedata.normalize("NFKD", _JOINER.sub("", text).casefold())
    t = "".join(ch for ch in t if not unicodedata.combining(ch)).translate(_PLAIN)
    return _WORD.findall(t)


def longest_common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two arrays of word numbers."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        gain = np.where(b == x, row[:-1] + 1, 0)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], gain))
    return int(row[-1])


def best_passage(item: np.ndarray, text: np.ndarray, least: int = 12, per_edit: int = 6) -> tuple[int, int]:
    """(words, edits) of the longest passage of the item in the text with at most one edit in ``per_edit`` words.

    A passage is a run of at least ``least`` consecutive words of the item; words altered, missing or slipped in are
    edits.  (0, 0) if there is none.  A long text is aligned in stretches, which overlap by as many words as a passage
    can cover in the text, so that none is cut; numbers and memory then stay small for a text of any length.
    """
    n, m = len(item), len(text)
    if n < least or m < least - least // per_edit:
        return 0, 0
    cover = n + n // per_edit
    stretch = max(STRETCH, 4 * cover)
    found = [_best_in_stretch(item, text[at : at + stretch], least, per_edit) for at in range(0, max(m - cover, 1), stretch - cover)]
    return max(found, key=lambda f: (f[0], -f[1]))


def _best_in_stretch(item: np.ndarray, text: np.ndarray, least: int, per_edit: int) -> tuple[int, int]:
    """``best_passage`` of a short text.  Many starts of the passage are followed at once: for each, the fewest edits to
    match item[start:end] with any part of the text, for growing end.  Starts go in blocks of bounded memory, and a start
    is given up once its edits are more than the rest of the item allows.
    """
    n, m = len(item), len(text)
    kind = np.int16 if n + m + 1 < np.iinfo(np.int16).max else np.int32
    steps = np.arange(m + 1, dtype=kind)
    best = (0, 0)
    block = max(1, CELLS // (m + 1))
    for first in range(0, n - least + 1, block):
        starts = np.arange(first, min(first + block, n - least + 1))
        cost = np.zeros((len(starts), m + 1), kind)
        for length in range(1, n - first + 1):
            live = starts + length <= n
            if length % 4 == 0:
                live &= (cost.min(axis=1) * per_edit <= n - starts) & (n - starts > best[0])
            if not live.all():
                starts, cost = starts[live], cost[live]
            if not len(starts):
                break
            word = item[starts + length - 1]
            match = cost[:, :-1] + (text[None, :] != word[:, None])
            new = cost + 1
            np.minimum(new[:, 1:], match, out=new[:, 1:])
            # words slipped in: spread along the text
            new = np.minimum.accumulate(new - steps, axis=1) + steps
            cost = new.astype(kind)
            if length >= least:
                edits = cost.min(axis=1)
                i = int(edits.argmin())
                if edits[i] * per_edit <= length and (length > best[0] or length == best[0] and edits[i] < best[1]):
                    best = (length, int(edits[i]))
    return best
