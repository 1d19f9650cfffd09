"""Personal information inside free text: found by a character tagger, given out in one form, replaced by placeholders."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.llm import char_tagger as tagger
from affinis.llm.pii_rules import KINDS, learnt_names, with_learnt_names
from affinis.llm.pii_sentences import mixed, refilled
from affinis.session import spread

#: Tag 0 is no information; kind k has the tags 2k+1 (first character) and 2k+2 (the rest).
N_TAGS = 2 * len(KINDS) + 1
#: Characters of a window and its step: the scores of a character come from the window in which it lies further inside.
WINDOW, STEP = 256, 192
#: Windows scored, and texts decoded, at once in a task, by characters.
BLOCK_CHARACTERS = 128 * 1024
LANGUAGES = ("en", "de", "fr", "es")
#: Copies of each labelled text of the sample with other pieces in the same places.
REFILLS = 3
WEIGHTS = Path(__file__).with_name("pii_weights.npz")


# ---------------------------------------------------------------------------------------------------- training


def _tagged(text: str, marks: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    gold = np.zeros(len(text), np.int64)
    for kind, a, b in marks:
        k = KINDS.index(kind)
        gold[a:b] = 2 * k + 2
        gold[a] = 2 * k + 1
    return tagger.symbols(text).astype(np.int64), gold


def training_windows(texts: list[str], invented: int, seed: int = 5) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Windows with their tags: from the sample as its labels say, from copies of it with other pieces, and from ``invented`` texts."""
    rng = random.Random(seed)
    given, family = learnt_names(texts)
    labels = [[(k, a, b) for k, a, b, _ in with_learnt_names(t, given, family)] for t in texts]
    plain = [t for t, marks in zip(texts, labels) if not marks and t.strip()]
    both = [(t, marks) for t, marks in zip(texts, labels) if marks]
    own = list(both)
    for _ in range(REFILLS):
        both += [refilled(rng, t, marks, rng.choice(LANGUAGES)) for t, marks in own]
    both += [(t, []) for t in plain[: 4 * len(own)]]
    both += [mixed(rng, plain, rng.choice(LANGUAGES)) for _ in range(invented)]
    windows, tags = [], []
    for text, marks in both:
        ids, gold = _tagged(text, marks)
        for a, b in _windows(len(text)):
            windows.append(ids[a:b])
            tags.append(gold[a:b])
    return windows, tags


def save(weights: dict[str, np.ndarray], path: Path = WEIGHTS) -> None:
    np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in weights.items()})


def load(path: Path = WEIGHTS) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


# ---------------------------------------------------------------------------------------------------- searching


def _windows(length: int) -> list[tuple[int, int]]:
    out = []
    for a in range(0, max(1, length - WINDOW + STEP), STEP):
        out.append((a, min(a + WINDOW, length)))
        if a + WINDOW >= length:
            break
    return out


def _batches(lengths: list[int]) -> Iterator[list[int]]:
    """Indices of jobs of like length, as many at a time as fit the block."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__)
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and (n + 1) * lengths[order[at + n]] <= BLOCK_CHARACTERS:
            n += 1
        yield order[at : at + n]
        at += n


def tag_texts(weights: dict, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of the tagged passages of each text.

    Windows of all texts are scored in blocks of like length; where windows of a text overlap, each gives the scores up
    to the middle of the overlap.  The best tags are then found over each text as a whole, so no passage is cut by a
    window.
    """
    ids = [tagger.symbols(t) for t in texts]
    jobs = [(i, a, b) for i, x in enumerate(ids) if len(x) for a, b in _windows(len(x))]
    scores = [np.empty((len(x), N_TAGS), np.float32) for x in ids]
    half = (WINDOW - STEP) // 2
    for part in _batches([b - a for _, a, b in jobs]):
        block, mask, _ = tagger.pad([ids[i][a:b] for i, a, b in map(jobs.__getitem__, part)])
        e, _ = tagger.emissions(weights, block, mask)
        for j, (i, a, b) in enumerate(map(jobs.__getitem__, part)):
            low, high = (0 if a == 0 else half), (b - a if b == len(ids[i]) else b - a - half)
            scores[i][a + low : a + high] = e[low:high, j]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    own = [i for i, x in enumerate(scores) if len(x)]
    for part in _batches([len(scores[i]) for i in own]):
        names = [own[j] for j in part]
        steps = max(len(scores[i]) for i in names)
        e, mask = np.zeros((steps, len(names), N_TAGS), np.float32), np.zeros((steps, len(names)), np.float32)
        for j, i in enumerate(names):
            e[: len(scores[i]), j], mask[: len(scores[i]), j] = scores[i], 1.0
        best = tagger.viterbi(weights, e, mask)
        for j, i in enumerate(names):
            out[i] = _spans(best[: len(scores[i]), j])
    return out


def _spans(tags: np.ndarray) -> list[tuple[str, int, int]]:
    spans: list[tuple[str, int, int]] = []
    for pos in np.flatnonzero(tags).tolist():
        kind = KINDS[(tags[pos] - 1) // 2]
        if spans and spans[-1][2] == pos and spans[-1][0] == kind and tags[pos] % 2 == 0:
            spans[-1] = (kind, spans[-1][1], pos + 1)
        else:
            spans.append((kind, pos, pos + 1))
    return spans


_TRIM = {"name": " \t\n\r,;:()<>\"“”–-", "email": " \t\n\r,;:<>()\"“”–.", "phone": " \t\n\r,;:.–-/", "id_number": " \t\n\r,;:.()–-/", "address": " \t\n\r,;:()–"}


def _found(kind: str, piece: str) -> str | None:
    """The form in which a piece is given out, or None if it cannot be of its kind."""
    if kind == "email":
        plain = re.sub(r"\s+dot\s+", ".", re.sub(r"\s*[\[(]\s*(?:dot|punto|point|punkt)\s*[\])]\s*", ".", piece.lower()))
        plain = re.sub(r"\s", "", re.sub(r"\s*[\[(]\s*(?:at|arroba)\s*[\])]\s*|\s+at\s+", "@", plain).removeprefix("mailto:"))
        return plain if re.fullmatch(r"[^@]+@[^@.]+(?:\.[^@.]+)+", plain) else None
    if kind == "phone":
        digits = re.sub(r"\D", "", piece)
        return digits if len(digits) >= 6 else None
    if kind == "id_number":
        form = re.sub(r"[^A-Z0-9]", "", piece.upper())
        return form if sum(map(str.isdigit, form)) >= 4 else None
    if kind == "address":
        return piece if re.search(r"\d", piece) and re.search(r"[^\W\d_]{2}", piece) else None
    return piece if re.search(r"[^\W\d_]{2}", piece) and len(piece.split()) > 1 and not re.search(r"\d", piece) else None


def checked(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, found) of the tagged passages.

    Kind and place are the tagger's; borders inside a word are moved to its ends, marks around the piece are left out,
    and what cannot be a piece of its kind (an address without a number, an email address without a host) is dropped.
    """
    out: list[tuple[str, int, int, str]] = []
    for kind, a, b in spans:
        while a > 0 and text[a - 1].isalnum() and text[a].isalnum():
            a -= 1
        while b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
            b += 1
        piece = text[a:b]
        a += len(piece) - len(piece.lstrip(_TRIM[kind]))
        b -= len(piece) - len(piece.rstrip(_TRIM[kind]))
        if kind == "phone" and text[a:b].count("(") != text[a:b].count(")"):
            # a bracket that belongs to the sentence, or one that was left outside
            if a and text[a - 1] == "(" and text[a:b].count(")") > text[a:b].count("("):
                a -= 1
            elif text[a:b].startswith("("):
                a += 1
        found = _found(kind, text[a:b]) if a < b else None
        if found and (not out or out[-1][2] <= a):
            out.append((kind, a, b, found))
    return out


def masked(text: str, pieces: list[tuple[str, int, int, str]]) -> str:
    """The text with each piece replaced by its kind in capitals, all else unchanged."""
    out, at = [], 0
    for kind, a, b, _ in pieces:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


_PIECES = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("found", T.StringType())]))


def find_pii(df: DataFrame, key: str, text: str, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """``key``, ``masked`` (the text with typed placeholders) and ``pieces`` (kind, start, end, found) of every text.

    Whole texts are scored in overlapping windows, decoded as a whole, and the pieces written in one form.  A NULL text stays NULL with no pieces, empty
    texts stay empty; a text of any length costs in proportion to it; repeated texts have the same pieces each; an
    empty table gives an empty table; other columns are left out.  Texts move only where there are fewer partitions than
    cores can use; the weights (a hundred kilobytes) are broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(weights or load())
    # keys travel as text: pandas would round large numbers in a batch with a NULL key
    schema = T.StructType([T.StructField("__key", T.StringType()), T.StructField("masked", T.StringType()), T.StructField("pieces", _PIECES)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in frames:
            for at in range(0, len(d), 2000):
                part = d.iloc[at : at + 2000]
                texts = [t if t is not None and t == t else None for t in part["__text"]]
                spans = tag_texts(shared.value, [t or "" for t in texts])
                pieces = [checked(t, s) if t else [] for t, s in zip(texts, spans)]
                yield pd.DataFrame({"__key": part["__key"].to_numpy(object), "masked": [None if t is None else masked(t, x) for t, x in zip(texts, pieces)], "pieces": pieces})

    slim = df.select(F.col(key).cast("string").alias("__key"), F.col(text).cast("string").alias("__text"))
    found = spread(slim, "__key", "__text").mapInPandas(run, schema)
    return found.select(F.col("__key").cast(df.schema[key].dataType).alias(key), "masked", "pieces")
