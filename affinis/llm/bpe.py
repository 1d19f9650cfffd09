"""Encoding of texts with a public byte-level BPE tokenizer."""

from __future__ import annotations

import heapq
import json
import os
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files lie, unless the caller names another place.
TOKENIZER_DIR = os.environ.get("AFFINIS_TOKENIZERS", "/opt/tokenizers")
#: Words kept with their ids between the batches of a partition; when full, the memory is emptied, never the work.
MEMO_WORDS = 400_000
# Fixed value: the published split pattern of this tokenizer family.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, others from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    for i, b in enumerate(b for b in range(256) if b not in set(printable)):
        letters[chr(256 + i)] = b
    return letters


@lru_cache(maxsize=2)
def load(path: str) -> tuple[np.ndarray, dict[tuple[int, int], tuple[int, int]]]:
    """(id of each byte, (left id, right id) -> (rank, merged id)) of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    byte_ids = np.zeros(256, np.int64)
    for letter, b in _byte_letters().items():
        byte_ids[b] = vocab[letter]
    merges = {}
    for rank, m in enumerate(model["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
    return byte_ids, merges


def encode_words(words: list[bytes], byte_ids: np.ndarray, merges: dict) -> list[list[int]]:
    """Ids of each word, all words at once.

    The words lie one after another as a linked list of symbols.  An index maps each mergeable pair to all its
    positions; ranks that occur are taken in ascending order, all places of the pair are merged from left to right, and
    the two pairs next to each place are taken out of and put into the index.  A merge only ever makes pairs of later
    rank, so every rank is met once.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8)
    ids = byte_ids[flat].tolist()
    n = len(ids)
    ends = np.cumsum(lengths)
    # next and previous symbol within the word; n stands for none
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    for e in ends.tolist():
        if e:
            after[e - 1] = n
            if e < n:
                before[e] = -1
    alive = bytearray(b"\x01") * n
    where: dict[int, set[int]] = defaultdict(set)
    pair_of: dict[int, tuple[int, int, int]] = {}

    def put(i: int, a: int, b: int) -> None:
        m = merges.get((a, b))
        if m is not None:
            rank = m[0]
            if rank not in pair_of:
                pair_of[rank] = (a, b, m[1])
                heapq.heappush(ranks, rank)
            where[rank].add(i)

    ranks: list[int] = []
    for i in range(n):
        if after[i] < n:
            put(i, ids[i], ids[after[i]])
    while ranks:
        rank = heapq.heappop(ranks)
        a, b, new = pair_of.pop(rank)
        for i in sorted(where.pop(rank)):
            if not alive[i] or ids[i] != a:
                continue
            j = after[i]
            if j >= n or ids[j] != b:
                continue
            left, right = before[i], after[j]
            if left >= 0:
                m = merges.get((ids[left], a))
                if m is not None and m[0] in where:
                    where[m[0]].discard(left)
                put(left, ids[left], new)
            if right < n:
                m = merges.get((b, ids[right]))
                if m is not None and m[0] in where:
                    where[m[0]].discard(j)
                put(i, new, ids[right])
                before[right] = i
            ids[i], after[i], alive[j] = new, right, 0
    out, i = [], 0
    for e, length in zip(ends.tolist(), lengths.tolist()):
        word, i = [], e - length
        while length and i < n:
            word.append(ids[i])
            i = after[i]
        out.append(word)
    return out


def encode(df: DataFrame, key: str, text: str, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``key`` and the token ids of ``text`` (array of integers), without special tokens.

    NULL and empty texts have the empty list; the names of special tokens inside a text are ordinary text; texts of any
    length are encoded whole.  Equal texts have equal ids, an empty table gives an empty table; other columns are left
    out, so clashing names do not matter.  ``path`` names the vocabulary file, which every worker must be able to read.
    No shuffle: distinct words are encoded once for each batch of a partition and remembered for the next.
    """
    file = path or os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json")
    field = df.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        byte_ids, merges = load(file)
        split = regex.compile(SPLIT)
        memo: dict[str, list[int]] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            words = [split.findall(t) if t else [] for t in texts]
            if len(memo) > MEMO_WORDS:
                memo.clear()
            new = list({w for doc in words for w in doc if w not in memo})
            if new:
                memo.update(zip(new, encode_words([w.encode("utf-8", "surrogatepass") for w in new], byte_ids, merges)))
            encoded = [[i for w in doc for i in memo[w]] for doc in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoded, pa.list_(pa.int32()))], names=[key, ids])

    schema = T.StructType([T.StructField(key, field.dataType), T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return df.select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
