"""Evaluation texts leaking into training text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.llm.passage_match import best_passage, longest_common_subsequence, words
from affinis.session import cut_lineage, spread

#: Hashed vocabulary and latent dimensions: they fix the size of everything that is sent around.
VOCABULARY, LATENT = 4096, 96
#: Words of a passage and its step, in documents and in items.
TEXT_WINDOW, TEXT_STEP, ITEM_WINDOW, ITEM_STEP = 16, 6, 12, 3
#: Passages of this cosine or more in latent space go to the exact tests.
LEAST_COSINE = 0.65
#: What counts as a leak: so many words in a row, of which one in so many may be wrong.
LEAST_WORDS, WORDS_PER_EDIT = 12, 6
#: A paraphrase holds the answer and this share of the item's words in their order.
PARAPHRASE_SHARE = 0.6
#: Item words that one pass over the texts holds (tens of megabytes); a larger suite is searched in parts, one after another.
PART_WORDS = 500_000
#: Passages whose vectors are in memory at once, of a text and of the items.
BLOCK = 2048
#: Partitions of texts that one task of the decomposition sums up: each task sends a product of fixed size (3 MB).
PARTITIONS_A_TASK = 16
_SEED = 20_240_901


def _numbers(texts: pd.Series) -> list[np.ndarray]:
    """The words of each text as 64-bit numbers, the same in every process."""
    lists = [words(t) for t in texts]
    flat = np.array([w for ws in lists for w in ws], object)
    if not len(flat):
        return [np.zeros(0, np.int64) for _ in lists]
    code, unique = pd.factorize(flat)
    number = pd.util.hash_array(np.asarray(unique, object), categorize=False).view(np.int64)[code]
    return np.split(number, np.cumsum([len(ws) for ws in lists])[:-1])


def _passages(numbers: list[np.ndarray], window: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all word buckets in a row, text of each passage, its start and end in the row); both in growing order."""
    length = np.array([len(w) for w in numbers], np.int64)
    flat = np.concatenate(numbers) & (VOCABULARY - 1) if len(numbers) else np.zeros(0, np.int64)
    count = np.where(length > 0, 1 + np.maximum(-(-(length - window) // step), 0), 0)
    owner = np.repeat(np.arange(len(length)), count)
    at = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * step
    first = np.cumsum(length) - length
    return flat, owner, first[owner] + at, first[owner] + np.minimum(at + window, length[owner])


def _slices(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[slice, int, int]]:
    """Passages in blocks, with the words that each block covers: the memory of a block does not depend on its texts."""
    for i in range(0, len(start), BLOCK):
        s = slice(i, min(i + BLOCK, len(start)))
        yield s, int(start[s][0]), int(end[s][-1])


def _norms(b: np.ndarray, start: np.ndarray, end: np.ndarray, idf: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(idf[b] ** 2)]
    return np.sqrt(np.maximum(total[end] - total[start], 1e-24))


def _project(b: np.ndarray, start: np.ndarray, end: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """TF-IDF rows of unit length times the basis, by running sums over the words, without building the rows."""
    total = np.zeros((len(b) + 1, basis.shape[1]))
    np.cumsum((basis * idf[:, None])[b], axis=0, out=total[1:])
    return (total[end] - total[start]) / _norms(b, start, end, idf)[:, None]


def _back(b: np.ndarray, start: np.ndarray, end: np.ndarray, idf: np.ndarray, y: np.ndarray, out: np.ndarray) -> None:
    """Adds the transposed TF-IDF rows times y: every word gets the sum over the passages that cover it."""
    scaled = y / _norms(b, start, end, idf)[:, None]
    change = np.zeros((len(b) + 1, y.shape[1]))
    change[start] += scaled  # no two passages start, or end, at one word
    change[end] -= scaled
    word = np.cumsum(change, axis=0)[:-1]
    order = np.argsort(b, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(b[order]) > 0])
    own = b[order][cuts]
    out[own] += np.add.reduceat(word[order], cuts, axis=0) * idf[own, None]


def _normalised(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, w): the word numbers of every text that is not NULL; the key as text, as pandas would round large numbers beside a NULL."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in frames:
            yield pd.DataFrame({"key": d["key"], "w": _numbers(d["text"])})

    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("w", T.ArrayType(T.LongType()))])
    slim = df.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    return spread(slim, "key", "text").mapInPandas(run, schema)


def _inverse_frequency(words_df: DataFrame) -> np.ndarray:
    """idf of every bucket over all texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros(VOCABULARY + 1, np.int64)
        for d in frames:
            for w in d["w"]:
                count[np.unique(np.asarray(w) & (VOCABULARY - 1))] += 1
            count[VOCABULARY] += len(d)
        yield pd.DataFrame({"bucket": np.arange(VOCABULARY + 1, dtype=np.int32), "n": count})

    count = np.zeros(VOCABULARY + 1)
    for r in words_df.mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # VOCABULARY + 1 rows
        count[r["bucket"]] = r["n"]
    return np.log((max(count[VOCABULARY], 1.0) + 1) / (count[:VOCABULARY] + 1)) + 1.0


def latent_basis(texts: DataFrame, items: DataFrame, passes: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(idf, orthonormal basis VOCABULARY x LATENT): a randomised SVD of all TF-IDF passages of texts and items.

    Every pass multiplies the passages of all partitions with the current basis and back, in blocks; partial products
    of fixed size are added up by Spark.  Item passages are weighted to have as much mass as all texts together, else
    the few topics of a small suite would be lost among the texts.
    """
    spark = texts.sparkSession
    few = max(spark.sparkContext.defaultParallelism, -(-texts.rdd.getNumPartitions() // PARTITIONS_A_TASK))
    texts = texts.select("w").coalesce(few)
    idf = _inverse_frequency(texts)
    both = texts.withColumn("item", F.lit(False)).unionByName(items.select("w").withColumn("item", F.lit(True)))
    basis = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((VOCABULARY, LATENT)))[0]
    names = [f"c{i}" for i in range(LATENT)]
    schema = "item boolean, bucket int, n long, " + ", ".join(f"{c} double" for c in names)
    for _ in range(passes):
        shared = spark.sparkContext.broadcast((idf, basis))  # VOCABULARY x LATENT numbers, whatever the data

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            idf, basis = shared.value
            total, n = {}, {}
            for d in frames:
                for item, part in d.groupby("item"):
                    out = total.setdefault(item, np.zeros((VOCABULARY, LATENT)))
                    b, _, start, end = _passages([np.asarray(w) for w in part["w"]], *((ITEM_WINDOW, ITEM_STEP) if item else (TEXT_WINDOW, TEXT_STEP)))
                    n[item] = n.get(item, 0) + len(start)
                    for s, low, high in _slices(start, end):
                        w, a, z = b[low:high], start[s] - low, end[s] - low
                        _back(w, a, z, idf, _project(w, a, z, idf, basis), out)
            for item, out in total.items():
                at = np.flatnonzero(out.any(axis=1))
                f = pd.DataFrame(out[at], columns=names)
                f.insert(0, "n", np.r_[n[item], np.zeros(max(len(at) - 1, 0), np.int64)][: len(at)].astype(np.int64))
                f.insert(0, "bucket", at.astype(np.int32))
                f.insert(0, "item", bool(item))
                yield f

        summed = both.mapInPandas(run, schema).groupBy("item", "bucket").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).toPandas()  # 2 x VOCABULARY rows
        g = np.zeros((2, VOCABULARY, LATENT))
        g[summed["item"].to_numpy(int), summed["bucket"].to_numpy()] = summed[names].to_numpy()
        n = [max(int(summed["n"][summed["item"] == i].sum()), 1) for i in (False, True)]
        basis = np.linalg.qr(g[0] + g[1] * (n[0] / n[1]) + 1e-9 * basis)[0]
        shared.unpersist()
    return idf, basis


def _unit(y: np.ndarray) -> np.ndarray:
    return (y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(key, item_key, words, edits, lcs, cosine, answer, paraphrase) of every text that holds a passage of an item.

    A leak is a run of at least LEAST_WORDS consecutive words of the item in the text, at most one in WORDS_PER_EDIT of
    which is altered, missing or has a word slipped in; case, accents, punctuation and white space do not count.
    Candidates are passages near an item's passage in latent semantic space; around them the longest common subsequence
    and then the alignment of the best passage decide.  ``answer`` says whether the words that tell the item from all
    other items (names, numbers) all stand there.  A text without such a run is a ``paraphrase`` (words = 0) if it holds
    the answer and PARAPHRASE_SHARE of the item's words in their order.

    Whole texts are searched.  NULL, empty and blank texts hold nothing; repeated texts are found each; items of fewer
    than LEAST_WORDS words cannot leak; empty tables give no rows.  The items are a stated query set: all texts meet
    them in blocks of bounded size, and a suite of more than PART_WORDS words goes in parts, each in a pass of its own.
    """
    spark = docs.sparkSession
    schema = T.StructType(
        [T.StructField("key", T.StringType()), T.StructField("item_key", T.StringType())]
        + [T.StructField(c, T.IntegerType()) for c in ("words", "edits", "lcs")]
        + [T.StructField("cosine", T.FloatType()), T.StructField("answer", T.BooleanType()), T.StructField("paraphrase", T.BooleanType())]
    )
    texts = cut_lineage(_normalised(docs, key, text))
    suite = cut_lineage(_normalised(items.select(item_key, item_text).distinct(), item_key, item_text).filter(F.size("w") >= LEAST_WORDS))
    telling = suite.select("key", F.explode(F.array_distinct("w")).alias("x")).distinct().groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).filter("n = 1")
    suite = cut_lineage(suite.join(telling.groupBy("key").agg(F.collect_list("x").alias("own")), "key", "left"))  # an item's own words
    total = suite.agg(F.coalesce(F.sum(F.size("w")), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // PART_WORDS))
    idf, basis = latent_basis(texts, suite)
    shared = spark.sparkContext.broadcast((idf, basis))  # VOCABULARY x LATENT numbers

    def search(part: int) -> DataFrame:
        held = suite.filter(F.pmod(F.xxhash64("key", "w"), F.lit(parts)) == part).toPandas().sort_values("key")  # about PART_WORDS words
        none = np.zeros(0, np.int64)
        own = spark.sparkContext.broadcast((held["key"].tolist(), [np.asarray(w) for w in held["w"]], [none if o is None else np.asarray(o, np.int64) for o in held["own"]]))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            (keys, numbers, own_words), (idf, basis) = own.value, shared.value
            known = [_Item(w, o) for w, o in zip(numbers, own_words)]
            b, owner, start, end = _passages(numbers, ITEM_WINDOW, ITEM_STEP)
            z = [_unit(_project(b[low:high], start[s] - low, end[s] - low, idf, basis)) for s, low, high in _slices(start, end)]
            for d in frames:
                out = [] if z else None
                part_keys, body = d["key"].tolist(), [np.asarray(w) for w in d["w"]]
                for t, i, c, low, high in _near(body, idf, basis, z, owner) if z else ():
                    # a passage that meets the candidate reaches at most so far beyond it
                    reach = len(numbers[i]) + len(numbers[i]) // WORDS_PER_EDIT
                    found = _tested(known[i], body[t][max(low - reach, 0) : high + reach])
                    if found:
                        out.append((part_keys[t], keys[i], *found[:3], c, *found[3:]))
                if out:
                    yield pd.DataFrame(out, columns=[f.name for f in schema.fields])

        return texts.mapInPandas(run, schema)

    found = reduce(DataFrame.unionByName, [search(i) for i in range(parts)])
    back = [F.col("key").cast(docs.schema[key].dataType).alias(key), F.col("item_key").cast(items.schema[item_key].dataType).alias(item_key)]
    return found.select(*back, *schema.names[2:])


def _near(body: list[np.ndarray], idf: np.ndarray, basis: np.ndarray, z: list[np.ndarray], owner: np.ndarray) -> list[tuple[int, int, float, int, int]]:
    """(text, item, best cosine, first word, last word) where passages of a text come near passages of an item."""
    b, text_of, start, end = _passages(body, TEXT_WINDOW, TEXT_STEP)
    first = np.cumsum([0, *map(len, body)])
    near: dict[tuple[int, int], tuple[float, int, int]] = {}
    for s, low, high in _slices(start, end):
        y = _unit(_project(b[low:high], start[s] - low, end[s] - low, idf, basis))
        for k, part in enumerate(z):
            cosine = y @ part.T
            p, q = np.nonzero(cosine >= LEAST_COSINE)
            t = text_of[s][p]
            for ti, i, c, a, e in zip(t.tolist(), owner[k * BLOCK + q].tolist(), cosine[p, q].tolist(), (start[s][p] - first[t]).tolist(), (end[s][p] - first[t]).tolist()):
                was = near.get((ti, i), (0.0, a, e))
                near[ti, i] = max(c, was[0]), min(a, was[1]), max(e, was[2])
    return [(t, i, c, a, e) for (t, i), (c, a, e) in near.items()]


class _Item:
    """An item with the sets that tell quickly what a text can hold of it."""

    def __init__(self, words_: np.ndarray, own: np.ndarray):
        self.words, listed = words_, words_.tolist()
        self.known, self.pairs, self.own = frozenset(listed), frozenset(zip(listed, listed[1:])), frozenset(own.tolist())


def _tested(item: _Item, body: np.ndarray) -> tuple[int, int, int, bool, bool] | None:
    """(words, edits, lcs, answer, paraphrase) of an item in a stretch of text, or None."""
    least_common = LEAST_WORDS - LEAST_WORDS // WORDS_PER_EDIT
    listed, known = body.tolist(), item.known
    if sum(w in known for w in listed) < least_common:
        return None
    # an edit breaks two pairs of neighbours at most, so a passage keeps this many of them
    pairs = item.pairs
    whole = sum(p in pairs for p in zip(listed, listed[1:])) >= LEAST_WORDS - 1 - 2 * (LEAST_WORDS // WORDS_PER_EDIT)
    answer = item.own.issubset(listed)
    if not whole and not (answer and item.own):
        return None
    lcs = longest_common_subsequence(item.words, body)
    if lcs < least_common:
        return None
    n, edits = best_passage(item.words, body, LEAST_WORDS, WORDS_PER_EDIT) if whole else (0, 0)
    if n:
        return n, edits, lcs, answer, False
    return (0, 0, lcs, True, True) if item.own and answer and lcs >= PARAPHRASE_SHARE * len(item.words) else None
