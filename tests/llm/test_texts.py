import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from affinis.llm import bpe, char_tagger, leaks, pii
from affinis.llm.passage_match import best_passage, longest_common_subsequence, words
from affinis.llm.pii_rules import labelled, learnt_names, with_learnt_names

VOCABULARY = Path(bpe.TOKENIZER_DIR) / "byte_bpe_50k.json"


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no tokenizer files here")
class TestEncoding:
    texts = ["", None, "Hello  world's 12345 \n\t ends ", "äöü ß 中文 😀 á", "<|endoftext|> is text", "a" * 3000, " " * 40, "\x00\x01", "same", "same"]

    def test_against_the_library(self, spark, data):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(str(VOCABULARY))
        t.encode_special_tokens = True
        rng = random.Random(0)
        docs = [d for d in pd.read_parquet(f"{data}/documents.parquet").text if isinstance(d, str)]
        more = ["".join(rng.choice("ab '\né中1  Z.") for _ in range(rng.randint(0, 50))) for _ in range(300)]
        rows = list(enumerate([*self.texts, *docs, *more]))
        df = spark.createDataFrame([(i, x, "clash") for i, x in rows], "doc_id long, text string, ids string").repartition(3)
        got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(df, "doc_id", "text").collect()}
        assert len(got) == len(rows)
        for i, x in rows:
            assert got[i] == (t.encode(x, add_special_tokens=False).ids if x else [])

    def test_nothing(self, spark):
        assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_words():
    assert words("L'Hélice_EXTERNE &amp; déjà—vu <br/>naïve s&auml;mple") == ["lhelice", "externe", "deja", "vu", "naive", "sample"]
    assert words(None) == words("") == words(" .,; ") == []


def slow_best(item, text, least=12, per=6):
    best = 0
    for a in range(len(item)):
        row = [0] * (len(text) + 1)
        for b in range(a, len(item)):
            new = [row[0] + 1]
            for j, w in enumerate(text, 1):
                new.append(min(row[j - 1] + (w != item[b]), row[j] + 1, new[-1] + 1))
            row = new
            n = b - a + 1
            if n >= least and min(row) * per <= n:
                best = max(best, n)
    return best


def test_passage_against_loops():
    rng = random.Random(1)
    for _ in range(60):
        item = [rng.randrange(30) for _ in range(rng.randint(8, 22))]
        text = [rng.randrange(30) for _ in range(5)] + item[rng.randrange(4) : rng.randint(10, 22)] + [rng.randrange(30) for _ in range(5)]
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = [rng.randrange(30)] * rng.randint(0, 1)
        got = best_passage(np.array(item), np.array(text, int))[0]
        assert got == slow_best(item, text)


@pytest.mark.parametrize("n_words", [33_000, 40_000, 70_000])
def test_passage_in_long_texts(n_words):
    item, text = np.arange(15), np.random.default_rng(n_words).integers(100, 5000, n_words)
    assert best_passage(item, text) == (0, 0)
    for at in (0, 8181, 8192, 16_380, n_words // 2, n_words - 15):
        leak = text.copy()
        leak[at : at + 15] = item
        assert best_passage(item, leak) == (15, 0)
    leak = text.copy()
    leak[-15:] = item
    leak[-5] = 99
    assert best_passage(item, leak) == (15, 1)


def test_passage_of_a_long_item():
    item = np.arange(40_000)
    assert best_passage(item[:33_000], item[20_000:20_040] + 0, 32_990) == (0, 0)
    text = np.r_[np.full(33_000, -1), item[:20]]
    assert best_passage(item[:20], text) == (20, 0)


def test_common_subsequence():
    assert longest_common_subsequence(np.array([1, 2, 3, 4]), np.array([2, 9, 4])) == 2
    assert longest_common_subsequence(np.array([1]), np.array([], int)) == 0


ITEM = "The hollow capsid softly mirrors the rim of the warm vessel while the lamp stays dark and cold 53"


def leak_rows(spark, docs, items=((1, ITEM), (2, "too short an item"), (3, None))):
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, key string")
    b = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(d, "doc_id", "text", b, "item_id", "text").collect()}


def test_leaks(spark):
    other = "A weak inhibitor shifts the binding curve after two hours. "
    w = ITEM.split()
    docs = [
        (1, other + ITEM), (2, other + " ".join(w[2:15]).upper()), (3, other + " ".join(w[:8])), (4, None), (5, ""), (6, "   "), (7, other * 400 + "capsíd softly-mirrors, the RIM of the wrong vessel while the; lamp stays dark and"),
        (8, other), (9, other + ITEM), (10, " ".join(w[i] if i % 3 else "zzz" for i in range(len(w)))),
    ]
    assert leak_rows(spark, docs) == {(1, 1), (2, 1), (7, 1), (9, 1)}


def test_paraphrases(spark):
    """Without a run of twelve words, but with the words that only this item has, and most others in their order."""
    w = ITEM.split()
    near = " ".join(x for i, x in enumerate(w) if i not in (1, 2, 5, 10, 14))
    d = spark.createDataFrame([(1, near), (2, " ".join(w[:8])), (3, ITEM)], "doc_id long, text string")
    other = "Every cold lamp near the vessel stays dark while some other capsid slowly leaves the warm rim of the place"
    b = spark.createDataFrame([(1, "The hollow capsid softly mirrors the rim of the warm vessel while the lamp stays dark and cold 53"), (2, other)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in leaks.find_leaks(d, "doc_id", "text", b, "item_id", "text").collect()}
    assert not got[3, 1]["paraphrase"] and got[3, 1]["words"] == len(w)
    assert all(r["words"] == 0 and r["answer"] for r in got.values() if r["paraphrase"])
    assert (2, 1) not in got


def test_suite_in_parts(spark, monkeypatch):
    """A suite larger than one pass holds gives the same rows in parts."""
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(20))) for i in range(40)]
    docs = [(i, "before it " + t + " after it") for i, t in items[::3]] + [(99, "nothing of it")]
    whole = leak_rows(spark, docs, items)
    assert whole == {(i, i) for i, _ in items[::3]}
    monkeypatch.setattr(leaks, "PART_WORDS", 250)
    assert leak_rows(spark, docs, items) == whole


def test_long_text_and_item(spark):
    rng = np.random.default_rng(3)
    long = " ".join(f"n{x}" for x in rng.integers(0, 4000, 60_000))
    assert leak_rows(spark, [(1, long + " " + ITEM), (2, long)]) == {(1, 1)}


def test_leaks_of_nothing(spark):
    assert leak_rows(spark, []) == set()
    assert leak_rows(spark, [(1, ITEM)], [(3, None)]) == set()


def test_leaks_against_brute_force(spark, data):
    docs, items = pd.read_parquet(f"{data}/documents.parquet"), pd.read_parquet(f"{data}/benchmark.parquet")
    number: dict = {}
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in words(t)], np.int64)
    bank = [(i, code(t)) for i, t in zip(items.item_id, items.text)]
    want = set()
    for d, t in zip(docs.doc_id, docs.text):
        x = code(t) if isinstance(t, str) else np.zeros(0, np.int64)
        want |= {(d, i) for i, w in bank if np.isin(w, x).sum() >= 10 and best_passage(w, x)[0]}
    from affinis.llm.queries import p9_found

    assert {tuple(r) for r in p9_found(spark, data).collect()} == want


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in char_tagger.initial(3, 3).items()}
    windows, tags = [rng.integers(1, char_tagger.SYMBOLS, n) for n in (5, 3)], [rng.integers(0, 3, n) for n in (5, 3)]
    ids, mask, gold = char_tagger.pad(windows, tags)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    _, g = char_tagger._gradients(p, ids, mask, gold)
    for name in p:
        flat = np.flatnonzero(np.abs(g[name]) > 1e-2)[:4]
        for at in flat:
            step = 1e-2
            old = p[name].flat[at]
            p[name].flat[at] = old + step
            up = char_tagger._gradients(p, ids, mask, gold)[0]
            p[name].flat[at] = old - step
            down = char_tagger._gradients(p, ids, mask, gold)[0]
            p[name].flat[at] = old
            assert abs((up - down) / (2 * step) - g[name].flat[at]) < 0.05 * max(1, abs(g[name].flat[at]))


def test_training_learns():
    rng = random.Random(1)
    texts = [f"{rng.choice(['we saw', 'then', 'call'])} {rng.randint(10, 99)} by Tel. +44 {rng.randint(1000, 9999)} {rng.randint(100, 999)} {rng.randint(100, 999)} today" for _ in range(200)]
    weights = char_tagger.train(*pii.training_windows(texts, 0), pii.N_TAGS, hidden=8, epochs=6)
    spans = pii.tag_texts(weights, texts[:20])
    assert sum(any(k == "phone" for k, *_ in s) for s in spans) >= 18


PIECES = [
    ("Contact ISMAR.HAVERLING@MAIL.TARNHOLM.TEST today.", ("email", "ismar.haverling@mail.tarnholm.test")),
    ("write to wexcomb dot perrin at assay dot example dot net!", ("email", "wexcomb.perrin@assay.example.net")),
    ("E-Mail: nfarrowin(at)labs(dot)example(dot)org. Ein", ("email", "nfarrowin@labs.example.org")),
    ("Tel. +49 (0)30 23125-921 after noon", ("phone", "4903023125921")),
    ("n° de sécurité sociale 9 52 13 99 561 055", ("id_number", "9521399561055")),
    ("National ID: 9866C-72357.", ("id_number", "9866C72357")),
    ("Send it to 203B Dunmere Street, Tarnholm ZZ2 9QX.", ("address", "203B Dunmere Street")),
    ("Wohnt: Maplenweg 169a, 00984 Morvick.", ("address", "Maplenweg 169a")),
    ("My name is Ms R. O'Trellan.", ("name", "R. O'Trellan")),
    ("Signed: Zellwig, Corvin.", ("name", "Zellwig, Corvin")),
]


@pytest.mark.parametrize("text, want", PIECES)
def test_written_forms(text, want):
    assert [(k, f) for k, _, _, f in labelled(text)] == [want]


@pytest.mark.parametrize("text", ["Lot 4856-30-380", "Batch 011 548 225.", "2017-01-14.", "IC50@25C", "v2.31@main", "Ref. 2015/602-5", "@plate20", "10.99999/tarn.3637.22", "", "Harbin Street is long"])
def test_no_information(text):
    assert labelled(text) == []


def test_find_pii(spark):
    filler = "The control series slows the smell of the mixture in both laboratories. "
    rows = [(i, filler + t, "clash") for i, (t, _) in enumerate(PIECES)] + [(100, None, ""), (101, "", ""), (102, filler * 300 + PIECES[3][0], ""), (103, filler, "")]
    rows += [(104, filler, ""), (105, filler + PIECES[8][0], "")]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, masked string"), "doc_id", "text").collect()}
    assert len(got) == len(rows)
    for i, (t, (kind, found)) in enumerate(PIECES):
        assert [(p["kind"], p["found"]) for p in got[i]["pieces"]] == [(kind, found)], t
        assert f"[{kind.upper()}]" in got[i]["masked"] and got[i]["masked"].startswith(filler)
    assert got[100]["masked"] is None and got[100]["pieces"] == [] and got[101]["masked"] == ""
    assert len(got[102]["pieces"]) == 1 and got[103]["masked"] == got[104]["masked"] == filler
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_held_out_recall(data):
    """Pieces beyond doubt in texts the tagger was not trained on come out; names beside them are those of sure ones."""
    texts = [t for t in pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text if isinstance(t, str)]
    spans = pii.tag_texts(pii.load(), texts)
    labels = [with_learnt_names(t, *learnt_names(texts)) for t in texts]
    want = sum(map(len, labels))
    got = [pii.checked(t, s) for t, s in zip(texts, spans)]
    hit = sum(len(set(w) & set(g)) for w, g in zip(labels, got))
    assert hit >= 0.95 * want and sum(map(len, got)) <= 1.05 * want
