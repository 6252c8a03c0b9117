"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tsfoundry.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words, ratio=10):
    out = {}
    for w, n in words.items():
        others = [(-words[x], x) for x in words if near(w, x)]
        best = min(others, default=None)
        form = best if best and -best[0] >= ratio * n else None
        out[w] = (form[1] if form else None, n, len(others), -form[0] if form else None)
    root = {}
    for w in words:
        at = w
        while out[at][0]:
            at = out[at][0]
        root[w] = at
    return {w: (f, root[w], n, k, m) for w, (f, n, k, m) in out.items()}


def edited(r, w, alphabet):
    k, i = r.randrange(3), r.randrange(len(w))
    return w[:i] + w[i + 1 :] if k == 0 else w[:i] + r.choice(alphabet) + w[i + (k == 1) :]


@pytest.mark.parametrize("alphabet", ["ab", "abcdé", "abcdefghijklmnopqrstuvwxyzàÿß字"])
def test_variants_equal_brute_force(spark, alphabet):
    r = random.Random(len(alphabet))
    words = {}
    for _ in range(120):
        w = "".join(r.choice(alphabet) for _ in range(r.randint(5, 14)))
        for _ in range(r.randint(1, 4)):
            words[w] = r.choice([1, 2, 9, 10, 11, 100, 1000, 1000, 100_000])
            w = edited(r, w, alphabet)
    words = {w: n for w, n in words.items() if len(w) >= 4}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)).collect()
    assert {x.word: tuple(x)[1:] for x in got} == plain(words) and len(got) == len(words)


def test_each_pair_is_found_once(spark):
    r = random.Random(3)
    words = {"".join(r.choice("ab") for _ in range(7)) for _ in range(90)} | {"".join(r.choice("ab") for _ in range(8)) for _ in range(90)}
    got = [frozenset((x.word, x.other)) for x in spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()]
    assert len(got) == len(set(got)) and set(got) == {frozenset((a, b)) for a in words for b in words if near(a, b)}


def test_words_of_documents(spark):
    r = random.Random(4)
    texts = ["Éclairés ÇAFÉSTOU programme PROGRAMME programmes, short wörter×zeichen", None, "", "x" * 200_000, "x" * 200_000 + " y" * 5, "program­mes a1programme"]
    rows = [(i, r.choice(texts), "clash", 1) for i in range(300)] + [(None, texts[0], "clash", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    count = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    want = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    words = spelling.noisy_words(df)
    assert {x.word: x.n for x in words.collect()} == want
    got = {x.word: tuple(x)[1:] for x in spelling.variants(words).collect()}
    assert got == plain(want)


def test_one_edit_is_the_plain_definition():
    r = random.Random(7)
    words = ["".join(r.choice("abé") for _ in range(r.randint(1, 5))) for _ in range(120)]
    assert all(spelling.one_edit(a, b) == near(a, b) for a in words for b in words)


def test_odd_tables(spark):
    df = spark.createDataFrame([("abcd", 1, 0), ("abcd", 1, 0), ("abc", 50, 0), (None, 3, 0), ("abce", None, 0), ("abcdé", 30, 0), ("", 9, 0)], "word string, n long, form int")
    got = {x.word: tuple(x)[1:] for x in spelling.variants(df).collect()}
    assert got == {"abcd": ("abcdé", "abcdé", 2, 1, 30), "abc": (None, "abc", 50, 0, None), "abcdé": (None, "abcdé", 30, 1, None), "": (None, "", 9, 0, None)}
    assert spelling.variants(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(df, ratio=1)
    long = [("a" * 100_000, 5), ("a" * 100_001, 70), ("a" * 50_000 + "b" + "a" * 50_000, 2)]
    got = {len(x.word): x.n_near for x in spelling.variants(spark.createDataFrame(long[:2], "word string, n long")).collect()}
    assert got == {100_000: 1, 100_001: 1}
    assert spelling.variants(spark.createDataFrame(long, "word string, n long")).agg(F.sum("n_near")).first()[0] == 6
