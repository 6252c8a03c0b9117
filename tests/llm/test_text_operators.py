"""Language, tokens, quality and toxicity against brute force, round trips and held-out labels."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tsfoundry.llm import bpe, language, packing, quality, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, None, "en"), (2, "", "de"), (3, " \n\t ", None), (4, "a", None), (None, "null id", "x"), (4, "a", None), (5, "word " * 50_000, "en"), (6, "12 34 !!", "fr")]


@pytest.fixture()
def odd(spark):
    rows = [(i, t, lang, "clash", 0, "z") for i, t, lang in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id string, n int, rest string")


def empty(df):
    return df.where("false")


# --- BPE ------------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\xa0", "a", "aaaa", "The", " the", "'s", "'ll", "<|endoftext|>", "é", "漢", "🙂", "1", ".", "!!", "\ue000", "\x1c"]), max_size=14).map("".join), min_size=1, max_size=8))
def test_encoding_is_that_of_the_library(texts):
    voc, want = bpe.vocabulary(PATH), [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    for merge in (bpe.merge_words, bpe.merge_with_tiktoken):
        ids, off = bpe.encode_texts(pa.array(texts), voc, merge)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == want


def test_encode_and_decode_odd_rows(odd):
    tok = Tokenizer.from_file(PATH)
    got = sorted(((r.doc_id or 0), r.ids, r.text) for r in bpe.decode(bpe.encode(odd, PATH), PATH, keep=("ids",)).collect())
    want = sorted(((i or 0), tok.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, _ in ODD)
    assert got == want
    assert bpe.decode(bpe.encode(empty(odd), PATH), PATH).count() == 0


# --- Packing --------------------------------------------------------------------------------------
def test_pieces_and_places(odd):
    import zlib

    tok = Tokenizer.from_file(PATH)
    rows = packing.pack(packing.pieces(odd, PATH, capacity=64), capacity=64).collect()
    texts = [(i, t or "") for i, t, _ in ODD]
    want = Counter()
    for i, t in texts:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        cuts = list(range(len(ids), 0, -64))[::-1]
        for k, stop in enumerate(cuts):
            start = cuts[k - 1] if k else 0
            want[(i, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert len(by) <= -(-sum(r.length for r in rows) // 64) + 1
    assert packing.pack(packing.pieces(empty(odd), PATH)).count() == 0


@pytest.mark.parametrize("n", [1, 40, 3000, 40_000])
def test_sequences_are_near_the_lower_bound(n):
    lengths = np.minimum(np.exp(np.random.default_rng(n).normal(6.0, 1.0, n)).astype(int) + 1, 1024)
    counts = np.bincount(lengths, minlength=1025)
    used = packing.solve(counts, 1024)
    placed = np.zeros(1025, int)
    for config, times in used:
        assert sum(k * c for k, c in config) <= 1024
        for k, c in config:
            placed[k] += c * times
    assert (placed == counts).all()
    assert sum(t for _, t in used) <= 1.002 * lengths.sum() / 1024 + 2


# --- Language -------------------------------------------------------------------------------------
def samples(seed, n):
    """Texts of three made-up languages, one in another script, and mixed ones."""
    r = random.Random(seed)
    syllables = {"aa": ["ka", "lo", "mi", "tu", "the"], "bb": ["schn", "ör", "ung", "wer", "ich"], "cc": ["при", "вет", "как", "дел", "мир"]}
    word = lambda lang: "".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 3)))
    return [(i, " ".join(word(lang) for _ in range(r.randint(5, 60))), lang) for i in range(n) for lang in [r.choice(list(syllables))]], word


def test_language_on_held_out_texts_and_spans(spark, odd):
    rows, word = samples(1, 300)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df.where("doc_id % 4 <> 2"))
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    held = [x for x in rows if x[0] % 4 == 2]
    assert sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.97 * len(held)
    mixed = " ".join([word("aa") for _ in range(40)] + [word("bb") for _ in range(25)] + [word("cc") for _ in range(10)])
    one = language.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    assert [(s.lang, s.first_word, s.n_words) for s in one.spans] == [("aa", 0, 40), ("bb", 40, 25), ("cc", 65, 10)]
    out = language.identify(odd, model).collect()
    assert len(out) == len(ODD)
    assert {r.doc_id: r.lang_pred for r in out if r.doc_id in (1, 2, 3, 6)} == {1: "und", 2: "und", 3: "und", 6: "und"}
    assert all(0 <= r.score <= 1 for r in out)
    assert language.identify(empty(odd), model).count() == 0
    none = language.identify(odd, language.fit(empty(odd)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    kept = language.keep_known(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {4, 5, None}


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(0)
    for _ in range(30):
        lengths = r.integers(0, 7, 5)
        off = np.concatenate(([0], np.cumsum(lengths)))
        s = r.normal(0, 2, (off[-1], 3)).astype(np.float32)
        path = language.viterbi(s, off, 1.5)
        cost = lambda p, a: sum(s[a + i, x] for i, x in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:]))
        for a, b in zip(off[:-1], off[1:]):
            best = max(cost(p, a) for p in np.ndindex(*[3] * (b - a))) if b > a else 0
            assert abs(cost(path[a:b].tolist(), a) - best) < 1e-4


# --- Quality --------------------------------------------------------------------------------------
def plain_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            covered.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, odd):
    r = random.Random(3)
    texts = ["".join(r.choice(["a ", "b ", "ü ", "c#", "\n", "a b c d e f g h ", "  ", "|x "]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("xx"))
    got = {x.doc_id: x for x in quality.quality_rules(df, quality.references(df)).collect()}
    for i, t in enumerate(texts):
        x, want = got[i], plain_quality(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (x.base_failed and x.kept)
    assert quality.quality_rules(odd, {}).count() == len(ODD)
    assert quality.quality_rules(empty(odd), quality.references(empty(odd))).count() == 0


def test_distance_tells_shuffled_letters_from_language():
    reference = np.array([0.7, 0.2, 0.1])
    d = quality.js_distance(np.array([[70, 20, 10], [0, 0, 9], [0, 0, 0]]), reference)
    m = (reference + [0, 0, 1]) / 2
    kl = sum(a * np.log2(a / b) for a, b in zip(reference, m)) + np.log2(1 / m[2])
    assert d[0] < 1e-6 and abs(d[1] - np.sqrt(kl / 2)) < 1e-9 and d[2] == 1


# --- Toxicity -------------------------------------------------------------------------------------
def test_toxicity_on_held_out_rows(spark, odd):
    r = random.Random(5)
    common, bad = [f"word{i}" for i in range(300)], ["meanie", "rotter", "dolt"]
    rows = []
    for i in range(900):
        w = [r.choice(common) for _ in range(r.randint(10, 60))]
        toxic = int(r.random() < 0.3)
        for _ in range(r.randint(1, 3) * toxic):
            w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.where("doc_id % 5 <> 0").select("doc_id", "toxic"))
    got = {x.doc_id: x for x in toxicity.score(df, model).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if i % 5 == 0]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    out = toxicity.score(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in out)
    assert toxicity.score(empty(odd), model).count() == 0
    flat = toxicity.fit(df, df.where("toxic = 0").select("doc_id", "toxic"))
    assert {x.score for x in toxicity.score(odd, flat).collect()} == {0.0}
    assert toxicity.fit(empty(df), df.select("doc_id", "toxic")).trees is None


def test_lexicon_counts_rows_beyond_the_sample(spark, monkeypatch):
    r = random.Random(6)
    common = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 200)
    plain = [(i, int(r.random() < 0.3), [r.choice(common) for _ in range(20)]) for i in range(600)]
    order = [x.id for x in spark.createDataFrame([(i,) for i, _, _ in plain], "id long").orderBy(F.xxhash64("id"), "id").collect()]
    beyond = set(order[200:])
    rows = [(i, " ".join(w + ["meanie"] * toxic + ["rotter"] * (toxic and i in beyond)), toxic) for i, toxic, w in plain]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert {"meanie", "rotter"} <= set(toxicity.fit(df, df.select("doc_id", "toxic")).lexicon)


def test_digests_of_the_codec_query(spark, tmp_path):
    rows = [(i, t) for i, t, _ in ODD if i is not None]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tok = Tokenizer.from_file(PATH)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted(map(tuple, bpe.query(spark, str(tmp_path)).collect()))
    ids = [(i, t or "", tok.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    assert got == sorted((i, len(x), sha(",".join(map(str, x))), sha(t)) for i, t, x in ids)


def test_text_without_common_words_is_rejected(spark):
    """Usual letters and marks, no common word: the word rule alone can tell it from a language."""
    r = random.Random(8)
    common = [f"{a}{b}" for a in "tos" for b in "heanri"]
    rare = lambda: "".join(r.choice("bcdflmnprstaeiou") for _ in range(r.randint(4, 9)))
    text = lambda n, share: " ".join((r.choice(common) if r.random() < share else rare()) + ("." if i % 12 == 11 else "") for i in range(n)).capitalize()
    docs = spark.createDataFrame([(i, text(r.randint(60, 400), 0.4), "en") for i in range(150)], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(i, text(n, 0.0), None) for i, n in enumerate([60, 80, 150, 400, 3000])], "doc_id long, text string, lang string")
    refs = quality.references(docs)
    assert [x.kept for x in quality.quality_rules(odd, refs).collect()] == [False] * 5
    assert all(x.kept for x in quality.quality_rules(docs, refs).collect())
    bare = quality.no_common_words(refs["en"][1])
    assert all(abs(x.word_distance - bare) < 1e-9 for x in quality.quality_rules(odd, refs).collect())
