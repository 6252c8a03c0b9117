"""Duplicates, near duplicates, repeated strings, URL verdicts and the pipeline against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tsfoundry.llm import exact_dedup, near_dedup, suffix_dedup, suffixes, url_filter

ODD = [(1, None), (2, ""), (3, " \n "), (4, "a  b"), (5, "a b"), (None, "a\tb"), (4, "a  b"), (6, "long " * 40_000), (7, "long " * 40_000)]


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in ODD], "doc_id long, text string, id string, part string, n int")


# --- Exact ----------------------------------------------------------------------------------------
def test_exact_groups(spark, odd, monkeypatch):
    r = random.Random(1)
    texts = ["one", "two  three", "two three", "", None, "one "]
    rows = [(i, r.choice(texts) if r.random() < 0.7 else f"text {r.randint(0, 40)}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = {i: (min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows}
    for limit in (1000, 10):  # with and without groups in several parts
        monkeypatch.setattr(exact_dedup, "GROUP_ROWS", limit)
        assert {x[0]: tuple(x[1:]) for x in exact_dedup.exact_dedup(df).collect()} == want
    out = exact_dedup.exact_dedup(odd).collect()
    assert sorted((x.keep_id, x.group_size, x.kept) for x in out if x.text_sha256 == hashlib.sha256(b"a b").hexdigest()) == [(4, 4, False)] * 3 + [(4, 4, True)]
    assert {x.doc_id for x in exact_dedup.keep_first(odd).collect()} == {1, 3, 4, 6} and exact_dedup.keep_first(odd).count() == 4
    assert exact_dedup.exact_dedup(odd.where("false")).count() == 0


# --- Near -----------------------------------------------------------------------------------------
def plain_components(rows):
    sets, parent = {}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_components(spark, odd):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(80)]
    rows = []
    for f in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 30, 80, 200]))]
        for _ in range(25):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 14))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(w).upper() if r.random() < 0.2 else " ".join(w)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", " ", "one", "ONE", "one two"])]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x[0]: tuple(x[1:]) for x in got} == plain_components(rows)
    out = {(x.doc_id, x.n_shingles): (x.component_id, x.kept) for x in near_dedup.near_dedup(odd).collect()}
    assert out == {(1, 0): (1, True), (2, 0): (2, True), (3, 0): (3, True), (4, 1): (4, True), (5, 1): (4, False), (None, 1): (None, True), (6, 1): (6, True), (7, 1): (6, False)}
    assert near_dedup.near_dedup(odd.where("false")).count() == 0
    assert near_dedup.keep_one(odd).columns == odd.columns and near_dedup.keep_one(odd).count() == 6


def test_long_chains_and_sketches(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(10, 60)] + [(100, 101)], "a long, b long")
    assert {tuple(x) for x in near_dedup.components(links).collect()} == {(i, 10) for i in range(10, 61)} | {(100, 100), (101, 100)}
    r = np.random.default_rng(0)
    for share in (0.6, 0.8, 0.95):
        both, own = int(4000 * share), int(4000 * (1 - share) / 2)
        pool = r.integers(0, 1 << 63, both + 2 * own, dtype=np.uint64)
        minima = near_dedup.minhashes(np.concatenate([pool[: both + own], pool[:both], pool[both + own :]]), np.array([0, both + own, 2 * (both + own)]))
        a, b = near_dedup.odd_sketches(minima)
        assert abs(near_dedup.estimate(a, b) - share) < 0.2


# --- Suffixes -------------------------------------------------------------------------------------
def test_suffix_arrays():
    r = np.random.default_rng(0)
    for t in range(400):
        x = r.integers(0, r.integers(1, 5), r.integers(1, 60)).astype(np.int16)
        x = np.tile(x[:3], 15) if t % 9 == 0 else x
        assert suffixes.suffix_array(x, 6, 10**6).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def plain_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("hot", [20_000, 4])
def test_repeated_strings(spark, odd, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_FRAGMENTS", hot)
    r = random.Random(hot)
    base = ["".join(r.choice("abcdé \n") for _ in range(400)) for _ in range(5)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(r.randint(0, 5)):
            s = r.randint(0, 300)
            parts.append(r.choice(base)[s : s + r.randint(1, 250)] if r.random() < 0.7 else "xy" * r.randint(0, 150))
        rows.append((i, "".join(parts) or None))
    got = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_bytes, sum(s.stop - s.start for s in x.spans), len(x.spans), bytes(x.kept)) for x in got} == plain_repeats(rows)
    out = suffix_dedup.remove_repeats(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert {x.doc_id: len(x.text) for x in out.collect() if x.doc_id in (6, 7)} == {6: 5, 7: 0}  # what starts after the first period covers the rest
    assert suffix_dedup.repeated_spans(odd.where("false")).count() == 0


def test_groups_of_most_rows_or_bytes_are_split_first(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "GROUP_ROWS", 5)
    monkeypatch.setattr(exact_dedup, "GROUP_BYTES", 100)
    monkeypatch.setattr(exact_dedup, "SPLIT_GROUPS", 2)
    rows = [(i, "") for i in range(60)] + [(100 + i, "x" * 150) for i in range(4)] + [(200 + i, "y" * 90) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = exact_dedup.split_groups(docs.select(F.sha2("text", 256).alias("sha"), F.col("text").alias("norm"))).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {x.sha: x.parts for x in groups} == {sha(""): 12, sha("x" * 150): 6}
    got = {x.doc_id: (x.keep_id, x.group_size, x.kept) for x in exact_dedup.exact_dedup(docs).collect()}
    first, size = {"": 0, "x": 100, "y": 200}, {"": 60, "x": 4, "y": 2}
    assert got == {i: (first[t[:1]], size[t[:1]], i == first[t[:1]]) for i, t in rows}


# --- URLs -----------------------------------------------------------------------------------------
def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_url_parts_rules_and_templates(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.NET/en/1?x", "https://b.net#f", "ftp://net/", "http://xnet/", "http://x.org/fr/9", "http://x.org/frz", "a://b://c/d", "http://ÄB.net/\n?", "http://example.com/de/", "http://sub.example.com/de"]
    bad = [f"http://mixed.io/ads/{i}" for i in range(60)]
    good = [f"http://mixed.io/news/{i}" for i in range(60)]
    rows = list(enumerate(urls + bad + good)) + [(3, "http://"), (None, "http://q.io/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([(i, u in good) for i, u in rows if u in bad or u in good], "page_id long, good boolean")
    got = url_filter.url_filter(pages, labels, url_filter.RULES).collect()
    assert len(got) == len(rows)
    by = {x.page_id: x for x in got if x.page_id is not None}
    for i, u in rows:
        if i is None:
            continue
        host, path = plain_url(u)
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "block" if u in bad else "allow"))
        assert (by[i].host, by[i].path, by[i].rule, by[i].verdict) == (host, path, rule, verdict), u
    assert {x.template for x in got if x.host == "mixed.io"} == {"/ads/<n>", "/news/<n>"}
    assert url_filter.url_filter(pages.where("false"), labels, url_filter.RULES).count() == 0


def test_url_branches_stand_alone_among_many_few_and_deep(spark):
    deep, ways = "/".join("abcdefgh"), "/".join("way" for _ in range(40))
    good = [f"http://many.io/s{chr(97 + i % 26)}{chr(97 + i // 26)}/{j}" for i in range(300) for j in range(2)]
    bad = [f"http://many.io/ads/{i}" for i in range(300)]  # a third of the pages, beside 300 other sections
    good += [f"http://few.io/news/{i}" for i in range(150)]
    bad += [f"http://few.io/spam/{i}" for i in range(19)]
    good += [f"http://deep.io/{deep}/news/{i}" for i in range(60)]
    bad += [f"http://deep.io/{deep}/ads/{i}" for i in range(60)]
    good += [f"http://way.io/{ways}"]
    rows = list(enumerate(bad + good))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i >= len(bad)) for i, _ in rows], "page_id long, good boolean")
    got = {x.page_id: x for x in url_filter.url_filter(pages, labels, []).collect()}
    assert [u for i, u in rows if got[i].verdict != ("block" if i < len(bad) else "allow")] == []
    assert {got[i].template for i, u in rows if "deep.io" in u} == {f"/{deep}/news/<n>", f"/{deep}/ads/<n>"}
    assert {got[i].template for i, u in rows if "many.io" in u} == {"/ads/<n>", "/*/<n>"}
    assert got[len(rows) - 1].template == "/" + ways


def test_url_exact_test_of_a_branch(spark):
    cases = [(n, k, big, g) for n in (1, 3, 7, 19) for k in range(n + 1) for big, g in ((19, 9), (40, 20), (500, 490), (9000, 30)) if k <= g and n - k <= big - g]
    df = spark.createDataFrame(cases, "n long, k long, big long, g long")
    got = df.withColumn("d", url_filter.differs(F.col("n"), F.col("k"), F.col("big"), F.col("g")))
    for n, k, big, g, d in got.collect():
        chance = [math.comb(g, i) * math.comb(big - g, n - i) / math.comb(big, n) for i in range(n + 1)]
        assert d == (min(sum(chance[: k + 1]), sum(chance[k:])) < url_filter.TAIL), (n, k, big, g)


# --- Pipeline -------------------------------------------------------------------------------------
def test_pipeline_stages(spark, tmp_path):
    r = random.Random(9)
    vocabulary = [f"w{i}x" for i in range(60)]
    passage = " ".join(r.choice(vocabulary) for _ in range(70))
    rows = []
    for i in range(60):
        w = " ".join(r.choice(vocabulary) for _ in range(r.randint(20, 200)))
        rows.append((i, w + " " + passage if i % 6 == 0 else w, "en", "s", 0))
    rows += [(60, rows[1][1], "en", "s", 0), (61, rows[2][1] + " tail", "en", "s", 0), (62, "12 34", None, None, None), (63, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept, n = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        kept.write.parquet(str(tmp_path / f"stage{k}"))
        kept = spark.read.parquet(str(tmp_path / f"stage{k}"))
        n.append({x.doc_id for x in kept.collect()})
    everything = set(range(64))
    assert n[0] == everything - {62, 63} and n[1] == n[0] - {60} and n[2] == n[1] - {61} and n[3] == n[2]
    want = plain_repeats([(i, t) for i, t, *_ in rows if i in n[2]])
    assert {x.doc_id: x.text for x in kept.collect()} == {i: v[3].decode() for i, v in want.items()}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in pieces} == n[3]
