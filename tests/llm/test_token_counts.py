"""Token counts against the tokenizers libraries, and what the cache saves."""

import public_tokenizers
import pytest

from tsfoundry.llm import token_counts
from tsfoundry.session import scratch_path

TEXTS = [None, "", " ", "a", "Words and  words\n\nand more.", "<|endoftext|>", "x<|endoftext|> y", "naïve — 字字 🙂🙂", "퟿ private", "long text " * 30_000, "'s 've 1234567 ", "\t\t mixed\r\n"]


def plain(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t or "")) for t in texts]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


@pytest.fixture()
def cache(spark):
    return scratch_path(spark, "token-cache")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, digest string, n_tokens int, id int")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, cache, name):
    rows = [*enumerate(TEXTS), (3, "a"), (3, "a"), (None, "a"), (None, None), (50, TEXTS[4]), (3, "other text of this id")]
    got = token_counts.token_counts(table(spark, rows), public_tokenizers.path(name), cache, limit=10).collect()
    want = sorted((str(i), len((t or "").encode()), n, n > 10) for (i, t), n in zip(rows, plain(name, [t for _, t in rows])))
    assert sorted((str(x.doc_id), *tuple(x)[1:]) for x in got) == want
    assert token_counts.token_counts(table(spark, []), public_tokenizers.path(name), cache).count() == 0


def test_only_distinct_misses_are_encoded(spark, cache):
    path, other = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    size = lambda: spark.read.parquet(cache).count()
    first = table(spark, [(i, f"text {i % 7}") for i in range(60)] + [(1, "text 1")] * 20).repartition(5)
    token_counts.fill(first, path, cache)
    assert size() == 7
    rows = first.selectExpr("cast(doc_id as string) id", "unhex(sha2(text, 256)) digest", "text")
    known = token_counts.stored(spark, cache, token_counts.version(path))
    assert known.count() == 7 and token_counts.misses(rows, known).count() == 0
    more = first.unionAll(table(spark, [(100 + i, f"new {i % 3}") for i in range(30)]))
    token_counts.fill(more, path, cache)
    assert size() == 10
    token_counts.fill(more, path, cache)
    assert size() == 10
    token_counts.fill(first, other, cache)  # another tokenizer has counts of its own
    assert size() == 17 and token_counts.stored(spark, cache, token_counts.version(path)).count() == 10


def test_stored_counts_are_used(spark, cache):
    """A planted count comes back, also where two runs have stored a digest twice."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    planted = spark.createDataFrame([("planted",)] * 2, "text string").selectExpr(f"'{token_counts.version(path)}' tokenizer", "unhex(sha2(text, 256)) digest", "777L n_tokens")
    planted.write.partitionBy("tokenizer").parquet(cache)
    got = token_counts.token_counts(table(spark, [(1, "planted"), (2, "planted"), (3, "b")]), path, cache).collect()
    assert sorted((x.doc_id, x.n_tokens, x.over_limit) for x in got) == [(1, 777, True), (2, 777, True), (3, 1, False)]


def test_query_keeps_a_named_cache(spark, cache):
    spark.conf.set(token_counts.CACHE_SETTING, cache)
    try:
        a = token_counts.query(spark, "/root/testdata/sf0.001").toPandas().sort_values("doc_id")
        n = spark.read.parquet(cache).count()
        b = token_counts.query(spark, "/root/testdata/sf0.001").toPandas().sort_values("doc_id")
    finally:
        spark.conf.unset(token_counts.CACHE_SETTING)
    assert a.reset_index(drop=True).equals(b.reset_index(drop=True)) and spark.read.parquet(cache).count() == n > 0
