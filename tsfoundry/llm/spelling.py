"""Spelling variants: words one edit apart, found by pivotal bigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsfoundry.llm.common import load
from tsfoundry.session import configure, cut_lineage

NAME = "op11_spelling_variants"

#: Words have at least so many code points and occurrences.
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form occurs at least so many times as often as its variant.
RATIO = 10
#: A run's code point is deleted where this divides its checksum.
NOISE = 31
#: Bigrams are counted in so many buckets, whatever the alphabet; a table of as many counts goes to the tasks.
BUCKETS = 1 << 16
#: Code points up to which a word itself stands in the index.
LONG = 64
#: Bigrams in a prefix, tried in turn: of three some two are disjoint; the last size takes all.
PREFIX_SIZES = (3, 4, 5, 6, 8, 11, 16, 1 << 30)
#: A prefix grows while its pivots are expected to meet more words than this.
MEETS = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def noisy_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: runs of letters in lower case, some with one code point deleted, and their occurrences.

    A null text has no words, a null id counts as an empty one; repeated rows
    count each time, and other columns are ignored.
    """
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("run", F.translate("run", _UPPER, _LOWER)).withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % NOISE == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


class _Grams:
    """The bigrams of a batch of words, end to end: buckets, and for each its word and place in it."""

    def __init__(self, words: pa.Array):
        self.length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        self.code = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4").astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.count = self.length - 1
        self.first = np.concatenate(([0], np.cumsum(self.count)))[:-1]
        self.word = np.repeat(np.arange(len(self.length)), self.count)
        self.place = np.arange(len(self.word)) - self.first[self.word]
        at = self.start[self.word] + self.place
        mixed = (self.code[at] * np.uint64(0x9E3779B1) + self.code[at + 1] * np.uint64(0x85EBCA77)) & np.uint64(0xFFFFFFFF)
        self.bucket = (mixed >> np.uint64(16)).astype(np.int64) % BUCKETS

    def choose(self, counts: np.ndarray, order: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which bigrams belong to their word's prefix, the prefix's last rank, and the places of the two pivots.

        A prefix holds a word's rarest bigrams, and all others of the last
        one's rank. It grows until two bigrams in it, disjoint and the left one
        for what stands before it, the right one for what stands behind it,
        are expected to meet few words. Dynamic programming from left to right
        finds the best two: the best left one up to each place, then the best
        right one two places on.
        """
        rank = order[self.bucket]
        by_rank = rank[np.lexsort((rank, self.word))]
        rare = np.log((counts[self.bucket] + 1) / (counts.sum() + 1))
        total = np.concatenate(([0.0], np.cumsum(rare)))
        index, end = np.arange(len(rank)), (self.first + self.count)[self.word]
        # Expected words with the same head or tail: its overlapping bigrams weigh half each.
        ahead, behind = self.place + 1, end - index
        head = (total[index + 1] - total[self.first[self.word]]) * (ahead + 1) / (2 * ahead)
        tail = (total[end] - total[index]) * (behind + 1) / (2 * behind)
        big = np.int64(1) << 42
        meets = lambda x: np.minimum(16 * n_words * np.exp(x), big // 64).astype(np.int64)
        head, tail = meets(head), meets(tail)

        words = len(self.length)
        last, left, right = (np.zeros(words, np.int64) for _ in range(3))
        open_ = np.ones(words, bool)
        for size in PREFIX_SIZES:
            size = np.minimum(size, self.count)
            until = by_rank[self.first + size - 1]
            inside = rank <= until[self.word]
            step = np.where(inside, head, big // 4) - self.word * big  # smaller in each next word, so a running minimum begins anew there
            least = np.minimum.accumulate(step)
            which = np.maximum.accumulate(np.where(np.concatenate(([True], step[1:] < least[:-1])), index, 0))
            second = np.flatnonzero(self.place >= 2)
            cost = np.full(len(rank), big)
            cost[second] = np.where(inside[second], tail[second], big // 4) + least[second - 2] + self.word[second] * big
            best = np.minimum.reduceat(cost, self.first)
            hit = np.flatnonzero(cost == best[self.word])
            at = hit[np.unique(self.word[hit], return_index=True)[1]]
            now = open_ & ((best <= 16 * MEETS) | (size == self.count))
            last[now], right[now], left[now] = until[now], self.place[at][now], self.place[which[at - 2]][now]
            open_ &= ~now
            if not open_.any():
                break
        return rank <= last[self.word], last, left, right

    def hashes(self, word: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of what a word has up to the bigram at a place, and from it on."""
        base = np.uint64(0x9E3779B97F4A7C15)
        power = np.cumprod(np.full(int(self.length.max(initial=0)) + 1, base, np.uint64))
        owner = np.repeat(np.arange(len(self.length)), self.length)
        inner = np.arange(len(self.code)) - self.start[owner]
        ahead = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.code * power[inner])))
        behind = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.code * power[self.length[owner] - 1 - inner])))
        at = self.start[word]
        return ahead[at + place + 2] - ahead[at], behind[at + self.length[word]] - behind[at + place]


def _key(kind: int, hashed: np.ndarray, length: np.ndarray) -> np.ndarray:
    mixed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + length.astype(np.uint64) * np.uint64(0x94D049BB133111EB) + np.uint64(kind)
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def gram_counts(words: DataFrame) -> np.ndarray:
    """Occurrences of each bucket of bigrams in ``words(word)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(_Grams(b.column(0)).bucket, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = words.select("word").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows
    counts = np.zeros(BUCKETS, np.int64)
    counts[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: each pair of ``words(word, n)`` that one edit separates, once.

    Bigrams are ordered from rare to common, and each word has a prefix in this
    order. Of two words one edit apart, take the one whose prefix ends earlier:
    the edit leaves one of its two pivots whole, which then stands in the other's prefix. If the right
    pivot is whole and the edit lies to its left, both words are equal from
    that pivot on; else they are equal up to the left pivot's end. So the index
    has, for each prefix bigram, the length with the part of the word up to the
    bigram and the part from it on; a word asks for its left pivot's part and
    its right pivot's part at three lengths. What meets is verified by edit
    distance. Words are distinct, of four code points at least. Rows of the index
    hold the word up to ``LONG`` code points; longer ones, which may have very
    many rows, are named by a hash there and fetched for the pairs that meet.
    """
    counts, n_words = gram_counts(words), words.count()
    short = _meet(words.where(F.length("word") <= LONG), counts, n_words, "word")
    long = _meet(words.where(F.length("word") >= LONG).withColumn("id", F.xxhash64("word")), counts, n_words, "id")
    name = words.select(F.xxhash64("word").alias("id"), "word")
    long = long.join(name, "id").join(name.select(F.col("id").alias("other_id"), F.col("word").alias("other")), "other_id")
    long = long.where(F.greatest(F.length("word"), F.length("other")) > LONG)
    near = F.levenshtein("word", "other", 1) == 1
    # the edit distance of long words takes the square of their length even under a limit
    return _verified(short, near).unionAll(_verified(long.mapInArrow(_keep_one_edit, long.schema), F.lit(True)))


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion or replacement turns one word into the other, in linear time."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    x, y = (np.frombuffer(w.encode("utf-32-le"), "<u4") for w in sorted((a, b), key=len))
    differ = np.flatnonzero(x != y[: len(x)])
    if not len(differ):
        return True
    at = int(differ[0])
    return bool((x[at + (len(x) == len(y)) :] == y[at + 1 :]).all())


def _keep_one_edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, others = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("word", "other"))
        yield b.filter(pa.array([one_edit(w, o) for w, o in zip(words, others)], pa.bool_()))


def _verified(met: DataFrame, near: F.Column) -> DataFrame:
    """The pairs of ``met`` one edit apart, each once: of two ways to meet the right pivot's counts."""
    ahead = (F.col("last") < F.col("other_last")) | ((F.col("last") == F.col("other_last")) & (F.col("word") < F.col("other")))
    tail = lambda c: F.right(c, F.length("word") - F.col("right"))
    same_tail = tail(F.col("word")) == tail(F.col("other"))
    same_head = F.substring("word", F.lit(1), F.col("left") + 2) == F.substring("other", F.lit(1), F.col("left") + 2)
    once = F.when(F.col("kind") == 1, same_tail).otherwise(same_head & ~same_tail)
    return met.where(ahead & once & near).select("word", "n", "other", "other_n")


def _meet(words: DataFrame, counts: np.ndarray, n_words: int, name: str) -> DataFrame:
    """Asking words with what their pivots meet; ``name`` is the column that stands for a word: ``word`` or ``id``."""
    order = np.empty(BUCKETS, np.int64)
    order[np.argsort(counts, kind="stable")] = np.arange(BUCKETS)

    def batch(b: pa.RecordBatch, of: np.ndarray, key: np.ndarray, kind: np.ndarray, last: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        take = pa.array(of)
        own = b.column(b.schema.get_field_index(name)).take(take)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind.astype(np.int8)), own, b.column(1).take(take), pa.array(last.astype(np.int32)), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))], ["key", "kind", name, "n", "last", "left", "right"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            g = _Grams(b.column(0))
            inside, last, _, _ = g.choose(counts, order, n_words)
            of, place = g.word[inside], g.place[inside]
            for kind, hashed in enumerate(g.hashes(of, place)):
                yield batch(b, of, _key(kind, hashed, g.length[of]), np.full(len(of), kind), last[of], place, place)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            g = _Grams(b.column(0))
            _, last, left, right = g.choose(counts, order, n_words)
            of = np.arange(b.num_rows)
            up_to, from_on = g.hashes(of, left)[0], g.hashes(of, right)[1]
            for kind, hashed in enumerate((up_to, from_on)):
                for more in (-1, 0, 1):
                    yield batch(b, of, _key(kind, hashed, g.length + more), np.full(len(of), kind), last, left, right)

    schema = f"key long, kind byte, {name} {'string' if name == 'word' else 'long'}, n long, last int, left int, right int"
    rows = words.select("word", "n", *([name] if name != "word" else []))
    asks = rows.mapInArrow(ask, schema)
    other = "other" if name == "word" else "other_id"
    has = rows.mapInArrow(index, schema).select("key", "kind", F.col(name).alias(other), F.col("n").alias("other_n"), F.col("last").alias("other_last"))
    return asks.join(has, ["key", "kind"]).where(F.col("last") <= F.col("other_last"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms(word, form)``, whose chains have an end: each follows its form's form, twice as far in every round."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = now.join(after, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        moved = cut_lineage(moved)
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")
        now = moved.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``words(word, n)``.

    Two words are near if they differ by one inserted, deleted or replaced code
    point. A word's form is the near word that occurs most often, ties going to
    the smallest in code-point order, if it occurs ``ratio`` times as often as
    the word; its root is where the forms end. Null words, or a null ``n``, are
    left out; counts of repeated words add up; words of fewer than four code points
    have no near words here. Other columns are ignored; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("forms must occur more often than their variants")
    words = cut_lineage(words.where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    pairs = cut_lineage(near_pairs(words.where(F.length("word") >= 4)))
    both = pairs.select("word", "other", "other_n").unionAll(pairs.select("other", "word", "n"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))).alias("best"))
    known = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.n") >= ratio * F.col("n"), -F.col("best.n")))
    known = cut_lineage(known.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"))
    ends = roots(known.where("form IS NOT NULL"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(noisy_words(load(configure(spark), sf_dir, "documents")))


ORACLE = r"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents),
k AS (SELECT id, run, count(*) AS n FROM (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM r) GROUP BY ALL),
b AS (SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] END)) AS bytes FROM k),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM b, t),
w AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
words AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
known AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 10 * w.n THEN b.top END AS form_n,
         CASE WHEN b.top >= 10 * w.n THEN (SELECT min(x.other) FROM near x WHERE x.word = w.word AND x.other_n = b.top) END AS form
  FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (
  WITH RECURSIVE c(word, root) AS (SELECT word, form FROM known WHERE form IS NOT NULL UNION ALL SELECT c.word, k.form FROM c JOIN known k ON k.word = c.root WHERE k.form IS NOT NULL)
  SELECT c.word, c.root FROM c JOIN known k ON k.word = c.root WHERE k.form IS NULL)
SELECT k.word, k.form, coalesce(c.root, k.word) AS root, k.n, k.n_near, k.form_n FROM known k LEFT JOIN chain c ON c.word = k.word
"""
