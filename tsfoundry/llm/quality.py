"""Quality rules: exact counts per text and distance from the language's usual distributions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsfoundry.llm.common import chunks, id_and_text, load, text_buffer, words
from tsfoundry.session import configure, cut_lineage

NAME = "op10_quality_rules"
ORACLE = None

WINDOW = 8
#: Base limits: fewest words, and the most words in repeated windows, in hundredths.
LEAST_WORDS = 20
MOST_REPEATED = 30
#: Most frequent words of a language whose shares are compared; the rest is one share.
COMMON_WORDS = 64
#: A text needs so many characters, or words, before its distribution is judged.
LEAST_CHARS = 200
LEAST_JUDGED_WORDS = 50
#: Largest Jensen-Shannon distance (base 2, 0 to 1) of characters from the nearest language that passes.
MOST_CHAR_DISTANCE = 0.25
#: Largest one of words, as a part of the distance at which a text without any common word of the language lies:
#: from LEAST_JUDGED_WORDS words on, and from LONG_WORDS on, where chance moves a text's shares less.
MOST_WORD_PART, MOST_WORD_PART_LONG = 0.98, 0.85
LONG_WORDS = 200

#: Character classes: lower, upper, digit, space, line end, sentence mark, other ASCII mark, beyond ASCII.
CLASSES = 8
_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9]], _CLASS[[10, 11, 12, 13]] = 3, 4
_CLASS[list(b".,;:!?'\"-()")] = 5
_CLASS[128:192], _CLASS[192:256] = 8, 7  # continuation bytes are no characters
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(codes: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each row that lie in a window of ``window`` (a power of two) words that occurs twice or more in the row.

    Windows get exact numbers by doubling: those of 2, 4, ... words are pairs of shorter ones.
    """
    n, rows = len(codes), len(offsets) - 1
    if n < window:
        return np.zeros(rows, np.int64)
    ids, size = codes, 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    while size < window // 2:
        ids = pd.factorize(ids[:-size] * (int(ids.max()) + 1) + ids[size:])[0]
        size *= 2
    start = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
    width = int(ids.max()) + 1
    key, _ = pd.factorize((row[start] * width + ids[start]) * width + ids[start + size])
    again = start[np.bincount(key)[key] > 1] if len(key) else start
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return per_row((np.cumsum(edge[:-1]) > 0).astype(np.int64), offsets)


def duplicate_lines(text: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their row."""
    split = pc.split_pattern(text.cast(pa.large_string()), "\n")
    lines = split.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(text)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    has_word = pc.match_substring_regex(lines.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    code = lines.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keep = has_word[code] if len(code) else np.zeros(0, bool)
    row, code = row[keep], code[keep]
    distinct = np.unique(row * (len(has_word) + 1) + code) // (len(has_word) + 1)
    return np.bincount(row, minlength=len(text)) - np.bincount(distinct, minlength=len(text))


def char_classes(text: pa.Array) -> np.ndarray:
    """Characters of each class per row."""
    raw, off = text_buffer(text)
    row = np.repeat(np.arange(len(text), dtype=np.int64), np.diff(off))
    return np.bincount(row * 9 + _CLASS[raw], minlength=len(text) * 9).reshape(-1, 9)[:, :CLASSES]


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of counts from a distribution; 1 for rows without counts."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    m = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum(axis=1)
        d = np.sqrt(np.clip((kl(p) + kl(np.broadcast_to(reference, p.shape))) / 2, 0, 1))
    return np.where(total[:, 0] > 0, d, 1.0)


def no_common_words(common: dict[str, float]) -> float:
    """Distance of a text that holds none of a language's common words; it follows from their shares alone."""
    rest = 1 - sum(common.values())
    only = np.zeros((1, len(common) + 1))
    only[0, -1] = 1
    return float(js_distance(only, np.array([*common.values(), rest]))[0])


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[np.ndarray, dict[str, float]]]:
    """Per language the shares of the character classes, and of the COMMON_WORDS most frequent words in lower case.

    Counts of all documents whose language is known. Tasks count their words
    before the shuffle; the result has COMMON_WORDS + 8 numbers a language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, limit=4 << 20):
            lang = b.column(1).dictionary_encode()
            of = lang.indices.to_numpy(zero_copy_only=False)
            codes, distinct, off = words(pc.ascii_lower(b.column(0)))
            row_lang = np.repeat(of, np.diff(off))
            classes = char_classes(b.column(0))
            for k, name in enumerate(lang.dictionary.to_pylist()):
                n = np.bincount(codes[row_lang == k], minlength=len(distinct))
                seen = np.flatnonzero(n)
                own = classes[of == k].sum(axis=0)
                word = pa.concat_arrays([distinct.take(pa.array(seen)).cast(pa.string()), pa.array([f" {i}" for i in range(CLASSES)])])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(word)), word, pa.array(np.concatenate((n[seen], own)).astype(np.int64))], ["lang", "word", "n"])

    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counted = known.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted)  # counted once, used twice
    # A word holds no space, so a name that begins with one is a character class.
    kind = F.col("word").startswith(" ")
    best = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "word")
    top = counted.withColumn("kind", kind).withColumn("place", F.row_number().over(best)).where(f"place <= {max(COMMON_WORDS, CLASSES)}")
    total = counted.where(~kind).groupBy("lang").agg(F.sum("n").alias("total"))
    found: dict[str, tuple[np.ndarray, dict[str, float]]] = {}
    sums = {r["lang"]: r["total"] for r in total.collect()}
    for r in top.collect():
        classes, common = found.setdefault(r["lang"], (np.zeros(CLASSES), {}))
        if r["kind"]:
            classes[int(r["word"])] = r["n"]
        else:
            common[r["word"]] = r["n"] / sums[r["lang"]]
    return {lang: (c / max(c.sum(), 1), w) for lang, (c, w) in sorted(found.items())}


def quality_rules(docs: DataFrame, refs: dict[str, tuple[np.ndarray, dict[str, float]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, distances and verdict of every text.

    Returns ``id_col, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, char_distance, word_distance``. A text is
    compared with every language and one that is near enough counts, so a wrong
    language label harms nobody; short texts are not judged by distance. A null or empty
    text has no words and fails; without references only the base decides.
    Repeated rows are judged alike; null ids stay; other columns are ignored.
    """
    names = sorted({w for _, common in refs.values() for w in common})
    number = {w: i for i, w in enumerate(names)}
    tables = []
    for classes, common in refs.values():
        share = np.zeros(len(names) + 1)
        for w, x in common.items():
            share[number[w]] = x
        mine = np.zeros(len(names) + 1, bool)
        mine[[number[w] for w in common]] = True
        share[-1] = 1 - share.sum()
        tables.append((classes, share, mine, no_common_words(common)))
    known = pa.array(names, pa.large_string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            text = b.column(1)
            raw, at = text_buffer(text)
            codes, distinct, off = words(text)
            n = np.diff(off)
            length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
            chars = per_row(length[codes], off) if len(codes) else np.zeros(b.num_rows, np.int64)
            symbols = per_row(_SYMBOL[raw], at)
            lines, repeats = duplicate_lines(text), repeated_words(codes, off)
            failed = (n < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n)
            classes = char_classes(text)
            near_chars, near_words, strange = np.ones(b.num_rows), np.ones(b.num_rows), np.ones(b.num_rows, bool)
            if tables:
                common = pc.fill_null(pc.index_in(pc.ascii_lower(distinct), known), len(names)).to_numpy(zero_copy_only=False) if len(distinct) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(b.num_rows), n)
                width = len(names) + 1
                table = np.bincount(row * width + common[codes], minlength=b.num_rows * width).reshape(-1, width)
                part = np.where(n >= LONG_WORDS, MOST_WORD_PART_LONG, MOST_WORD_PART)
                for shares, words_of, mine, bare in tables:
                    near_chars = np.minimum(near_chars, js_distance(classes, shares))
                    own = np.where(mine, table, 0)
                    own[:, -1] = n - own[:, :-1].sum(axis=1)
                    distance = js_distance(own, words_of)
                    near_words = np.minimum(near_words, distance)
                    strange &= distance > part * bare  # of every language
            far = (classes.sum(axis=1) >= LEAST_CHARS) & (near_chars > MOST_CHAR_DISTANCE) | (n >= LEAST_JUDGED_WORDS) & strange
            far &= bool(tables)
            out = [b.column(0), *map(pa.array, (n, chars, symbols, lines, repeats, failed, ~failed & ~far, near_chars, near_words))]
            yield pa.RecordBatch.from_arrays(out, ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"])

    schema = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(configure(spark), sf_dir, "documents")
    return quality_rules(docs, references(docs))
