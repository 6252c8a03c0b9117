"""Toxicity scores: boosted trees over dense features, calibrated."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsfoundry.llm.common import chunks, id_and_text, load, text_buffer, words
from tsfoundry.llm.language import remainder
from tsfoundry.llm.quality import per_row
from tsfoundry.session import configure, cut_lineage

NAME = "op8_toxicity"
ORACLE = None

#: Trees and calibration are fitted on at most so many labelled rows, those of the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
#: Most terms in the lexicon; a term needs so many toxic texts and such odds against clean ones.
LEXICON_TERMS = 600
LEAST_TOXIC = 4
LEAST_ODDS = 6.0
#: A term is a word, or a prefix of so many letters of longer words.
PREFIX = 5
#: Words from a term to a second person that count as near.
NEAR = 4
#: Bits of the filter of labelled ids, 4 MB.
FILTER_BITS = 1 << 25
#: Trees.
ROUNDS, DEPTH, RATE = 20, 3, 0.3
#: A fifth of the fitting rows calibrates the scores.
CALIBRATION_OF = 5

# Words that address somebody, in the languages of the texts. Fixed values.
SECOND_PERSON = [
    "you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "euer", "eure",
    "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "usted", "ustedes", "ti", "tus", "vosotros", "vuestro",
]
# What digits and marks stand for in disguised words. Fixed values.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})

FEATURES = [
    "word_hits", "prefix_hits", "disguised_hits", "hits_per_100", "odds_sum", "odds_max", "distinct_hits", "near_second_person",
    "second_person_per_100", "capital_share", "capital_words", "exclaim_per_100", "question_per_100", "mark_share", "mixed_words", "long_runs", "log_words",
]


@dataclass
class Toxicity:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    prior: float


def terms(distinct: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The letters' core of each word in lower case, and ``~`` with its prefix for words longer than that."""
    core = pc.replace_substring_regex(pc.utf8_lower(distinct), r"^[^\pL]+|[^\pL]+$", "")
    long = pc.greater(pc.utf8_length(core), PREFIX)
    prefix = pc.if_else(long, pc.binary_join_element_wise(pa.scalar("~", core.type), pc.utf8_slice_codeunits(core, 0, PREFIX), pa.scalar("", core.type)), pa.scalar("", core.type))
    return core, prefix


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Terms of ``rows(text, toxic)`` that toxic texts hold far more often, with their log odds; each text counts a term once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            toxic = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            codes, distinct, off = words(b.column(0))
            row = np.repeat(np.arange(b.num_rows), np.diff(off))
            for kind in terms(distinct):
                kind = kind.dictionary_encode()
                code = kind.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes]
                pair = np.unique(row * (len(kind.dictionary) + 1) + code)
                term, of = pair % (len(kind.dictionary) + 1), pair // (len(kind.dictionary) + 1)
                hits = np.bincount(term, toxic[of], minlength=len(kind.dictionary)).astype(np.int64)
                both = np.bincount(term, minlength=len(kind.dictionary))
                yield pa.RecordBatch.from_arrays([kind.dictionary.cast(pa.string()), pa.array(hits), pa.array(both - hits)], ["term", "toxic", "clean"])

    counted = rows.select("text", "toxic").mapInArrow(count, "term string, toxic long, clean long").where("term <> ''").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n = rows.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    odds = ((F.col("toxic") + 0.5) / (n["t"] + 1)) / ((F.col("clean") + 0.5) / (n["c"] + 1))
    best = counted.withColumn("odds", odds).where((F.col("toxic") >= LEAST_TOXIC) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc(F.col("toxic") * F.log("odds")), "term").limit(LEXICON_TERMS)
    return {r["term"]: float(np.log(r["odds"])) for r in best.collect()}


def features(rows: DataFrame, lexicon: dict[str, float], keep: tuple[str, ...] = ()) -> DataFrame:
    """FEATURES of ``rows(id, text)`` beside ``id`` and the columns ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(list(lexicon), pa.large_string())
        odds_of = np.array([*lexicon.values(), 0.0])
        persons = pa.array(SECOND_PERSON, pa.large_string())
        for b in chunks(batches):
            n_rows = b.num_rows
            text = b.column(b.schema.get_field_index("text"))
            raw, at = text_buffer(text)
            codes, distinct, off = words(text)
            row = np.repeat(np.arange(n_rows), np.diff(off))
            core, prefix = terms(distinct)
            place = lambda x: pc.fill_null(pc.index_in(x, names), len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
            word, pre = place(core), place(prefix)
            odd = pc.match_substring_regex(distinct, r"\pL.*[0-9@$*!_]+.*\pL").to_numpy(zero_copy_only=False).astype(bool)
            other = np.full(len(distinct), len(names))
            for i in np.flatnonzero(odd & (word == len(names))).tolist():
                plain = distinct[i].as_py().lower().translate(DISGUISE).strip(",;:?")
                if plain in lexicon:
                    other[i] = word_number[plain]
            best = np.where(word < len(names), word, np.where(other < len(names), other, pre))
            hit, per = best[codes] < len(names), lambda x: per_row(np.asarray(x, float), off)
            value = odds_of[best][codes]
            person = pc.is_in(core, persons).to_numpy(zero_copy_only=False).astype(bool)[codes] if len(codes) else np.zeros(0, bool)
            run_of = np.concatenate(([0], np.cumsum(person)))
            index = np.arange(len(codes))
            low, high = np.maximum(index - NEAR, off[row] if len(row) else 0), np.minimum(index + NEAR + 1, off[row + 1] if len(row) else 0)
            near = hit & (run_of[high] > run_of[low])
            highest = np.zeros(n_rows)
            np.maximum.at(highest, row[hit], value[hit])
            pairs = np.unique(row[hit] * (len(names) + 1) + best[codes][hit]) // (len(names) + 1)
            n = np.maximum(np.diff(off), 1).astype(float)
            chars = np.maximum(np.diff(at), 1).astype(float)
            upper = (raw >= 65) & (raw <= 90)
            letter = upper | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
            mark = (raw > 32) & ~letter & ~((raw >= 48) & (raw <= 57))
            by = lambda x: per_row(x.astype(np.int64), at)
            shout = pc.match_substring_regex(distinct, r"^\PL*\p{Lu}{2,}\PL*$").to_numpy(zero_copy_only=False).astype(bool)
            runs = pc.match_substring_regex(distinct, r"aaa|eee|iii|ooo|uuu|sss|lll|!!!|\?\?\?").to_numpy(zero_copy_only=False).astype(bool)
            out = [
                per(word[codes] < len(names)), per((pre[codes] < len(names)) & (word[codes] == len(names))), per(other[codes] < len(names)), 100 * per(hit) / n, per(value), highest, np.bincount(pairs, minlength=n_rows), per(near),
                100 * per(person) / n, by(upper) / np.maximum(by(letter), 1), per(shout[codes]) / n, 100 * by(raw == 33) / n, 100 * by(raw == 63) / n, by(mark) / chars, per(odd[codes]) / n, per(runs[codes]) / n, np.log1p(np.diff(off)),
            ]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("id", *keep)] + [pa.array(np.asarray(x, float)) for x in out], ["id", *keep, *FEATURES])

    word_number = {t: i for i, t in enumerate(lexicon)}
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("id", *keep, "text").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in ("id", *keep)) + "".join(f", {c} double" for c in FEATURES))


def labelled(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """``texts`` joined with ``marks(id, toxic)``; most texts without a mark don't reach the shuffle.

    A filter of at most ``FILTER_BITS`` bits, one for each hash of a marked id,
    is met by every text where it is read; what it lets through wrongly falls
    out in the join. The join is the same at every size.
    """
    bit = lambda: F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    block = F.bitmap_bucket_number(F.col("bit") + 1)
    place = F.bitmap_bit_position(F.col("bit") + 1)
    bits = marks.select(bit().alias("bit")).groupBy(block.alias("block")).agg(F.bitmap_construct_agg(place).alias("bits"))
    # FILTER_BITS / 8 bytes at most
    near = texts.withColumn("bit", bit()).withColumn("block", block).join(F.broadcast(bits), "block")
    byte = F.conv(F.hex(F.substring("bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = near.where(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0).select(*texts.columns)
    return near.hint("merge").join(marks, "id")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Toxicity:
    """Lexicon from all labelled rows but the calibration's; trees and calibration from a bounded sample of them.

    Of two labels of one id the toxic one counts; null ids and labels are
    ignored. With labels of one kind only, or none, every score is that share.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    texts = id_and_text(docs, id_col, text_col)
    chosen = marks.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    # At most SAMPLE_ROWS rows of 12 bytes.
    rows = cut_lineage(texts.join(F.broadcast(chosen), "id"))
    held = F.crc32(F.concat(F.lit("c"), F.col("id").cast("string")).cast("binary")) % CALIBRATION_OF == 0
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"), F.count_distinct(held, "toxic").alias("kinds")).first()
    if not seen["n"] or seen["kinds"] < 4:
        return Toxicity({}, None, None, (seen["t"] or 0) / max(seen["n"], 1))
    lexicon = learn_lexicon(labelled(texts.where(~held), marks))
    known = cut_lineage(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(rows, lexicon, ("toxic",))).select("id", "features", F.col("toxic").cast("double").alias("label")))
    trees = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=RATE, seed=1, cacheNodeIds=False).fit(known.where(~held))
    scored = trees.transform(known.where(held)).select("label", "probability")
    curve = IsotonicRegression(featuresCol="probability", featureIndex=1).fit(scored)
    return Toxicity(lexicon, trees, curve, seen["t"] / seen["n"])


def score(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, predicted`` of every whole text.

    Null and empty texts have features of zero and are scored like others.
    Repeated rows get equal scores; null ids stay; other columns are ignored.
    """
    rows = id_and_text(docs, id_col, text_col)
    if model.trees is None:
        out = rows.select(F.col("id"), F.lit(float(model.prior)).alias("score"))
    else:
        dense = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(rows, model.lexicon)).select("id", "features")
        curve = model.curve.setPredictionCol("score")
        out = curve.transform(model.trees.transform(dense).select("id", "probability")).select("id", "score")
    bounded = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return out.select(F.col("id").alias(id_col), bounded.alias("score"), (bounded >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = configure(spark)
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    labels = load(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    return score(docs, fit(docs, labels)).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
