"""Toxicity of texts: boosted trees over dense features, calibrated isotonically.

A lexicon of words and word beginnings is learned from labelled documents: terms
that occur in many toxic ones and hardly in others. Each text becomes a few
densities: lexicon hits and their weights, hits near a second person, capitals,
punctuation, disguised spellings. Spark's gradient-boosted trees learn from
these, and isotonic regression on documents held back from the trees maps their
output to probabilities. Texts are read in whole, once, where they lie.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log, log1p

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.llm.common import batches_of, fold_of, read
from nearkin.sources.storage import durable

#: Labelled documents that the model is fitted on at most, chosen by hash.
SAMPLE_ROWS = 20_000
#: Terms of the learned lexicon at most, strongest first.
LEXICON_TERMS = 4_000
#: A term needs so many toxic documents, and to be so many times as frequent there.
MIN_TOXIC_DOCS = 6
MIN_LIFT = 8.0
PREFIX_LENGTHS = (4, 5, 6)
_PREFIX = "^"  # marks a term that is a word's beginning
_NEAR_WORDS = 4
_MEMO = 400_000

# Plain English abuse that counts without labels, and second persons.
SEED_WORDS = ("bastard", "idiot", "moron", "scum", "stupid", "worthless")
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta"
    " vous votre vos tú ti tus usted ustedes vosotros".split()
)

_LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")
_INNER = re.compile(r"[^\W\d_][\d@$*!|_.\-]+[^\W\d_]")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_REPEATED = re.compile(r"(\w)\1\1")
_ASCII = np.arange(256)
_CAPITAL = (_ASCII >= 65) & (_ASCII <= 90)
_LOWER = (_ASCII >= 97) & (_ASCII <= 122)
_DIGIT = (_ASCII >= 48) & (_ASCII <= 57)
_SPACE = (_ASCII == 32) | ((_ASCII >= 9) & (_ASCII <= 13))
_MARK = (_ASCII < 128) & (_ASCII > 32) & ~_CAPITAL & ~_LOWER & ~_DIGIT

FEATURES = (
    "log_words",
    "hits_per_word",
    "log_hits",
    "weight_per_word",
    "top_weight",
    "disguised_hits",
    "hits_near_you",
    "you_per_word",
    "shouted_per_word",
    "disguised_per_word",
    "stretched_per_word",
    "capitals_per_letter",
    "digits_per_char",
    "marks_per_char",
    "exclamations_per_word",
    "questions_per_word",
    "symbols_per_word",
)


def _core(token: str) -> str:
    return _EDGES.sub("", token).lower()


def terms_of(word: str) -> list[str]:
    """The word and its beginnings, as the lexicon lists them."""
    return [word, *(_PREFIX + word[:n] for n in PREFIX_LENGTHS if len(word) > n)]


@dataclass
class Lexicon:
    """Weights by term; looks tokens up, plain or disguised."""

    weights: dict[str, float]

    def __post_init__(self) -> None:
        whole = {t: w for t, w in self.weights.items() if not t.startswith(_PREFIX)}
        self._starred: dict[str, float] = {}
        for word, weight in whole.items():
            for i in range(1, len(word)):
                self._starred[f"{word[:i]}*{word[i + 1:]}"] = weight
        self._memo: dict[str, tuple] = {}

    def weight(self, word: str) -> float:
        return max((self.weights.get(t, 0.0) for t in terms_of(word)), default=0.0)

    def token(self, token: str) -> tuple[float, bool, bool, bool, bool, bool]:
        """Weight, disguised hit, second person, shouted, disguised, stretched."""
        known = self._memo.get(token)
        if known is not None:
            return known
        word = _core(token)
        weight, hidden = self.weight(word), False
        inner = bool(_INNER.search(token))
        if weight == 0 and inner:
            plain = _NOT_LETTERS.sub("", word.translate(_LOOKALIKES))
            dropped = _NOT_LETTERS.sub("", word)
            weight = max(self.weight(plain), self.weight(dropped), self._starred.get(word, 0.0))
            hidden = weight > 0
        stretched = bool(_REPEATED.search(word))
        if weight == 0 and stretched:
            weight = self.weight(_REPEATED.sub(r"\1", re.sub(r"(\w)\1{2,}", r"\1", word)))
        shouted = len(word) > 2 and token.isupper()
        found = (weight, hidden, word in SECOND_PERSON, shouted, inner, stretched)
        if len(self._memo) >= _MEMO:
            self._memo.clear()
        self._memo[token] = found
        return found

    def features(self, text: str) -> list[float]:
        """Dense features of a whole text, in the order of ``FEATURES``."""
        tokens = text.split()
        n = max(1, len(tokens))
        hits = hidden = you = shouted = inner = stretched = 0
        total = top = 0.0
        for token, times in Counter(tokens).items():
            w, h, y, s, i, r = self.token(token)
            if w:
                hits += times
                total += w * times
                top = max(top, w)
                hidden += times * h
            you += times * y
            shouted += times * s
            inner += times * i
            stretched += times * r
        near = 0
        if hits and you:
            marks = [self.token(t) for t in tokens]
            people = np.flatnonzero([m[2] for m in marks])
            for at in np.flatnonzero([m[0] > 0 for m in marks]):
                k = np.searchsorted(people, at - _NEAR_WORDS)
                near += k < len(people) and people[k] <= at + _NEAR_WORDS
        count = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        chars = max(1, int(count.sum()))
        capitals, marks_n = int(count[_CAPITAL].sum()), int(count[_MARK].sum())
        letters = max(1, chars - int(count[_SPACE | _DIGIT].sum()) - marks_n)
        symbols = int(count[[35, 36, 37, 38, 42, 64]].sum())
        return [
            log1p(len(tokens)),
            hits / n,
            log1p(hits),
            total / n,
            top,
            float(hidden),
            near / n,
            you / n,
            shouted / n,
            inner / n,
            stretched / n,
            capitals / letters,
            int(count[_DIGIT].sum()) / chars,
            marks_n / chars,
            int(count[33]) / n,
            int(count[63]) / n,
            symbols / n,
        ]


@dataclass
class ToxicityModel:
    """What was learned; without both classes the score is their plain share."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float


def _learn_lexicon(train: DataFrame) -> Lexicon:
    """Terms with many more toxic documents than their share, by a log ratio."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(batch["t"].to_pylist(), batch["y"].to_pylist(), strict=True):
                words = {_core(token) for token in set((text or "").split())}
                counts[y].update({t for w in words if w for t in terms_of(w)})
            terms = list(counts[0].keys() | counts[1].keys())
            sides = [pa.array([c[t] for t in terms], pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), *sides], names=["term", "clean", "toxic"]
            )

    sizes = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    weights = {w: log(MIN_LIFT) for w in SEED_WORDS}
    if toxic:
        terms = train.select("t", "y").mapInArrow(count, "term string, clean long, toxic long")
        summed = terms.groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("x"))
        lift = (F.col("x") + 0.5) / (toxic + 1.0) / ((F.col("c") + 0.5) / (clean + 1.0))
        strong = summed.withColumn("lift", lift).where(
            (F.col("x") >= MIN_TOXIC_DOCS) & (F.col("lift") >= MIN_LIFT)
        )
        best = strong.orderBy(F.desc(F.log("lift") * F.col("x")), "term").limit(LEXICON_TERMS)
        weights |= {r.term: log(r.lift) for r in best.collect()}
    return Lexicon(weights)


def with_features(
    docs: DataFrame,
    lexicon: Lexicon,
    keep: list[str],
    text_of: Callable[[pa.RecordBatch], pa.Array],
    sent: list[str],
) -> DataFrame:
    """The columns ``keep`` and ``features``, an array in the order of ``FEATURES``.

    Tasks get the columns ``sent``, in which ``text_of`` finds the texts.
    """
    schema = docs.select(*keep).withColumn("features", F.array(F.lit(0.0))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            rows = [lexicon.features(t or "") for t in text_of(batch).to_pylist()]
            found = pa.array(rows, pa.list_(pa.float64()))
            columns = [*(batch[c] for c in keep), found]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "features"])

    return docs.select(*sent).mapInArrow(run, schema)


def _training_rows(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int
) -> DataFrame:
    """Labelled texts: at most ``rows`` ids, by hash, so the join can be sent out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(
        F.max((F.col(label_col) > 0).cast("int")).alias("y")
    )
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t"))
    return texts.join(F.broadcast(chosen), "_id").select("t", "y")


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> ToxicityModel:
    """Learn from the labelled texts, at most ``sample_rows`` of them.

    Labels that are null, or have no document, teach nothing; of several labels
    of one id the highest counts. A fifth of the texts, by hash, is kept from
    the trees and calibrates them, copies of a text on the same side.
    """
    train = durable(
        _training_rows(docs, labels, id_col, text_col, label_col, sample_rows), "labelled"
    )
    lexicon = _learn_lexicon(train)
    held_back = F.pmod(F.xxhash64(F.coalesce("t", F.lit(""))), F.lit(5)) == 0
    keep = ["y", "held_back"]
    rows = train.withColumn("held_back", held_back)
    rows = with_features(rows, lexicon, keep, lambda batch: batch["t"], [*keep, "t"])
    rows = rows.select("held_back", F.col("y").cast("double").alias("label"), "features")
    rows = durable(rows, "features").coalesce(4)
    counts = {
        (r.held_back, r.label): r.n
        for r in rows.groupBy("held_back", "label").agg(F.count("*").alias("n")).collect()
    }
    total, toxic = sum(counts.values()), sum(n for (_, y), n in counts.items() if y)
    share = toxic / total if total else 0.0
    if not all(counts.get((False, y)) for y in (0.0, 1.0)):
        return ToxicityModel(lexicon, None, None, share)
    rows = rows.withColumn("features", array_to_vector("features"))
    trees = GBTClassifier(
        maxIter=20, maxDepth=3, stepSize=0.3, maxBins=64, seed=1, labelCol="label"
    ).fit(rows.where("not held_back"))
    if not all(counts.get((True, y)) for y in (0.0, 1.0)):
        return ToxicityModel(lexicon, trees, None, share)
    raw = trees.transform(rows.where("held_back")).withColumn("p", _raw())
    calibration = IsotonicRegression(featuresCol="p", predictionCol="calibrated").fit(
        raw.select("label", "p")
    )
    return ToxicityModel(lexicon, trees, calibration, share)


def _raw():
    return vector_to_array("probability")[1]


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(<id>, score, predicted)`` for each row of ``docs``.

    A null text counts as an empty one and is scored like any text. The
    calibrated probability is a step function; a thousandth of the trees' own
    output orders texts on the same step.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    rows = with_features(rows, model.lexicon, ["_id"], lambda batch: batch["_t"], ["_id", "_t"])
    return _scored(rows, model, "_id").withColumnRenamed("_id", id_col)


def _scored(rows: DataFrame, model: ToxicityModel, key: str) -> DataFrame:
    if model.trees is None:
        scored = rows.select(key, F.lit(float(model.share)).alias("score"))
    else:
        raw = model.trees.transform(rows.withColumn("features", array_to_vector("features")))
        raw = raw.select(key, _raw().alias("p"))
        if model.calibration is None:
            scored = raw.withColumnRenamed("p", "score")
        else:
            mixed = 0.999 * F.col("calibrated") + 0.001 * F.col("p")
            scored = model.calibration.transform(raw).select(key, mixed.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text") -> DataFrame:
    """The rows that the model doesn't call toxic, all columns, in place."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    at = docs.columns.index(text_col)
    rows = with_features(
        rows, model.lexicon, ["_row"], lambda batch: batch["_row"].field(at), ["_row"]
    )
    return _scored(rows, model, "_row").where("predicted = 0").select("_row.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels")
    learn = labels.where(fold_of(F.col("doc_id")) != 0)
    scored = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, learn))
    held_out = fold_of(F.col("doc_id")) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
