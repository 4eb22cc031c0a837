"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels.

A sentence s of words W has z = bias + the sum of its words' weights and toxicity sigmoid(z). A document
is toxic unless none of its sentences is: p = 1 - prod(1 - sigmoid(z)) = 1 - exp(-sum softplus(z)).
Training needs document labels only, and the sentence scores then locate the offending sentences.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, extended, prepare, table, without

#: The training sample is bounded: so many labelled documents, so many characters in all, none of them longer than
#: an eighth of that.
TRAIN_DOCS = 8000
TRAIN_CHARS = 24_000_000
#: Features of the model at most, and how many standard errors their log odds lie above zero at least.
MOST_FEATURES = 1 << 16
SURE = 3
STEPS = 120
PENALTY = 0.05
#: Bias at the start; an untrained model keeps it.
FIRST_BIAS = -5.0

_PARTS = re.compile(r"[.!?\n\r]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[str]:
    return _PARTS.split(text)


def features(word: str) -> list[str]:
    """The word itself and its first 3 to 6 letters: insults are inflected."""
    return [word, *(f"^{word[:n]}" for n in range(3, min(7, len(word) + 1)))]


def bags(text: str) -> list[set[str]]:
    """Words of each sentence that has any; one empty set where none has."""
    return [b for b in (set(_WORD.findall(s)) for s in sentences(text.lower())) if b] or [set()]


def _sentences(batches):
    for batch in batches:
        docs, toxic, words = [], [], []
        for doc, y, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "toxic", "text")], strict=True):
            for bag in bags(text):
                docs.append(doc)
                toxic.append(y)
                words.append(sorted(bag))
        yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field("doc_id").type), pa.array(toxic, pa.int32()), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "toxic", "words"])


def _features_of(word: str):
    """features() as an expression."""
    starts = [F.when(F.char_length(word) >= n, F.concat(F.lit("^"), F.substring(word, 1, n))) for n in range(3, 7)]
    return F.array_compact(F.array(F.col(word), *starts))


def _screened(sentences: DataFrame, toxic: int, clean: int) -> list[str]:
    """Features whose documents are toxic more often than others by SURE standard errors of the log odds, the surest
    first. Counted by Spark; only they reach the driver."""
    words = sentences.select("doc_id", "toxic", F.explode("words").alias("word")).distinct()
    pairs = words.select("doc_id", "toxic", F.explode(_features_of("word")).alias("feature")).distinct()
    counted = pairs.groupBy("feature").agg((F.sum("toxic") + 0.5).alias("t"), (F.sum(1 - F.col("toxic")) + 0.5).alias("c"))
    odds = F.log(F.col("t") / (toxic + 1)) - F.log(F.col("c") / (clean + 1))
    sure = odds / F.sqrt(1 / F.col("t") + 1 / F.col("c"))
    kept = counted.select("feature", sure.alias("sure")).where(F.col("sure") > SURE).orderBy(F.desc("sure"), "feature").limit(MOST_FEATURES)
    return [r.feature for r in kept.collect()]


def _coded(names: list[str]):
    """Sentences to (doc_id, features): the codes of their words' features, of those sentences that have any."""

    def run(batches):
        code = {f: i for i, f in enumerate(names)}
        known: dict[str, list[int]] = {}
        for batch in batches:
            docs, found = [], []
            for doc, words in zip(batch.column("doc_id").to_pylist(), batch.column("words").to_pylist(), strict=True):
                own: list[int] = []
                for w in words:
                    if w not in known:
                        known[w] = [code[f] for f in features(w) if f in code]
                    own += known[w]
                if own:
                    docs.append(doc)
                    found.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field("doc_id").type), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "features"])

    return run


class NoisyOr:
    """weights: feature -> weight; bias: of every sentence. A sentence counts each of its words once."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self._values: dict[str, float] = {}

    @classmethod
    def fit(cls, names: list[str], y: np.ndarray, n_sentences: np.ndarray, doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, steps: int = STEPS) -> NoisyOr:
        """Full-batch Adam on the documents' log loss with an L2 penalty; no randomness. y, n_sentences: by document;
        doc: of each sentence that has features; sentence, feature: pairs. Without both labels every score is near
        the share of toxic documents, without any document the bias stays."""
        n_docs, n_sents, n = len(y), len(doc), len(names)
        rest = n_sentences - np.bincount(doc, minlength=n_docs)  # sentences without features
        weights, bias = np.zeros(n), FIRST_BIAS
        m, v = np.zeros(n + 1), np.zeros(n + 1)
        if 0 < y.sum() < n_docs:
            for t in range(1, steps + 1):
                z = bias + np.bincount(sentence, weights[feature], n_sents)
                total = np.bincount(doc, np.logaddexp(0, z), n_docs) + rest * np.logaddexp(0, bias)
                # d loss / d z: sigmoid(z) for a clean document, -sigmoid(z) / (exp(total) - 1) for a toxic one
                factor = np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0)
                g = factor[doc] / (1 + np.exp(-np.clip(z, -500, 500)))
                g_rest = (factor * rest).sum() / (1 + np.exp(-np.clip(bias, -500, 500)))
                grad = np.append(np.bincount(feature, g[sentence], n) + PENALTY * weights, g.sum() + g_rest) / n_docs
                m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
                move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
                weights -= move[:-1]
                bias -= float(move[-1])
        elif n_docs:
            bias = float(np.log(np.expm1(-np.log1p(-(y.sum() + 0.5) / (n_docs + 1)))))
        return cls({f: float(w) for f, w in zip(names, weights, strict=True) if abs(w) > 1e-3}, bias)

    def value(self, word: str) -> float:
        v = self._values.get(word)
        if v is None:
            if len(self._values) > 1 << 18:
                self._values.clear()
            v = self._values[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return v

    def score(self, text: str) -> tuple[float, int, float]:
        """Document's score, index of its worst sentence among sentences(text) and that one's score.
        An empty text counts as one sentence without words."""
        bias, known, value = self.bias, self._values, self.value
        total, worst, at, counted = 0.0, bias, 0, False
        for i, s in enumerate(_PARTS.split(text.lower())):
            bag = set(_WORD.findall(s))
            if not bag:
                continue
            counted = True
            z = bias + sum([known[w] if w in known else value(w) for w in bag])
            total += math.log1p(math.exp(z)) if z < 30 else z
            if z > worst:
                worst, at = z, i
        if not counted:
            total = math.log1p(math.exp(bias))
        return -math.expm1(-total), at, 1 / (1 + math.exp(-min(max(worst, -500), 500)))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, docs_bound: int = TRAIN_DOCS, chars_bound: int = TRAIN_CHARS) -> NoisyOr:
    """Fits on a bounded sample: the labelled, not held-out documents first by hash, at most docs_bound of
    them and chars_bound characters; a text of over an eighth of these is left out, so that no one crowds out the others.
    Null labels and labels of unknown documents are left out; a document labelled more than once is toxic if any
    label says so; different texts of one doc_id are one document, repeated rows count once. Without any labelled
    document the model is untrained; ValueError if there are some and all are too long.

    Spark counts the features; the driver gets those kept and the sentences that have any, as codes.
    """
    prepare(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    order = [F.xxhash64(F.lit("sample"), "doc_id"), "doc_id"]
    # The sample has docs_bound rows at most.
    sample = known.orderBy(*order).limit(docs_bound)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    fit = cut(found.where(F.length("text") <= chars_bound // 8).dropDuplicates(["doc_id", "text"]))
    if fit.isEmpty():
        if not found.isEmpty():
            raise ValueError(f"no labelled document has {chars_bound // 8} characters or fewer")
        return NoisyOr({}, FIRST_BIAS)
    # One task adds up the sizes of these rows, without their texts.
    sizes = fit.groupBy("doc_id").agg(F.sum(F.length("text")).alias("size"))
    taken = sizes.withColumn("sum", F.sum("size").over(Window.orderBy(*order))).where(F.col("sum") <= chars_bound).select("doc_id")
    parts = cut(fit.join(F.broadcast(taken), "doc_id").select("doc_id", "toxic", "text").mapInArrow(_sentences, T.StructType([docs.schema["doc_id"], T.StructField("toxic", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType()))])))
    by_doc = sorted(tuple(r) for r in parts.groupBy("doc_id").agg(F.max("toxic"), F.count("*")).collect())
    place = {doc: i for i, (doc, _, _) in enumerate(by_doc)}
    y, n_sentences = np.array([r[1] for r in by_doc], np.float64), np.array([r[2] for r in by_doc], np.float64)
    names = _screened(parts, int(y.sum()), int(len(y) - y.sum()))
    rows = parts.select("doc_id", "words").mapInArrow(_coded(names), T.StructType([docs.schema["doc_id"], T.StructField("features", T.ArrayType(T.IntegerType()))])).collect()
    rows.sort(key=lambda r: (place[r.doc_id], r.features))
    doc = np.array([place[r.doc_id] for r in rows], np.int64)
    sentence = np.repeat(np.arange(len(rows)), [len(r.features) for r in rows]) if rows else np.empty(0, np.int64)
    return NoisyOr.fit(names, y, n_sentences, doc, sentence, np.array([f for r in rows for f in r.features], np.int64))


def score_documents(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """docs with score (0 to 1), predicted (1 if score >= 0.5), worst_sentence (text of the sentence with the
    highest score; null for an empty text) and worst_score. Null texts count as empty. Every row keeps its
    columns, repeated rows repeat, columns of these names are replaced."""
    spark = docs.sparkSession
    prepare(spark)
    docs = without(docs, "score", "predicted", "worst_sentence", "worst_score")
    schema = extended(docs, score="double", predicted="int", worst_sentence="string", worst_score="double")
    shared = spark.sparkContext.broadcast((model.weights, model.bias))  # MOST_FEATURES entries at most

    def run(batches):
        own = NoisyOr(*shared.value)
        for batch in batches:
            scores, worst, best = [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                p, at, z = own.score(text)
                scores.append(p)
                best.append(z)
                worst.append(sentences(text)[at] if text else None)
            p = np.array(scores, np.float64)
            columns = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(worst, pa.string()), pa.array(best, pa.float64())],
                names=[*batch.schema.names, "score", "predicted", "worst_sentence", "worst_score"],
            )

    return docs.mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "worst_sentence", "worst_score")
