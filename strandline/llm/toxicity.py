"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams (with word ends), so misspellings that were
never seen share most of it. A document's vector is the mean of its words' vectors; a linear softmax over it gives the
score. Training takes a bounded, balanced sample of labelled rows. Since the model is linear above the buckets, scoring
needs one number for each bucket: the broadcast is 2**BITS floats, whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import ngrams
from strandline.llm import words as W
from strandline.llm.langid import bounded_sample
from strandline.llm.packing import gathered
from strandline.llm.shared import added_to, release_memory, small_batches, stored

SIZES, BITS, WIDTH = range(3, 6), 18, 4

#: Labelled rows of each class that training takes, about, and the longest text it takes: the sample that reaches the
#: driver holds at most about 2 * PER_CLASS * MOST_CHARS characters. Defaults of ``fit``.
PER_CLASS, MOST_CHARS = 1500, 20_000

#: Parts of the sample that are each scored by a model of the other parts, to set the bias.
PARTS = 3

#: n-grams are learnt if their share of the sample's texts leans to one class by so many standard errors (estimated with
#: PROBES random signs); the others would only name single documents.
LEAST_LEAN, PROBES = 2.5, 24

ROUNDS, RATE, SCALE, SEED = 60, 0.1, 100.0, 3

#: Marks cut from the ends of words.
MARKS = ".,;:!?\"'()[]{}<>#*$%&|-_/\\"


def bag(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, int]:
    """Distinct words of the texts, then (text, word) of every occurrence, and how many texts there are."""
    texts = pc.utf8_lower(W.whole(texts))
    flat, owner = W.split_words(texts)
    found = flat.dictionary_encode()
    return pc.utf8_trim(found.dictionary, characters=MARKS), owner, found.indices.to_numpy().astype(np.int64), len(texts)


def subwords(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, bucket) of the n-grams of <word>; a word of fewer letters than an n-gram has its shorter ones."""
    points, lengths = ngrams.code_points(pc.binary_join_element_wise(*(x.cast(pa.large_string()) if isinstance(x, pa.Array) else pa.scalar(x, pa.large_string()) for x in ("<", words, ">", ""))))
    yield from ngrams.hashed(points, lengths, SIZES, BITS)


@dataclass
class Model:
    #: Each bucket's share in the difference of the two classes' logits, and that of an empty text.
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        words, owner, word, n = bag(texts)
        total, count = np.zeros(len(words)), np.zeros(len(words))
        for w, bucket in subwords(words):
            ngrams.summed(w, self.weights[bucket], total)
            ngrams.summed(w, np.ones(len(w)), count)
        mean = total / np.maximum(count, 1)
        sums = np.bincount(owner, weights=mean[word], minlength=n)
        logit = SCALE * sums / np.maximum(np.bincount(owner, minlength=n), 1) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500)))


class _Rows:
    """A sparse matrix that multiplies dense ones from both sides."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int], both: bool = True):
        self.shape = shape
        rows, columns, values = rows.astype(np.int32), columns.astype(np.int32), values.astype(np.float32)
        order = np.argsort(columns, kind="stable")
        self.backward = columns[order], rows[order], values[order][:, None]
        if both:
            order = np.argsort(rows, kind="stable")
            self.forward = rows[order], columns[order], values[order][:, None]

    def __call__(self, dense: np.ndarray, back: bool = False) -> np.ndarray:
        to, source, value = self.backward if back else self.forward
        out = np.zeros((self.shape[1] if back else self.shape[0], dense.shape[1]), np.float32)
        ngrams.summed(to, dense[source] * value, out)
        return out


def train(texts: pa.Array, toxic: np.ndarray) -> Model:
    """Embeddings and softmax trained together by Adam on the weighted log loss of the sample."""
    share = float(np.mean(toxic)) if len(toxic) else 0.0
    if not 0.0 < share < 1.0:
        return Model(np.zeros(1 << BITS), -2.0 if share == 0.0 else 2.0)
    words, owner, word, n = bag(texts)
    pair, count = np.unique(owner.astype(np.int64) * len(words) + word, return_counts=True)
    docs = _Rows(pair // len(words), pair % len(words), count / np.maximum(np.bincount(owner, minlength=n), 1)[pair // len(words)], (n, len(words)))
    found = list(subwords(words))
    w, bucket = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    grams = np.bincount(w, minlength=len(words))
    every = _Rows(w, bucket, 1.0 / grams[w], (len(words), 1 << BITS), both=False)
    rng = np.random.default_rng(SEED)
    lean = (toxic - share).astype(np.float32)[:, None]
    error = np.zeros(1 << BITS, np.float32)
    for _ in range(PROBES):
        signs = rng.choice([-1.0, 1.0], (n, 1)).astype(np.float32)
        error += np.square(every(docs(lean * signs, back=True), back=True))[:, 0] / PROBES
    z = every(docs(lean, back=True), back=True)[:, 0] / np.maximum(np.sqrt(error), 1e-12)
    del every
    learnt = (np.abs(z) >= LEAST_LEAN)[bucket]
    w, bucket = w[learnt], bucket[learnt]
    parts = _Rows(w, bucket, 1.0 / grams[w], (len(words), 1 << BITS))
    values = {
        "e": (rng.uniform(-0.1 / WIDTH, 0.1 / WIDTH, (1 << BITS, WIDTH)) * (np.abs(z) >= LEAST_LEAN)[:, None]).astype(np.float32),
        "w": rng.normal(0, 0.3, (WIDTH, 2)).astype(np.float32),
        "b": np.zeros((1, 2), np.float32),
    }
    first, second = {k: np.zeros_like(x) for k, x in values.items()}, {k: np.zeros_like(x) for k, x in values.items()}
    target = np.stack([1 - toxic, toxic], axis=1).astype(np.float32)
    for step in range(1, ROUNDS + 1):
        hidden = SCALE * docs(parts(values["e"]))
        logits = hidden @ values["w"] + values["b"]
        chance = np.exp(logits - logits.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        miss = (chance - target) / n
        slopes = {"w": hidden.T @ miss, "b": miss.sum(axis=0, keepdims=True), "e": parts(docs(SCALE * miss @ values["w"].T, back=True), back=True)}
        for k, slope in slopes.items():
            first[k] += 0.1 * (slope - first[k])
            second[k] += 0.01 * (slope * slope - second[k])
            values[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    lean = values["w"][:, 1] - values["w"][:, 0]
    return Model((values["e"] @ lean).astype(np.float64), float(values["b"][0, 1] - values["b"][0, 0]))


def balanced(texts: pa.Array, toxic: np.ndarray, shares: tuple[float, float]) -> Model:
    """A model of all the texts; its bias is moved to where texts that a model hasn't seen have the least log loss.

    For that each of PARTS parts is scored by a model of the others; classes weigh as much as their own ``shares``.
    """
    model = train(texts, toxic)
    part = np.arange(len(toxic)) % PARTS
    logit = np.zeros(len(toxic))
    if min(toxic.sum(), len(toxic) - toxic.sum()) < PARTS:
        return model
    for k in range(PARTS):
        own = part == k
        chance = np.clip(train(texts.filter(pa.array(~own)), toxic[~own]).scores(texts.filter(pa.array(own))), 1e-12, 1 - 1e-12)
        logit[own] = np.log(chance / (1 - chance))
        release_memory()
    weight = np.where(toxic == 1, shares[1] / toxic.sum(), shares[0] / (len(toxic) - toxic.sum()))
    moves = np.arange(-6, 6.01, 0.05)
    loss = [float(weight @ np.logaddexp(0, np.where(toxic == 1, -1, 1) * (logit + move))) for move in moves]
    return Model(model.weights, model.bias + float(moves[int(np.argmin(loss))]))


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, per_class: int = PER_CLASS, most_chars: int = MOST_CHARS) -> Model:
    """Train on a balanced sample of the labelled documents where ``learn_from`` (on doc_id) holds.

    About ``per_class`` documents of each class are learnt from, none of over ``most_chars`` characters. Null doc_ids, labels
    and texts are not learnt from; a document with both labels counts as toxic, and of rows that share a doc_id the first text
    in order counts. Without labels of both classes every text gets one score.
    """
    small_batches(docs.sparkSession)
    known = labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(learn_from & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen, sizes = bounded_sample(known, "toxic", per_class, 2)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).where(F.length("text") <= most_chars)
    sample = rows.join(F.broadcast(stored(chosen, "toxicity-sample")), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = sample.toPandas().sort_values("doc_id")
    total = max(1, sum(sizes.values()))
    return balanced(pa.array(sample["text"].tolist(), pa.string()), sample["toxic"].to_numpy(np.int64), (sizes.get(0, 0) / total, sizes.get(1, 0) / total))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with score (0 to 1) and predicted (1 from 0.5 on).

    A null or empty text gets the score of the bias alone. Columns of those names are replaced; only the text decides. A very
    long text is scored whole, by one task. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("score", "predicted")
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            found = shared.value.scores(table.column("text"))
            table = table.append_column("score", pa.array(found)).append_column("predicted", pa.array((found >= 0.5).astype(np.int32)))
            yield from table.combine_chunks().to_batches()

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(score, added_to(docs.schema).add("score", "double").add("predicted", "integer"))
