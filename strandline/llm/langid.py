"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are learnt on the executors from a bounded sample of labelled rows; the matrix of log probabilities, whose size is
checked, is broadcast. Scoring sums the matrix rows of a text's n-grams, for whole texts, in numpy.
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
from strandline.llm.packing import gathered
from strandline.llm.shared import added_to, small_batches, stored

SIZES, BITS = range(1, 4), 15

#: Labelled documents learnt from, for each language, about (a threshold on a hash of doc_id), and languages at most: the
#: broadcast matrix has 2**BITS rows of one float each, 32 MB at 128 languages. Defaults of ``fit``.
PER_LANGUAGE, LANGUAGES = 1500, 128

#: Matrix cells that scoring holds at once, about.
CELLS = 4 << 20

SMOOTHING = 0.5

UNKNOWN = "und"

#: Bytes of text that a worker holds as code points at once, about.
BATCH_BYTES = 3 << 19


def bounded_sample(rows: DataFrame, group: str, most: int, groups: int) -> tuple[DataFrame, dict]:
    """Rows whose hash of doc_id is low enough that about ``most`` rows of each group are left, and all groups' sizes.

    ValueError if there are over ``groups`` groups: their sizes are sent to every task.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(group).count().limit(groups + 1).collect()}
    if len(sizes) > groups:
        raise ValueError(f"over {groups} values of {group}: the model would not fit a broadcast")
    if not sizes:
        return rows, sizes
    own = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col(group))
    share = F.pmod(F.xxhash64(F.lit(17), F.col("doc_id")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rows.where(share * own < most), sizes


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points with anything but letters as spaces, lengths, and which texts have a letter."""
    points, lengths = ngrams.code_points(pc.utf8_lower(W.whole(texts)))
    letter = ngrams.is_letter(points)
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    return np.where(letter, points, 32), lengths, np.bincount(owner[letter], minlength=len(lengths)) > 0


@dataclass
class Model:
    languages: list[str]
    #: log probability of each bucket (rows) in each language, and of each language.
    matrix: np.ndarray
    prior: np.ndarray

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The best language's index (-1: no letter) and its posterior probability."""
        points, lengths, lettered = _points(texts)
        total = np.tile(self.prior, (len(lengths), 1))
        for owner, bucket in ngrams.hashed(points, lengths, SIZES, BITS, min(ngrams.CHUNK, max(1 << 10, CELLS // len(self.languages)))):
            ngrams.summed(owner, self.matrix[bucket], total)
        best = total.argmax(axis=1)
        spread = np.exp(np.minimum(total - total.max(axis=1, keepdims=True), 0.0))
        return np.where(lettered, best, -1), np.where(lettered, 1.0 / spread.sum(axis=1), 0.0)


def fit(docs: DataFrame, learn_from: Column, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> Model:
    """Learn from a sample of the rows of ``docs`` where ``learn_from`` holds and doc_id, lang and text are there.

    About ``per_language`` documents of each language are learnt from; over ``languages`` languages are an error, as the
    matrix would no longer fit a broadcast. Nothing to learn from gives a model without languages.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    chosen, sizes = bounded_sample(rows.select("doc_id", F.col("lang").cast("string").alias("lang")), "lang", per_language, languages)
    names = sorted(sizes)
    number = {x: k for k, x in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, BATCH_BYTES):
            points, lengths, _ = _points(table.column("text"))
            lang = np.array([number[x] for x in table.column("lang").to_pylist()], np.int64)
            found = [(len(names) << BITS) + lang, *(lang[owner] << BITS | bucket for owner, bucket in ngrams.hashed(points, lengths, SIZES, BITS))]
            for cells in found:
                at, n = np.unique(cells, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["cell", "n"])

    keys = stored(chosen.select("doc_id", "lang").distinct(), "language-sample")
    sample = rows.select("doc_id", F.col("text").cast("string")).join(F.broadcast(keys), "doc_id")
    cells = sample.select("lang", "text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(names) << BITS) + len(names))
    counts[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(float)
    grams, seen = counts[: len(names) << BITS].reshape(len(names), 1 << BITS) + SMOOTHING, counts[len(names) << BITS :]
    matrix = np.log(grams / grams.sum(axis=1, keepdims=True)).T
    return Model(names, np.ascontiguousarray(matrix, np.float64), np.log((seen + 1.0) / (seen + 1.0).sum()) if names else np.zeros(0))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if nothing was learnt. Ties go to the
    language first in order. Columns of those names are replaced; only the text decides. A very long text is scored whole, by
    one task. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("lang_pred", "score")
    shared = spark.sparkContext.broadcast(model)

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, UNKNOWN], dtype=object)
        for table in gathered(batches, BATCH_BYTES):
            n = table.num_rows
            best, score = shared.value.scores(table.column("text")) if shared.value.languages else (np.full(n, -1), np.zeros(n))
            table = table.append_column("lang_pred", pa.array(names[best], pa.string())).append_column("score", pa.array(score))
            yield from table.combine_chunks().to_batches()

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(identify, added_to(docs.schema).add("lang_pred", "string").add("score", "double"))
