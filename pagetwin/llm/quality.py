"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(w . x - threshold_k): one weight vector over hashed n-grams of the text and of its
character shapes, shared by all grades, and thresholds in rising order. The expected grade and the tail
probability (of the best grade, or from `good` on) select documents.

The model is fitted on the driver from at most about MAX_ROWS rated texts, of those longer than MAX_CHARS code
points a stretch of that length (both parameters), each once whole and once as a short stretch; whole texts are rated.

Defined results: null texts and texts of white space only get the lowest grade, tail 0, and are rejected; a
document with several ratings is fitted with each; null ratings are ignored; with ratings of one grade or none,
every text with content is kept; equal rows give equal rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetwin.llm.rows import narrow, tidy
from pagetwin.llm.samples import labelled, stretch
from pagetwin.llm.subwords import counts, raw_grams
from pagetwin.session import prepare

BUCKETS = 1 << 16
MAX_ROWS, MAX_CHARS = 5000, 20_000
EPOCHS, RATE, L2 = 8, 0.3, 1e-6
#: Kept when the tail probability reaches this.
KEEP = 0.5


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their log counts, scaled to unit length."""
    at, n = counts(raw_grams(text, BUCKETS), BUCKETS)
    x = np.log1p(n)
    return at, x / np.sqrt((x * x).sum()) if len(x) else x


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def tails(self, text: str) -> np.ndarray:
        """P(grade > k) for each grade but the last."""
        at, x = features(text)
        return sigmoid(float(self.weights[at] @ x) - self.thresholds)

    def rate(self, text: str | None, good: int) -> tuple[float, float]:
        """(expected grade, P(grade >= good))."""
        if not text or not text.strip():
            return float(self.grades[0]) if self.grades else 0.0, 0.0
        if len(self.grades) < 2:
            return float(self.grades[0]) if self.grades else 0.0, 1.0
        tail = self.tails(text)
        steps = np.diff(np.array(self.grades, float))
        k = self.grades.index(good) if good in self.grades else len(self.grades) - 1
        return float(self.grades[0] + (tail * steps).sum()), float(tail[k - 1]) if k else 1.0


def likelihood(z: float, theta: np.ndarray, c: int) -> float:
    """Of grade c: P(> c - 1) - P(> c)."""
    above = sigmoid(z - theta[c - 1]) if c else 1.0
    beyond = sigmoid(z - theta[c]) if c < len(theta) else 0.0
    return max(above - beyond, 1e-6)


def slopes(z: float, theta: np.ndarray, c: int) -> tuple[float, np.ndarray]:
    """Of the logarithm of the likelihood of grade c, for the score and the thresholds."""
    p, marks = likelihood(z, theta, c), np.zeros(len(theta))
    if c:
        marks[c - 1] = -(s := sigmoid(z - theta[c - 1])) * (1 - s) / p
    if c < len(theta):
        marks[c] = (s := sigmoid(z - theta[c])) * (1 - s) / p
    return -float(marks.sum()), marks


def fit(texts: list[str], ratings: list[int], seed: int = 1) -> Model:
    grades = sorted(set(ratings))
    if len(grades) < 2:
        return Model(grades, np.zeros(BUCKETS), np.zeros(0))
    rng = np.random.default_rng(seed)
    y = np.searchsorted(grades, ratings)
    above = [(y > k).mean() for k in range(len(grades) - 1)]
    theta = -np.log(np.array(above) / (1 - np.array(above)))
    w, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    xs = [features(t) for t in texts]
    for epoch in range(EPOCHS):
        for k in rng.permutation(len(texts)):
            t = texts[k]
            n = int(rng.integers(60, 600))
            lo = int(rng.integers(0, max(1, len(t) - n)))
            # Stretches of mixed texts may not deserve the text's grade, so they weigh less.
            for (at, x), weight in ((xs[k], 1.0), (features(t[lo : lo + n]), 0.1 if len(t) > n else 0.0)):
                if not len(at) or not weight:
                    continue
                score, marks = slopes(float(w[at] @ x), theta, int(y[k]))
                step = weight * score * x - L2 * w[at]
                seen[at] += step * step
                w[at] += RATE * step / np.sqrt(seen[at])
                theta = np.maximum.accumulate(theta + 0.02 * weight / (1 + epoch) * marks)
    return Model(grades, w, theta)


def fit_documents(docs: DataFrame, labels: DataFrame, rating: str = "quality", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """The sample of ratings is drawn first; only its few ids are broadcast to the documents."""
    rated = labels.select("doc_id", F.col(rating).cast("int").alias("rating")).where("doc_id is not null and rating is not null").withColumn("text", F.lit(""))
    chosen = labelled(rated, "rating", max_rows)
    if not chosen:
        return Model([], np.zeros(BUCKETS), np.zeros(0))
    few = docs.sparkSession.createDataFrame([(r["doc_id"], r["rating"]) for r in chosen], f"doc_id {rated.schema['doc_id'].dataType.simpleString()}, rating int")
    got = docs.select("doc_id", stretch(F.col("text"), max_chars).alias("text")).where("text is not null").join(F.broadcast(few), "doc_id").collect()  # at most about max_rows rows
    got = sorted(got, key=lambda r: (str(r["doc_id"]), r["text"]))
    return fit([r["text"] for r in got], [r["rating"] for r in got])


def rate_documents(docs: DataFrame, model: Model, good: int | None = None, keep: float = KEEP) -> DataFrame:
    """One row per input row: doc_id, expected_grade, tail_probability, kept."""
    spark = prepare(docs.sparkSession)
    rows = narrow(docs)
    shared = spark.sparkContext.broadcast(model)
    good = model.grades[-1] if good is None and model.grades else good

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = [m.rate(t.as_py(), good) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[1] >= keep for g in got], pa.bool_())], names=["doc_id", "expected_grade", "tail_probability", "kept"])

    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, expected_grade double, tail_probability double, kept boolean")


def drop_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without what the classifier rejects; all columns stay. Rows are decided one by one, in place."""
    spark = prepare(docs.sparkSession)
    model = fit_documents(docs, labels)
    shared = spark.sparkContext.broadcast(model)
    good = model.grades[-1] if model.grades else 0

    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        m = shared.value
        return pa.array([m.rate(t.as_py(), good)[1] >= KEEP for t in texts], pa.bool_())

    return docs.where(kept(F.coalesce(docs["text"], F.lit(""))))
