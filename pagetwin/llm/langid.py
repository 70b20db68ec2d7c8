"""Language identification: averaged hashed subword embeddings with a linear softmax, by SGD in numpy.

The model is fitted on the driver from at most about MAX_ROWS labelled texts, of those longer than MAX_CHARS
code points a stretch of that length (both parameters); predictions read whole texts. A text's vector is the mean of the embeddings of
its letter n-grams. Scores are softmax probabilities after temperature scaling on rows set aside from the
sample, and `rejected` marks scores under the threshold that keeps RISK of those rows wrong at most.

Defined results: null texts and texts without letters are `und` with score 0 and rejected; without labelled
rows every text is; a null doc_id is neither held out nor learned from; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetwin.llm.rows import narrow, tidy
from pagetwin.llm.samples import labelled, stretch
from pagetwin.llm.subwords import counts, word_grams
from pagetwin.session import prepare

BUCKETS, DIM = 1 << 15, 16
MAX_ROWS, MAX_CHARS = 4000, 20_000
EPOCHS, RATE = 4, 2.0
RISK = 0.01
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    """Scores of a text are the mean of table[gram] plus bias, so embeddings and weights are multiplied once."""

    def __init__(self, labels: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        self.labels, self.table, self.bias = labels, table, bias
        self.temperature, self.threshold = temperature, threshold

    def logits(self, text: str) -> np.ndarray | None:
        total, n = np.zeros(len(self.labels)), 0
        for g in word_grams(text, BUCKETS):
            total += self.table[g].sum(0, dtype=np.float64)
            n += len(g)
        return total / n + self.bias if n else None

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text) if text and self.labels else None
        if z is None:
            return UNKNOWN, 0.0
        p = softmax(z / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def gradients(rows: np.ndarray, f: np.ndarray, w: np.ndarray, b: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the cross entropy, for the weights, the bias and the embeddings `rows` whose mean by the shares f is the text."""
    h = f @ rows
    g = softmax(h @ w + b)
    g[label] -= 1
    return np.outer(h, g), g, np.outer(f, w @ g)


def fit(texts: list[str], langs: list[str], seed: int = 1) -> Model:
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    if not labels:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    w, b = np.zeros((DIM, len(labels))), np.zeros(len(labels))
    y = np.array([labels.index(x) for x in langs])
    order = rng.permutation(len(texts))
    aside, train = order[: len(order) // 5], order[len(order) // 5 :]
    features = {}

    def of(k: int, part: str | None = None):
        if part is None and k in features:
            return features[k]
        at, n = counts(word_grams(texts[k] if part is None else part, BUCKETS), BUCKETS)
        got = (at, n / n.sum() if len(n) else n)
        if part is None:
            features[k] = got
        return got

    steps, done = EPOCHS * len(train) * 2, 0
    for _ in range(EPOCHS):
        for k in rng.permutation(train):
            t = texts[k]
            # Each text once whole and once as a short stretch, so that short texts are learned too.
            lo = int(rng.integers(0, max(1, len(t) - 20)))
            for at, f in (of(k), of(k, t[lo : lo + int(rng.integers(20, 200))])):
                rate = RATE * (1 - done / steps)
                done += 1
                if not len(at):
                    continue
                dw, db, de = gradients(emb[at], f, w, b, y[k])
                w -= rate * dw
                b -= 0.1 * rate * db
                # A mean moves every embedding by its small share only; longer steps make up for that.
                emb[at] -= (rate * min(len(at), 20)) * de
    model = Model(labels, (emb @ w).astype(np.float32), b)
    calibrate(model, [texts[k] for k in aside], y[aside])
    return model


def calibrate(model: Model, texts: list[str], y: np.ndarray) -> None:
    rows = [(z, c) for z, c in ((model.logits(t), c) for t, c in zip(texts, y)) if z is not None]
    if not rows:
        return
    z, c = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(c)), c] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.05, 2000, 121), key=loss))
    p = softmax(z / model.temperature)
    score, right = p.max(1), p.argmax(1) == c
    order = np.argsort(-score)
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(wrong <= RISK)
    model.threshold = float(score[order[good[-1]]]) if len(good) else 1.0


def fit_documents(docs: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    rows = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    got = sorted(labelled(rows.withColumn("text", stretch(F.col("text"), max_chars)), "lang", max_rows), key=lambda r: (str(r["doc_id"]), r["text"]))
    return fit([r["text"] for r in got], [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, rejected."""
    spark = prepare(docs.sparkSession)
    rows = narrow(docs)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = [m.predict(t.as_py()) for t in batch.column(1)]
            cols = [[g[0] for g in got], [g[1] for g in got], [g[0] == UNKNOWN or g[1] < m.threshold for g in got]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.bool_())))], names=["doc_id", "lang_pred", "score", "rejected"])

    found = rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
