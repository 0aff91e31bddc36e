"""Quality classifier: hashed word n-grams, logistic regression trained by FTRL-proximal, sparse dot products.

A text's tokens are runs of letters and digits, and runs of marks, with their
case. Features are n-grams of tokens (n 1 and 2) and of token shapes (n 1 to 3; shape: word or mark, first letter
and whole word upper case or not, same as the token before or two before),
hashed into ``2**BITS`` weights. A feature's value is its share among the n-grams of
its family times ``SCALE``, so a score is a sum of weights over the whole text however long.

Training takes at most ``TRAIN_ROWS`` labelled rows, those with the smallest
hash of their id, in ``SHARDS`` shards; each shard's learner makes
``EPOCHS`` passes with per-coordinate rates, L1 and L2, and the shards' weights are averaged.
Only weights (``SHARDS`` x ``2**BITS`` numbers) reach the driver.

Defined cases: null and empty texts have only the bias and get its score; without any usable
label every score is 0.5; rows with a null doc_id are scored and count as not
held out; labels that are null or of unknown documents are ignored; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm import jobs
from plinth.llm.kernels import U64, WORDS_AND_MARKS, Tokens, mix, runs, text_chunks

BITS = 18
TRAIN_ROWS = 16_000
SHARDS = 8
EPOCHS = 3
SCALE = 24.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
THRESHOLD = 0.3
_FAMILIES = 5


def features(data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family: (row, weight index) of every n-gram of every text of a chunk."""
    t = Tokens(data, offs, WORDS_AND_MARKS, lower=False)
    h = t.hashes()
    upper = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 65) & (data <= 90), out=upper[1:])
    ups, n = upper[t.end] - upper[t.start], t.end - t.start
    shape = t.kind.astype(U64) + U64(3) * (ups == n) + U64(6) * ((ups > 0) & (data[t.start] >= 65) & (data[t.start] <= 90)) + U64(12) * ((t.kind == 2) & (n > 1))
    for gap in (1, 2):
        again = np.zeros(len(h), bool)
        again[gap:] = h[gap:] == h[:-gap]
        shape += U64(12 * 2 * gap) * again
    shape = mix(shape, 3)
    out = []
    for family, (x, k) in enumerate(((h, 1), (h, 2), (shape, 1), (shape, 2), (shape, 3))):
        g = runs(x, k, 1000 * family)
        m = len(g)
        whole = t.doc[:m] == t.doc[k - 1 : k - 1 + m]
        out.append((t.doc[:m][whole], (g[whole] >> U64(64 - BITS)).astype(np.int64)))
    return out


def margins(data: np.ndarray, offs: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The sparse dot product of each text with the weights; the last weight is the bias."""
    rows = len(offs) - 1
    total = np.full(rows, w[-1])
    for doc, at in features(data, offs):
        total += SCALE * np.bincount(doc, w[at], rows) / np.maximum(1, np.bincount(doc, minlength=rows))
    return total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes of follow-the-regularised-leader over (indices, values, label)."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, y in examples:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = (_sigmoid(w @ x) - y) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    return weights(z, n)


def _train(table: pa.Table) -> pa.Table:
    table = table.sort_by([("turn", "ascending"), ("doc_id", "ascending"), ("y", "ascending")])
    ys = table.column("y").to_pylist()
    examples = []
    for a, b, data, offs in text_chunks(table.column("text")):
        found = features(data, offs)
        cuts = [np.searchsorted(doc, np.arange(b - a + 1)) for doc, _ in found]
        for d in range(b - a):
            at, x = [np.array([1 << BITS])], [np.ones(1)]
            for (_, index), c in zip(found, cuts, strict=True):
                own = index[c[d] : c[d + 1]]
                if len(own):
                    u, k = np.unique(own, return_counts=True)
                    at.append(u)
                    x.append(SCALE * k / len(own))
            u, inv = np.unique(np.concatenate(at), return_inverse=True)
            examples.append((u, np.bincount(inv, np.concatenate(x)), ys[a + d]))
    return pa.table({"w": pa.array([ftrl(examples).tolist()], pa.list_(pa.float64()))})


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learned from ``labels(doc_id, quality)``, at most ``train_rows`` of them."""
    jobs.small_batches(docs.sparkSession)
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y", F.xxhash64("doc_id", F.lit("turn")).alias("turn"))
    learned = rows.groupBy(F.pmod(F.col("turn"), F.lit(SHARDS)).alias("shard")).applyInArrow(lambda t: _train(t.drop_columns(["shard"])) if "shard" in t.column_names else _train(t), "w array<double>").collect()
    return np.mean([np.array(r.w) for r in learned], axis=0) if learned else np.zeros((1 << BITS) + 1)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [margins(data, offs, shared.value) for _, _, data, offs in text_chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(np.concatenate(parts)) if parts else np.zeros(0))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learned from the labels of those that are not held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    weights = fit(docs, labels.where(~held))
    return score(docs, weights).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``threshold`` or more."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.where(~held)))
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in text_chunks(batch.column(text)):
                yield batch.slice(a, b - a).filter(pa.array(_sigmoid(margins(data, offs, shared.value)) >= threshold))

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns)
