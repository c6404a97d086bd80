"""Toxicity: chains of linear classifiers over hashed words, fitted with out-of-fold predictions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from palimpsest.llm.common import registry, smallest, table
from palimpsest.llm.linear import folds, logistic, sigmoid
from palimpsest.llm.words import SYMBOLS, mix, slices, word_hashes

QUERIES, SQL, query = registry()

#: Labelled rows that the chain is fitted on at most: so many of each combination of labels, together TRAIN_ROWS.
TRAIN_ROWS = 6000
#: Features kept: those that tell a category best, in at least LEAST of the fitted rows.
FEATURES, LEAST = 1500, 4
#: A feature must differ between the two kinds of rows by this chi-square at least (one in a thousand by chance).
SURE = 10.83
#: Leading bytes of longer words that count as features besides the whole words.
PREFIXES = (4, 5, 6)
FOLDS = 4


def _row_features(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and feature hashes of all words of a batch, with repeats."""
    hashes, bounds, _, heads = word_hashes(batch.column(column), SYMBOLS, PREFIXES)
    rows = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
    keep = [h != 0 for h in heads]
    return np.concatenate([rows, *[rows[k] for k in keep]]), np.concatenate([hashes, *[h[k] for h, k in zip(heads, keep, strict=True)]])


@dataclass
class Chain:
    """A linear model per category; each also reads the probabilities of the categories before it."""

    categories: list[str]
    features: np.ndarray
    weights: list[np.ndarray]
    intercepts: list[float]
    thresholds: list[float]

    def __post_init__(self):
        self.order = np.argsort(self.features)
        self.sorted = self.features[self.order]
        self.marks = np.zeros(1 << 16, dtype=bool)
        self.marks[(self.sorted & np.uint64(0xFFFF)).astype(np.int64)] = True

    def matrix(self, rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
        """Presence of the features in ``n`` rows."""
        x = np.zeros((n, len(self.features)), dtype=np.float32)
        if len(self.features):
            may = self.marks[(hashes & np.uint64(0xFFFF)).astype(np.int64)]
            rows, hashes = rows[may], hashes[may]
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            hit = self.sorted[at] == hashes
            x[rows[hit], self.order[at[hit]]] = 1
        return x

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, a column a category, in the order of the chain."""
        out = np.zeros((len(x), len(self.categories)), dtype=np.float32)
        for c, (w, b) in enumerate(zip(self.weights, self.intercepts, strict=True)):
            out[:, c] = sigmoid(np.hstack([x, out[:, :c]]) @ w + b)
        return out.astype(np.float64)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on to say yes: it gives the best F1, in the middle of the gap below it; one half if all are alike."""
    order = np.argsort(-p, kind="stable")
    ones = y.sum()
    if not 0 < ones < len(y):
        return 0.5
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + ones)
    f1[:-1][p[order][:-1] == p[order][1:]] = -1  # equal ones go together
    at = int(np.argmax(f1))
    below = float(p[order][at + 1]) if at + 1 < len(y) else 0.0
    return (float(p[order][at]) + below) / 2


def fit_chain(rows: list[np.ndarray], y: np.ndarray, categories: Sequence[str]) -> Chain:
    """Fit on the distinct feature hashes of some rows and their 0/1 labels (a column a category)."""
    n = len(rows)
    found, place = np.unique(np.concatenate(rows), return_inverse=True) if n else (np.zeros(0, np.uint64), np.zeros(0, int))
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    df = np.bincount(place, minlength=len(found)).astype(float)
    chosen: set[int] = set()
    for c in range(y.shape[1]):
        ones = np.bincount(place, weights=y[owner, c], minlength=len(found))
        total = max(float(y[:, c].sum()), 1.0)
        p1, p0 = (ones + 0.5) / (total + 1), (df - ones + 0.5) / (n - total + 1)
        told = np.abs(np.log(p1 / p0)) * np.abs(p1 - p0)
        share = df / max(n, 1)
        sure = (p1 - p0) ** 2 >= SURE * share * (1 - share) * (1 / max(total, 1) + 1 / max(n - total, 1))
        told[(df < LEAST) | ~sure] = 0
        best = np.argsort(-told, kind="stable")[: FEATURES // y.shape[1]]
        chosen.update(best[told[best] > 0].tolist())
    keep = np.array(sorted(chosen), dtype=int)
    chain = Chain(list(categories), found[keep] if len(keep) else found[:0], [], [], [])
    x = chain.matrix(owner, found[place] if n else found, n)
    fold = folds(n, FOLDS)
    earlier = np.zeros((n, 0), dtype=np.float32)
    for c in range(y.shape[1]):
        xc = np.hstack([x, earlier])
        if n == 0 or y[:, c].min() == y[:, c].max():
            chain.weights.append(np.zeros(xc.shape[1], np.float32))
            chain.intercepts.append(20.0 if n and y[0, c] else -20.0)
            out = y[:, c].astype(np.float32)
        else:
            gram = xc @ xc.T
            w, b = logistic(xc, y[:, c], l2=1e-4, steps=300, balanced=False, gram=gram)
            chain.weights.append(w[:, 0])
            chain.intercepts.append(float(b[0]))
            out = np.zeros(n, dtype=np.float32)
            for f in range(FOLDS):
                a, o = fold != f, fold == f
                w, b = logistic(xc[a], y[a, c], l2=1e-4, steps=200, balanced=False, gram=gram[np.ix_(a, a)])
                out[o] = sigmoid(xc[o] @ w + b)[:, 0]
        chain.thresholds.append(best_threshold(out, y[:, c]))
        earlier = np.hstack([earlier, out[:, None]])  # what later models see is out of fold, as it will be of new rows
    return chain


def fit(docs: DataFrame, labels: DataFrame, categories: dict, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Chain:
    """Fit on at most ``rows`` labelled documents, those with the smallest hash of the key, alike of each combination of labels.

    ``categories`` maps names to 0/1 conditions over ``labels``, in the order
    of the chain.  Rows with a null label are left out.
    """
    names = list(categories)
    tags = labels.select(F.col(key).alias("_key"), *[c.cast("int").alias(n) for n, c in categories.items()]).dropna().dropDuplicates(["_key"])
    share = max(1, rows // 2 ** len(names))
    place = W.partitionBy(*names).orderBy("_hash", "_key")
    tags = smallest(tags.withColumn("_hash", F.xxhash64("_key")), names, "_hash", share).withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= share).drop("_place", "_hash")
    sample = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(tags), "_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                owner, hashes = _row_features(part, 1)
                order = np.argsort(owner, kind="stable")
                cut = np.searchsorted(owner[order], np.arange(part.num_rows + 1))
                lists = [np.unique(hashes[order[a:b]]).view(np.int64) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(lists, pa.list_(pa.int64()))], names=["_key", *names, "f"])

    schema = T.StructType([sample.schema[0], *[T.StructField(n, T.IntegerType()) for n in names], T.StructField("f", T.ArrayType(T.LongType()))])
    got = sample.select("_key", "_text", *names).mapInArrow(run, schema).toArrow().to_pandas()
    got = got.sort_values("_key", kind="stable").drop_duplicates("_key").reset_index(drop=True)
    order = np.argsort(mix(got["_key"].to_numpy().astype(np.int64).view(np.uint64)), kind="stable") if len(got) else []
    got = got.iloc[order]
    return fit_chain([np.asarray(f).view(np.uint64) for f in got["f"]], got[names].to_numpy(dtype=float).reshape(len(got), len(names)), names)


def classify(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``docs`` with a probability ``p_<category>`` per category (replaced if there); a null text is an empty one.

    Whole texts in Arrow batches, without an exchange.
    """
    added = [f"p_{c}" for c in chain.categories]
    docs = docs.drop(*added)
    at = docs.columns.index(text)
    out = T.StructType([*docs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in added]])
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, at):
                owner, hashes = _row_features(part, at)
                order = np.argsort(owner, kind="stable")
                owner, hashes = owner[order], hashes[order]
                p = np.zeros((part.num_rows, len(added)))
                for a in range(0, part.num_rows, 1000):
                    b = min(part.num_rows, a + 1000)
                    i, j = np.searchsorted(owner, [a, b])
                    p[a:b] = model.predict(model.matrix(owner[i:j] - a, hashes[i:j], b - a))
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(p[:, c]) for c in range(len(added))]], names=out.names)

    return docs.mapInArrow(run, out)


def label_categories() -> dict:
    """Categories of the ``labels`` table: poor quality, toxicity, and toxicity in a good text."""
    poor, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return {"low_quality": poor, "toxic": toxic, "toxic_prose": toxic & ~poor}


def toxic_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float | None = None) -> DataFrame:
    """``key, toxic`` and a probability per category of every document; ``threshold`` None: the one with the best F1 out of fold."""
    chain = fit(docs, labels, label_categories(), key, text)
    out = classify(docs.select(key, text), chain, text).drop(text)
    threshold = chain.thresholds[chain.categories.index("toxic")] if threshold is None else threshold
    return out.select(key, (F.col("p_toxic") >= threshold).alias("toxic"), *[f"p_{c}" for c in chain.categories])


@query("op1_toxicity")
def toxicity(spark, sf):
    return toxic_documents(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"))
