"""Language identification with error-correcting output codes over binary n-gram classifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from palimpsest.llm.common import registry, smallest, table
from palimpsest.llm.linear import dual_logistic, folds
from palimpsest.llm.words import raw

QUERIES, SQL, query = registry()

#: Rows that the classifiers are fitted on at most, and languages that are learned at most (those with most rows).
TRAIN_ROWS, LANGUAGES = 2400, 64
DIMENSIONS = 1 << 13
#: Ambiguous: the second-best codeword's loss is within this of the best one's.
AMBIGUOUS = 0.02
_LETTER = re.compile(r"[^\W\d_]")
_PIECE = 1 << 20


def held_out(key: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the key as text is 2 modulo 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(data: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Hashed counts of the byte runs of 1 to 4 in a text (A-Z folded), logarithmic and of length 1."""
    counts = np.zeros(dimensions, dtype=np.int64)
    shift = np.uint32(32 - int(dimensions).bit_length() + 1)
    for at in range(0, len(data), _PIECE):
        x = data[max(0, at - 3):at + _PIECE].astype(np.uint32)
        x += np.where((x >= 65) & (x <= 90), np.uint32(32), np.uint32(0))
        skip = min(3, at)
        run = x
        with np.errstate(over="ignore"):
            for n in range(1, 5):
                if n > 1:
                    if len(x) < n:
                        break
                    run = (run[:-1] << np.uint32(8)) | x[n - 1:]
                first = max(0, skip - n + 1)
                h = ((run[first:] * np.uint32(2654435761)) ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2246822519)
                counts += np.bincount(h >> shift, minlength=dimensions)
    out = np.log1p(counts).astype(np.float32)
    norm = float(np.linalg.norm(out))
    return out / norm if norm else out


def codewords(classes: int, seed: int = 5) -> np.ndarray:
    """A code of +1 and -1, a row a class: every split of up to 6 classes, else the best of many random codes."""
    if classes <= 1:
        return np.ones((classes, 1), dtype=np.int8)
    if classes <= 6:
        columns = [[1, *[1 if j >> i & 1 else -1 for i in range(classes - 1)]] for j in range(2 ** (classes - 1) - 1)]
        return np.array(columns, dtype=np.int8).T
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = max(15, int(np.ceil(10 * np.log2(classes))))
    for _ in range(300):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(classes, bits))
        apart = (bits - code.astype(int) @ code.T.astype(int)) // 2
        least = int(apart[~np.eye(classes, dtype=bool)].min())
        if least > far and (np.abs(code.sum(axis=0)) < classes).all():
            best, far = code, least
    return best


@dataclass
class LanguageModel:
    """What is learned: languages, code (a row a language), weights of the bits, and each bit's standing per language."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    intercepts: np.ndarray
    standing: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of each row of ``x`` to each codeword."""
        margins = np.clip(x @ self.weights + self.intercepts, -20, 20)
        return np.stack([np.log1p(np.exp(-margins * c)) @ s for c, s in zip(self.code, self.standing, strict=True)], axis=1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score between 0 and 1, and whether it is ambiguous, per row."""
        loss = self.losses(x)
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        low = loss[np.arange(len(loss)), best]
        p = np.exp(-(loss - low[:, None]) * self.code.shape[1])
        score = 1.0 / p.sum(axis=1)
        close = loss[np.arange(len(loss)), order[:, 1]] - low < AMBIGUOUS if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return best, score, close


def _products(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Inner products of sparse rows, a range of dimensions at a time."""
    out, width = np.zeros((len(rows), len(rows)), dtype=np.float32), 1024
    for low in range(0, DIMENSIONS, width):
        part = np.zeros((len(rows), width), dtype=np.float32)
        for i, (at, value) in enumerate(rows):
            a, b = np.searchsorted(at, (low, low + width))
            part[i, at[a:b] - low] = value[a:b]
        out += part @ part.T
    return out


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], y: list[str]) -> LanguageModel:
    """Fit on the features (places and values) and languages of a few thousand rows."""
    names = sorted(set(y))
    code = codewords(len(names))
    number = {v: i for i, v in enumerate(names)}
    kinds = np.array([number[v] for v in y])
    bits = (code[kinds] > 0).astype(np.float32)
    standing = np.ones(code.shape)
    gram, k = _products(rows), 3
    if len(names) > 1 and len(y) >= 4 * k:
        fold, right = folds(len(y), k), np.zeros(bits.shape, dtype=bool)
        for f in range(k):
            known, new = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            a, b = dual_logistic(gram[np.ix_(known, known)], bits[known], l2=1e-6, steps=100)
            right[new] = ((gram[np.ix_(new, known)] @ a + b) > 0) == (bits[new] > 0)
        for c in range(len(names)):
            standing[c] = np.maximum(right[kinds == c].mean(axis=0), 1e-3)
    standing /= standing.sum(axis=1, keepdims=True)
    a, b = dual_logistic(gram, bits, l2=1e-6, steps=200)
    weights = np.zeros((DIMENSIONS, code.shape[1]), dtype=np.float32)
    for (at, value), factor in zip(rows, a, strict=True):
        weights[at] += value[:, None] * factor
    return LanguageModel(names, code, weights, b, standing)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", rows: int = TRAIN_ROWS,
        languages: int = LANGUAGES) -> LanguageModel | None:
    """Learn from at most ``rows`` different labelled texts, as many of each language as there are, up to its share.

    Held-out rows, null texts and null labels are left out.  The sample is the
    one with the smallest hashes of text, so reruns agree.  None if there is
    nothing to learn from.
    """
    train = docs.where(~held_out(F.col(key)) & F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}"))
    distinct = train.groupBy(F.col(label).alias("_lang"), F.xxhash64(text).alias("_hash")).agg(F.min(key).alias("_key"))
    known = [r._lang for r in distinct.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(languages).collect()]
    if not known:
        return None
    place = W.partitionBy("_lang").orderBy("_hash")
    share = max(1, rows // len(known))
    near = smallest(distinct.where(F.col("_lang").isin(known)), ["_lang"], "_hash", share)
    chosen = near.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= share)
    texts = train.select(F.col(key).alias("_key"), F.col(label).alias("_lang"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    sample = texts.join(F.broadcast(chosen.select("_key", "_lang", "_hash")), ["_key", "_lang", "_hash"]).select("_hash", "_lang", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(2))
            at, value = [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                f = features(data[a:b])
                at.append(np.flatnonzero(f).astype(np.int32))
                value.append(f[at[-1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], names=["_hash", "_lang", "at", "value"])

    got = sample.mapInArrow(run, "_hash long, _lang string, at array<int>, value array<float>").toArrow()
    order = np.lexsort((np.array(got["_lang"].to_pylist()), got["_hash"].to_numpy()))
    langs, at, value = got["_lang"].to_pylist(), got["at"].combine_chunks(), got["value"].combine_chunks()
    hashes, rows_, y, seen = got["_hash"].to_pylist(), [], [], set()
    for i in map(int, order):
        if (hashes[i], langs[i]) not in seen:  # rows that repeat key and text count once
            seen.add((hashes[i], langs[i]))
            rows_.append((at[i].values.to_numpy(), value[i].values.to_numpy()))
            y.append(langs[i])
    return fit_rows(rows_, y)


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, score, ambiguous`` (replaced if there), in Arrow batches, without an exchange.

    ``lang_pred`` is the language with the nearest codeword, ``und`` with
    score 0 where the text is null or has no letter, or nothing was learned.
    ``score`` is the softmax of the negative losses.  ``ambiguous`` marks
    texts for which a second codeword is about as near.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    at = docs.columns.index(text)
    out = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                        T.StructField("ambiguous", T.BooleanType())])
    names = model.languages if model else []
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column(at)
            data, offsets = raw(column)
            n = batch.num_rows
            ok = np.array([bool(v.is_valid and _LETTER.search(v.as_py())) for v in column], dtype=bool) & (m is not None)
            best, score, close = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
            for part in np.array_split(np.flatnonzero(ok), max(1, -(-int(ok.sum()) // 256))):
                if len(part):
                    x = np.stack([features(data[offsets[i]:offsets[i + 1]]) for i in part])
                    best[part], score[part], close[part] = m.predict(x)
            said = pa.array([names[b] if k else "und" for b, k in zip(best, ok, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, said, pa.array(score), pa.array(close)], names=out.names)

    return docs.mapInArrow(run, out)


def confident(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language can be told: neither ``und`` nor ambiguous; columns as they are."""
    model = fit(docs, key, text, label)
    names = [f"_{i}" for i in range(len(docs.columns))]  # none clashes with what is added
    told = identify(docs.toDF(*names), model, names[docs.columns.index(text)])
    return told.where("lang_pred <> 'und' and not ambiguous").select(*names).toDF(*docs.columns)


@query("op5_language_id")
def language_id(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = fit(docs)
    out = identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return out.drop("text")
