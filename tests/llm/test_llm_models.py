"""Language, toxicity, tokenising, search: held-out accuracy, the library, brute force."""

import hashlib
import random
from importlib import import_module

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import language, linear, neighbours, pieces, toxicity

SF = "/root/testdata/sf0.01"


def test_logistic_separates():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 30)).astype(np.float32)
    y = (x[:, :2] @ np.array([[1.0, -1], [1, 1]]) > 0.3).astype(float)
    w, b = linear.logistic(x[:300], y[:300], steps=300)
    assert (((x[300:] @ w + b) > 0) == (y[300:] > 0)).mean() > 0.93


# --- language -----------------------------------------------------------------

@pytest.mark.parametrize("n", [2, 3, 4, 6, 9, 20])
def test_codewords_are_apart(n):
    code = language.codewords(n).astype(int)
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= (1 if n == 2 else max(2, code.shape[1] // 4)) and set(np.unique(code)) <= {-1, 1}


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.QUERIES["op5_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97


def test_language_edges(spark):
    rng = random.Random(1)
    rows = []
    for i in range(160):
        lang, letters = (("aa", "abcdef"), ("bb", "uvwxyz"))[i % 2]
        rows.append((i, " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(12)), lang, "old"))
    rows += [(900, None, "aa", "old"), (901, "", None, "old"), (902, "12 34 -- !", "bb", "old"), (903, "ABC FED", None, "old"), (None, "xyz uvw", "bb", "old"),
             (904, "uvw " * 200_000, None, "old"), (905, "uvw xyz", None, "old"), (905, "uvw xyz", None, "old")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.fit(docs)
    out = language.identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "ambiguous"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.select("doc_id", "lang_pred", "score").collect()}
    assert [got[i] for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert [got[i][0] for i in (903, None, 904, 905)] == ["aa", "bb", "bb", "bb"]
    assert all(got[i][0] == ("aa", "bb")[i % 2] for i in range(160))
    kept = language.confident(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    empty = docs.limit(0)
    assert language.fit(empty) is None and language.identify(empty, None).count() == 0
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows = [(i, "abc abd" if i % 2 else "xyz xyw", "a" if i % 2 else "b") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = language.held_out(F.col("doc_id"))
    wrong = docs.withColumn("lang", F.when(held, "c").otherwise(F.col("lang")))
    assert language.fit(wrong).languages == ["a", "b"]
    assert language.fit(docs, rows=2).languages == ["a", "b"]


# --- toxicity -----------------------------------------------------------------

def test_chain_feeds_probabilities_on():
    """The second category follows from the first one's two words together: only the chain can tell it by them alone."""
    rng = np.random.default_rng(3)
    rows, y = [], []
    for _ in range(900):
        words = rng.choice(np.arange(100, 400, dtype=np.uint64), 12, replace=False)
        first = rng.random() < 0.4
        if first:
            words[0] = rng.integers(1, 12)
        rows.append(np.unique(words))
        y.append((first, first))
    chain = toxicity.fit_chain(rows[:600], np.array(y[:600], dtype=float), ["a", "b"])
    assert chain.weights[1].shape[0] == len(chain.features) + 1 and chain.weights[1][-1] > 0
    owner = np.repeat(np.arange(300), [len(r) for r in rows[600:]])
    p = chain.predict(chain.matrix(owner, np.concatenate(rows[600:]), 300))
    assert ((p > 0.5) == np.array(y[600:])).mean() > 0.97


def test_toxic_words_and_edges(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(600):
        w = [rng.choice(vocab) for _ in range(30)]
        if i % 4 == 0:
            w[rng.randrange(30)] = rng.choice(["zozo", "ZAZA,", "zykkel" + rng.choice(vocab)])
        docs.append((i, " ".join(w), "old"))
        if i < 400:
            labels.append((i, 1, int(i % 4 == 0)))
    docs += [(900, None, "old"), (901, "", "old"), (902, "zozo " + "abc " * 300_000, "old"), (903, "zykkelnew", "old"), (None, "zaza", "old"), (904, "zozo", "old"), (904, "zozo", "old")]
    labels += [(1, 1, 0), (2, None, 1), (None, 1, 1), (9999, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, p_toxic string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.toxic_documents(d, lab).collect()}
    assert all(got[i] == (i % 4 == 0) for i in range(400, 600))
    assert (got[900], got[901], got[902], got[903], got[None], got[904]) == (False, False, True, True, True, True)
    assert toxicity.toxic_documents(d, lab).count() == len(docs)
    assert toxicity.toxic_documents(d.limit(0), lab).count() == 0
    assert not any(r.toxic for r in toxicity.toxic_documents(d, lab.limit(0)).collect())


def test_toxicity_on_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    got = toxicity.QUERIES["op1_toxicity"](spark, SF)
    both = got.join(labels, "doc_id").toPandas()
    assert got.count() == 1000 and (both["toxic"].astype(int) == both["label"]).mean() > 0.98


def test_toxicity_of_new_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    new = toxicity.toxic_documents(docs, labels.where(half)).join(labels.where(~half).select("doc_id", F.col("toxic").alias("label")), "doc_id").toPandas()
    assert (new["toxic"].astype(int) == new["label"]).mean() > 0.99 and new[new["label"] == 1]["toxic"].mean() > 0.9


# --- pieces -------------------------------------------------------------------

@pytest.fixture(scope="module")
def sp():
    return pieces.Pieces(import_module("public_tokenizers").path(pieces.MODEL))


PARTS = ["a", "b", " ", "  ", "\n", "\t", "▁", "é", "中", "😀", "1", "23", "<s>", "<0x0A>", "\0", "　", "the", " the", "﻿", "´", "ing", "ation"]


def test_encoding_is_the_library_s(sp, spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["x" * 5000, " " * 3000, "ab" * 4000, "中文" * 900]
    for t in texts:
        ids = sp.encode(t)
        assert ids == [1, *sp.library.encode(t), 2] and sp.decode(ids) == sp.library.decode(ids)


def test_decoding_any_ids_is_the_library_s(sp):
    rng = random.Random(2)
    for _ in range(6000):
        ids = [rng.choice([1, 2, 0, 3, 13, 28705, 264, 258, 200, 198, 130, 131, 229, 187, 176, 243, 162, 151]) for _ in range(rng.randint(0, 9))]
        assert sp.decode(ids) == sp.library.decode(ids), ids


def test_token_digests(spark, sp):
    rows = [(1, None, 5), (2, "", 5), (3, "Hello world", 5), (3, "Hello world", 5), (None, "x y", 5), (4, "long " * 100_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = pieces.token_digests(docs, check_every=1)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for i, t, _ in rows:
        ids = [1, *sp.library.encode(t or ""), 2]
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.library.decode(ids).encode()).hexdigest()))
    assert sorted([tuple(r) for r in got.collect()], key=repr) == sorted(want, key=repr)
    back = pieces.decode(pieces.encode(docs), ids="ids")
    assert sorted([r.text for r in back.collect()]) == sorted((t or "") for _, t, _ in rows)
    assert pieces.token_digests(docs.limit(0)).count() == 0


# --- neighbours ---------------------------------------------------------------

def brute(rows, k):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ok = list({(i, tuple(v)): (i, v) for i, v in ok}.values())
    out = []
    for i, q in ok:
        if i % 20 == 0:
            others = sorted((-float((v * q).sum()), j) for j, v in ok if j != i and len(v) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(others[:k])]
    return sorted(out)


def test_nearest_with_edges(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 8)
    monkeypatch.setattr(neighbours, "SIGMAS", 6.0)  # exact but for one in a billion
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(12).round(3).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(90)] + [(20, rows[20][1])]  # one very common vector, a repeated row
    rows += [(2000, None), (2001, []), (2020, [0.0] * 12), (2040, [float("nan")] + [1.0] * 11), (2060, [None] + [1.0] * 11), (2080, [float("inf")] + [1.0] * 11),
             (None, [1.0] * 12), (2100, [1.0, 2.0]), (2120, [3.0, -1.0]), (2140, [-0.0] + [1.0] * 11)]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = sorted(tuple(r) for r in neighbours.search(vectors, F.col("vec_id") % 20 == 0).collect())
    want = brute(rows, 20)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)
    assert neighbours.search(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in vectors.collect()]
    want = {(w[0], w[2]) for w in brute(rows, 20)}
    got = neighbours.QUERIES["op8_nearest"](spark, "/root/testdata/sf0.1").collect()
    assert len(got) == len(want) and len({(r.query_id, r.vec_id) for r in got} & want) >= 0.97 * len(want)


def test_error_bounds_hold():
    rng = np.random.default_rng(6)
    x, q, turn = rng.standard_normal((500, 64)), rng.standard_normal((20, 64)), neighbours.rotations(64)
    codes = neighbours.Codes.of(x, x.mean(axis=0), turn)
    guess, off = codes.estimate(q, x.mean(axis=0), turn)
    assert codes.bits.shape == (500, 32)
    away = np.abs(guess - q @ x.T) / off
    assert (away < neighbours.SIGMAS).mean() > 0.97 and away.mean() > 0.3
