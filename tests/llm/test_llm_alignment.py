"""Alignment of two tokenizers against a brute-force version that encodes every text whole."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from palimpsest.llm import alignment

SCHEMA = "doc_id long, text string, _n long, _digest string, n_links string"  # columns with clashing names


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(public_tokenizers.path(alignment.FIRST))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.SECOND))


def brute(models, rows):
    """Measures of each row, from whole texts, character sets and plain loops."""
    a, b = models
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in kept} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in kept)}
    aligned = []
    for _, text in rows:
        groups = []
        if text:
            ids_a = a.encode(" " + text, add_special_tokens=False).ids
            ids_b = b.encode(text)
            raw_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
            raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                ends_a, ends_b, n = set(), set(), 0
                for r in raw_a:
                    ends_a.add(n := n + len(r))
                n = 0
                for r in raw_b:
                    ends_b.add(n := n + len(r))
                cuts = sorted(ends_a & ends_b)
                parts = {c: ([], []) for c in cuts}
                for side, (ids, raw) in enumerate(((ids_a, raw_a), (ids_b, raw_b))):
                    n, at = 0, 0
                    for i, r in zip(ids, raw, strict=True):
                        n += len(r)
                        while cuts[at] < n:
                            at += 1
                        parts[cuts[at]][side].append(i)
                groups = [parts[c] for c in cuts]
        aligned.append(groups)
    links = [Counter((x, y) for p, q in groups for x in p for y in q) for groups in aligned]
    docs = Counter(pair for doc in links for pair in doc)
    best = defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    out = []
    for (i, _), groups, doc in zip(rows, aligned, links, strict=True):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((i, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), sum(doc.values()),
                    sum(n for pair, n in doc.items() if docs[pair] == best[pair[0]]), sum(n * docs[pair] for pair, n in doc.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def texts():
    rng = random.Random(5)
    odd = ["", None, " ", "  ", "a", " a", "a ", "a  b ", "\n", "a\n b", "x\t y", "a b", "a 　b", "▁", "a▁b", "a ▁", "<|endoftext|>", "x <s> </s> <unk> <0x41>", "é" * 300,
           "日本語のテキストと中文文本", "👩‍👩‍👧 ok", "it's 'tis  don't ", "\x00\x01 \x1c \x1f a", "\x85 x\x85 y", "1234567 89,01 2.3e-5", "a" * 5000, "ab " * 4000, "z" * 70 + " q", "� ﻿",
           "\r\n \r\n", "Straße übermäßig", "x " + "é ñ" * 40, "´`  ´", "한국어 문장", "   x", "ᠠ᠎ x", "a​ b"]
    letters = "abcdeéß 日\n.,'0 9 A  \t-_▂"
    return odd + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(150)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x", "y") for i, t in rows], SCHEMA)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_against_whole_texts(spark, models):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(None, "a b"), (3, "ab ab"), (3, "ab ab"), (7, None)] + [(1000 + i, "the same text again") for i in range(300)]
    got = alignment.align_documents(frame(spark, rows))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(got) == sorted(brute(models, rows), key=repr)


def test_the_quick_encoder_is_the_same(models):
    """Random characters of all blocks, tokens side by side, and merges that overlap."""
    t = alignment._load(alignment.FIRST, alignment.SECOND)
    assert t.quick is not None
    rng = random.Random(8)
    points = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000] + [chr(rng.randrange(0x3000, 0xD800)) for _ in range(3000)]
    some = ["".join(rng.choices(points, k=rng.randint(1, 30))) for _ in range(3000)]
    spelled = [b.decode() for b in t.bytes_a if b and not any(c > 127 for c in b)]
    some += ["".join(rng.choices(spelled, k=rng.randint(1, 8))) for _ in range(6000)]
    some += ["".join(rng.choices("aab-=_ .", k=rng.randint(1, 40))) for _ in range(3000)] + [c * n for c in "a-=_ .0x*" for n in range(1, 70)]
    slow = models[0].encode_batch(some, add_special_tokens=False)
    assert [t.quick.encode_ordinary(x) for x in some if not t.unsure.search(x)] == [e.ids for x, e in zip(some, slow, strict=True) if not t.unsure.search(x)]
    assert sum(1 for x in some if t.unsure.search(x)) < 2000


def test_many_shards_and_small_chunks(spark, models, monkeypatch):
    """Pair counts in several passes give the same."""
    rows = [(i, t) for i, t in enumerate(texts())]
    monkeypatch.setattr(alignment, "SHARD", 100)
    assert len(alignment._shards(alignment.pair_counts(alignment.encoded_texts(frame(spark, rows))))) > 3
    assert rows_of(alignment.align_documents(frame(spark, rows))) == sorted(brute(models, rows), key=repr)


def test_chunks_in_a_task(models, monkeypatch):
    """Small chunks, counts handed on early, and groups whose ids are counted before they are paired."""
    rows = [(i, t) for i, t in enumerate(texts()) if t]
    monkeypatch.setattr(alignment, "HELD", 50)
    monkeypatch.setattr(alignment, "TOGETHER", 40)
    monkeypatch.setattr(alignment, "WIDE", 3)
    batch = alignment.pa.RecordBatch.from_arrays([[t for _, t in rows], [1] * len(rows), [str(i) for i, _ in rows]], ["_text", "_n", "_digest"])
    out = [r for b in alignment._encode(alignment.FIRST, alignment.SECOND)(iter([batch])) for r in b.to_pylist()]
    want = brute(models, rows)
    assert [(int(r["_digest"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in out if r["_digest"]] == [(*w[:5], w[7]) for w in want]
    once = Counter()
    for r in out:
        if r["pair"] is not None:
            once[r["pair"]] += r["docs"]
    monkeypatch.undo()
    whole = [r for b in alignment._encode(alignment.FIRST, alignment.SECOND)(iter([batch])) for r in b.to_pylist() if r["pair"] is not None]
    assert once == Counter({r["pair"]: r["docs"] for r in whole})


def test_empty_table(spark):
    assert alignment.align_documents(frame(spark, [])).count() == 0
    assert rows_of(alignment.align_documents(frame(spark, [(1, None), (None, "")]))) == sorted([(1, *[0] * 6, ""), (None, *[0] * 6, "")], key=repr)


def test_query_on_the_table(spark, models):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(alignment.QUERIES["op12_alignment"](spark, sf)) == sorted(brute(models, rows), key=repr)
