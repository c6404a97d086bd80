"""Line dedup against a brute-force version: nulls, ties, repeats, long texts, hot lines, clashing names."""

import hashlib
import random
from collections import defaultdict

from palimpsest.llm import lines

SCHEMA = "doc_id long, text string, _key string, _drop int, _text string"  # columns with clashing names
SPACES = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_chars=40, min_docs=5):
    """Kept text, lines and dropped lines of each row."""
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[line.strip(SPACES).translate(LOWER)].add(i)
    keep = {k: max((d for d in docs if d is not None), default=None) for k, docs in holders.items() if len(k) >= min_chars and len(docs) >= min_docs}
    out = []
    for i, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if (k := x.strip(SPACES).translate(LOWER)) not in keep or keep[k] == i]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def rows():
    rng = random.Random(4)
    common = [f"This line is found in many documents, {n} " + "x" * n for n in range(12)]
    odd = ["é" * 40, "É" * 40, "A" * 39, "a" * 40, " \t" + "B" * 45 + "\x0b\r", "b" * 45, "\x1c" + "b" * 45, "c" * 20_000, "", " ", " " + "a" * 40, "ǅ" * 41, "ß" * 40, "x" * 40 + "\x00"]
    out = []
    for i in range(120):
        parts = [rng.choice(common + odd) for _ in range(rng.randint(0, 12))] + [f"own line {i} " * 4] * rng.randint(0, 2)
        rng.shuffle(parts)
        out.append((i, "\n".join(x.upper() if rng.random() < 0.2 and x.isascii() else x for x in parts)))
    out += [(None, None), (None, common[3]), (None, common[3]), (7, common[0] + "\n" + common[0]), (7, ""), (8, None), (5000, "\n\n"), (-3, "\n".join(common * 400))]
    out += [(2000 + i, "the very common line that a third of all documents hold\nand this" + str(i)) for i in range(80)]
    out += [(3000, common[5])] * 6 + [(4000 + i, "only four documents hold this line, so it has to stay") for i in range(4)]
    return out + [(4003, "only four documents hold this line, so it has to stay")]


def frame(spark, data):
    return spark.createDataFrame([(i, t, "x", 3, "y") for i, t in data], SCHEMA)


def test_against_brute_force(spark):
    data = rows()
    got = lines.line_digests(frame(spark, data))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(data)]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == sorted(want, key=repr)


def test_texts_and_other_columns(spark):
    data = rows()
    got = lines.drop_repeated_lines(frame(spark, data), min_chars=10, min_docs=3)
    assert got.columns == ["doc_id", "text", "_key", "_drop", "_text"]
    assert {tuple(r)[2:] for r in got.collect()} == {("x", 3, "y")}
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=repr) == sorted([(i, t if not d else k) for (i, t), (_, _, d, k) in zip(data, brute(data, 10, 3), strict=True)], key=repr)


def test_empty_table(spark):
    assert lines.line_digests(frame(spark, [])).count() == 0
    assert [tuple(r) for r in lines.line_digests(frame(spark, [(None, None)])).collect()] == [(None, 1, 0, hashlib.sha256(b"").hexdigest())]
