"""Words, components, exact and near duplicates, passages: against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import common, exact, jaccard, passages, words

SCHEMA = "doc_id long, text string, keep_id string, _n long"  # columns with clashing names


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA)


def vocabulary(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def test_words_match_the_pattern():
    texts = ["Ab cd\tEF  gh", None, "", "  x ", "ab CD ef gh", "é" * 5 + " y", "w" * 700_000 + " ab " + "q " * 400_000, "a b\x1fc\x0bd"]
    h, bounds, starts, _ = words.word_hashes(pa.array(texts, pa.string()))
    want = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


def test_shingles_of_rows():
    h, bounds, _, _ = words.word_hashes(pa.array(["a b c d e", "a b", "", "x a b c d"]))
    rows = list(words.row_shingles(h, bounds, 4))
    assert [len(r) for r in rows] == [2, 1, 0, 2] and rows[0][0] == rows[3][1]


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(5, 5), (None, 1), (400, 401), (400, 401)] + [(i, i + 1) for i in range(500, 540)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = common.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {x: find(x) for x in parent}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        won = False
        for i, t in members:
            kept = not won and i == best[0] and len(t) == len(best[1])
            won |= kept
            out.append((i, best[0], len(members), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


EXACT = [(3, "a b"), (1, "ab"), (2, " ab "), (4, None), (5, ""), (6, " \t\n"), (7, "x" * 50_000), (8, "x" * 50_000), (9, "É  é"), (9, "É  é"), (9, "É  é"),
         (None, "zz"), (None, "zz"), (10, "zz"), (-5, "q"), (-6, "q"), (2**63 - 1, "w"), (-(2**63), "w"), (11, "a b"), (12, "once")]


@pytest.mark.parametrize("digest", [exact.sha256, lambda c: exact.F.substring(exact.sha256(c), 1, 1)], ids=["sha", "colliding"])
def test_exact_groups(spark, digest):
    rows = EXACT + [(100 + i, "same " + " " * (i % 3)) for i in range(40)]
    got = [tuple(r) for r in exact.exact_groups(frame(spark, rows), digest=digest).collect()]
    if digest is not exact.sha256:
        got = [(*g[:4], None) for g in got]
        assert sorted(got, key=repr) == sorted([(*b[:4], None) for b in exact_brute(rows)], key=repr)
    else:
        assert sorted(got, key=repr) == exact_brute(rows)


def test_exact_deduplicate(spark):
    kept = exact.deduplicate(frame(spark, EXACT)).collect()
    want = [(b[0]) for b in exact_brute(EXACT) if b[3]]
    assert sorted([r.doc_id for r in kept], key=repr) == sorted(want, key=repr)
    assert kept[0].asDict().keys() == {"doc_id", "text", "keep_id", "_n"}
    assert exact.exact_groups(frame(spark, [])).count() == 0 and exact.deduplicate(frame(spark, [])).count() == 0


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def jaccard_brute(rows, k, percent):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted([(i, len(s), find(i) if i is not None else None) for i, s in sets], key=repr)


def near_copies(seed, bases=12, copies=14):
    """Families of texts with edits of all sizes around the threshold, chains among them."""
    rng, vocab, rows = random.Random(seed), vocabulary(400, seed), []
    common_line = " ".join(rng.choice(vocab) for _ in range(9))
    for b in range(bases):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 4, 6, 30, 60, 120]))]
        last = base
        for _ in range(copies):
            w = list(rng.choice([base, last]))
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            last = w
            rows.append((rng.choice([" ", "\n"]).join(w) + (f" {common_line}" if rng.random() < 0.3 else "")))
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(900, None), (901, ""), (902, "  "), (None, rows[0]), (903, rows[0].upper()), (904, "a"), (905, "A"), (5, rows[5])]


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 5, 80), (3, 1, 60)])
def test_jaccard_components(spark, seed, k, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_ELEMENTS", 300)  # several blocks
    monkeypatch.setattr(jaccard, "GROUP_MEMBERS", 7)
    rows = near_copies(seed)
    got = jaccard.similar_groups(frame(spark, rows), shingle=k, percent=percent)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == jaccard_brute(rows, k, percent)


@pytest.mark.parametrize("share", [0, 1 << 40])
def test_jaccard_entries_are_exchanged_once(spark, share, monkeypatch):
    """With no element hot, and with all that repeat; entries are not written."""
    rnd, written = random.Random(share), []
    monkeypatch.setattr(jaccard, "HOT_SHARE", share)
    monkeypatch.setattr(jaccard, "materialize", lambda df, name: written.append(name) or common.materialize(df, name))
    base = [[f"w{rnd.randrange(60)}" for _ in range(30)] for _ in range(12)]
    rows = [(i, " ".join(w if rnd.random() > 0.02 else "x" for w in base[i % 12])) for i in range(120)] + [(None, " ".join(base[0])), (500, None), (501, "a b")]
    got = jaccard.similar_groups(frame(spark, rows), shingle=3, percent=70)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == jaccard_brute(rows, 3, 70)
    assert "jaccard-pairs" in written and "jaccard-entries" not in written


def test_jaccard_edges(spark):
    assert jaccard.similar_groups(frame(spark, [])).count() == 0
    rows = near_copies(4, 3, 5)
    kept = jaccard.one_of_each(frame(spark, rows), shingle=5, percent=80)
    want = [i for i, _, c in jaccard_brute(rows, 5, 80) if i is None or i == c]
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted(want, key=repr) and kept.columns == ["doc_id", "text", "keep_id", "_n"]


def test_jaccard_lists_find_all():
    rng = np.random.default_rng(2)
    leader = np.sort(rng.choice(10**6, 80, replace=False)).astype(np.int64)
    sets = []
    for _ in range(120):
        keep = leader[rng.random(80) > rng.choice([0.02, 0.1, 0.3])]
        sets.append(np.unique(np.concatenate([keep, rng.choice(10**6, rng.integers(0, 9))])))
    overlap = np.array([len(np.intersect1d(s, leader)) for s in sets])
    lists = jaccard.Lists(sets, overlap, 85)
    for s, o in zip(sets, overlap, strict=True):
        got = sorted(int(x) for part in lists.similar(s, leader, int(o)) for x in part)
        want = [i for i, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 85 * len(np.union1d(s, t))]
        assert got == want


def long_copies(words_, changed, seed=11):
    """A text of so many different words, and copies with so many of them changed."""
    rng = random.Random(seed)
    base, out = [f"w{i}" for i in range(words_)], []
    for c, n in enumerate(changed):
        w = list(base)
        for i in rng.sample(range(words_), n):
            w[i] = f"c{c}x{i}"
        out.append(" ".join(w))
    return out


def test_sketches_bound_the_overlap_of_long_sets():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**63, 100_000).astype(np.uint64))
    sets = [base, np.concatenate([base[3000:], rng.integers(0, 2**63, 3000).astype(np.uint64)]), base[:65_280], base[:900]]
    sets = [np.unique(s) for s in sets]
    table = jaccard._sketches([jaccard.sketch(s) for s in sets])
    for i, s in enumerate(sets):
        most = jaccard.most_shared(table, table[i])
        for n, t in zip(most, sets, strict=True):
            assert len(np.intersect1d(s, t)) <= n <= min(len(s), len(t))
    # _screen and _candidates, for two sets that are similar and a small one that is not
    sizes = [len(s) for s in sets]
    drawn = [jaccard.sketch(s) for s in sets]
    pairs = [(0, 1), (1, 0), (0, 3), (2, 1)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]), pa.array([b for _, b in pairs]), pa.array([a for a, _ in pairs]), pa.array([sizes[b] for _, b in pairs]),
         pa.array([sizes[a] for a, _ in pairs]), pa.array([drawn[b] for _, b in pairs]), pa.array([drawn[a] for a, _ in pairs])],
        names=["leader", "id", "rep", "leader_rep", "n", "leader_n", "s", "leader_s"])
    got = pa.Table.from_batches(jaccard._screen(85)(iter([batch])))["may"].to_pylist()
    assert got == [True, True, False, False]
    rows = [(9, kind, i, i, sizes[i], drawn[i]) for i in (0, 1, 3) for kind in (1, 2)]
    pdf = jaccard.pd.DataFrame(rows, columns=["leader", "kind", "id", "component", "n", "s"])
    assert jaccard._candidates(85)(pdf)["id"].tolist() == [0, 1]


def test_jaccard_links_very_long_documents(spark):
    """Near copies of 100,000 different shingles, whose sketches don't fit bytes; similarity about 0.94, 0.91 and 0.6."""
    rows = list(enumerate(long_copies(100_003, (0, 800, 1300, 8000)))) + [(10, "w1 w2 w3 w4 w5")]
    got = jaccard.similar_groups(frame(spark, rows), shingle=4, percent=85)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == jaccard_brute(rows, 4, 85)
    assert jaccard_brute(rows, 4, 85)[1][2] == 0


def test_compact_windows_hold_each_run_once():
    values = np.random.default_rng(1).integers(0, 40, 120)
    found = passages.compact_windows(values, 10)
    for i in range(120):
        for j in range(i + 9, 120):
            nodes = [(left, c, right) for left, c, right in found if left <= i <= c <= j <= right]
            assert len(nodes) == 1 and values[nodes[0][1]] == values[i:j + 1].min()


def test_passages(spark):
    rng, vocab = random.Random(7), vocabulary(3000, 7)

    def text(n):
        return [rng.choice(vocab) for _ in range(n)]

    shared, other = text(55), text(70)
    near = list(shared)
    near[27] = "changed"
    docs = {1: text(40) + shared + text(30), 2: shared + text(90), 3: text(10) + near, 4: text(200), 5: text(45), 6: other + text(20), 7: text(33) + other, 8: text(30) + shared[:30] + text(60)}
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(9, None), (10, ""), (None, " ".join(docs[1])), (11, " ".join(docs[6])), (6, " ".join(docs[6]))]
    rows += [(20 + i, " ".join(text(20) + shared)) for i in range(30)]
    got = passages.repeated_passages(frame(spark, rows)).collect()
    flagged = {r.doc_id for r in got} | {r.other_id for r in got}
    assert flagged == {1, 2, 6, 7, 11, *range(20, 50)} | {3}
    for r in got:
        a, b = (dict(rows)[i].lower().split()[s:e + 1] for i, s, e in ((r.doc_id, r.first_word, r.last_word), (r.other_id, r.other_first_word, r.other_last_word)))
        x, y = shingle_set(" ".join(a), 5), shingle_set(" ".join(b), 5)
        assert len(a) >= 50 and len(x & y) / len(x | y) == pytest.approx(r.similarity) and r.similarity >= 0.8
    whole = [r for r in got if r.doc_id == 2 and r.other_id == 1]
    assert [(r.first_word, r.last_word, r.other_first_word) for r in whole] == [(0, 54, 40)]
    assert passages.repeated_passages(frame(spark, [])).count() == 0


def test_equal_passages_in_crowded_files_are_found(spark):
    """Many documents share a phrase of 44 words and nothing else; the passages of later pairs go over it, and one overlaps another."""
    rng, vocab = random.Random(21), vocabulary(5000, 21)

    def inside(words_):
        """Whether the minima of the first four hash functions have the usual context on both sides within the phrase."""
        h = words.shingles(words.word_hashes(pa.array([" ".join(words_)]))[0], 5)
        return all(9 <= words.mix(h ^ s).argmin() <= 30 for s in passages._SEEDS[:4])

    def text(n):
        return [rng.choice(vocab) for _ in range(n)]

    phrase, rows = next(p for p in iter(lambda: text(44), None) if inside(p)), []
    for i in range(40):
        rows.append((i, text(40) + phrase + text(40)))
    for i in range(100, 160, 2):
        passage = text(4) + phrase + text(4)
        rows += [(i, text(25) + passage + text(25)), (i + 1, text(30) + passage + text(20))]
    chain = text(120)
    rows += [(200, chain[:62] + text(40)), (201, text(10) + chain + text(10)), (202, text(40) + chain[50:110] + text(9))]
    rows = [(i, " ".join(w)) for i, w in rows]
    got = passages.repeated_passages(frame(spark, rows)).collect()
    assert {(r.doc_id, r.other_id) for r in got} >= {(i + 1, i) for i in range(100, 160, 2)} | {(201, 200), (202, 201)}
    assert all(i >= 100 for r in got for i in (r.doc_id, r.other_id))
    for r in got:
        a, b = (dict(rows)[i].split()[s:e + 1] for i, s, e in ((r.doc_id, r.first_word, r.last_word), (r.other_id, r.other_first_word, r.other_last_word)))
        assert len(a) >= 50 and (a == b) == (r.similarity == 1.0)


def test_near_passages_are_found(spark):
    """Passages of 60 words with one changed (similarity 0.84): 1 - (1 - s)^4 says nearly all; two hashes found 53."""
    rng, vocab, rows = random.Random(9), vocabulary(5000, 9), []
    for i in range(60):
        p = [rng.choice(vocab) for _ in range(60)]
        q = list(p)
        q[rng.randrange(20, 40)] = "changed"
        rows += [(2 * i, " ".join(p)), (2 * i + 1, " ".join(q))]
    got = {r.doc_id // 2 for r in passages.repeated_passages(frame(spark, rows)).collect()}
    assert len(got) >= 58


def test_near_passages_in_crowded_files_are_found(spark):
    """Twelve pairs of near passages that share a phrase of 44 words, more than there are rounds; a word of the phrase is changed in one of each pair."""
    rng, vocab, rows = random.Random(33), vocabulary(5000, 33), []

    def text(n):
        return [rng.choice(vocab) for _ in range(n)]

    phrase = text(44)
    for i in range(12):
        p = text(8) + phrase + text(8)
        q = p[:30] + [f"changed{i}"] + p[31:]
        rows += [(2 * i, " ".join(text(20) + p + text(20))), (2 * i + 1, " ".join(text(25) + q + text(15)))]
    assert passages.least_run(5, 50, 80) == 21
    got = passages.repeated_passages(frame(spark, rows)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(2 * i + 1, 2 * i) for i in range(12)}


def test_passages_of_connected_documents_are_found(spark):
    """0 and 1 share a passage elsewhere, 2 one with 0 and 3 one with 1 over a phrase of all four; the passage of 2 and 3 over that phrase is another."""
    def files(text):
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(text)])], names=["id", "text"])
        return {k for rows in passages._windows(5, 50, 80)(iter([batch])) for k, c in zip(*(rows.column(x).to_pylist() for x in ("key", "c"))) if c >= 0}

    def documents(seed):
        rng, vocab = random.Random(seed), vocabulary(5000, 33)
        first, second, right, phrase, apart = ([rng.choice(vocab) for _ in range(n)] for n in (8, 8, 8, 44, 60))
        fill = [[rng.choice(vocab) for _ in range(30)] for _ in range(6)]
        return [apart + fill[0] + first + phrase + fill[1], fill[2] + apart + second + phrase + fill[3], first + phrase + right + fill[4], second + phrase + right + fill[5]]

    def together(docs):
        x, y, a, b = map(files, docs)
        return a & b <= x & y

    docs = next(d for d in map(documents, range(1000)) if together(d))
    got = {(r.doc_id, r.other_id) for r in passages.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in enumerate(docs)])).collect()}
    assert got == {(1, 0), (2, 0), (3, 1), (3, 2)}


@pytest.mark.parametrize("longer", [0, 1])
def test_a_passage_with_words_inserted_is_one(longer):
    """Nine words between halves of 40: similarity 0.81, and neither half is a passage."""
    rng, vocab = random.Random(41), vocabulary(5000, 41)
    one, two, more = ([rng.choice(vocab) for _ in range(n)] for n in (40, 40, 9))
    sides = [words.shingles(words.word_hashes(pa.array([" ".join(w)]))[0], 5) for w in (one + more + two, one + two)]
    a, b = sides if longer == 0 else sides[::-1]
    assert [f[:4] for f in passages.match(a, b, 0, 46, 80)] == [(0, len(a) - 1, 0, len(b) - 1)]
