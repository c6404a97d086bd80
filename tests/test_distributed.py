"""Block-wise and round-wise algorithms against brute force."""

import json
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.functions import scale
from palimpsest.operators import deident, dialogue, pack, registry, similarity, structure, summaries, transcript
from palimpsest.sources import corpus, segments
from palimpsest.streaming import flows, memory


def _skewed(spark, n=400):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", i, rng.randrange(9), rng.randrange(100) if rng.random() < 0.4 else None) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t long, v long, x long")


def _same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(*a.columns).collect()), key=str)


def test_blocks_match_plain_windows(spark):
    df = _skewed(spark)
    w = W.partitionBy("k").orderBy("t")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    _same(df.withColumn("o", F.row_number().over(w).cast("long")), scale.number_rows(df, ["k"], "t", ["t"], "o", 13))
    _same(df.withColumn("o", F.sum("v").over(upto)), scale.running_sum(df, ["k"], "t", ["t"], F.col("v"), "o", 13))
    _same(df.withColumn("o", F.coalesce(F.sum("v").over(before), F.lit(0))),
          scale.running_sum(df, ["k"], "t", ["t"], F.col("v"), "o", 13, inclusive=False))
    _same(df.withColumn("o", F.last("x", True).over(upto)), scale.carry_last(df, ["k"], "t", ["t"], F.col("x"), "o", 13))
    _same(df.withColumn("o", F.lag("x").over(w)), scale.previous(df, ["k"], "t", ["t"], F.col("x"), "o", 13))
    _same(df.withColumn("o", F.min("v").over(upto)), scale.running_min(df, ["k"], "t", "v", "o", 13))


def test_no_single_partition_for_rows(spark):
    plan = scale.number_rows(_skewed(spark), ["k"], "t", ["t"], "o", 13)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def _greedy(frames, threshold):
    out, kept = {}, {}
    for section, fid, sig in sorted(frames, key=lambda f: (f[0], f[1])):
        best = None
        for k, ksig in kept.setdefault(section, []):
            d = sum(abs(a - b) for a, b in zip(sig, ksig)) / len(sig)
            if best is None or d < best[0]:
                best = (d, k)
        if best and best[0] <= threshold:
            out[(section, fid)] = best[1]
        else:
            out[(section, fid)] = None
            kept[section].append((fid, sig))
    return out


def test_dedup_frames_matches_greedy(spark):
    rng = random.Random(3)
    base = [[rng.randrange(256) for _ in range(24)] for _ in range(6)]
    frames = []
    for i in range(90):
        sig = base[rng.randrange(6)] if rng.random() < 0.3 else [max(0, v + rng.randrange(-4, 5)) for v in base[rng.randrange(6)]]
        frames.append((i % 2, i, sig))
    df = spark.createDataFrame(frames, "section int, frame_id long, sig array<int>")
    got = {(r.section, r.frame_id): r.dup_of for r in pack.dedup_frames(df, 2.0).collect()}
    assert got == _greedy(frames, 2.0)


def test_dedup_frames_of_one_cell_in_tiles(spark, monkeypatch):
    """Signatures too alike for the grid to part them are compared in tiles; repeats of a dropped frame may be nearer to a later one."""
    monkeypatch.setattr(pack, "TILE", 16)
    rng = random.Random(4)
    base = [[128 + rng.randrange(-6, 7) for _ in range(12)] for _ in range(60)]
    frames = [(s, i, base[rng.randrange(60)]) for s in ("a", "b") for i in range(120)] + [("c", 0, None), ("c", 1, None), ("c", 2, [1, None]), ("c", 3, [1, None])]
    df = spark.createDataFrame(frames, "section string, frame_id long, sig array<int>")
    rows = {(r.section, r.frame_id): r.dup_of for r in pack.dedup_frames(df, 4.0).collect()}
    assert rows == _greedy([f for f in frames if f[0] != "c"], 4.0) | {("c", i): None for i in range(4)}
    left, right = (pd.DataFrame({name: range(3), "sig": [[0, 0], [1, 2], [9, 9]]}) for name in ("id", "early"))
    assert pack._within(2.0)(left, right).values.tolist() == [[1, 0, 1.5]]


def test_four_frames_keep_three(spark):
    a, b, c = [10] * 256, [90] * 256, [200] * 256
    df = spark.createDataFrame([("s", 0, a), ("s", 1, b), ("s", 2, a), ("s", 3, c)], "section string, frame_id long, sig array<int>")
    assert pack.dedup_frames(df).where("selected").count() == 3


def test_keyframes_match_walk(spark):
    rng = random.Random(7)
    rows = [(s, t * 0.5, rng.getrandbits(63) if rng.random() < 0.5 else 12345) for s in ("a", "b") for t in range(120)]
    expect = []
    for stream in ("a", "b"):
        acc, last, key, n = 0.0, None, None, 0
        for _, t, h in [r for r in rows if r[0] == stream]:
            if t < acc:
                continue
            acc += 1.5
            if (last is None or (h ^ last).bit_count() > 8) and (key is None or (h ^ key).bit_count() > 4) and n < 20:
                expect.append((stream, t))
                key, n = h, n + 1
            last = h
    df = spark.createDataFrame(rows, "stream string, t double, hash long")
    got = transcript.keyframes(df, interval=1.5, limit=20, block=11.0).select("stream", "t").collect()
    assert sorted(map(tuple, got)) == sorted(expect)


def _chunks(sizes, limit):
    chunks, cur, used = [], [], 0
    for i, n in enumerate(sizes):
        if cur and used + n > limit:
            chunks.append((cur[0], cur[-1]))
            cur = cur[-1:]
            used = sizes[cur[0]]
        cur.append(i)
        used += n
    return chunks + [(cur[0], cur[-1])]


def test_chunks_match_brute_force(spark):
    rng = random.Random(1)
    sentences = ["x" * rng.randrange(1, 40) for _ in range(60)]
    df = spark.createDataFrame([(1, "\n".join(sentences))], "doc_id long, text string")
    got = [(r["first"], r["last"]) for r in summaries.chunk_sentences(df, 100).orderBy("chunk").collect()]
    assert got == _chunks([len(s) for s in sentences], 100)


def test_sliding_window_covers_every_chunk(spark):
    lines = [f"line number {i} about topic{i % 3} and more words here" for i in range(50)]
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    row = summaries.summarize(df, max_input_chars=400, evaluate=False).first()
    idx = [s.idx for s in row.chosen]
    assert idx == sorted(set(idx)) and all(s.text == lines[s.idx] for s in row.chosen)
    for first, last in _chunks([len(x) for x in lines], 400):
        assert any(first <= i <= last for i in idx)


@pytest.mark.parametrize(("few", "bound"), [(2_000, 4096), (0, 4096), (0, 5)])
def test_retrieve_is_exact_with_common_words(spark, monkeypatch, few, bound):
    monkeypatch.setattr(similarity, "FEW_QUESTIONS", few)
    rng = random.Random(11)
    vocab = ["the", "of"] + [f"w{i}" for i in range(30)]
    sent = [(i, 0, 0, " ".join(["the"] * (rng.random() < 0.8) + rng.choices(vocab, k=6))) for i in range(300)]
    qs = [(i, " ".join(rng.choices(vocab, k=4))) for i in range(20)] + [(99, "the of")]
    tok = lambda s: {w for w in s.split() if len(w) > 1}
    expect = set()
    for q, text in qs:
        ranked = sorted(((-len(tok(text) & tok(s)), d) for d, _, _, s in sent if tok(text) & tok(s)))[:3]
        expect |= {(q, d) for _, d in ranked}
    got = similarity.retrieve(spark.createDataFrame(qs, "item_id long, text string"),
                              spark.createDataFrame(sent, "doc_id long, para int, nth int, text string"), bound=bound)
    assert {(r.item_id, r.doc_id) for r in got.collect()} == expect


def test_shares_with_tiles(spark):
    rows = [("hot", f"c{i}") for i in range(40)] + [("cold", "c1"), ("cold", "c2")]
    got = {(r.a, r.b): r.n_shared for r in registry.shares_with(spark.createDataFrame(rows, "capability string, component string"), width=8).collect()}
    assert len(got) == 40 * 39 and got[("c1", "c2")] == 2 and got[("c3", "c4")] == 1


def test_stream_answers_like_batch(spark, tmp_path):
    turns = [(c, t, "user" if t % 2 else "assistant", f"topic{c} part {t} words here.\nmore about topic{c}" if t % 2 == 0 else f"what about topic{c}?")
             for c in range(3) for t in range(6)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = flows.stream_table(spark, str(tmp_path / "in"), df.schema)
    flows.start_qa(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    _same(got.select("conv_id", "turn", "answer"), dialogue.answer_turns(df).select("conv_id", "turn", "answer"))


def test_followup_keeps_topic(spark):
    rows = [(1, 1, "量子计算是什么"), (1, 2, "那为什么"), (1, 3, "它如何发展"), (1, 4, "查一下最新进展与市场情况吧")]
    got = dialogue.resolve_questions(spark.createDataFrame(rows, "conv_id long, turn long, text string"), width=2).orderBy("turn").collect()
    assert [r.is_followup for r in got] == [False, True, True, False]
    assert got[1].topic == "量子计算" and got[2].resolved.startswith("量子计算")


def test_segments_once_and_gate_routes(spark, tmp_path):
    df = spark.createDataFrame([(1, "mail a@b.com now"), (2, "nothing")], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = flows.stream_table(spark, str(tmp_path / "in"), df.schema)
    flows.start_gate(stream, str(tmp_path / "ok"), str(tmp_path / "held"), str(tmp_path / "ck")).awaitTermination()
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == [2]
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "held")).collect()] == [1]


# --- similarity join ---------------------------------------------------------------
def _word(start, i):
    """A word of letters only."""
    return start + "".join(chr(97 + int(d)) for d in f"{i:05d}")


def _tokens(text):
    return set(text.rstrip("?").split())


def _share(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def _pairs(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "and"] + [_word("w", i) for i in range(40)]
    side = lambda: [" ".join(dict.fromkeys(rng.choices(words, k=rng.randint(1, 9)))) + "?" for _ in range(n)]
    return [(f"p{p}", side(), side()) for p in range(3)]


@pytest.mark.parametrize("bound", [4096, 3])
def test_diff_and_consistency_match_brute_force(spark, bound):
    data = _pairs(3, 40)
    df = spark.createDataFrame([(k, "\n".join(a), "\n".join(b)) for k, a, b in data], "pair_id string, left_text string, right_text string")
    want, traced = set(), set()
    for k, a, b in data:
        ta, tb = [_tokens(x) for x in a], [_tokens(x) for x in b]
        used = set()
        for i, x in enumerate(ta):
            best, j = max((_share(x, y), -j) for j, y in enumerate(tb))
            if best < 0.3:
                want.add((k, "removed", i, None))
            else:
                used.add(-j)
                if best < 0.85:
                    want.add((k, "modified", i, -j))
        want |= {(k, "added", j, None) for j, y in enumerate(tb) if max(_share(x, y) for x in ta) < 0.3 and j not in used}
        for i, y in enumerate(tb):
            best, j = max((_share(y, x), -j) for j, x in enumerate(ta))
            traced.add((k, i, -j if best else -1, best >= 0.12))
    got = {(r.pair_id, r.change, r.idx, r.other_idx) for r in similarity.diff_documents(df, bound=bound).collect()}
    assert got == want
    got = {(r.pair_id, r.idx, r.best_match_idx, r.traceable) for r in similarity.consistency(df, bound=bound).collect()}
    assert got == traced


def test_one_word_in_ten_thousand_sentences(spark):
    """The common word is in no index: every sentence has rarer ones, which a similarity of 0.3 can't do without."""
    n = 10_000
    line = lambda i, starts: "common " + " ".join(_word(s, i) for s in starts) + "."
    left = "\n".join(line(i, "lmn") for i in range(n))
    right = "\n".join(line(i, "lmx" if i % 2 else "rst") for i in range(n))
    df = spark.createDataFrame([("p", left, right)], "pair_id string, left_text string, right_text string")
    got = similarity.diff_counts(similarity.diff_documents(df)).collect()
    assert [tuple(r) for r in got] == [("p", n // 2, n // 2, n // 2)]


def test_tiled_join_bounds_every_group(spark):
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [("cold", 1), ("left", 2), (None, 3)], "k string, a long")
    right = spark.createDataFrame([("hot", i) for i in range(200)] + [("cold", 5), ("right", 2), (None, 3)], "k string, b long")
    got = scale.tiled_join(left, right, ["k"], bound=20)
    assert got.columns == ["k", "a", "b"]
    assert sorted(map(tuple, got.collect())) == sorted([("hot", i, j) for i in range(300) for j in range(200)] + [("cold", 1, 5)])


# --- key frames and silence -----------------------------------------------------------
@pytest.mark.parametrize("size", [1, 2, 7])
def test_keyframes_in_small_blocks(spark, monkeypatch, size):
    """Chains that cross many blocks, long stretches without a key, a null stream."""
    monkeypatch.setattr(transcript, "KEY_BLOCK", size)
    rng = random.Random(size)
    near = [rng.getrandbits(62) for _ in range(3)]
    rows = []
    for s in ("a", "b", None):
        for t in range(100):
            base = near[0] if 20 < t < 70 else rng.choice(near)
            rows.append((s, float(t), base ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) if rng.random() < 0.7 else rng.getrandbits(62)))
    expect = []
    for stream in ("a", "b", None):
        last = key = None
        for _, t, h in [r for r in rows if r[0] == stream]:
            if (last is None or (h ^ last).bit_count() > 2) and (key is None or (h ^ key).bit_count() > 5):
                expect.append((stream, t, len([e for e in expect if e[0] == stream]) + 1))
                key = h
            last = h
    df = spark.createDataFrame(rows, "stream string, t double, hash long")
    got = transcript.keyframes(df, scene_bits=2, key_bits=5, block=30.0).select("stream", "t", "ordinal").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expect, key=repr)
    assert transcript.keyframes(df.limit(0)).count() == 0


def _split(levels, share, silence, piece):
    peak = max(levels) or 1.0
    quiet = [x / peak < share for x in levels]
    cuts, i = [], 0
    while i < len(levels):
        j = i
        while j < len(levels) and quiet[j]:
            j += 1
        if j - i >= silence:
            cuts.append(i + (j - i) // 2)
        i = max(j, i + 1)
    bounds = [0, *cuts, len(levels)]
    out = []
    for k, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if k and e - s < piece:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


@pytest.mark.parametrize("block", [1, 5, 64])
def test_silence_split_matches_walk(spark, block):
    rng = random.Random(block)
    streams = {s: [0.0 if rng.random() < q else rng.random() + 0.1 for _ in range(n)] for s, q, n in (("a", 0.8, 150), ("b", 0.3, 90), ("c", 1.0, 40), ("d", 0.0, 30), ("e", 0.95, 1))}
    df = spark.createDataFrame([(s, i, x) for s, levels in streams.items() for i, x in enumerate(levels)], "stream string, frame_idx long, rms double")
    got = transcript.silence_split(df, share=0.05, silence_frames=3, piece_frames=8, block=block).collect()
    want = [(s, k + 1, a, b) for s, levels in streams.items() for k, (a, b) in enumerate(_split(levels, 0.05, 3, 8))]
    assert sorted(map(tuple, got)) == sorted(want)


# --- recordings and session memory ------------------------------------------------------
def _part(folder, n, text, **more):
    folder.mkdir(exist_ok=True)
    (folder / f"seg_{n:03d}.json").write_text(text if isinstance(text, str) else json.dumps(text | more))


def test_live_segments(spark, tmp_path):
    """The last open part waits, a broken one is an error row, nothing is read twice, closing lets the last one in."""
    root, sink, log = tmp_path / "rec", str(tmp_path / "sink"), str(tmp_path / "log")
    root.mkdir()
    body = {"duration": 2.0, "confidence": 0.5, "segments": [{"start": 0.5, "end": 1.0, "text": "x"}]}
    for n, text in enumerate([body | {"text": "one"}, "{broken", "", body | {"text": "four"}]):
        _part(root / "r1", n, text)
    _part(root / "r2", 7, body | {"text": "only"})

    def run():
        return sorted((r.stream, r.part_no, r.status) for r in flows.run_to_table(segments.read_segments(spark, str(root)), sink, log).collect())

    assert run() == [("r1", 0, "ok"), ("r1", 1, "error"), ("r1", 2, "error")]
    _part(root / "r1", 2, body | {"text": "three"})
    _part(root / "r1", 4, '{"duration": null}')
    assert run() == [("r1", 0, "ok"), ("r1", 1, "error"), ("r1", 2, "error"), ("r1", 3, "ok")]
    for r in ("r1", "r2"):
        (root / r / segments.CLOSED).write_text("")
    assert run() == [("r1", 0, "ok"), ("r1", 1, "error"), ("r1", 2, "error"), ("r1", 3, "ok"), ("r1", 4, "ok"), ("r2", 7, "ok")]
    parts = segments.read_again(spark.read.parquet(sink))
    placed, merged = transcript.merge_parts(parts)
    assert sorted((r.part_no, r.status, r.offset) for r in placed.where("stream = 'r1'").collect()) == [(0, "ok", 0.0), (1, "error", 2.0), (2, "ok", 2.0), (3, "ok", 4.0), (4, "ok", 6.0)]
    assert [r.start for r in transcript.merged_segments(placed).where("stream = 'r1'").orderBy("part_no").collect()] == [0.5, 2.5, 4.5]
    pieces = transcript.merged_text(parts, parts_a_piece=2).orderBy("stream", "piece").collect()
    assert [tuple(r) for r in pieces] == [("r1", 0, "one\nthree"), ("r1", 1, "four"), ("r2", 0, "only")]
    assert merged.where("stream = 'r1'").first().base_part == 0


def _session(n, c=1):
    rng = random.Random(n)
    words = [f"word{i}" for i in range(12)]
    return [(c, t, "user" if t % 2 else "assistant", " ".join(rng.choices(words, k=5)) + (".\n" + " ".join(rng.choices(words, k=3)) + "." if t % 3 == 0 else "?" if t % 2 else ".")) for t in range(n)]


def test_answers_in_blocks_are_the_same(spark, monkeypatch):
    """Blocks of two questions hand on what was cited: the same answers as in one block."""
    df = spark.createDataFrame(_session(40), "conv_id long, turn long, role string, text string")
    whole = dialogue.answer_turns(df).select("turn", "answer").collect()
    monkeypatch.setattr(dialogue, "QUESTIONS", 2)
    assert sorted(dialogue.answer_turns(df, bound=3).select("turn", "answer").collect()) == sorted(whole)


def test_memory_outlives_micro_batches(spark, tmp_path, monkeypatch):
    """Turns that come batch by batch are answered as if they had come together; nothing said is read again."""
    df = spark.createDataFrame(_session(24), "conv_id long, turn long, role string, text string")
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    for low in (0, 8, 16):
        df.where(f"turn >= {low} and turn < {low + 8}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        flows.start_qa(flows.stream_table(spark, str(tmp_path / "in"), df.schema), out, log).awaitTermination()
    _same(spark.read.parquet(out).select("turn", "answer"), dialogue.answer_turns(df).select("turn", "answer"))
    with pytest.raises(ValueError, match="forgets"):
        flows.start_qa(flows.stream_table(spark, str(tmp_path / "in"), df.schema), out, log, ttl_ms=1000)


class _Store:
    """A state variable in memory that counts calls and forgets as a real one does."""

    def __init__(self, clock, ttl):
        self.data, self.clock, self.ttl = {}, clock, ttl

    def getValue(self, key):
        self.clock["calls"] += 1
        value, at = self.data.get(key, (None, 0))
        return None if self.ttl and at + self.ttl <= self.clock["now"] else value

    def updateValue(self, key, value):
        self.clock["calls"] += 1
        self.data[key] = (value, self.clock["now"])

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)

    def getCurrentProcessingTimeInMs(self):
        return self.clock["now"]


def _remembered(batches, ttl=None):
    """Answers of one session to ``batches`` of ``turn, asks, words``, a second apart, and the calls to its state."""
    clock = {"now": 0, "calls": 0}
    new = lambda *a: _Store(clock, ttl)
    memory_ = memory.SessionMemory(3, ttl)
    memory_.init(SimpleNamespace(getValueState=new, getMapState=new))
    out = []
    for batch in batches:
        clock["now"] += 1000
        rows = []
        for turn, asks, said in batch:
            known = {"said": said, "core": said, "subject": said, "may": False, "blank": False} | {f"{c}_tokens": said.split() for c in ("said", "core", "subject")} if asks else {}
            sentences = [] if asks else said.split(".")
            rows.append({"turn": turn, "asks": asks, "sentences": sentences, "sentence_tokens": sentences} | known)
        frame = pd.DataFrame({"packed": [json.dumps(r) for r in rows]})
        for got in memory_.handleInputRows((7,), iter([frame[:2], frame[2:]]), _Store(clock, ttl)):
            out += [(r["turn"], [(c["para"], c["text"]) for c in r["citations"]]) for r in map(json.loads, got["packed"])]
    return out, clock["calls"]


@pytest.mark.parametrize("ttl", [None, 3500])
def test_memory_in_buckets_matches_a_scan(monkeypatch, ttl):
    """Lists over several parts, buckets that are split, texts said twice, turns sent again, entries that end."""
    monkeypatch.setattr(memory, "LIST_PART", 4)
    monkeypatch.setattr(memory, "BUCKET", 8)
    monkeypatch.setattr(memory, "TURNS", 3)
    rng = random.Random(5)
    word = lambda: f"w{min(rng.randrange(40), rng.randrange(40))}"
    line = lambda: " ".join(dict.fromkeys(word() for _ in range(4)))
    turns = [(t, t % 3 == 2, line() if t % 3 == 2 else ".".join(line() for _ in range(3))) for t in range(90)]
    batches = [turns[i:i + 10] + (turns[i - 1:i] if i and not turns[i - 1][1] else []) for i in range(0, 90, 10)]
    said, cited, want = {}, {}, []
    for now, batch in enumerate(batches, 1):
        live = lambda at: not ttl or at * 1000 + ttl > now * 1000
        for t, asks, text in batch:
            for nth, x in enumerate([] if asks else text.split(".")):
                if (t, nth) not in said or not live(said[t, nth][1]):
                    said[t, nth] = (x, now)
        for t, asks, text in sorted(batch):
            if asks:
                asked = set(text.split())
                found = [(-len(asked & set(x.split())) / len(asked) * (dialogue.CITED_PENALTY if x in cited and live(cited[x]) else 1), *at, x)
                         for at, (x, when) in said.items() if at[0] < t and live(when) and asked & set(x.split())]
                best = sorted(found)[:3]
                cited |= {x: now for _, _, _, x in best}
                want.append((t, [(para, x) for _, para, _, x in best]))
    assert _remembered(batches, ttl)[0] == want


def test_memory_asks_its_store_little():
    """A short session's micro-batch takes a few calls, however many words it has: each costs about a fifth of a millisecond."""
    turns = [(0, False, ".".join(f"a{i} b{i} c{i}" for i in range(50))), (1, True, "a3 b4 c5"), (2, False, "more"), (3, True, "b4 a9")]
    got, calls = _remembered([turns])
    assert [t for t, _ in got] == [1, 3] and calls <= 6


# --- outlines, listings, one scan ----------------------------------------------------------
@pytest.mark.parametrize("block", [1, 4, 512])
def test_outline_tree_matches_stack(spark, block):
    rng = random.Random(block)
    rows = [(d, p, rng.choice([0, 1, 1, 2, 3, 5]) + (p % 50 > 40) * 2, f"n{p}") for d, n in ((1, 120), (2, 7), (None, 30)) for p in sorted(rng.sample(range(3 * n), n))]
    want, open_ = [], {}
    for d, p, depth, text in rows:
        stack = open_.setdefault(d, [])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        want.append((d, p, depth, text, stack[-1][1] if stack else None))
        stack.append((depth, p))
    df = spark.createDataFrame(rows, "doc_id long, pos int, depth int, text string")
    got = structure.outline_tree(df.where("doc_id is not null"), block=block)
    assert sorted(map(tuple, got.collect())) == sorted(w for w in want if w[0] is not None)
    assert structure.outline_tree(df.limit(0)).count() == 0


def test_listings(spark):
    rows = [("s1", "b.part.mp4", "out", 3.0, 5.5, "Talk", "x", "P1"), ("s1", "a.mp4", "out", 1.0, 2.0, None, None, None), ("s2", ".mp4", "o", None, 2.0, "", "", "P2")]
    clips = spark.createDataFrame(rows, "section string, filename string, folder string, start double, end double, transcript_title string, basis string, product_name string")
    listing = pack.clip_listing(clips)
    got = {tuple(r) for r in pack.clip_rows(listing).collect()}
    assert got == {("s1", "s1", 1, "a", "", "a.mp4", "out/a.mp4", "1.00", "2.00", "1.00", ""), ("s1", "s1", 2, "b.part", "Talk", "b.part.mp4", "out/b.part.mp4", "3.00", "5.50", "2.50", "x"),
                   ("s2", "s2", 1, ".mp4", "", ".mp4", "o/.mp4", "", "2.00", "", "")}
    copies = spark.createDataFrame([("s1", "s1_P1_文案.md"), ("s1", "s1_P1_文案.md"), ("s1", "s2_P2_文案.md")], "section string, name string")
    assert {(r[0], r[2], r[7]) for r in pack.product_rows(listing, copies).collect()} == {("P1", 2, "s1_P1_文案.md"), ("P2", 1, "")}


def test_documents_without_hits_are_normalised_once(spark):
    """Rows that share a key, repeat, or are null: each keeps its own text."""
    rows = [(1, "mail a@b.com now"), (1, "ｎothing here"), (2, None), (None, "call 13812345678"), (None, "plain"), (3, "plain"), (3, "plain")]
    copies, hits = deident.desensitize(spark.createDataFrame(rows, "doc_id long, text string"), "hybrid")
    got = sorted([(r.doc_id, r.text) for r in copies.collect() if "⟦" not in (r.text or "")], key=repr)
    assert got == sorted([(1, "nothing here"), (2, None), (None, "plain"), (3, "plain"), (3, "plain")], key=repr)
    assert {r.original for r in hits.collect()} == {"a@b.com", "13812345678"}


def test_exemption_table_is_like_the_list(spark):
    rules = [("public", "global", ""), ("local", "path", "a/b/"), ("public", "path", "a"), ("public", "glob", "*.log"), ("public", "glob", "z/?.txt"), ("local", "path", "c/d.txt"), ("local", "other", "a")]
    paths = ["a", "a/b", "a/b/c.txt", "a/bc", "a/x.log", "z/1.txt", "z/12.txt", "c/d.txt", "c/d.txt/e", "", "q", "q", None]
    df = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "rel_path string, _path long")
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "line long, scope string, how string, value string")
    for some in (rules[:-1], rules[1:-1]):
        want = corpus.apply_exemptions(df, some).select("_path", "exempt", "reason")
        got = corpus.apply_exemption_table(df.withColumnRenamed("_path", "n"), table.join(spark.createDataFrame([(v,) for v in {r[2] for r in some}], "value string"), "value", "left_semi"))
        _same(want.select(F.col("_path").alias("n"), "exempt", "reason"), got)


def test_streams_of_tables_that_are_folders(spark, tmp_path):
    """A table of several part files is read as a stream too, and one without rows gives no answers."""
    from palimpsest.plans import streams

    turns = spark.createDataFrame(
        [(c, t, "user" if t % 2 == 0 else "assistant", f"where are the apples of {c}?" if t % 2 == 0 else f"The apples of {c} lie in the cellar!") for c in (1, 2) for t in range(1, 5)],
        "conv_id long, turn long, role string, text string")
    for rows, name in ((turns, "some"), (turns.limit(0), "none")):
        rows.repartition(3).write.parquet(str(tmp_path / name / "conversations.parquet"))
        want = streams.answer_turns(spark, str(tmp_path / name)).collect()
        got = streams.qa_memory(spark, str(tmp_path / name)).collect()
        assert sorted(got) == sorted(want)
        assert len(got) == (4 if name == "some" else 0)


def test_anchor_mode_is_told_once_a_text(spark):
    """The search for arrows in the whole text stands below the lines, not beside each."""
    df = spark.createDataFrame([(1, "# a\n[01:02] said\n▶ **03:04** arrow\n \n\x1c body \x85")], "doc_id long, text string")
    got = pack.parse_anchors(df)
    assert [(r.line_no, r.mode, r.time_sec, r.heading, r.body) for r in got.collect()] == [(3, "arrow", 184, "a", "arrow")]
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    lines_at = next(i for i, x in enumerate(plan) if "Generate posexplode" in x)
    searched = [i for i, x in enumerate(plan) if "THEN arrow" in x]
    assert searched and all(i > lines_at for i in searched)


def test_strip_takes_every_blank(spark):
    from palimpsest.functions import text as T
    from palimpsest.functions.patterns import WS

    d = spark.createDataFrame([(chr(i) + "a" + chr(i) + "\n " + chr(i),) for i in range(0x3100)], "t string")
    assert d.where(T.strip(F.col("t")) != F.regexp_replace("t", f"^[{WS}]+|[{WS}]+$", "")).count() == 0
    assert "btrim" in str(T.strip(F.col("t")))


def test_language_is_told_ahead_of_the_exchange(spark):
    """Keywords and sentences share the exchange, so what stands below it is done once."""
    df = spark.createDataFrame([(1, "One thing here! Another thing there."), (2, "今天天气很好。明天天气也好。后天天气不好。")], "doc_id long, text string")
    got = summaries.scored_documents(df)
    assert {r.doc_id: (r.lang, len(r.ranked)) for r in got.collect()} == {1: ("en", 2), 2: ("zh", 3)}
    above, *below = got._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
    assert "THEN zh ELSE en" not in above and below and all(x.count("THEN zh ELSE en") == 1 for x in below)


def test_sharing_pairs_meet_once(spark):
    """Each pair is joined from its lower number only; both directions come of the count."""
    rows = [(t, o) for t, n in (("x", 30), ("y", 11), ("z", 1)) for o in range(n)] + [("x", 3), ("w", None), ("w", 1), ("w", 2)]
    claims = spark.createDataFrame(rows, "capability string, component long")
    out = registry.shares_with(claims, width=4)
    got = {(r.a, r.b): r.n_shared for r in out.collect()}
    want = {}
    owners = {t: {o for u, o in rows if u == t and o is not None} for t, _ in rows}
    for held in owners.values():
        for a in held:
            for b in held - {a}:
                want[a, b] = want.get((a, b), 0) + 1
    assert got == want
    assert "(_na" in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [5, 256])
def test_owners_are_gathered_once(spark, monkeypatch, most):
    """Things of few claims need no join of owners; those of many, and owners of many things, are dealt out and count the same."""
    monkeypatch.setattr(registry, "CLAIMS", most)
    rng = random.Random(8)
    rows = [(f"t{i}", rng.randrange(60)) for i in range(40) for _ in range(rng.choice([1, 3, 40]))] + [("t0", None), (None, 1), (None, 2)] + [(f"u{i}", o) for i in range(300) for o in (61, 60)]
    out = registry.shares_with(spark.createDataFrame(rows, "capability string, component int"), width=4)
    want, owners = {}, {}
    for t, o in rows:
        if t is not None and o is not None:
            owners.setdefault(t, set()).add(o)
    for held in owners.values():
        for a in held:
            for b in held - {a}:
                want[a, b] = want.get((a, b), 0) + 1
    assert sorted(map(tuple, out.collect())) == sorted((a, b, n) for (a, b), n in want.items())
    assert ("_tile" in out._jdf.queryExecution().optimizedPlan().toString()) == (most == 5)


def test_a_batch_of_segments_is_listed_once(tmp_path, monkeypatch):
    """The files of a batch are those its last offset was told from; one told before a restart is listed again."""
    for n in range(5):
        (tmp_path / "rec").mkdir(exist_ok=True)
        (tmp_path / "rec" / f"seg_{n}.json").write_text("{}")
    listed, plain = [], segments._Reader._parts
    monkeypatch.setattr(segments._Reader, "_parts", lambda self: listed.append(1) or plain(self))
    reader = segments._Reader({"path": str(tmp_path)})
    end = reader.latestOffset()
    assert end == {"rec": 3} and [[n for _, n, _ in p.files] for p in reader.partitions({"rec": 0}, end)] == [[1, 2, 3]] and len(listed) == 1
    (tmp_path / "rec" / segments.CLOSED).write_text("")
    later = reader.latestOffset()
    assert [[n for _, n, _ in p.files] for p in reader.partitions(end, later)] == [[4]] and len(listed) == 2
    for other in (reader, segments._Reader({"path": str(tmp_path)})):
        assert [[n for _, n, _ in p.files] for p in other.partitions({}, end)] == [[0, 1, 2, 3]]
    assert len(listed) == 4
