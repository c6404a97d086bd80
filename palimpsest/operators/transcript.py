"""Time-stamped segments, frames and recognition results."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.functions import patterns as P
from palimpsest.functions.scale import attach, number_rows, pinned, previous, running_min, running_sum, spread_topk
from palimpsest.functions.text import strip
from palimpsest.session import cut_lineage

# --- fixed values: thresholds ------------------------------------------------
LOW, MEDIUM_TRANSCRIPT, MEDIUM_OTHER = 0.5, 0.75, 0.85
SILENCE_SHARE, SILENCE_MS, FRAME_MS, PIECE_MS = 0.03, 700, 20, 2000
SCENE_BITS, KEY_BITS = 8, 4

# --- fixed values: phrases that point at a picture ---------------------------
DEICTIC = (
    "如图", "见图", "见下图", "见上图", "如图所示", "如下图", "上图", "下图", "这张图", "这个图", "此图", "该图", "这张表",
    "这个表", "此表", "该表", "图中", "图里", "图内", "表里", "流程图", "结构图", "架构图", "示意如下", "看这张", "看图中",
    "参照图", "参考图", "图中所示", "框图", "配图", "附图", "as shown", "this figure", "this chart", "this picture",
    "see the figure", "see the chart", "see the picture", "pictured above", "as illustrated", "the diagram",
    "the figure above", "in the figure", "in this image", "as depicted", "shown below", "shown above",
)

# --- fixed values: language and task hints, in order of precedence -----------
LANGUAGE_HINTS: dict[str, tuple[str, ...]] = {
    "zh": ("中文", "汉语", "普通话", "国语", "chinese", "zh", "zh-cn"),
    "en": ("英文", "英语", "english", "en"),
    "ja": ("日文", "日语", "日本语", "japanese", "ja"),
    "ko": ("韩文", "韩语", "朝鲜语", "korean", "ko"),
    "fr": ("法文", "法语", "french", "fr"),
    "de": ("德文", "德语", "german", "de"),
    "es": ("西班牙文", "西班牙语", "spanish", "es"),
    "ru": ("俄文", "俄语", "russian", "ru"),
    "pt": ("葡文", "葡语", "葡萄牙语", "portuguese", "pt"),
    "it": ("意大利文", "意大利语", "italian", "it"),
    "ar": ("阿拉伯文", "阿拉伯语", "arabic", "ar"),
    "hi": ("印地文", "印地语", "hindi", "hi"),
    "vi": ("越南文", "越南语", "vietnamese", "vi"),
    "th": ("泰文", "泰语", "thai", "th"),
    "yue": ("粤语", "cantonese", "yue"),
}
TASK_HINTS = {
    "translate": ("翻译", "译", "translate", "translation"),
    "transcribe": ("转录", "转写", "听写", "transcribe", "transcription", "asr"),
}

# --- fixed values: classes of a correction -----------------------------------
CN_NUMERALS = "零一二三四五六七八九十百千万两"
NUMBER_FIX, SOUND_FIX, REVISION = "数字/单位规范", "同音/形近误识", "修订"


def fmt_seconds(seconds: Column) -> Column:
    """``[MM:SS]``, or ``[HH:MM:SS]`` from one hour on; halves round to even."""
    s = F.bround(seconds).cast("long")
    h, m, sec = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("[%02d:%02d:%02d]", h, m, sec)).otherwise(F.format_string("[%02d:%02d]", m, sec))


def fmt_duration(seconds: Column) -> Column:
    m, s = F.floor(seconds / 60).cast("long"), F.floor(seconds % 60).cast("long")
    return (
        F.when(seconds <= 0, F.lit("0 秒")).when(m > 0, F.format_string("%d 分 %d 秒", m, s))
        .otherwise(F.format_string("%d 秒", s))
    )


def srt_time(seconds: Column) -> Column:
    ms = F.bround(seconds * 1000).cast("long")
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60, ms % 1000)


def to_srt(segments: DataFrame, *, stream: str = "stream", width: float = 3600.0) -> DataFrame:
    """Numbered subtitle cues, one row each; a stream's file is its cues in order."""
    numbered = number_rows(segments, [stream], "start", ["start", "end"], "cue", width)
    body = F.concat(
        F.col("cue").cast("string"), F.lit("\n"), srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end")),
        F.lit("\n"), strip(F.col("text")), F.lit("\n"),
    )
    return numbered.select(stream, "cue", body.alias("srt"))


def offset_segments(segments: DataFrame, offset: Column) -> DataFrame:
    """Shift segment and word times by ``offset`` seconds."""
    shifted = {"start": F.col("start") + offset, "end": F.col("end") + offset}
    if "words" in segments.columns:
        shifted["words"] = F.transform("words", lambda w: w.withField("start", w["start"] + offset).withField(
            "end", w["end"] + offset))
    return segments.withColumns(shifted)


def mean_confidence(words: DataFrame, by: Iterable[str], prob: str = "prob") -> DataFrame:
    return words.groupBy(*by).agg(F.bround(F.avg(prob), 3).alias("confidence"))


def merge_parts(parts: DataFrame, *, stream: str = "stream", width: float = 10_000) -> tuple[DataFrame, DataFrame]:
    """Lay recorded parts end to end: ``(parts with their offset, one row per stream)``.

    The text stays one row per part, in order; :func:`merged_text` glues it.
    """
    placed = running_sum(
        parts, [stream], "part_no", ["part_no"], F.coalesce("duration", F.lit(0.0)), "offset", width, inclusive=False
    )
    ok = F.col("status") == "ok"
    merged = parts.groupBy(stream).agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum(F.coalesce("duration", F.lit(0.0))).alias("duration"),
        F.avg("confidence").alias("confidence"),
        F.coalesce(F.min(F.when(ok, F.col("part_no"))), F.min("part_no")).alias("base_part"),
    )
    return placed, merged


def merged_text(parts: DataFrame, *, stream: str = "stream", parts_a_piece: int = 1000, width: float = 10_000) -> DataFrame:
    """The texts of a stream's parts joined by line breaks, empty ones left out: ``stream, piece, text``.

    A piece holds the texts of up to ``parts_a_piece`` parts, so a stream of
    any length is a number of bounded rows in the order of ``piece``.
    """
    said = parts.where(F.coalesce(F.col("text"), F.lit("")) != "").select(stream, "part_no", "text")
    numbered = number_rows(said, [stream], "part_no", ["part_no"], "_n", width)
    pieces = numbered.groupBy(stream, F.floor((F.col("_n") - 1) / parts_a_piece).alias("piece")).agg(
        F.array_sort(F.collect_list(F.struct("part_no", "text"))).alias("p"))
    return pieces.select(stream, "piece", F.array_join(F.col("p.text"), "\n").alias("text"))


def merged_segments(placed: DataFrame, *, stream: str = "stream") -> DataFrame:
    """The segments of placed parts on the stream's own time: ``stream, part_no, nth, start, end, text``."""
    rows = placed.select(stream, "part_no", "offset", F.posexplode("segments").alias("nth", "s"))
    return offset_segments(rows.select(stream, "part_no", "nth", "offset", "s.start", "s.end", "s.text"), F.col("offset")).drop("offset")


def quality_tier(source: Column, confidence: Column) -> Column:
    cut = F.when(source == "transcript", MEDIUM_TRANSCRIPT).otherwise(MEDIUM_OTHER)
    return (
        F.when(confidence.isNull(), "unknown").when(confidence < LOW, "low").when(confidence < cut, "medium")
        .otherwise("high")
    )


def confidence_gate(boxes: DataFrame, by: Iterable[str], threshold: float = 0.85, score: str = "score") -> DataFrame:
    mean = F.bround(F.avg(score), 3)
    return boxes.groupBy(*by).agg(F.count(F.lit(1)).alias("num_boxes"), mean.alias("avg_confidence")).withColumn(
        "suggest_upgrade", F.col("avg_confidence") < threshold
    )


def diff_kind(raw: Column, corrected: Column) -> Column:
    digits, digits_c = F.regexp_replace(raw, r"\P{Nd}", ""), F.regexp_replace(corrected, r"\P{Nd}", "")
    gap = F.abs(F.length(raw) - F.length(corrected))
    numeral = F.concat(raw, corrected).rlike(f"[{CN_NUMERALS}]")
    return (
        F.when(raw == corrected, "").when((digits != "") & (digits != digits_c), NUMBER_FIX)
        .when(numeral & (gap <= 3), NUMBER_FIX).when(gap <= 2, SOUND_FIX).otherwise(REVISION)
    )


def correction_entries(raw: DataFrame, corrected: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Segments whose text changed: ``key, idx, raw, corrected, kind``."""
    pair = raw.select(key, "idx", strip(F.col("text")).alias("raw")).join(
        corrected.select(key, "idx", strip(F.col("text")).alias("corrected")), [key, "idx"]
    )
    return pair.where(F.col("raw") != F.col("corrected")).withColumn("kind", diff_kind(F.col("raw"), F.col("corrected")))


def correction_notes(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """One line per document: how many corrections of each class, in order of first use."""
    per = entries.groupBy(key, "kind").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))
    part = F.struct("first", F.concat(F.col("kind"), F.lit(" "), F.col("n").cast("string"), F.lit(" 处")).alias("t"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), "、")
    return per.groupBy(key).agg(
        F.concat(F.lit("共纠正 "), F.sum("n").cast("string"), F.lit(" 处："), listed).alias("notes")
    )


def apply_corrections(raw: DataFrame, corrected: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Use corrected text only where a document has as many corrected segments as raw ones."""
    n_raw = raw.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    n_cor = corrected.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    agree = n_raw.join(n_cor, [key, "n"]).select(key)
    usable = corrected.join(agree, key, "left_semi").select(key, "idx", F.col("text").alias("_c"))
    return raw.join(usable, [key, "idx"], "left").select(
        key, "idx", F.coalesce("_c", "text").alias("text"), F.col("text").alias("raw_text"),
        F.col("_c").isNotNull().alias("applied"),
    )


def points_at_picture(text: Column) -> Column:
    low = F.lower(text)
    return low.rlike("|".join(DEICTIC))


def referenced_points(segments: DataFrame) -> DataFrame:
    """Segments that point at a picture, with the time halfway through."""
    return segments.where(points_at_picture(F.col("text"))).withColumns({
        "timestamp": F.bround((F.col("start") + F.col("end")) / 2.0, 2),
        "segment_start": F.bround("start", 2), "segment_end": F.bround("end", 2), "segment_text": strip(F.col("text")),
    })


#: Frames of a stream that are summed up in one row.
SILENCE_BLOCK = 4096


def silence_split(frames: DataFrame, *, stream: str = "stream", share: float = SILENCE_SHARE,
                  silence_frames: int = SILENCE_MS // FRAME_MS, piece_frames: int = PIECE_MS // FRAME_MS,
                  block: int = SILENCE_BLOCK) -> DataFrame:
    """Cut streams in the middle of long silences: ``stream, piece, first_frame, end_frame``.

    ``frames``: ``stream, frame_idx`` (dense from 0), ``rms``; a null level is
    loud.  A block of frames is one row.  Its summary is where it is loud for
    the first and the last time, and the cuts between; a silence that goes on
    over blocks lies between the last loud frame before a block and its first.
    A piece that is too short belongs to the one before it, so only cuts with
    enough behind them count.  Frames are exchanged once; what else is put in
    order per stream is one row per block.
    """
    # quietness is told against the peak of the whole stream, so blocks keep their levels until it is known
    rows = frames.withColumn("_b", F.floor(F.col("frame_idx") / block)).groupBy(stream, "_b").agg(
        F.array_sort(F.collect_list(F.struct("frame_idx", "rms"))).alias("f"), F.max("rms").alias("top"), F.count(F.lit(1)).alias("n"))
    rows = cut_lineage(rows)
    level = cut_lineage(rows.groupBy(stream).agg(F.max("top").alias("_peak"), F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_blocks")))
    rows = attach(rows, level, [stream], "_blocks")
    peak = F.when(F.col("_peak") == 0, 1.0).otherwise(F.col("_peak"))
    loud = F.transform(F.filter("f", lambda x: ~F.coalesce(x["rms"] / peak < share, F.lit(False))), lambda x: x["frame_idx"])

    def cuts(before: Column, after: Column) -> Column:
        """The middles of the long silences between the loud frames ``before`` and ``after``."""
        silent = F.zip_with(before, after, lambda p, q: F.struct((p + 1).alias("a"), (q - p - 1).alias("run")))
        return F.transform(F.filter(silent, lambda r: r["run"] >= silence_frames), lambda r: r["a"] + F.floor(r["run"] / 2).cast("long"))

    rows = rows.select(stream, "_b", "_n", pinned(loud).alias("loud"))
    inner = cuts(F.slice("loud", F.lit(1), F.greatest(F.size("loud") - 1, F.lit(0))), F.slice("loud", F.lit(2), F.size("loud")))
    rows = cut_lineage(rows.select(stream, "_b", "_n", F.get("loud", F.lit(0)).alias("first"), F.get("loud", F.size("loud") - 1).alias("last"), inner.alias("inner")))

    w = W.partitionBy(stream).orderBy("_b")
    before, after = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
    ends = F.col("_b") == F.max("_b").over(W.partitionBy(stream))
    heard = F.coalesce(F.max("last").over(before), F.lit(-1))
    rows = rows.withColumns({"heard": heard, "ends": ends})
    lead = F.when(F.col("first").isNotNull(), cuts(F.array("heard"), F.array("first")))
    tail = F.when(F.col("ends"), cuts(F.array(F.greatest("heard", F.coalesce("last", F.lit(-1)))), F.array("_n")))
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("cuts", F.concat(F.coalesce(lead, none), F.coalesce("inner", none), F.coalesce(tail, none)))
    following = F.coalesce(F.min(F.get("cuts", F.lit(0))).over(after), F.col("_n"))
    rows = rows.withColumn("next", F.concat(F.slice("cuts", F.lit(2), F.size("cuts")), F.array(following)))
    own = F.filter(F.arrays_zip("cuts", "next"), lambda c: c["next"] - c["cuts"] >= piece_frames)
    rows = rows.withColumn("own", F.transform(own, lambda c: c["cuts"]))
    rows = rows.withColumns({"so_far": F.coalesce(F.sum(F.size("own")).over(before), F.lit(0)),
                             "then": F.coalesce(F.min(F.get("own", F.lit(0))).over(after), F.col("_n")),
                             "opens": F.col("_b") == F.min("_b").over(W.partitionBy(stream))})
    first = F.when(F.col("opens"), F.array(F.lit(0).cast("long"))).otherwise(none)
    rows = rows.withColumns({"starts": F.concat(first, "own"), "number": F.col("so_far") + F.when(F.col("opens"), 1).otherwise(2)})
    pieces = rows.withColumn("stops", F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array("then"))).select(
        stream, "number", F.posexplode(F.arrays_zip("starts", "stops")).alias("i", "p"))
    return pieces.where("p.starts is not null").select(
        stream, (F.col("number") + F.col("i")).cast("long").alias("piece"), F.col("p.starts").alias("first_frame"), F.col("p.stops").alias("end_frame"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sampled(frames: DataFrame, interval: float, *, stream: str = "stream", block: float = 3600.0) -> DataFrame:
    """Every frame whose time has reached the next multiple of ``interval``.

    The counting rule ``taken += t >= taken * interval`` has the closed form
    ``taken_i = i + min(0, min_{j<=i}(floor(t_j / interval) + 1 - j))``.
    """
    numbered = cut_lineage(number_rows(frames, [stream], "t", ["t"], "_i", block))
    slack = (F.floor(F.col("t") / F.lit(interval)) + 1 - F.col("_i")).cast("long")
    low = cut_lineage(running_min(numbered.withColumn("_f", slack), [stream], "_i", "_f", "_low", block))
    taken = F.col("_i") + F.least(F.lit(0), F.col("_low"))
    before = previous(low.withColumn("_a", taken), [stream], "_i", ["_i"], F.col("_a"), "_b", block)
    return before.where(F.col("_a") > F.coalesce("_b", F.lit(0))).drop("_i", "_f", "_low", "_a", "_b")


#: Candidates of a stream that are linked in one step.
KEY_BLOCK = 512


def _first_far(hashes: np.ndarray, key: int, bits: int) -> int:
    """Place of the first hash that differs from ``key`` by more than ``bits`` bits, or -1."""
    far = np.bitwise_count((hashes ^ np.int64(key)).view(np.uint64)) > bits
    return int(far.argmax()) if far.any() else -1


def _linked(bits: int):
    """For each block the place of each candidate's successor in it (-1: none), and where its chain leaves the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            follows, leaves = [], []
            for row in batch.column("hashes"):
                h = np.array(row.as_py(), dtype=np.int64)
                far = np.triu(np.bitwise_count((h[:, None] ^ h[None, :]).view(np.uint64)) > bits, 1)
                follow = np.where(far.any(axis=1), far.argmax(axis=1), -1)
                leave = np.arange(len(h))
                for i in range(len(h) - 2, -1, -1):
                    if follow[i] >= 0:
                        leave[i] = leave[follow[i]]
                follows.append(follow.tolist())
                leaves.append(leave.tolist())
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(follows, ints), pa.array(leaves, ints)], [*batch.schema.names, "follow", "leave"])

    return run


def _entered(bits: int):
    """Where the keys that wait in front of a block would enter it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.array(x.as_py(), dtype=np.int64) for x in batch.column("hashes")]
            at = [_first_far(h, k, bits) for h, k in zip(hashes, batch.column("key").to_pylist(), strict=True)]
            to = [x.as_py()[i] if i >= 0 else -1 for x, i in zip(batch.column("leave"), at, strict=True)]
            kept = [batch.column(c) for c in ("_s", "b", "e", "_to")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(at, pa.int32()), pa.array(to, pa.int32())], ["_s", "b", "e", "_to", "at", "e2"])

    return run


def _chains(links: DataFrame, bits: int, kind: str) -> DataFrame:
    """From where a chain leaves a block (``_s, b, e``) to where it enters a later one (``b2, at``) and leaves that (``e2``).

    A key waits in front of the next block until a candidate there differs.
    Those that meet none look at two blocks, then four and so on, so a long
    stretch without a change takes few rounds.
    """
    ends = links.groupBy("_s").agg(F.max("b").alias("_last"))
    waiting = links.select("_s", "b", "hashes", F.explode(F.array_distinct("leave")).alias("e")).select(
        "_s", "b", "e", F.get("hashes", F.col("e")).alias("key")).join(ends, "_s")
    waiting = cut_lineage(waiting.select("*", (F.col("b") + 1).alias("_from")).where("_from <= _last"))
    found, width = None, 1
    while not waiting.isEmpty():
        ahead = F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (width - 1), F.col("_last")))).alias("_to")
        met = waiting.select("_s", "b", "e", "key", ahead).join(links.select("_s", F.col("b").alias("_to"), "hashes", "leave"), ["_s", "_to"])
        met = met.select("_s", "b", "e", "_to", "key", "hashes", "leave").mapInArrow(_entered(bits), f"_s {kind}, b long, e int, _to long, at int, e2 int")
        first = cut_lineage(met.where("at >= 0").groupBy("_s", "b", "e").agg(F.min(F.struct("_to", "at", "e2")).alias("m")))
        new = first.select("_s", "b", "e", F.col("m._to").alias("b2"), "m.at", "m.e2")
        found = new if found is None else found.unionByName(new)
        waiting = waiting.join(first, ["_s", "b", "e"], "left_anti").withColumn("_from", F.col("_from") + width)
        waiting, width = cut_lineage(waiting.where("_from <= _last")), width * 2
    if found is None:
        return links.select("_s", "b", F.lit(0).alias("e"), F.col("b").alias("b2"), F.lit(0).alias("at"), F.lit(0).alias("e2")).limit(0)
    return cut_lineage(found)


def _visited(links: DataFrame, chains: DataFrame) -> DataFrame:
    """The places where the chain from a stream's first candidate leaves its blocks, by pointer doubling."""
    seen = cut_lineage(links.where("b = 0").select("_s", "b", F.get("leave", F.lit(0)).alias("e")))
    jump = chains.select("_s", "b", "e", "b2", "e2")
    while not jump.isEmpty():
        seen = cut_lineage(seen.unionByName(seen.join(jump, ["_s", "b", "e"]).select("_s", F.col("b2").alias("b"), F.col("e2").alias("e"))))
        again = jump.select("_s", F.col("b").alias("b2"), F.col("e").alias("e2"), F.col("b2").alias("b3"), F.col("e2").alias("e3"))
        jump = cut_lineage(jump.join(again, ["_s", "b2", "e2"]).select("_s", "b", "e", F.col("b3").alias("b2"), F.col("e3").alias("e2")))
    return seen


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of a block's candidates from where it is entered to where it is left."""
    for batch in batches:
        out = []
        for follow, at in zip(batch.column("follow").to_pylist(), batch.column("at").to_pylist(), strict=True):
            path = []
            while at >= 0:
                path.append(at)
                at = follow[at]
            out.append(path)
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_s", "times", "hashes")], pa.array(out, pa.list_(pa.int32()))], ["_s", "times", "hashes", "path"])


def keyframes(hashes: DataFrame, *, interval: float | None = None, scene_bits: int = SCENE_BITS,
              key_bits: int = KEY_BITS, limit: int | None = None, stream: str = "stream", block: float = 3600.0) -> DataFrame:
    """Scene changes that also differ from the last key frame, at most ``limit`` per stream if it is given.

    ``hashes``: ``stream, t, hash`` (64-bit).  Sampling and scene change are
    window work.  Which candidate is the next key depends only on the last
    one, so each has one successor: the next that differs from it.  Within
    blocks of :data:`KEY_BLOCK` candidates successors come from one table of
    distances; where a chain leaves a block it is linked to the block it enters
    next (:func:`_chains`), and pointer doubling from a stream's first
    candidate tells which of these links are used.  No task holds a stream.
    A null stream is a stream; ties in ``t`` go by hash; frames without a hash
    are left out.
    """
    frames = hashes.select(stream, "t", "hash").where("hash is not null")
    if interval:
        frames = cut_lineage(sampled(frames, interval, stream=stream, block=block))
    scene = previous(frames, [stream], "t", ["t"], F.col("hash"), "last", block)
    candidates = scene.where(F.col("last").isNull() | (hamming(F.col("hash"), F.col("last")) > scene_bits)).select(
        stream, "t", "hash"
    )
    numbered = number_rows(cut_lineage(candidates), [stream], "t", ["t", "hash"], "_n", block)
    rows = numbered.select(F.struct(stream).alias("_s"), F.floor((F.col("_n") - 1) / KEY_BLOCK).alias("b"), F.struct("t", "hash").alias("f"))
    blocks = rows.groupBy("_s", "b").agg(F.array_sort(F.collect_list("f")).alias("f"))
    blocks = blocks.select("_s", "b", F.col("f.t").alias("times"), F.col("f.hash").alias("hashes"))
    kind = blocks.schema["_s"].dataType.simpleString()
    links = cut_lineage(blocks.mapInArrow(_linked(key_bits), f"_s {kind}, b long, times array<double>, hashes array<long>, follow array<int>, leave array<int>"))
    chains = _chains(links, key_bits, kind)
    entries = _visited(links, chains).join(chains, ["_s", "b", "e"]).select("_s", F.col("b2").alias("b"), "at")
    entries = entries.unionByName(links.where("b = 0").select("_s", "b", F.lit(0).alias("at")))
    paths = entries.join(links, ["_s", "b"]).select("_s", "times", "hashes", "follow", "at").mapInArrow(
        _followed, f"_s {kind}, times array<double>, hashes array<long>, path array<int>")
    keys = paths.select("_s", "times", "hashes", F.explode("path").alias("i")).select(
        F.col(f"_s.{stream}").alias(stream), F.get("times", F.col("i")).alias("t"), F.get("hashes", F.col("i")).alias("hash"))
    keys = number_rows(cut_lineage(keys), [stream], "t", ["t", "hash"], "ordinal", block)
    return keys if limit is None else keys.where(F.col("ordinal") <= limit)


def batch_report(results: DataFrame, *, account: str = "account", status: str = "status") -> DataFrame:
    """Counts per status for each account and overall (account null)."""
    return results.rollup(account, status).agg(F.count(F.lit(1)).alias("n")).where(
        F.col(status).isNotNull() | F.col(account).isNull()
    )


def first_titles(results: DataFrame, *, account: str = "account", order: Iterable[str] = ("id",),
                 title: str = "title", k: int = 20) -> DataFrame:
    """Number of entries and the first ``k`` titles per account."""
    order = list(order)
    top = spread_topk(results.select(account, *order, title), [account], order, k)
    titles = top.groupBy(account).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", title))), lambda e: e[title]).alias("titles")
    )
    return results.groupBy(account).agg(F.count(F.lit(1)).alias("n")).join(titles, account)


def cache_key(content: Column, options: dict[str, Column]) -> Column:
    """``sha256(content):sha256(options)``; output folder and cache switch do not count."""
    relevant = {k: v for k, v in sorted(options.items()) if k not in ("out_dir", "use_cache")}
    blob = F.to_json(F.struct(*[v.alias(k) for k, v in relevant.items()]))
    return F.concat(F.sha2(content, 256), F.lit(":"), F.sha2(blob, 256))


def incremental(inputs: DataFrame, store: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """``(stored results that can be reused, inputs still to compute)``."""
    return store.join(inputs.select(key).distinct(), key, "left_semi"), inputs.join(store.select(key), key, "left_anti")


def language_hint(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, words in LANGUAGE_HINTS.items():
        chain = chain.when(reduce(or_, (low.contains(w) for w in words)), F.lit(code))
    return chain


def task_hint(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for task, words in TASK_HINTS.items():
        chain = chain.when(reduce(or_, (low.contains(w) for w in words)), F.lit(task))
    return chain


def boxes_to_text(boxes: DataFrame, page: Iterable[str], order: str = "box_no", text: str = "text") -> DataFrame:
    """Boxes of one page joined in reading order (a page bounds the array)."""
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda b: b[text]), "\n"
    )
    return boxes.where(F.col(text).isNotNull()).groupBy(*page).agg(joined.alias("text"))


def media_type(path: Column) -> Column:
    """transcript / video / ocr / doc_extract by extension, or null."""
    from palimpsest.functions.detection import extension

    ext, chain = extension(path), F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, exts in P.MEDIA_EXT.items():
        chain = chain.when(ext.isin(*exts), F.lit(kind))
    return chain
