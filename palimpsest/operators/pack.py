"""Content-pack records: anchors, frames, naming, integrity gates, roll-ups."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.functions.patterns import D, WS
from palimpsest.functions.scale import by_key, number_rows, pinned
from palimpsest.functions.splice import let, matches
from palimpsest.functions.text import strip
from palimpsest.operators.similarity import line_array
from palimpsest.session import cut_lineage

# --- fixed values: file names, anchors, images -------------------------------
CHAPTER = rf"^[{WS}]*第[{WS}]*({D}+)[{WS}]*([章节])"
D13_FRAME = rf"^frame_({D}+)_({D}+)\.png$"
KEY_FRAME = rf"^.+_kf_{D}+_({D}+)\.png$"
MD_IMAGE = r"!\[[^\]]*\]\(<?([^)>]+)>?\)"
ARROW_ANCHOR = rf"▶[{WS}]*\*{{0,2}}[{WS}]*(?:({D}{{1,2}}):)?({D}{{1,2}}):({D}{{2}})[{WS}]*\*{{0,2}}"
STAMP_ANCHOR = rf"^[{WS}]*\[(?:({D}{{1,2}}):)?({D}{{1,2}}):({D}{{2}})\][{WS}]*"
MD_HEADING = rf"^(#{{1,6}})[{WS}]+(.+?)[{WS}]*$"
SHOT_NAME = rf"(?i)^第({D}{{2,3}})节_图({D}{{2,3}})_(.+)\.(png|jpe?g)$"
MEANINGFUL = r"[\x{4e00}-\x{9fff}]|[A-Za-z0-9]{2,}"
COURSE_LEVEL = ("README.md", "00_课程总览_索引.md", "小节视频清单.csv", "产品切片清单.csv", "文案汇总.md", "小节视频索引.md")
GENERIC_HEADINGS = ("开场", "引言", "前言", "介绍", "导入", "概述", "正文", "结语", "结束", "收尾", "导论", "引入", "背景",
                    "本节", "本课")
KEYWORD = r"[\x{4e00}-\x{9fff}]{2,}|[A-Za-z][A-Za-z0-9_&+.-]{1,}"
KEYWORD_TRIM = "、，。：；！？·()（）【】[]《》\"'"
STOP = tuple("""
的 了 是 和 与 在 有 我 你 他 她 它 这 那 一个 我们 你们 他们 就是 什么 怎么 可以 这个 那个 然后 因为 所以 但是 如果 已经 还是
不是 没有 时候 这样 一样 非常 其实 大家 可能 需要 知道 看到 觉得 东西 问题 视频 课程 本节 这一 一张 第一 第二 第三 以及 而且
只是 还有 比如 例如 那么 这么 一些 一下 部分 内容 图片 截图 例子 情况 地方 上面 下面 里面 出来 起来 进去
""".split())

# --- fixed values: slide classes ---------------------------------------------
SLIDE_TOC = "目录|CONTENTS|课程大纲|课程内容|本课内容|本节内容|内容提要|课程结构|课程安排"
SLIDE_SUMMARY = "小[结节]|总结|回顾|要点|综上所述|本节课我们|我们学习了|谢谢观看|感谢观看|感谢收看|下节课|预告|思考题|结语|再见"
SLIDE_COVER = rf"课程封面|入门篇|进阶篇|系列课|讲师|主讲|授课|第[{WS}]*{D}+[{WS}]*课|课时安排"


def chapter_number(name: Column) -> Column:
    """Chapter number without leading zeros, '' where there is none."""
    digits = F.regexp_extract(F.coalesce(name, F.lit("")), CHAPTER, 1)
    bare = F.regexp_replace(digits, "^0+", "")
    return F.when(digits == "", "").when(bare == "", "0").otherwise(bare)


def section_prefix(section: Column) -> Column:
    digits, unit = F.regexp_extract(section, CHAPTER, 1), F.regexp_extract(section, CHAPTER, 2)
    number = F.coalesce(chapter_number(section).try_cast("int"), F.lit(0))
    return (
        F.when(digits != "", F.concat(F.format_string("第%02d", number), unit, F.lit("_")))
        .when(F.coalesce(section, F.lit("")) == "", "").otherwise(F.concat(section, F.lit("_")))
    )


def section_files(files: DataFrame, sections: DataFrame, drop_course_level: bool = False) -> DataFrame:
    """Files of each section: same chapter number, or no number at all.

    The numbered files meet their section by equi-join.  Unnumbered files belong
    to every section: they come as a second, separate frame of rows with a null
    section, not copied once per section.
    """
    numbered = files.withColumn("digits", chapter_number(F.col("name")))
    own = numbered.where("digits != ''").join(
        sections.select("section", chapter_number(F.col("section")).alias("digits")).where("digits != ''"), "digits"
    )
    shared = numbered.where("digits = ''").withColumn("section", F.lit(None).cast("string"))
    if drop_course_level:
        shared = shared.where(~F.col("name").isin(*COURSE_LEVEL))
    return own.select("section", *files.columns).unionByName(shared.select("section", *files.columns))


def kw_tokens(text: Column) -> Column:
    found = F.transform(matches(F.coalesce(text, F.lit("")), KEYWORD), lambda t: F.btrim(t, F.lit(KEYWORD_TRIM)))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*STOP))


def kw_hit(keyword: Column, text: Column) -> Column:
    """Substring hit; from five characters on, any three in a row count too."""
    windows = F.sequence(F.lit(1), F.greatest(F.length(keyword) - 2, F.lit(1)))
    loose = (F.length(keyword) >= 5) & F.exists(windows, lambda i: text.contains(F.substr(keyword, i, F.lit(3))))
    return (keyword != "") & (text != "") & (text.contains(keyword) | loose)


def kw_score(keywords: Column, text: Column) -> Column:
    return F.size(F.filter(keywords, lambda k: kw_hit(k, text)))


def ocr_lines(text: Column) -> Column:
    raw = F.coalesce(text, F.lit(""))
    parts = F.when(raw.contains("\n"), F.split(raw, "\n", -1)).otherwise(F.split(raw, r" \| ", -1))
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def parse_anchors(docs: DataFrame, *, key: str = "doc_id", text: str = "text", max_body: int | None = None) -> DataFrame:
    """Time anchors of Markdown transcripts with the heading above and a body excerpt.

    A document with one arrow anchor is read in arrow mode throughout, else its
    ``[MM:SS]`` line starts are taken.  Windows are bounded by one document.
    """
    w = W.partitionBy(key).orderBy("pos")
    t, ln = F.col(text), F.col("line")
    base = by_key(docs.select(key, text), key)
    # ahead of the lines: beside them, the whole text would be searched again for each
    base = base.select(key, text, pinned(F.when(t.rlike(ARROW_ANCHOR), "arrow").otherwise("ts")).alias("mode"))
    rows = base.select(key, "mode", F.posexplode(line_array(t)).alias("pos", "line"))
    head = F.when(ln.rlike(MD_HEADING), strip(F.regexp_extract(ln, MD_HEADING, 2)))
    clean = F.when(strip(ln) != "", strip(ln))
    rows = rows.withColumns({
        "heading": F.coalesce(F.last(head, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit("")),
        "after": F.first(clean, ignorenulls=True).over(w.rowsBetween(1, 3)),
    })
    arrow = F.col("mode") == "arrow"

    def group(i: int) -> Column:
        return F.when(arrow, F.regexp_extract(ln, ARROW_ANCHOR, i)).otherwise(F.regexp_extract(ln, STAMP_ANCHOR, i))

    hit = F.when(arrow, ln.rlike(ARROW_ANCHOR)).otherwise(ln.rlike(STAMP_ANCHOR))
    rest = F.when(arrow, F.get(F.split(ln, ARROW_ANCHOR, 2), F.lit(1))).otherwise(
        F.regexp_replace(ln, STAMP_ANCHOR, ""))
    body = F.btrim(rest, F.lit(" *|　-—"))
    hour = F.coalesce(group(1).try_cast("int"), F.lit(0))
    minute, second = group(2).try_cast("int"), group(3).try_cast("int")
    stamp = F.concat(
        F.when(group(1) != "", F.format_string("%02d:", hour)).otherwise(""), F.format_string("%02d:%02d", minute, second)
    )
    said = F.when(body == "", F.coalesce("after", F.lit(""))).otherwise(body)
    return rows.where(hit).select(
        key, (F.col("pos") + 1).alias("line_no"), "mode", (hour * 3600 + minute * 60 + second).alias("time_sec"),
        stamp.alias("timecode"), "heading",
        (F.substring(said, 1, max_body) if max_body else said).alias("body"),
    )


def frame_time(name: Column) -> Column:
    """Seconds encoded in a frame's file name, or null."""
    whole, part = F.regexp_extract(name, D13_FRAME, 1), F.regexp_extract(name, D13_FRAME, 2)
    d13 = whole.try_cast("long") + part.try_cast("long") / 100.0
    return F.when(name.rlike(D13_FRAME), d13).when(
        name.rlike(KEY_FRAME), F.regexp_extract(name, KEY_FRAME, 1).try_cast("long") / 100.0
    )


def frame_index(frames: DataFrame, segments: DataFrame, *, stem: str = "stem", tolerance: float = 0.01) -> DataFrame:
    """Frames with the text of the segment shown at (almost) the same time.

    Times are bucketed by the tolerance; each segment is offered to its own and
    the two neighbouring buckets, so the range test becomes an equi-join.
    """
    f = frames.withColumn("ts", frame_time(F.col("name"))).withColumn("_b", F.floor(F.col("ts") / tolerance))
    s = segments.select(
        stem, F.col("timestamp").alias("_t"), F.col("segment_no"), F.col("segment_text"),
        F.explode(F.array(*[F.floor(F.col("timestamp") / tolerance) + d for d in (-1, 0, 1)])).alias("_b"),
    )
    near = f.join(s, [stem, "_b"]).where(F.abs(F.col("ts") - F.col("_t")) < tolerance)
    first = near.groupBy(stem, "name").agg(F.min_by("segment_text", "segment_no").alias("segment_text"))
    return f.drop("_b").join(first, [stem, "name"], "left").withColumn(
        "segment_text", F.coalesce("segment_text", F.lit(""))
    )


#: Frames of one side that a task compares at once.
TILE = 4096


def _within(threshold: float):
    """Pairs ``id, early, mad`` of a tile's frames whose signatures differ by at most ``threshold`` in the mean."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, early = left["id"].to_numpy(), right["early"].to_numpy()
        a, b = (np.stack(list(side["sig"])).astype(np.int64) for side in (left, right))
        n, out = a.shape[1], []
        top = max(int(np.abs(a).max()), int(np.abs(b).max())) * 2 * n
        a, b = (np.ascontiguousarray(x.T.astype(np.int32 if top < 2**31 else np.int64)) for x in (a, b))
        step = max(1, 2**18 // len(early))
        for lo in range(0, len(ids), step):
            part = a[:, lo:lo + step]
            total, diff = (np.zeros((part.shape[1], len(early)), a.dtype) for _ in range(2))
            for x, y in zip(part, b, strict=True):
                np.subtract(x[:, None], y[None, :], out=diff)
                total += np.abs(diff, out=diff)
            i, j = np.nonzero((total / n <= threshold) & (early[None, :] < ids[lo:lo + step, None]))
            out.append(pd.DataFrame({"id": ids[lo + i], "early": early[j], "mad": total[i, j] / n}))
        return pd.concat(out)

    return run


def _near_frames(grid: DataFrame, section: str, threshold: float) -> DataFrame:
    """Pairs ``section, id, early, mad`` of frames within ``threshold``.

    A cell's frames meet those of its own and the neighbouring cells in tiles of
    about :data:`TILE` by :data:`TILE`, so a cell that holds a whole section is
    spread over tasks, and only near pairs become rows.
    """
    cell = [section, "size", "g0", "g1", "g2"]
    offered = grid.select(section, "size", F.col("id").alias("early"), "sig", "g0", "g1", "g2")
    for g in cell[2:]:
        offered = offered.withColumn(g, F.explode(F.array(*[F.col(g) + d for d in (-1, 0, 1)])))
    sizes = grid.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    met = sizes
    for g in cell[2:]:
        met = met.withColumn(g, F.explode(F.array(*[F.col(g) + d for d in (-1, 0, 1)])))
    met = met.groupBy(*cell).agg(F.sum("_n").alias("_m"))
    parts = cut_lineage(sizes.join(met, cell).select(
        *cell, F.ceil(F.col("_n") / TILE).cast("int").alias("_lp"), F.ceil(F.col("_m") / TILE).cast("int").alias("_rp")))

    def dealt(rows: DataFrame, number: str, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        part = F.pmod(F.xxhash64(number), F.col(own)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return rows.join(parts, cell).select(*cell, number, "sig", part.alias(names[0]), each.alias(names[1]))

    left, right = dealt(grid, "id", "_lp", "_rp", ("_l", "_r")), dealt(offered, "early", "_rp", "_lp", ("_r", "_l"))
    kinds = {f.name: f.dataType.simpleString() for f in grid.schema}
    compare = _within(threshold)

    def keyed(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = compare(a, b) if len(a) and len(b) else pd.DataFrame({"id": [], "early": [], "mad": []})
        found.insert(0, "section", pd.Series([key[0]] * len(found), index=found.index, dtype=object))
        return found

    tile = [F.col(c) for c in (*cell, "_l", "_r")]
    pairs = left.groupBy(*tile).cogroup(right.toDF(*right.columns).groupBy(*tile)).applyInPandas(
        keyed, f"section {kinds[section]}, id {kinds['id']}, early {kinds['id']}, mad double")
    return pairs.withColumnRenamed("section", section)


def dedup_frames(frames: DataFrame, threshold: float = 2.0, *, section: str = "section", frame: str = "frame_id",
                 sig: str = "sig") -> DataFrame:
    """Near-duplicate frames: an earlier kept frame within ``threshold`` mean absolute difference.

    A frame is kept exactly when no earlier *kept* frame is near it.  Identical
    signatures are folded into their first frame; near pairs of the remaining
    ones are found once, on a grid over three partial means (frames within the
    threshold differ by a bounded amount in each); the kept set then settles in
    rounds, each deciding every frame whose earlier neighbours are all decided.
    No section is ever gathered into one task.  Frame numbers are integers.
    """
    uniq = frames.groupBy(section, sig).agg(F.min(frame).alias("id"))
    n = F.size(sig)
    third = F.ceil(n / 3).cast("int")

    def cell(i: int) -> Column:
        part = F.slice(sig, third * i + 1, third)
        total = F.aggregate(part, F.lit(0).cast("long"), lambda acc, v: acc + v)
        return F.floor(total / (F.lit(threshold) * n)).cast("long")  # sums differ by at most threshold * n

    grid = cut_lineage(uniq.select(
        section, "id", F.col(sig).alias("sig"), n.alias("size"), *[cell(i).alias(f"g{i}") for i in range(3)]))
    # without a section or with gaps in its signature, a frame is near none
    placed = grid.where(reduce(and_, (F.col(c).isNotNull() for c in (section, "g0", "g1", "g2"))))
    near = cut_lineage(_near_frames(placed, section, threshold))
    state = grid.select(section, "id").join(near.select(section, "id").distinct(), [section, "id"], "left_anti")
    kept = cut_lineage(state)
    open_ = cut_lineage(grid.select(section, "id").join(kept, [section, "id"], "left_anti"))
    while not open_.isEmpty():
        edges = near.join(open_, [section, "id"], "left_semi")
        early_kept = edges.join(kept.select(section, F.col("id").alias("early")), [section, "early"], "left_semi")
        dropped = early_kept.select(section, "id").distinct()
        waiting = edges.join(open_.select(section, F.col("id").alias("early")), [section, "early"], "left_semi").select(
            section, "id").distinct()
        rest = open_.join(dropped, [section, "id"], "left_anti")
        free = rest.join(waiting, [section, "id"], "left_anti")
        kept = cut_lineage(kept.unionByName(free))
        open_ = cut_lineage(rest.join(free, [section, "id"], "left_anti"))
    # nearest kept frame, earliest first on a tie; only kept frames before the frame count
    leaders = kept.select(section, F.col("id").alias("early"))
    both = near.select(section, F.col("id").alias("_first"), "early", "mad").unionByName(
        near.select(section, F.col("early").alias("_first"), F.col("id").alias("early"), "mad"))
    self = placed.select(section, F.col("id").alias("_first"), F.col("id").alias("early"), F.lit(0.0).alias("mad"))
    around = both.unionByName(self).join(leaders, [section, "early"], "left_semi")
    losers = frames.select(section, frame, sig).join(
        kept.select(section, F.col("id").alias(frame)), [section, frame], "left_anti")
    firsts = losers.join(placed.select(section, F.col("sig").alias(sig), F.col("id").alias("_first")), [section, sig]).drop(sig)
    mad = firsts.join(around, [section, "_first"]).where(F.col("early") < F.col(frame))
    best = mad.groupBy(section, frame).agg(F.min(F.struct("mad", "early")).alias("b"))
    return frames.select(section, frame).join(best, [section, frame], "left").select(
        section, frame, F.col("b").isNull().alias("selected"), F.col("b.early").alias("dup_of"),
        F.bround("b.mad", 2).alias("dup_mad"),
    )


def classify_slides(frames: DataFrame, *, text: str = "ocr_text", boxes: str = "num_boxes", ink: str = "ink",
                    char_max: int = 220, box_max: int = 14, list_box_max: int = 12, ink_max: float = 0.12) -> DataFrame:
    """knowledge / text_only with a subtype; much ink vetoes text_only."""
    raw = F.coalesce(text, F.lit(""))
    lines = ocr_lines(F.col(text))
    chars = F.length(F.regexp_replace(raw, f"[{WS}]", ""))
    nb = F.coalesce(F.col(boxes), F.size(lines))
    short = F.size(F.filter(lines, lambda x: F.length(x) <= 18)) / F.greatest(F.size(lines), F.lit(1))
    subtype = (
        F.when(raw.rlike(SLIDE_TOC), "toc").when(raw.rlike(SLIDE_SUMMARY), "summary").when(raw.rlike(SLIDE_COVER), "cover")
        .when((nb <= 3) & (chars <= 24), "transition")
        .when((F.size(lines) >= 3) & (short >= 0.8) & (nb <= list_box_max), "item_list").otherwise("")
    )
    texty = (F.col("subtype") != "") & (F.col("_chars") <= char_max) & (F.col("_nb") <= box_max)
    few_ink = F.coalesce(F.col(ink), F.lit(0.0)) <= ink_max
    return frames.withColumns({"subtype": subtype, "_chars": chars, "_nb": nb}).withColumn(
        "kind", F.when(texty & few_ink, "text_only").otherwise("knowledge")
    ).drop("_chars", "_nb")


def slide_stats(classified: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    return classified.groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("n"))


def anchor_check(anchors: DataFrame, frames: DataFrame, *, key: str = "section", anchor: Sequence[str] = ("line_no",),
                 window: float = 10.0, min_hit: int = 1, max_keywords: int | None = None, time: str = "time_sec", ts: str = "ts",
                 text: str = "ocr_text") -> DataFrame:
    """Best frame within ``±window`` of each anchor and ok / indeterminate / drift / no_frame.

    Range join by buckets of the window's width: an anchor is offered to its own
    and both neighbouring buckets, so a section holding a third of all frames is
    spread over its time axis.
    """
    a = anchors.withColumns({
        name: F.slice(kw_tokens(F.col(c)), 1, max_keywords) if max_keywords else kw_tokens(F.col(c))
        for name, c in (("head_kw", "heading"), ("alt_kw", "body"))
    }).withColumn("kws", F.when(F.size("head_kw") > 0, F.col("head_kw")).otherwise(F.col("alt_kw")))
    bucket = F.floor(F.col(time) / window)
    offered = a.select(key, *anchor, time, "kws", "alt_kw", F.explode(
        F.array(*[bucket + d for d in (-1, 0, 1)])).alias("_b"))
    f = frames.select(key, "frame_id", ts, F.coalesce(text, F.lit("")).alias("_text"),
                      F.floor(F.col(ts) / window).alias("_b"))
    delta = F.col(ts) - F.col(time)
    ranked = offered.join(f, [key, "_b"]).where(F.abs(delta) <= window).select(
        key, *anchor, F.struct(
            kw_score(F.col("kws"), F.col("_text")).alias("score"),
            kw_score(F.col("alt_kw"), F.col("_text")).alias("alt"),
            (-F.abs(F.bround(delta, 1))).alias("near"), (-F.col("frame_id")).alias("neg_id"),
            F.bround(delta, 1).alias("delta"),
        ).alias("r"),
    )
    best = ranked.groupBy(key, *anchor).agg(F.max("r").alias("best"))
    joined = a.join(best, [key, *anchor], "left")
    hit = (F.col("best.score") >= min_hit) | (F.col("best.alt") >= min_hit)
    vague = (F.col("mode") == "ts") | (F.size("head_kw") == 0) | strip(F.col("heading")).isin(*GENERIC_HEADINGS)
    status = (
        F.when(hit, "ok").when(vague, "indeterminate").when(F.col("best").isNotNull(), "drift").otherwise("no_frame")
    )
    return joined.select(
        key, *anchor, time, status.alias("status"), (-F.col("best.neg_id")).alias("best_frame"),
        F.col("best.score").alias("score"), F.col("best.delta").alias("drift_sec"),
    )


def name_rules(files: DataFrame, name: str = "name") -> DataFrame:
    """Issues of screenshot names, as an array per file."""
    n = F.col(name)
    ok = n.rlike(SHOT_NAME)
    stem = F.regexp_replace(n, r"\.[^.]*$", "")
    checks = {
        "no_chinese": ok & ~F.regexp_extract(n, SHOT_NAME, 3).rlike(r"[\x{4e00}-\x{9fff}]"),
        "pattern": ~ok,
        "zero_padding": ~ok & n.rlike(rf"^第{D}{{1}}节|_图{D}{{1}}(?!{D})"),
        "spaces": stem.contains(" ") | stem.contains("　"),
        "special_chars": n.rlike(r'[<>:"/\\|?*]'),
    }
    issues = F.array_compact(F.array(*[F.when(c, k) for k, c in checks.items()]))
    return files.withColumns({
        "pattern_ok": ok, "issues": issues,
        "chapter": F.regexp_extract(n, SHOT_NAME, 1), "index": F.regexp_extract(n, SHOT_NAME, 2),
        "desc": F.regexp_extract(n, SHOT_NAME, 3),
    })


def padding_consistency(checked: DataFrame, by: Iterable[str]) -> DataFrame:
    good = checked.where("pattern_ok")
    return good.groupBy(*by).agg(
        ((F.count_distinct(F.length("chapter")) > 1) | (F.count_distinct(F.length("index")) > 1)).alias("pad_inconsistent")
    )


def name_match(files: DataFrame, *, desc: str = "desc", para: str = "anchor_para", text: str = "ocr_text") -> DataFrame:
    """ok / mismatch / unverifiable for a name against the text in the picture."""
    kws = F.concat(kw_tokens(F.col(desc)), kw_tokens(F.col(para)))
    hits = kw_score(F.col("_kws"), F.coalesce(text, F.lit("")))
    blind = ~F.coalesce(text, F.lit("")).rlike(MEANINGFUL) | (F.size("_kws") == 0)
    verdict = F.when(F.col(text).isNull(), "ocr_failed").when(blind, "unverifiable").when(hits == 0, "mismatch").otherwise("ok")
    return files.withColumn("_kws", kws).withColumns({
        "verdict": verdict, "overlap": F.when(~blind & F.col(text).isNotNull(), hits)
    }).drop("_kws")


def validate_intervals(plan: DataFrame) -> DataFrame:
    """Rows of a cut plan that cannot be cut."""
    nameless = F.coalesce("name", F.lit("")) == ""
    return plan.withColumn(
        "problem", F.when(nameless, "missing_name").when(F.col("end") <= F.col("start"), "empty_interval")
    ).where(F.col("problem").isNotNull())


def plan_delta(plan: DataFrame, done: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Each planned cut marked reusable or still to do."""
    old = done.select("name", "hash", F.col("start").alias("_s"), F.col("end").alias("_e"))
    same = (F.abs(F.col("start") - F.col("_s")) < tolerance) & (F.abs(F.col("end") - F.col("_e")) < tolerance)
    return plan.join(old, ["name", "hash"], "left").withColumn("reused", F.coalesce(same, F.lit(False))).drop("_s", "_e")


# --- fixed values: headers of the listings -------------------------------------
CLIP_HEADER = ("节次", "节标题", "段号", "段标题", "逐字稿对应标题", "文件名", "相对路径", "起始", "结束", "时长_秒", "粒度来源")
PRODUCT_HEADER = ("产品名", "对应节次", "段号", "视频文件", "起始", "结束", "时长_秒", "文案文件")


def clip_listing(clips: DataFrame, *, section: str = "section", width: float = 10_000) -> DataFrame:
    """A section's clips numbered in the order of their start, with what their listings show.

    ``clips``: ``section, filename, folder, start, end, transcript_title,
    basis, product_name``.  Adds ``clip_no, title`` (the file name without its
    ending), ``rel_path`` and ``duration``.  A null start comes first.
    """
    rows = clips.withColumn("_at", F.coalesce(F.col("start"), F.lit(-1.0)))
    numbered = number_rows(rows, [section], "_at", ["_at", "filename"], "clip_no", width).drop("_at")
    return numbered.withColumns({
        "title": F.regexp_replace("filename", r"(?<=.)\.[^.]*$", ""), "rel_path": F.concat_ws("/", "folder", "filename"),
        "duration": F.col("end") - F.col("start"),
    })


def _seconds(column: str) -> Column:
    return F.when(F.col(column).isNull(), "").otherwise(F.format_string("%.2f", column))


def clip_rows(listing: DataFrame, *, section: str = "section") -> DataFrame:
    """The clip listing's CSV columns; times with two decimals, empty where there is none."""
    times = [_seconds(c) for c in ("start", "end", "duration")]
    columns = [F.col(section), F.col(section), F.col("clip_no"), F.col("title"), F.coalesce("transcript_title", F.lit("")), F.col("filename"), F.col("rel_path"),
               *times, F.coalesce("basis", F.lit(""))]
    return listing.select(*[c.alias(h) for c, h in zip(columns, CLIP_HEADER, strict=True)])


def product_rows(listing: DataFrame, copies: DataFrame, *, section: str = "section") -> DataFrame:
    """The product listing's CSV columns: clips with a product, and its copy text if the file is among ``copies`` (``section, name``)."""
    wanted = F.concat_ws("_", F.col(section).cast("string"), "product_name", F.lit("文案.md"))
    rows = listing.where(F.coalesce("product_name", F.lit("")) != "").withColumn("_copy", wanted)
    there = copies.select(F.col("section").alias("_s"), F.col("name").alias("_name")).distinct()
    rows = rows.join(there, (F.col(section) == F.col("_s")) & (F.col("_copy") == F.col("_name")), "left")
    times = [_seconds(c) for c in ("start", "end", "duration")]
    columns = [F.col("product_name"), F.col(section), F.col("clip_no"), F.col("filename"), *times, F.coalesce("_name", F.lit(""))]
    return rows.select(*[c.alias(h) for c, h in zip(columns, PRODUCT_HEADER, strict=True)])


def timeline(anchors: DataFrame, clips: DataFrame) -> DataFrame:
    """Anchors first, then clips, each numbered in its own order."""
    a = anchors.select("section", F.lit(1).alias("part"), F.col("time_sec").cast("double").alias("at"),
                       F.col("heading").alias("label"))
    c = clips.select("section", F.lit(2).alias("part"), F.col("start").cast("double").alias("at"),
                     F.col("name").alias("label"))
    return a.unionByName(c)


def image_refs(docs: DataFrame, *, key: Iterable[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Local image references, one row each."""
    refs = docs.select(*key, F.explode(matches(F.col(text), MD_IMAGE, 1)).alias("ref")).withColumn("ref", strip(F.col("ref")))
    return refs.where(~F.col("ref").startswith("http://") & ~F.col("ref").startswith("https://"))


def ref_integrity(refs: DataFrame, disk: DataFrame, *, ref: str = "ref", forbidden: str | None = None) -> DataFrame:
    """``issue, ref``: referenced but missing, on disk but unreferenced, in a forbidden folder."""
    used = refs.select(ref).distinct()
    have = disk.select(F.col(disk.columns[0]).alias(ref)).distinct()
    missing = used.join(have, ref, "left_anti").select(F.lit("missing").alias("issue"), ref)
    orphan = have.join(used, ref, "left_anti").select(F.lit("orphan").alias("issue"), ref)
    out = missing.unionByName(orphan)
    if forbidden:
        bad = used.where(F.col(ref).contains(forbidden)).join(have, ref, "left_semi")
        out = out.unionByName(bad.select(F.lit("forbidden").alias("issue"), ref))
    return out


def coverage_gaps(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_chars: int = 200) -> DataFrame:
    """Sections of at least ``min_chars`` characters (blanks and images aside) without an image.

    Sections are those of level 3, or of level 2 in a document without deeper headings.
    """
    rows = docs.select(key, pinned(line_array(F.col(text))).alias("lines"))
    levels = F.transform("lines", lambda ln: F.when(
        ln.startswith("#") & F.rlike(ln, F.lit(MD_HEADING)), F.length(F.regexp_extract(ln, MD_HEADING, 1))))
    rows = rows.withColumn("levels", pinned(levels))
    pick = F.when(F.array_max("levels") >= 3, 3).otherwise(2)
    places = F.filter(F.transform("levels", lambda level, i: F.when(level == F.col("pick"), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("pick", pick).withColumn("heads", pinned(places))

    def n_chars(body: Column) -> Column:
        plain = F.transform(body, lambda ln: F.when(ln.contains("!["), F.regexp_replace(ln, MD_IMAGE, "")).otherwise(ln))
        return F.aggregate(plain, F.lit(0).cast("long"), lambda n, ln: n + F.length(ln) - F.regexp_count(ln, F.lit(f"[{WS}]")))

    def section(at: Column, i: Column) -> Column:
        end = F.coalesce(F.get("heads", i + 1), F.size("lines"))
        body = F.slice("lines", at + 2, end - at - 1)
        return let(body, lambda b: F.struct(
            (i + 1).cast("long").alias("block"), strip(F.regexp_extract(F.get("lines", at), MD_HEADING, 2)).alias("heading"),
            n_chars(b).alias("n_chars"), F.exists(b, lambda ln: ln.contains("![") & F.rlike(ln, F.lit(MD_IMAGE))).alias("has_image")))

    found = rows.select(key, F.explode(F.transform("heads", section)).alias("s")).select(key, "s.*")
    return found.where((F.col("n_chars") >= min_chars) & ~F.col("has_image")).drop("has_image")


def anchor_flow(transcripts: DataFrame, deliverables: DataFrame, *, key: str = "section", text: str = "text") -> DataFrame:
    """Anchors in the source and in the deliverable of each section."""
    src = transcripts.groupBy(key).agg(F.sum(F.regexp_count(text, F.lit(ARROW_ANCHOR))).alias("n_source"))
    dst = deliverables.groupBy(key).agg(F.sum(F.regexp_count(text, F.lit(ARROW_ANCHOR))).alias("n_delivered"))
    n_src, n_dst = F.coalesce("n_source", F.lit(0)), F.coalesce("n_delivered", F.lit(0))
    return src.join(dst, key, "full").select(
        key, n_src.alias("n_source"), n_dst.alias("n_delivered"), ((n_src == 0) | (n_dst > 0)).alias("ok")
    )


def count_agreement(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """Counts per key in several record sets and whether they agree.

    One union and one aggregate instead of a chain of outer joins.
    """
    union = None
    for name, df in frames.items():
        part = df.select(key, F.lit(name).alias("src"))
        union = part if union is None else union.unionByName(part)
    counts = {n: F.count_if(F.col("src") == n).cast("long").alias(f"n_{n}") for n in frames}
    out = union.groupBy(key).agg(*counts.values())
    names = [F.col(f"n_{n}") for n in frames]
    return out.withColumn("agree", F.array_min(F.array(*names)) == F.array_max(F.array(*names)))


def records_complete(present: DataFrame, required: Sequence[str], *, key: str = "section", record: str = "record") -> DataFrame:
    """Required records each key lacks (at most ``len(required)`` per key)."""
    wanted = present.where(F.col(record).isin(*required))
    have = present.select(key).distinct().join(
        wanted.groupBy(key).agg(F.collect_set(record).alias("have")), key, "left")
    none = F.array().cast("array<string>")
    missing = F.array_except(F.array(*[F.lit(r) for r in required]), F.coalesce("have", none))
    return have.select(key, F.array_sort(missing).alias("missing"), (F.size(missing) == 0).alias("complete"))


def index_vs_disk(index: DataFrame, disk: DataFrame, key: str) -> DataFrame:
    """Entries that are only in the index or only on disk."""
    a = index.select(key).distinct().withColumn("_i", F.lit(True))
    b = disk.select(key).distinct().withColumn("_d", F.lit(True))
    return a.join(b, key, "full").where(F.col("_i").isNull() | F.col("_d").isNull()).select(
        key, F.when(F.col("_d").isNull(), "missing_on_disk").otherwise("not_in_index").alias("issue")
    )


def duration_check(clips: DataFrame, tolerance: float = 5.0, tiny: int = 200 * 1024) -> DataFrame:
    off = (F.col("measured") > 0) & (F.abs(F.col("measured") - F.col("planned")) >= tolerance)
    return clips.withColumns({"off": off, "tiny": F.col("size") <= tiny}).where(F.col("off") | F.col("tiny"))


def gate_summary(checks: DataFrame, key: str = "section") -> DataFrame:
    """Hard failures block, soft ones warn."""
    soft = F.col("level") == "soft"
    return checks.groupBy(key).agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("ok") & ~soft).cast("long").alias("failed"),
        F.count_if(~F.col("ok") & soft).cast("long").alias("warned"),
    ).withColumn("blocked", F.col("failed") > 0)


def consolidate(sections: DataFrame, key: str = "section", *, sums: Sequence[str], nullable: Sequence[str]) -> DataFrame:
    """Per section and overall (key null); unverified sections stay null, not 0.

    In the overall row nulls count as 0 and ``n_unverified`` says how many there were.
    """
    plain = [F.sum(c).alias(c) for c in sums]
    open_ = [F.sum(c).alias(c) for c in nullable]
    out = sections.rollup(key).agg(*plain, *open_, F.count_if(F.col(nullable[0]).isNull()).cast("long").alias("n_unverified"),
                                   F.grouping(key).alias("is_total"))
    return out.withColumns({c: F.when(F.col("is_total") == 1, F.coalesce(c, F.lit(0))).otherwise(F.col(c)) for c in nullable})


def ref_count(refs: DataFrame, by: Iterable[str] = (), ref: str = "ref") -> DataFrame:
    return refs.groupBy(*by).agg(F.count_distinct(ref).alias("n_refs"))


def transcript_meta(contracts: DataFrame, raw_only: DataFrame, *, stem: str = "stem") -> DataFrame:
    """Duration, language, segment count and whether no corrected copy exists."""
    degraded = raw_only.select(stem).distinct().withColumn("_raw", F.lit(True))
    return contracts.join(degraded, stem, "left").select(
        stem, F.coalesce(F.bround("duration_sec", 2), F.lit(0.0)).alias("duration_sec"),
        F.coalesce("detected_language", "language", F.lit("")).alias("language"), "segments_count", "confidence",
        F.coalesce("_raw", F.lit(False)).alias("degraded"),
    )
