"""Document diff, traceability and retrieval by token overlap (inverted-index joins)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.window import Window as W

from palimpsest.functions import text as T
from palimpsest.functions.patterns import WS
from palimpsest.functions.scale import attach, pinned, spread_topk, tiled_join
from palimpsest.functions.splice import let
from palimpsest.session import cut_lineage

# --- fixed values: thresholds, citations and headings ------------------------
MODIFIED_AT, SAME_AT, TRACEABLE_AT = 0.3, 0.85, 0.12
CITED_PENALTY = 0.15
CITATION = r"（见原文第\p{Nd}+段·句\p{Nd}+）|（见第\p{Nd}+篇·第\p{Nd}+段·句\p{Nd}+）"
KEYWORD_FOOTER = rf"^[{WS}]*关键词[：:].*$"
#: Ends of lines besides the line feed.
LINE_BREAKS = ("\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
SUMMARY_HEADING = rf"^#+[{WS}]*(摘要|关键词)[{WS}]*$"


def line_array(text: Column) -> Column:
    """Lines the way text tools split them (no empty tail after a final break)."""
    # Most texts only have line feeds, and those are split without a pattern.
    others = reduce(or_, (F.contains(text, F.lit(c)) for c in LINE_BREAKS))
    lines = F.when(others, F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]", -1)).otherwise(F.split(text, "\n", -1))
    return let(lines, lambda ln: F.when((F.size(ln) > 1) & (F.element_at(ln, -1) == ""), F.slice(ln, 1, F.size(ln) - 1)).otherwise(ln))


def clean_summary(text: Column) -> Column:
    """Drop citations, the keyword footer and summary headings."""
    kept = F.filter(
        line_array(text),
        lambda ln: ~F.rlike(ln, F.lit(KEYWORD_FOOTER)) & ~F.rlike(T.strip(ln), F.lit(SUMMARY_HEADING)),
    )
    return F.array_join(F.transform(kept, lambda ln: F.regexp_replace(ln, CITATION, "")), "\n")


def _sentences(pairs: DataFrame, key: str, text: str, index: str) -> DataFrame:
    rows = pairs.select(key, F.posexplode(T.sentence_array(F.col(text))).alias(index, "text"))
    return rows.withColumn("toks", pinned(T.similarity_tokens(F.col("text"))))


def sentence_matches(left: DataFrame, right: DataFrame, key: str, bound: int = 4096) -> DataFrame:
    """Jaccard of every left/right sentence pair of one document pair that shares a token.

    Sentences meet by (pair, token), those without a common token never; a
    token's sentences meet in tiles of at most about ``bound`` a side.
    """
    a = cut_lineage(left.select(key, "i", F.size("toks").alias("na"), F.explode("toks").alias("tok")))
    b = cut_lineage(right.select(key, "j", F.size("toks").alias("nb"), F.explode("toks").alias("tok")))
    return (
        tiled_join(a, b, [key, "tok"], bound)
        .groupBy(key, "i", "j")
        .agg(F.count(F.lit(1)).alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"))
        .select(key, "i", "j", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("sim"))
    )


# --- similarity join inside document pairs ----------------------------------------
def _token_sets(rows: DataFrame, key: str, index: str) -> DataFrame:
    """Rows with two hashes of their token set (``_a, _b``), written once as they are read several times."""
    toks = F.array_sort("toks")
    return cut_lineage(rows.select(key, index, "text", toks.alias("toks"), F.xxhash64(F.lit(1), toks).alias("_a"), F.xxhash64(F.lit(2), toks).alias("_b")))


def _different(rows: DataFrame, key: str, index: str) -> DataFrame:
    """Each different token set of a pair once: its first sentence and how many sentences have it.  Empty sets match nothing."""
    return rows.where(F.size("toks") > 0).groupBy(key, "_a", "_b").agg(
        F.first("toks").alias("toks"), F.min(index).alias("_first"), F.count(F.lit(1)).alias("_rows"))


def _by_frequency(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The different sets of both sides as ``key, _side, _a, _b, size, toks``, each with its rarest token (in the pair) first."""
    sides = left.select(key, F.lit(0).alias("_side"), "_a", "_b", "toks").unionByName(right.select(key, F.lit(1).alias("_side"), "_a", "_b", "toks"))
    words = cut_lineage(sides.select(key, "_side", "_a", "_b", F.explode("toks").alias("tok")))
    seen = cut_lineage(words.groupBy(key, "tok").agg(F.count(F.lit(1)).alias("n")))
    words = attach(words, seen, [key, "tok"], "n")
    sets = words.groupBy(key, "_side", "_a", "_b").agg(F.array_sort(F.collect_list(F.struct("n", "tok"))).alias("w"))
    return cut_lineage(sets.select(key, "_side", "_a", "_b", F.size("w").alias("size"), F.transform("w", lambda x: x["tok"]).alias("toks")))


def similar_sets(left: DataFrame, right: DataFrame, key: str, threshold: float, bound: int = 4096) -> DataFrame:
    """Pairs of token sets of one document pair with a Jaccard similarity of at least ``threshold``: ``key, la, lb, ra, rb, sim``.

    ``left`` and ``right`` are tables of different sets (``key, _a, _b,
    toks``).  Tokens are ordered by how many sets of the pair hold them.  Two
    sets can only be that similar if they share a token among the first
    ``n - ceil(threshold * n) + 1`` of each, so the most frequent tokens of a
    set are not indexed at all.  Where two sets meet, their sizes and what is
    left of them behind the shared token must allow the overlap; what remains
    is compared in full.  With a threshold of 0, any shared token will do.
    """
    sets = _by_frequency(left, right, key)
    need = F.ceil(F.lit(threshold) * F.col("size") - 1e-9)
    first = F.least(F.col("size"), F.col("size") - need + 1).cast("int")
    heads = sets.select(key, "_side", "_a", "_b", "size", F.posexplode(F.slice("toks", F.lit(1), first)).alias("at", "tok"))

    def side(n: int, s: str) -> DataFrame:
        return heads.where(F.col("_side") == n).select(
            key, "tok", F.col("_a").alias(f"{s}a"), F.col("_b").alias(f"{s}b"), F.col("size").alias(f"n{s}"), F.col("at").alias(f"at{s}"))

    least = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("nl") + F.col("nr")) - 1e-9)
    open_ = F.least(F.col("nl") - F.col("atl"), F.col("nr") - F.col("atr")) >= least
    fits = (F.col("nl") + 1e-9 >= threshold * F.col("nr")) & (F.col("nr") + 1e-9 >= threshold * F.col("nl"))
    met = tiled_join(side(0, "l"), side(1, "r"), [key, "tok"], bound).where(fits & open_).select(key, "la", "lb", "ra", "rb").distinct()

    def tokens(n: int, s: str) -> DataFrame:
        return sets.where(F.col("_side") == n).select(key, F.col("_a").alias(f"{s}a"), F.col("_b").alias(f"{s}b"), F.col("toks").alias(f"t{s}"))

    both = met.join(tokens(0, "l"), [key, "la", "lb"]).join(tokens(1, "r"), [key, "ra", "rb"])
    return both.select(key, "la", "lb", "ra", "rb", pinned(T.jaccard(F.col("tl"), F.col("tr"))).alias("sim")).where(F.col("sim") >= threshold)


def _best(found: DataFrame, own: DataFrame, others: DataFrame, key: str, side: str, other: str) -> DataFrame:
    """Per set of one side the most similar set of the other: ``key, _a, _b, best, partner, _rows``; the first partner wins a tie."""
    named = others.select(key, F.col("_a").alias(f"{other}a"), F.col("_b").alias(f"{other}b"), "_first")
    best = found.join(named, [key, f"{other}a", f"{other}b"]).groupBy(key, f"{side}a", f"{side}b").agg(
        F.max(F.struct("sim", (-F.col("_first")).alias("neg"))).alias("m"))
    best = best.select(key, F.col(f"{side}a").alias("_a"), F.col(f"{side}b").alias("_b"), F.col("m.sim").alias("best"), (-F.col("m.neg")).alias("partner"))
    return best.join(own.select(key, "_a", "_b", "_rows"), [key, "_a", "_b"])


def diff_documents(pairs: DataFrame, *, key: str = "pair_id", left: str = "left_text",
                   right: str = "right_text", bound: int = 4096) -> DataFrame:
    """Removed, modified and added sentences: ``key, change, idx, other_idx, score, text, other_text``.

    Sentences with equal token sets are compared once; which sets are similar
    enough comes from :func:`similar_sets`.
    """
    a, b = _token_sets(_sentences(pairs, key, left, "i"), key, "i"), _token_sets(_sentences(pairs, key, right, "j"), key, "j")
    sets_a, sets_b = cut_lineage(_different(a, key, "i")), cut_lineage(_different(b, key, "j"))
    found = cut_lineage(similar_sets(sets_a, sets_b, key, MODIFIED_AT, bound))
    best_a = cut_lineage(_best(found, sets_a, sets_b, key, "l", "r"))
    near_b = cut_lineage(_best(found, sets_b, sets_a, key, "r", "l"))
    used = best_a.select(key, F.col("partner").alias("j")).distinct()
    of_a = attach(a.select(key, "i", "text", "_a", "_b"), best_a, [key, "_a", "_b"], "_rows")
    changed = of_a.where(F.col("best") < SAME_AT)
    partners = changed.groupBy(key, F.col("partner").alias("j")).agg(F.count(F.lit(1)).alias("_rows")).join(b.select(key, "j", "text"), [key, "j"])
    partners = cut_lineage(partners.select(key, F.col("j").alias("partner"), F.col("text").alias("other_text"), "_rows"))
    modified = attach(changed.drop("_rows"), partners, [key, "partner"], "_rows").select(
        key, F.lit("modified").alias("change"), F.col("i").alias("idx"), F.col("partner").alias("other_idx"), F.bround("best", 3).alias("score"), "text", "other_text")
    nothing = [F.lit(None).cast("int").alias("other_idx"), F.lit(None).cast("double").alias("score"), "text",
               F.lit(None).cast("string").alias("other_text")]
    removed = of_a.where(F.col("best").isNull()).select(key, F.lit("removed").alias("change"), F.col("i").alias("idx"), *nothing)
    added = attach(b.select(key, "j", "text", "_a", "_b"), near_b, [key, "_a", "_b"], "_rows").where(F.col("best").isNull()).join(
        used, [key, "j"], "left_anti").select(key, F.lit("added").alias("change"), F.col("j").alias("idx"), *nothing)
    return removed.unionByName(modified).unionByName(added)


def diff_counts(diff: DataFrame, key: str = "pair_id") -> DataFrame:
    n = {c: F.count_if(F.col("change") == c).cast("long").alias(c) for c in ("added", "removed", "modified")}
    return diff.groupBy(key).agg(*n.values())


def consistency(pairs: DataFrame, *, key: str = "pair_id", original: str = "left_text", summary: str = "right_text",
                threshold: float = TRACEABLE_AT, bound: int = 4096) -> DataFrame:
    """Each summary sentence with its best source sentence and whether it is traceable.

    A pair of up to ``bound`` sentences by sentences is compared in its row.
    Larger pairs meet by tokens: sentences that find a source at ``threshold``
    need no more than the tokens that it takes; only the others are compared
    with all that share a token.
    """
    compared = T.sentence_count(F.col(original)).cast("long") * T.sentence_count(F.col(summary))
    large = F.coalesce(compared > bound, F.lit(False))
    found = _best_in_row(pairs.where(~large), key, original, summary)
    rest = cut_lineage(pairs.where(large).select(key, original, summary))
    if not rest.isEmpty():
        found = found.unionByName(_best_by_token(rest, key, original, summary, threshold, bound))
    score = F.coalesce("best", F.lit(0.0))
    return found.select(
        key, F.col("i").alias("idx"), "text", F.coalesce("partner", F.lit(-1)).cast("int").alias("best_match_idx"),
        F.bround(score, 3).alias("best_match_score"), (score >= threshold).alias("traceable"),
    )


def _best_in_row(pairs: DataFrame, key: str, original: str, summary: str) -> DataFrame:
    """``key, i, text, best, partner`` for each summary sentence, with all source sentences of its pair beside it."""
    sources = F.coalesce(F.transform(T.sentence_array(F.col(original)), T.similarity_tokens), F.array().cast("array<array<string>>"))
    rows = pairs.select(key, pinned(sources).alias("_src"), F.posexplode(T.sentence_array(F.col(summary))).alias("i", "text"))
    rows = rows.withColumn("_toks", pinned(T.similarity_tokens(F.col("text"))))

    def alike(source: Column, j: Column) -> Column:
        sizes = F.size("_toks") + F.size(source)
        return F.struct(let(F.size(F.array_intersect("_toks", source)), lambda n: F.when(n > 0, n / (sizes - n))).alias("sim"), (-j).alias("neg"))

    rows = rows.withColumn("_m", pinned(F.array_max(F.filter(F.transform("_src", alike), lambda m: m["sim"].isNotNull()))))
    return rows.select(key, "i", "text", F.col("_m.sim").alias("best"), (-F.col("_m.neg")).alias("partner"))


def _best_by_token(pairs: DataFrame, key: str, original: str, summary: str, threshold: float, bound: int) -> DataFrame:
    """Like :func:`_best_in_row`, for pairs with any number of sentences."""
    out = _token_sets(_sentences(pairs, key, summary, "i"), key, "i")
    src = _token_sets(_sentences(pairs, key, original, "j"), key, "j")
    sets_out, sets_src = cut_lineage(_different(out, key, "i")), cut_lineage(_different(src, key, "j"))
    near = cut_lineage(_best(similar_sets(sets_out, sets_src, key, threshold, bound), sets_out, sets_src, key, "l", "r"))
    rest = cut_lineage(sets_out.join(near, [key, "_a", "_b"], "left_anti"))
    far = cut_lineage(_best(similar_sets(rest, sets_src, key, 0.0, bound), rest, sets_src, key, "l", "r"))
    best = near.unionByName(far)
    return attach(out.select(key, "i", "text", "_a", "_b"), best, [key, "_a", "_b"], "_rows").select(key, "i", "text", "best", "partner")


def consistency_verdict(pairs: DataFrame, checked: DataFrame, *, key: str = "pair_id") -> DataFrame:
    counts = checked.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("traceable").alias("n_traceable")
    )
    n, t = F.coalesce("n", F.lit(0)), F.coalesce("n_traceable", F.lit(0))
    return pairs.select(key).join(counts, key, "left").select(
        key, n.alias("summary_sentences"), t.alias("traceable"), (n - t).alias("untraceable"),
        F.when(n == 0, 0.0).otherwise(F.bround(t / n, 3)).alias("traceable_ratio"),
        F.when(n == 0, "empty").when(n == t, "consistent").otherwise("inconsistent").alias("verdict"),
    )


#: Questions, and words in them, up to which the question side goes to every task.
FEW_QUESTIONS, FEW_WORDS = 2_000, 50_000


def retrieve(questions: DataFrame, sentences: DataFrame, k: int = 3, *, question_key: str = "item_id",
             question_text: str = "text", order: tuple[str, ...] = ("doc_id", "para", "nth"), text: str = "text",
             cited: DataFrame | None = None, bound: int = 4096) -> DataFrame:
    """Top-``k`` sentences per question by the share of question tokens they hold.

    A bounded set of questions is sent to every task: sentences are read once
    and scored where they are, and a task hands on ``k`` of them per question.
    More questions than that are joined by word, without the blocks that can't
    count (:func:`_retrieve_many`).  The result is exact either way.
    """
    q = questions.select(question_key, F.array_distinct(T.question_tokens(F.col(question_text))).alias("toks")).where(F.size("toks") > 0)
    size = q.select(F.size("toks").alias("n")).limit(FEW_QUESTIONS + 1).agg(F.count(F.lit(1)), F.sum("n")).first()
    if size[0] > FEW_QUESTIONS or (size[1] or 0) > FEW_WORDS:
        return _retrieve_many(questions, sentences, k, question_key, question_text, order, text, cited, bound)
    return _retrieve_few(q.collect(), q.schema[0], sentences, k, order, text, cited)


def _retrieve_few(asked: list, key: ST.StructField, sentences: DataFrame, k: int, order: tuple[str, ...], text: str,
                  cited: DataFrame | None) -> DataFrame:
    """The question words as a 0/1 matrix in every task; a batch's overlaps are sums of its rows."""
    words = {w: i for i, w in enumerate(sorted({w for r in asked for w in r.toks}))}
    wants = np.zeros((len(words), len(asked)), dtype=np.int32)
    for j, r in enumerate(asked):
        wants[[words[w] for w in r.toks], j] = 1
    shared = sentences.sparkSession.sparkContext.broadcast((words, wants, [r[0] for r in asked]))
    rows = sentences.select(*order, text)
    if cited is None:
        rows = rows.withColumn("_old", F.lit(False))
    else:
        seen = cited.select(F.col(text)).distinct().withColumn("_seen", F.lit(True))
        rows = rows.join(seen, text, "left").select(*order, text, F.coalesce("_seen", F.lit(False)).alias("_old"))
    out = ST.StructType([key, *[f for f in rows.schema.fields if f.name in order], ST.StructField("score", ST.DoubleType()), rows.schema[text]])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, wants, names = shared.value
        need = wants.sum(axis=0)
        held: list[list[tuple]] = [[] for _ in names]
        for pdf in batches:
            for part in (pdf.iloc[i:i + 2000] for i in range(0, len(pdf), 2000)):
                at = [[words[w] for w in toks if w in words] for toks in part["_toks"]]
                sizes = np.array([len(x) for x in at])
                if not sizes.any():
                    continue
                live = np.flatnonzero(sizes)
                starts = np.concatenate([[0], np.cumsum(sizes[live])[:-1]])
                overlap = np.add.reduceat(wants[np.concatenate([at[i] for i in live]).astype(int)], starts, axis=0)
                score = overlap / need * np.where(part["_old"].to_numpy()[live], CITED_PENALTY, 1.0)[:, None]
                keys = list(part.iloc[live][[*order, text]].itertuples(index=False, name=None))
                for j in range(len(names)):
                    s = score[:, j]
                    floor = held[j][-1][0] * -1 if len(held[j]) == k else 0.0
                    found = np.flatnonzero((s >= floor) & (s > 0))
                    if len(found) > k:
                        kth = np.partition(s[found], len(found) - k)[len(found) - k]
                        found = found[s[found] >= kth]
                    if len(found):
                        held[j] = sorted(held[j] + [(-s[i], keys[i]) for i in found])[:k]
        yield pd.DataFrame([(n, *x[:-1], -away, x[-1]) for n, rows in zip(names, held, strict=True) for away, x in rows], columns=out.names)

    found = rows.withColumn("_toks", T.question_tokens(F.col(text))).mapInPandas(best, out)
    top = spread_topk(found, [key.name], [F.desc("score"), *order], k)
    return top.select(key.name, "rank", *order, F.bround("score", 3).alias("score"), text)


#: How many sentences a question's rarest words should lead to at first, per sentence wanted, and how much more each further round may.
FIRST_LOOK, WIDER = 8, 8


def _retrieve_many(questions: DataFrame, sentences: DataFrame, k: int, question_key: str, question_text: str, order: tuple[str, ...],
                   text: str, cited: DataFrame | None, bound: int) -> DataFrame:
    """Top-``k`` sentences per question by the share of question tokens they hold; texts in ``cited`` count for less.

    Each word has a list of the sentences that hold it, cut into blocks by how
    many words of any question a sentence holds.  A question goes through its
    words from the rarest on.  A sentence that is first met at its r-th word
    holds at most the words from there on, and no more than its block says; a
    block that can't reach the question's k-th score so far is not joined.
    Rounds take ever more common words, until none can lead to a better
    sentence.  Blocks that many questions open meet them in tiles.  Exact;
    ties go to the first sentence in ``order``.
    """
    q = questions.select(question_key, F.array_distinct(T.question_tokens(F.col(question_text))).alias("asks")).where(F.size("asks") > 0)
    q = cut_lineage(q)
    words = q.select(question_key, F.size("asks").alias("nq"), F.explode("asks").alias("tok"))
    rows = sentences.select(*order, text)
    if cited is not None:
        rows = rows.join(cited.select(text).distinct().withColumn("_old", F.lit(True)), text, "left")
    else:
        rows = rows.withColumn("_old", F.lit(False))
    said = rows.select(*order, F.coalesce("_old", F.lit(False)).alias("old"), F.explode(T.question_tokens(F.col(text))).alias("tok"))
    said = said.join(words.select("tok").distinct(), "tok", "left_semi")
    held = cut_lineage(said.groupBy(*order, "old").agg(F.collect_list("tok").alias("holds")))
    lists = held.select(*order, "old", F.size("holds").alias("m"), F.explode("holds").alias("tok"))
    blocks = cut_lineage(lists.groupBy("tok", "m", "old").agg(F.count(F.lit(1)).alias("n")))
    freq = blocks.groupBy("tok").agg(F.sum("n").alias("df"))
    rank = W.partitionBy(question_key).orderBy("df", "tok")
    words = words.join(freq, "tok").select(
        question_key, "nq", "tok", F.coalesce(F.sum("df").over(rank.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        (F.count(F.lit(1)).over(W.partitionBy(question_key)) - F.row_number().over(rank) + 1).alias("behind"))
    words = cut_lineage(words)

    best, low, high = None, 0, FIRST_LOOK * k
    while True:
        asks = words.where(F.col("before") >= low)
        if best is None:
            asks = asks.withColumn("kth", F.lit(0.0))
        else:
            kth = best.where(F.col("rank") == k).select(question_key, F.col("score").alias("kth"))
            asks = asks.join(kth, question_key, "left").withColumn("kth", F.coalesce("kth", F.lit(0.0)))
        weight = F.when(F.col("old"), CITED_PENALTY).otherwise(1.0)
        reach = F.least("m", "behind") / F.col("nq") * weight
        opened = asks.where(F.col("behind") / F.col("nq") >= F.col("kth")).join(blocks, "tok").where(reach >= F.col("kth"))
        opened = cut_lineage(opened.select(question_key, "before", "tok", "m", "old"))
        if opened.isEmpty():
            break
        met = tiled_join(opened.where(F.col("before") < high).drop("before"), lists, ["tok", "m", "old"], bound).select(question_key, *order).distinct()
        scored = _scored(cut_lineage(met), q, held, question_key, order)
        if best is not None:
            scored = scored.unionByName(best.select(scored.columns)).dropDuplicates([question_key, *order])
        best = cut_lineage(spread_topk(scored, [question_key], [F.desc("score"), *order], k))
        low, high = high, high * WIDER
    if best is None:
        best = _scored(held.select(*order).crossJoin(q.select(question_key)).limit(0), q, held, question_key, order).withColumn("rank", F.lit(1))
    return best.join(sentences.select(*order, text), list(order)).select(question_key, "rank", *order, F.bround("score", 3).alias("score"), text)


def _scored(met: DataFrame, q: DataFrame, held: DataFrame, question_key: str, order: tuple[str, ...]) -> DataFrame:
    """Full scores of the question/sentence pairs ``met``."""
    asked = met.groupBy(question_key).agg(F.count(F.lit(1)).alias("_n")).join(q, question_key)
    rows = attach(met, cut_lineage(asked), [question_key], "_n").join(held, list(order))
    shared = F.size(F.array_intersect("asks", "holds")) / F.size("asks")
    return rows.select(question_key, *order, (shared * F.when(F.col("old"), CITED_PENALTY).otherwise(1.0)).alias("score"))
