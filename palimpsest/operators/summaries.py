"""Keywords, sentence ranking and extractive summaries.

Per-document operators exchange a document once, on its key.  Keyword counting,
the top-k cut and the join back all reuse that partitioning; everything after
it is computed inside the row.  Group operators (many documents, one summary)
never bring a group together: sentences stay rows and only top-k rows move.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.functions import text as T
from palimpsest.functions.patterns import WS
from palimpsest.functions.scale import BLOCK, by_key, by_key_and_size, carry_last, carry_offsets, pinned, spread_topk, with_block
from palimpsest.functions.splice import let, matches
from palimpsest.session import cut_lineage

SENTENCE = "struct<idx:int,para:int,sent:int,text:string,score:double>"


def _latin_terms(docs: DataFrame, keep: list) -> DataFrame:
    """Word and word-pair candidates, one row each, outside any lambda.

    The word array is zipped with itself shifted by one, so a pair needs no
    ordering of rows.  The last word has no partner.
    """
    ws = docs.select(*keep, pinned(matches(F.col("text"), T.LATIN_WORD)).alias("ws"))
    rows = ws.select(*keep, F.posexplode(F.arrays_zip(
        F.col("ws").alias("w"), F.slice("ws", F.lit(2), F.size("ws")).alias("next"))).alias("pos", "p"))
    rows = rows.select(*keep, "pos", F.lower("p.w").alias("w"), F.lower("p.next").alias("next"))
    alone = ~F.col("w").isin(*T.EN_STOP) & (F.length("w") > 1)
    paired = (
        F.col("next").isNotNull() & ~F.col("w").isin(*T.EN_STOP) & ~F.col("next").isin(*T.EN_STOP)
        & (F.length("w") > 2) & (F.length("next") > 2)
    )
    both = F.array(
        F.when(alone, F.struct(F.lit(0).alias("cls"), F.col("w").alias("term"))),
        F.when(paired, F.struct(F.lit(1).alias("cls"), F.concat_ws(" ", "w", "next").alias("term"))),
    )
    terms = rows.select(*keep, "pos", F.explode(both).alias("t")).where(F.col("t").isNotNull())
    return terms.select(*keep, "t.cls", "t.term", "pos", F.lit(1).alias("lead"))


def _chinese_terms(docs: DataFrame, keep: list) -> DataFrame:
    """Bigram (2) and trigram (3) candidates; ``lead`` marks the first use inside a run."""
    runs = docs.select(*keep, F.posexplode(matches(F.col("text"), T.CJK_RUN)).alias("run_no", "run"))
    sized = runs.select("*", F.explode(F.array(F.lit(2), F.lit(3))).alias("n"))
    listed = sized.withColumn("g", pinned(T.grams(F.col("run"), F.col("n"))))
    return listed.select(*keep, "run_no", "n", "g", F.posexplode("g").alias("i", "term")).select(
        *keep, F.col("n").alias("cls"), "term", (F.shiftleft(F.col("run_no").cast("long"), 31) + F.col("i")).alias("pos"),
        F.when(F.array_position("g", F.col("term")) == F.col("i") + 1, 1).otherwise(0).alias("lead"),
    ).where(~F.col("term").isin(*T.ZH_STOP))


def ngram_counts(df: DataFrame, n: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chinese n-gram frequency and the number of runs that hold it.

    Texts are exchanged, not their n-grams, to tasks of a bounded size; both counts reuse that partitioning.
    """
    runs = by_key_and_size(df.select(key, text), key, text).select(key, F.posexplode(matches(F.col(text), T.CJK_RUN)).alias("run_no", "run"))
    terms = runs.select(key, "run_no", F.explode(T.grams(F.col("run"), n)).alias("term"))
    return (
        terms.groupBy(key, "term", "run_no").agg(F.count(F.lit(1)).alias("k"))
        .groupBy(key, "term").agg(F.sum("k").alias("tf"), F.count(F.lit(1)).alias("df"))
    )


def _weight() -> Column:
    """Latin words (cls 0) and pairs (1) by count; Chinese bigrams (2) and trigrams (3) also by spread."""
    spread_out = F.col("tf") * (1.0 + F.log(1.0 + F.col("df")))
    return (
        F.when(F.col("cls") == 0, F.col("tf") * 1.0).when(F.col("cls") == 1, F.col("tf") * 0.8)
        .when(F.col("cls") == 2, spread_out).otherwise(spread_out * 1.3)
    )


def indexed(df: DataFrame, *, key: str = "doc_id", text: str = "text", exchange: bool = True) -> DataFrame:
    """Documents with located sentences, language and the minimum term spread.

    One exchange on ``key``; documents without a sentence drop out.
    """
    # any character that is not blank makes a sentence; this test reaches the scan
    base = df.select(key, F.col(text).alias("text")).where(F.col("text").rlike(f"[^{WS}]"))
    # told ahead of the exchange, which the keywords and the sentences share
    base = base.withColumn("lang", pinned(T.language(F.col("text"))))
    if exchange:
        base = by_key(base, key)
    return base.select(key, "text", pinned(T.located_sentences(F.col("text"))).alias("sents"), "lang")


def keyword_rows(docs: DataFrame, k: int = 8, *, key: str = "doc_id") -> DataFrame:
    """Top-``k`` keywords per document: ``key, term, weight, rank``."""
    latin = _latin_terms(docs.where("lang = 'en'").select(key, "text"), [key]).withColumn("min_df", F.lit(1))
    # the sentences of Chinese documents only, so that the others' are not made a second time here
    facts = docs.select(key, "text", "lang").where("lang = 'zh'").withColumn(
        "min_df", F.when(F.size(pinned(T.located_sentences(F.col("text")))) >= 3, 2).otherwise(1))
    chinese = _chinese_terms(facts.select(key, "min_df", "text"), [key, "min_df"])
    # numbers only, so that the aggregate hashes instead of sorting
    counted = latin.unionByName(chinese).groupBy(key, "cls", "term").agg(
        F.count(F.lit(1)).alias("tf"), F.sum("lead").alias("df"), F.min("pos").alias("pos"), F.max("min_df").alias("min_df")
    ).where(F.col("df") >= F.col("min_df"))
    weighed = counted.withColumn("weight", _weight())
    return spread_topk(weighed, [key], [F.desc("weight"), "cls", "pos"], k).select(key, "term", "weight", "rank")


def with_keywords(docs: DataFrame, k: int = 8, *, key: str = "doc_id") -> DataFrame:
    """Adds ``kws``: ``array<struct<term, weight>>`` in rank order."""
    entries = F.array_sort(F.collect_list(F.struct("rank", "term", "weight")))
    per_doc = keyword_rows(docs, k, key=key).groupBy(key).agg(
        F.transform(entries, lambda e: F.struct(e["term"].alias("term"), e["weight"].alias("weight"))).alias("kws")
    )
    none = F.array().cast("array<struct<term:string,weight:double>>")
    return docs.join(per_doc, key, "left").withColumn("kws", F.coalesce("kws", none))


def sentence_score(sentence: Column, i: Column, n: Column, kws: Column, lang: Column) -> Column:
    """.55 keyword cover + .22 position + .15 length + .08 signal word."""
    return let(F.lower(sentence), lambda low: _score(low, sentence, i, n, kws, lang))


def _score(low: Column, sentence: Column, i: Column, n: Column, kws: Column, lang: Column) -> Column:
    zero = F.lit(0.0)
    total = F.aggregate(kws, zero, lambda acc, k: acc + k["weight"])
    cover = F.aggregate(kws, zero, lambda acc, k: acc + F.when(low.contains(k["term"]), k["weight"]).otherwise(0.0))
    cover = cover / F.when(total == 0, 1.0).otherwise(total)
    place = (
        F.when(i == 0, 1.0).when(i == n - 1, 0.7)
        .when(i <= F.greatest(F.lit(1), F.floor(n / 5)), 0.6).otherwise(0.3)
    )
    chars, words = F.length(sentence), F.size(F.split(sentence, " "))
    size_zh = (
        F.when(chars.between(15, 80), 1.0).when(chars < 15, 0.4)
        .otherwise(F.greatest(F.lit(0.4), 1.0 - (chars - 80) / 200.0))
    )
    size_en = (
        F.when(words.between(8, 35), 1.0).when(words < 8, 0.4)
        .otherwise(F.greatest(F.lit(0.4), 1.0 - (words - 35) / 80.0))
    )
    size = F.when(lang == "zh", size_zh).otherwise(size_en)
    signal = F.when(reduce(or_, (low.contains(s) for s in T.SIGNALS)), 0.4).otherwise(0.0)
    return 0.55 * cover + 0.22 * place + 0.15 * size + 0.08 * signal


def _scored(sents: Column, kws: Column, lang: Column, offset: Column | None = None) -> Column:
    """Score an array of sentences by their place in that array."""
    start = offset if offset is not None else F.lit(0)
    return F.transform(
        sents,
        lambda s, i: F.struct(
            (i + start).cast("int").alias("idx"), s["para"].cast("int").alias("para"),
            s["sent"].cast("int").alias("sent"), s["text"].alias("text"),
            sentence_score(s["text"], i, F.size(sents), kws, lang).alias("score"),
        ),
    )


def _ranked(scored: Column) -> Column:
    """Best first; equal scores keep text order."""
    keyed = F.transform(scored, lambda s: F.struct((-s["score"]).alias("neg"), s["idx"].alias("idx"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def _in_text_order(chosen: Column) -> Column:
    return F.array_sort(chosen)


def _within_budget(ranked: Column, chars: int) -> Column:
    """Longest best-first prefix whose length fits; always at least one."""
    taken = F.aggregate(
        ranked,
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("n"), F.lit(False).alias("full")),
        lambda acc, s: F.when(
            acc["full"] | ((acc["n"] > 0) & (acc["total"] + F.length(s["text"]) > chars)),
            F.struct(acc["total"].alias("total"), acc["n"].alias("n"), F.lit(True).alias("full")),
        ).otherwise(
            F.struct((acc["total"] + F.length(s["text"])).alias("total"), (acc["n"] + 1).alias("n"),
                     F.lit(False).alias("full"))
        ),
    )
    return F.slice(ranked, F.lit(1), taken["n"])


def wanted(n: Column, length: int | None = None, ratio: float | None = None) -> Column:
    """How many sentences to keep out of ``n``."""
    if ratio is not None:
        k = F.greatest(F.lit(1), F.bround(n * F.lit(ratio)).cast("int"))
    elif length is not None:
        k = F.lit(length)
    else:
        k = F.greatest(F.lit(1), F.least(F.lit(5), F.bround(n * 0.3).cast("int")))
    return F.least(k, n)


def scored_documents(df: DataFrame, *, keywords: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with keywords and their sentences ranked best first (``ranked``)."""
    docs = with_keywords(indexed(df, key=key, text=text), keywords, key=key)
    return docs.withColumn("ranked", pinned(_ranked(_scored(F.col("sents"), F.col("kws"), F.col("lang")))))


def chunk_starts(sents: Column, max_chars: int, overlap: int = 1) -> Column:
    """Index of the first sentence of each chunk, filled up to a character budget."""
    if overlap not in (0, 1):
        raise ValueError("overlap must be 0 or 1")

    def step(acc: Column, s: Column) -> Column:
        size = F.length(s["text"])
        cut = (acc["used"] > -1) & (acc["used"] + size > max_chars) & (acc["i"] > 0)
        restart = acc["last"] if overlap else F.lit(0)
        return F.struct(
            (acc["i"] + 1).alias("i"),
            (F.when(cut, restart).otherwise(acc["used"]) + size).alias("used"),
            size.alias("last"),
            F.when(cut, F.concat(acc["starts"], F.array((acc["i"] - overlap).cast("int"))))
            .otherwise(acc["starts"]).alias("starts"),
        )

    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("used"), F.lit(0).alias("last"),
                    F.array(F.lit(0)).alias("starts"))
    return F.aggregate(sents, zero, step, lambda acc: acc["starts"])


def chunk_sentences(df: DataFrame, max_chars: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per chunk: first and last sentence index and its characters.  Map-only."""
    docs = indexed(df, key=key, text=text, exchange=False)
    starts = docs.withColumn("starts", pinned(chunk_starts(F.col("sents"), max_chars)))
    rows = starts.select(key, "sents", "starts", F.posexplode("starts").alias("chunk", "first"))
    last = F.coalesce(F.get("starts", F.col("chunk") + 1), F.size("sents") - 1)
    part = F.slice("sents", F.col("first") + 1, F.col("last") - F.col("first") + 1)
    chars = F.aggregate(part, F.lit(0), lambda acc, s: acc + F.length(s["text"]))
    return rows.withColumn("last", last).select(key, "chunk", "first", "last", chars.cast("long").alias("chars"))


def sliding_choice(sents: Column, kws: Column, lang: Column, max_chars: int, ratio: float | None = None,
                   length: int | None = None, chars: int | None = None) -> Column:
    """Best sentences of each chunk, the overlap counted once."""
    share = 0.3 if ratio is None else ratio

    def best_of(part: Column, start: Column) -> Column:
        keep = F.greatest(F.lit(1), F.bround(F.size(part) * F.lit(share)).cast("int"))
        return F.slice(_ranked(_scored(part, kws, lang, start)), F.lit(1), keep)

    def per_chunk(starts: Column) -> Column:
        def one(start: Column, c: Column) -> Column:
            end = F.coalesce(F.get(starts, c + 1), F.size(sents) - 1)
            return let(F.slice(sents, start + 1, end - start + 1), lambda part: best_of(part, start))

        return F.flatten(F.transform(starts, one))

    def deduplicated(found: Column) -> Column:
        return let(F.transform(found, lambda x: x["idx"]), lambda ids: F.filter(
            found, lambda s, i: F.array_position(ids, s["idx"]) == i + 1))

    once = let(let(chunk_starts(sents, max_chars), per_chunk), deduplicated)
    if length is not None:
        once = F.slice(_ranked(once), 1, length)
    elif chars is not None:
        once = let(_ranked(once), lambda r: _within_budget(r, chars))
    return _in_text_order(once)


def _segment(s: Column, lang: Column, cite: bool, doc: Column | None) -> Column:
    ended = reduce(or_, (s["text"].endswith(t) for t in T.TERMINAL))
    body = F.when(ended, s["text"]).otherwise(F.concat(s["text"], F.lit("。")))
    where = [F.lit("第"), (s["para"] + 1).cast("string"), F.lit("段·句"), s["sent"].cast("string"), F.lit("）")]
    if cite:
        head = [F.lit("（见原文")] if doc is None else [F.lit("（见第"), doc.cast("string"), F.lit("篇·")]
        body = F.concat(body, *head, *where)
    elif doc is not None:
        body = F.concat(F.lit("[文档"), doc.cast("string"), F.lit("] "), body)
    return F.when(lang == "zh", body).otherwise(s["text"])


def assemble(chosen: Column, lang: Column, cite: bool = False) -> Column:
    """Join the chosen sentences; Chinese ones get an end mark and, on demand, a citation."""
    parts = F.transform(chosen, lambda s: _segment(s, lang, cite, None))
    return F.when(lang == "zh", F.array_join(parts, "")).otherwise(F.array_join(parts, " "))


def tldr(best: Column, lang: Column) -> Column:
    """The best sentence, cut to one line."""
    cap = F.when(lang == "zh", 80).otherwise(140)
    cut = F.regexp_replace(F.substr(best, F.lit(1), cap), "[，。、；,.; ]+$", "")
    return F.when(F.length(best) > cap, F.concat(cut, F.lit("…"))).otherwise(best)


def quality(original: Column, summary: Column, kws: Column, chosen: Column, n: Column) -> dict[str, Column]:
    """Compression, reduction, keyword cover, sentence length and a 0..100 score."""
    compression = 1.0 - F.length(summary) / F.length(original)
    reduction = 1.0 - F.size(chosen) / n
    low = F.lower(summary)
    covered = F.size(F.filter(kws, lambda k: low.contains(k["term"])))
    cover = F.when(F.size(kws) == 0, 0.0).otherwise(covered / F.size(kws))
    mean = F.aggregate(chosen, F.lit(0), lambda acc, s: acc + F.length(s["text"])) / F.size(chosen)
    reads = (
        F.when(mean.between(25, 70), 1.0).when(mean < 25, 0.6)
        .otherwise(F.greatest(F.lit(0.5), 1.0 - (mean - 70) / 150.0))
    )
    score = F.bround(100 * (0.35 * compression + 0.30 * cover + 0.20 * reduction + 0.15 * reads)).cast("int")
    return {
        "compression_ratio": F.bround(compression, 3),
        "sentence_reduction": F.bround(reduction, 3),
        "keyword_coverage": F.bround(cover, 3),
        "keywords_covered": covered,
        "keywords_total": F.size(kws),
        "avg_sentence_len": F.bround(mean, 1),
        "score": F.greatest(F.lit(0), F.least(F.lit(100), score)),
    }


def summarize(df: DataFrame, *, length: int | None = None, ratio: float | None = None, chars: int | None = None,
              keywords: int = 8, cite: bool = False, max_input_chars: int | None = None, evaluate: bool = True,
              key: str = "doc_id", text: str = "text") -> DataFrame:
    """Extractive summary per document; with ``max_input_chars``, longer ones go through a sliding window of that size."""
    docs = scored_documents(df, keywords=keywords, key=key, text=text)
    n = F.size("sents")
    plain = (
        _within_budget(F.col("ranked"), chars) if chars
        else F.slice("ranked", F.lit(1), wanted(n, length, ratio))
    )
    chosen = _in_text_order(plain)
    if max_input_chars:
        long = (F.length("text") > max_input_chars) & (n > 1)
        chosen = F.when(
            long, sliding_choice(F.col("sents"), F.col("kws"), F.col("lang"), max_input_chars, ratio, length, chars)
        ).otherwise(chosen)
    out = docs.withColumn("chosen", pinned(chosen)).withColumn(
        "summary", pinned(assemble(F.col("chosen"), F.col("lang"), cite))
    )
    best = F.get(_ranked(F.col("chosen")), F.lit(0))["text"]
    columns = [
        key, "lang", n.alias("sentence_count"), "summary",
        F.transform("kws", lambda k: k["term"]).alias("keywords"),
        F.transform("kws", lambda k: F.bround(k["weight"], 2)).alias("keyword_weights"),
        "chosen", tldr(best, F.col("lang")).alias("tldr"),
    ]
    if evaluate:
        marks = quality(F.col("text"), F.col("summary"), F.col("kws"), F.col("chosen"), n)
        columns += [c.alias(name) for name, c in marks.items()]
    return out.select(*columns)


def brief(df: DataFrame, *, keywords: int = 8, candidates: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keywords, the best ``candidates`` sentences and counts (documents count from 1)."""
    docs = scored_documents(df, keywords=keywords, key=key, text=text)
    return docs.select(
        key,
        F.transform("kws", lambda k: k["term"]).alias("keywords"),
        F.transform(F.slice("ranked", 1, candidates), lambda s: F.struct(
            s["idx"].alias("index"), F.lit(1).alias("doc"), F.bround(s["score"], 3).alias("score"),
            s["text"].alias("text"))).alias("candidates"),
        F.size("sents").alias("total_sentences"),
        F.length("text").alias("char_count"),
    )


def hierarchical(df: DataFrame, *, l2: int = 3, l3: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One line, the core sentences, and supporting sentences that are not core."""
    docs = scored_documents(df, key=key, text=text)
    n = F.size("sents")

    def texts(k: int) -> Column:
        return F.transform(
            _in_text_order(F.slice("ranked", F.lit(1), F.least(F.lit(k), n))), lambda s: s["text"]
        )

    return docs.select(
        key, tldr(F.get("ranked", F.lit(0))["text"], F.col("lang")).alias("l1"), texts(l2).alias("l2"),
        F.filter(texts(l3), lambda t: ~F.array_contains(texts(l2), t)).alias("l3"),
        F.transform("kws", lambda k: k["term"]).alias("keywords"),
    )


def batch_index(df: DataFrame, *, length: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One index line per non-empty document: headline, summary, keywords, language."""
    s = summarize(df, length=length, evaluate=False, key=key, text=text)
    headline = F.get(T.sentence_array(F.col("summary")), F.lit(0))
    return s.select(key, headline.alias("headline"), "summary", "keywords", "lang")


#: Tasks that a group's documents are dealt to when they meet its facts.
SALTS = 64


def _group_facts(df: DataFrame, group: str, position: str, text: str) -> DataFrame:
    """Per document: numbers of sentences, Latin words and Chinese runs, the first and the last word.  Written once, as several steps read it."""
    words = df.select(group, position, F.col(text).alias("text"), pinned(matches(F.col(text), T.LATIN_WORD)).alias("_ws"))
    return cut_lineage(words.select(
        group, position, pinned(F.coalesce(T.sentence_count(F.col("text")), F.lit(0)).cast("long")).alias("n_sents"),
        F.size("_ws").alias("latin"), F.regexp_count("text", F.lit(T.CJK_RUN)).alias("cjk"),
        F.lower(F.get("_ws", F.lit(0))).alias("head"), F.lower(F.try_element_at("_ws", F.lit(-1))).alias("tail"),
    ).where("n_sents > 0"))


def group_sentences(df: DataFrame, group: str, *, position: str = "doc_id", text: str = "text",
                    width: float = 100_000) -> DataFrame:
    """All sentences of a group of documents with their index in the whole group."""
    return _exploded(_placed(df, _group_facts(df, group, position, text), group, position, text, width), group, position)


def _placed(df: DataFrame, facts: DataFrame, group: str, position: str, text: str, width: float) -> DataFrame:
    """Documents with their sentences and how many the group has before them; documents are put in order, not sentences."""
    docs = df.select(group, position, pinned(T.located_sentences(F.col(text))).alias("sents"))
    docs = with_block(docs.withColumn("_n", F.size("sents")).where("_n > 0"), position, width)
    inside = W.partitionBy(group, BLOCK).orderBy(position).rowsBetween(W.unboundedPreceding, -1)
    local = docs.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    per_block = with_block(facts, position, width).groupBy(group, BLOCK).agg(F.sum("n_sents").alias("_n"))
    return carry_offsets(local, [group], per_block, "_before").drop("_n")


def _exploded(docs: DataFrame, group: str, position: str, *more: str) -> DataFrame:
    rows = docs.select(group, position, *more, "_before", F.posexplode("sents").alias("nth", "s"))
    return rows.select(group, position, *more, "nth", "s.para", "s.sent", F.col("s.text").alias("text"), (F.col("_before") + F.col("nth")).alias("gidx"))


def _packed(doc: Column, pos: Column) -> Column:
    """Document place and word place (below 2 ** 62) as one number that orders both; a number keeps the aggregate hashing."""
    place = doc.cast("decimal(20,0)") * F.lit(2**62).cast("decimal(19,0)") + (pos.cast("long") + 1).cast("decimal(20,0)")
    return place.cast("decimal(38,0)")


def group_keywords(df: DataFrame, group: str, k: int = 8, *, position: str = "doc_id", text: str = "text",
                   width: float = 100_000) -> DataFrame:
    """Keywords over the union of a group's documents (Latin-script groups and Chinese alike).

    The documents count as one text, so the last word of one and the first word
    of the next form a pair as well.
    """
    return _group_keywords(df, _group_facts(df, group, position, text), group, k, position, text, width)


def _group_keywords(df: DataFrame, facts: DataFrame, group: str, k: int, position: str, text: str, width: float) -> DataFrame:
    docs = df.where(F.col(text).rlike(f"[^{WS}]"))
    marks = facts.groupBy(group).agg(F.sum("cjk").alias("cjk"), F.sum("latin").alias("latin"), F.sum("n_sents").alias("n_sents")).select(
        group, F.when(F.col("cjk") >= F.col("latin"), "zh").otherwise("en").alias("lang"), "n_sents")
    ends = facts.select(group, position, "head", "tail")
    seams = carry_last(ends, [group], position, [position], F.col("tail"), "before", width, inclusive=False)
    good = [F.col("before").isNotNull(), F.col("head").isNotNull()]
    for c in ("before", "head"):
        good += [~F.col(c).isin(*T.EN_STOP), F.length(c) > 2]
    seam_terms = seams.where(reduce(lambda a, b: a & b, good)).select(
        group, F.lit(1).alias("cls"), F.concat_ws(" ", "before", "head").alias("term"),
        _packed(F.col(position), F.lit(-1)).alias("pos"), F.lit(1).alias("lead"),
    )

    keep = [group, position]
    plain = docs.select(*keep, F.col(text).alias("text"))

    def placed(terms: DataFrame) -> DataFrame:
        return terms.select(group, "cls", "term", _packed(F.col(position), F.col("pos")).alias("pos"), "lead")

    counted = (
        placed(_latin_terms(plain, keep)).unionByName(placed(_chinese_terms(plain, keep))).unionByName(seam_terms)
        .groupBy(group, "cls", "term")  # map-side combine: a hot group ships its distinct terms
        .agg(F.count(F.lit(1)).alias("tf"), F.sum("lead").alias("df"), F.min("pos").alias("pos"))
    )
    latin = F.col("cls") < 2
    enough = F.col("df") >= F.when(F.col("n_sents") >= 3, 2).otherwise(1)
    chosen = counted.join(marks, group).where(
        (latin & (F.col("lang") == "en")) | (~latin & (F.col("lang") == "zh") & enough)
    ).withColumn("weight", _weight())
    return spread_topk(chosen, [group], [F.desc("weight"), "cls", "pos"], k).select(
        group, "lang", "term", "weight", "rank"
    )


def summarize_group(df: DataFrame, group: str, *, length: int | None = None, keywords: int = 8,
                    position: str = "doc_id", text: str = "text", width: float = 100_000) -> DataFrame:
    """Joint summary per group, one row per chosen sentence, in text order per group.

    Keywords and scores see the whole group; only the chosen rows are ranked
    across it, pruned map-side.
    """
    facts = _group_facts(df, group, position, text)
    sizes = facts.groupBy(group).agg(F.sum("n_sents").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("rank", "term", "weight")))
    kws = _group_keywords(df, facts, group, keywords, position, text, width).groupBy(group).agg(
        F.first("lang").alias("lang"), entries.alias("kws")
    )
    # a group's few facts go to SALTS places, so that a hot group's documents spread over as many tasks
    marks = cut_lineage(sizes.join(kws, group)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    docs = _placed(df, facts, group, position, text, width).withColumn("_salt", F.pmod(F.xxhash64(position), F.lit(SALTS)).cast("int"))
    scored = _exploded(docs.join(marks, [group, "_salt"]), group, position, "n", "kws", "lang").withColumn(
        "score", pinned(sentence_score(F.col("text"), F.col("gidx"), F.col("n"), F.col("kws"), F.col("lang")))
    ).select(group, position, "para", "sent", "gidx", "text", "score", "lang", "n")
    limit = length if length is not None else 5
    top = spread_topk(scored, [group], [F.desc("score"), "gidx"], limit)
    return top.where(F.col("rank") <= wanted(F.col("n").cast("int"), length)).select(
        group, position, "para", "sent", "gidx", "text", "score", "rank", "lang"
    )


def keyword_set(df: DataFrame, *, key: list[str], text: str = "text", top: int = 12) -> DataFrame:
    """Keyword set used to compare two summaries: ``key..., kw array<string>``."""
    zh = F.filter(
        T.cjk_grams(F.col(text), 2),
        lambda g: ~g.isin(*T.ZH_STOP_COMPARE) & ~F.substring(g, 1, 1).isin(*T.ZH_BOUNDARY)
        & ~F.substring(g, 2, 1).isin(*T.ZH_BOUNDARY),
    )
    words = F.filter(T.latin_words(F.col(text)), lambda w: ~w.isin(*T.EN_STOP_COMPARE, *T.ZH_STOP_COMPARE))
    terms = df.select(*key, F.posexplode(F.concat(zh, words)).alias("pos", "term"))
    counted = terms.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("f"), F.min("pos").alias("pos"))
    strong = spread_topk(counted.where("f >= 2"), key, [F.desc("f"), "pos"], top)
    # frequency first: with four repeated terms the once-only ones are left out
    ranked = spread_topk(counted, key, [F.desc("f"), "pos"], top)
    n_strong = strong.groupBy(*key).agg(F.count(F.lit(1)).alias("n_strong"))
    kept = ranked.join(n_strong, key, "left").where((F.coalesce("n_strong", F.lit(0)) < 4) | (F.col("f") >= 2))
    return kept.groupBy(*key).agg(F.array_sort(F.collect_list("term")).alias("kw"))


def compare(pairs: DataFrame, *, key: str = "pair_id", left: str = "left_text", right: str = "right_text",
            original: str | None = None) -> DataFrame:
    """Keyword overlap and length rules for two summaries of one text."""
    texts = pairs.select(key, F.explode(F.create_map(F.lit("l"), F.col(left), F.lit("r"), F.col(right)))
                         .alias("side", "text"))
    sets = keyword_set(texts, key=[key, "side"])
    none = F.array().cast("array<string>")
    wide = sets.groupBy(key).agg(
        F.max(F.when(F.col("side") == "l", F.col("kw"))).alias("lk"),
        F.max(F.when(F.col("side") == "r", F.col("kw"))).alias("rk"),
    )
    joined = pairs.join(wide, key, "left").withColumns(
        {"lk": F.coalesce("lk", none), "rk": F.coalesce("rk", none)}
    )
    union = F.size(F.array_union("lk", "rk"))
    shared = F.array_intersect("lk", "rk")
    a, b = F.length(left), F.length(right)
    rules = {
        "missing_right": F.size(F.array_except("lk", "rk")) > 0,
        "missing_left": F.size(F.array_except("rk", "lk")) > 0,
        "right_longer": (a > 0) & (b > 0) & (b > a * 1.6),
        "right_shorter": (a > 0) & (b > 0) & (b < a * 0.5),
    }
    if original is not None:
        o = F.length(original)
        rules["compression_gap"] = (o > 0) & (F.abs((1 - a / o) - (1 - b / o)) > 0.25)
    suggestions = F.array_compact(F.array(*[F.when(cond, name) for name, cond in rules.items()]))
    return joined.select(
        key, F.array_sort(shared).alias("keyword_overlap"),
        F.array_sort(F.array_except("lk", "rk")).alias("only_left"),
        F.array_sort(F.array_except("rk", "lk")).alias("only_right"),
        F.when(union == 0, 0.0).otherwise(F.bround(F.size(shared) / union, 3)).alias("keyword_jaccard"),
        a.alias("left_len"), b.alias("right_len"), suggestions.alias("suggestions"),
    )


def est_duration(text: Column) -> tuple[Column, Column, Column]:
    """(Chinese characters, Latin words, spoken seconds)."""
    zh = F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]"))
    words = F.regexp_count(text, F.lit("[A-Za-z]+"))
    return zh, words, zh / 220.0 * 60.0 + words / 150.0 * 60.0
