"""Registered queries: keywords, summaries, comparison, retrieval, structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import similarity, structure, summaries
from palimpsest.plans import sqlkit as Q
from palimpsest.plans.tables import documents, reply_pairs, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def docs(spark, sf):
    return documents(spark, sf, "doc_id", "text")


# --- SQL building blocks -----------------------------------------------------------
LANG = f"CASE WHEN len(regexp_extract_all(text, '{Q.CJK_RUN}')) >= len(regexp_extract_all(text, '{Q.LATIN}')) THEN 'zh' ELSE 'en' END"
PARAS = "list_filter(list_transform(string_split(regexp_replace(text, '\\n[[:space:]]*\\n', chr(2), 'g'), chr(2)), lambda p: regexp_replace(p, '^[[:space:]]+|[[:space:]]+$', '', 'g')), lambda p: p <> '')"


def sent_ctes(source: str = "documents", key: str = "doc_id") -> str:
    return f"""
para AS (SELECT {key}, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS para FROM (SELECT {key}, {PARAS} AS l FROM {source})),
sent0 AS (SELECT {key}, para, unnest(l) AS text, generate_subscripts(l, 1) AS sent FROM (SELECT {key}, para, {Q.sentences('p')} AS l FROM para)),
sent AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY para, sent) - 1 AS idx, count(*) OVER (PARTITION BY {key}) AS n FROM sent0)"""


def kw_ctes(k: int = 8) -> str:
    stop = Q.any_list(T.EN_STOP)
    return f"""
d AS (SELECT doc_id, text, {LANG} AS lang, {Q.words('text')} AS ws FROM documents WHERE doc_id IN (SELECT doc_id FROM sent)),
uni AS (SELECT doc_id, 0 AS cls, w AS term, i AS pos FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d WHERE lang = 'en')
 WHERE w NOT IN {stop} AND length(w) > 1),
bi AS (SELECT doc_id, 1 AS cls, a || ' ' || b AS term, i AS pos FROM (SELECT doc_id, unnest(ws[:-2]) AS a, unnest(ws[2:]) AS b, generate_subscripts(ws[2:], 1) - 1 AS i FROM d WHERE lang = 'en')
 WHERE a NOT IN {stop} AND b NOT IN {stop} AND length(a) > 2 AND length(b) > 2),
kw0 AS (SELECT *, tf::DOUBLE * CASE cls WHEN 0 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS weight FROM (SELECT doc_id, cls, term, min(pos) AS pos, count(*) AS tf FROM (SELECT * FROM uni UNION ALL SELECT * FROM bi) GROUP BY ALL)),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, cls, pos) AS rank FROM kw0) WHERE rank <= {k}),
kwl AS (SELECT doc_id, list({{'t': term, 'w': weight}} ORDER BY rank) AS kws FROM kw GROUP BY doc_id)"""


FOLD = "list_reduce(list_prepend(0.0::DOUBLE, {0}), lambda a, b: a + b)"
SIGNAL = " OR ".join(f"contains(lower(text), {Q.lit(s)})" for s in T.SIGNALS)


def score_ctes(part: str = "doc_id", idx: str = "idx", n: str = "n") -> str:
    total = FOLD.format("list_transform(kws, lambda k: k.w)")
    cover = FOLD.format("list_transform(kws, lambda k: CASE WHEN contains(lower(text), k.t) THEN k.w ELSE 0.0::DOUBLE END)")
    return f"""
sc0 AS (SELECT s.*, coalesce(kws, []) AS kws, dd.lang, len(string_split(s.text, ' ')) AS wn, length(s.text) AS cn FROM sent s JOIN d dd USING (doc_id) LEFT JOIN kwl USING (doc_id)),
sc1 AS (SELECT *, {total} AS total, {cover} AS cov FROM sc0),
scored AS (SELECT *, 0.55::DOUBLE * (cov / CASE WHEN total = 0 THEN 1.0::DOUBLE ELSE total END)
 + 0.22::DOUBLE * CASE WHEN {idx} = 0 THEN 1.0::DOUBLE WHEN {idx} = {n} - 1 THEN 0.7::DOUBLE WHEN {idx} <= greatest(1, {n} // 5) THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END
 + 0.15::DOUBLE * CASE WHEN lang = 'zh' THEN CASE WHEN cn BETWEEN 15 AND 80 THEN 1.0::DOUBLE WHEN cn < 15 THEN 0.4::DOUBLE ELSE greatest(0.4::DOUBLE, 1.0::DOUBLE - (cn - 80)::DOUBLE / 200.0::DOUBLE) END
   ELSE CASE WHEN wn BETWEEN 8 AND 35 THEN 1.0::DOUBLE WHEN wn < 8 THEN 0.4::DOUBLE ELSE greatest(0.4::DOUBLE, 1.0::DOUBLE - (wn - 35)::DOUBLE / 80.0::DOUBLE) END END
 + 0.08::DOUBLE * CASE WHEN {SIGNAL} THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS score FROM sc1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS rank FROM scored)"""


BASE = f"WITH {sent_ctes()}, {kw_ctes()}, {score_ctes()}"
WANT = "least(n, greatest(1, least(5, round_even(n * 0.3::DOUBLE, 0)::INT)))"


def _joined(lang: str = "lang") -> str:
    ended = " OR ".join(f"ends_with(text, {Q.lit(t)})" for t in T.TERMINAL)
    return (f"CASE WHEN any_value(lang) = 'zh' THEN string_agg(CASE WHEN {ended} THEN text ELSE text || '。' END, '' ORDER BY idx) "
            "ELSE string_agg(text, ' ' ORDER BY idx) END")


# --- sentences, paragraphs, language -------------------------------------------------
@query("t01_sentences", f"SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, {Q.sentences('text')} AS l FROM documents)")
def sentences(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(T.sentence_array(F.col("text"))).alias("pos", "sentence"))


@query("t02_paragraphs", f"SELECT doc_id, unnest(l) AS paragraph, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, {PARAS} AS l FROM (SELECT doc_id, replace(text, '. ', chr(10) || ' ' || chr(10)) AS text FROM documents))")
def paragraphs(spark, sf):
    spaced = F.replace("text", F.lit(". "), F.lit("\n \n"))
    return docs(spark, sf).select("doc_id", F.posexplode(T.paragraph_array(spaced)).alias("pos", "paragraph"))


@query("t03_sentence_index", f"WITH {sent_ctes('(SELECT doc_id, source, text FROM documents)')} SELECT source, doc_id, para, sent, row_number() OVER (PARTITION BY source ORDER BY doc_id, para, sent) - 1 AS gidx FROM sent JOIN (SELECT doc_id, source FROM documents) USING (doc_id)")
def sentence_index(spark, sf):
    d = documents(spark, sf, "doc_id", "source", "text")
    return summaries.group_sentences(d, "source", width=100).select("source", "doc_id", "para", "sent", "gidx")


@query("t04_language", f"SELECT doc_id, {LANG} AS lang FROM documents")
def language(spark, sf):
    return docs(spark, sf).select("doc_id", T.language(F.col("text")).alias("lang"))


# the tables hold no Chinese text, so Chinese stands in for digits here
_HANZI = "零一二三四五六七八九"


def _digits_as_hanzi(spark, sf):
    o = spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    raw = F.concat_ws(" ", F.format_string("%d", F.col("o_orderkey") * 37), F.format_string("%d", F.col("o_custkey") * 1111))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.translate(raw, "0123456789", _HANZI).alias("text"))


_HANZI_SQL = f"(SELECT o_orderkey AS doc_id, translate((o_orderkey * 37)::VARCHAR || ' ' || (o_custkey * 1111)::VARCHAR, '0123456789', '{_HANZI}') AS text FROM orders)"


def _gram_sql(n: int) -> str:
    return f"""WITH r AS (SELECT doc_id, unnest(l) AS run, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{Q.CJK_RUN}') AS l FROM {_HANZI_SQL})),
g AS (SELECT doc_id, k, unnest(list_transform(range(1, length(run) - {n - 2}), lambda i: substr(run, i, {n}))) AS term FROM r)
SELECT doc_id, term, count(*) AS tf, count(DISTINCT k) AS df FROM g GROUP BY doc_id, term"""


@query("t05_bigrams", _gram_sql(2))
def bigrams(spark, sf):
    return summaries.ngram_counts(_digits_as_hanzi(spark, sf), 2)


@query("t06_trigrams", _gram_sql(3))
def trigrams(spark, sf):
    return summaries.ngram_counts(_digits_as_hanzi(spark, sf), 3)


@query("t07_zh_keywords", f"""
WITH r AS (SELECT doc_id, unnest(l) AS run, generate_subscripts(l, 1) - 1 AS k FROM (SELECT doc_id, regexp_extract_all(text, '{Q.CJK_RUN}') AS l FROM {_HANZI_SQL})),
g AS (SELECT doc_id, k, 0 AS cls, unnest(list_transform(range(1, length(run)), lambda i: {{'t': substr(run, i, 2), 'i': i}})) AS s FROM r
UNION ALL SELECT doc_id, k, 1, unnest(list_transform(range(1, length(run) - 1), lambda i: {{'t': substr(run, i, 3), 'i': i}})) FROM r),
c AS (SELECT doc_id, cls, s.t AS term, count(*) AS tf, count(DISTINCT k) AS df, min(k * 100000 + s.i) AS pos FROM g WHERE s.t NOT IN {Q.any_list(T.ZH_STOP)} GROUP BY ALL),
w AS (SELECT *, CASE cls WHEN 1 THEN tf * (1.0::DOUBLE + ln(1.0::DOUBLE + df)) * 1.3::DOUBLE ELSE tf * (1.0::DOUBLE + ln(1.0::DOUBLE + df)) END AS weight FROM c)
SELECT doc_id, term, round(weight, 9) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, cls, pos) AS rank FROM w) WHERE rank <= 8""")
def zh_keywords(spark, sf):
    rows = summaries.keyword_rows(summaries.indexed(_digits_as_hanzi(spark, sf)))
    return rows.select("doc_id", "term", F.round("weight", 9).alias("weight"))


@query("t08_t09_keywords", f"WITH {sent_ctes()}, {kw_ctes()} SELECT doc_id, term, weight, rank FROM kw")
def keywords(spark, sf):
    return summaries.keyword_rows(summaries.indexed(docs(spark, sf)))


@query("t10_scores", BASE + " SELECT doc_id, idx, para, sent, text, round(score, 9) AS score, rank FROM ranked")
def scores(spark, sf):
    d = summaries.scored_documents(docs(spark, sf))
    rows = d.select("doc_id", F.posexplode("ranked").alias("r", "s"))
    return rows.select("doc_id", "s.idx", "s.para", "s.sent", "s.text", F.round("s.score", 9).alias("score"), (F.col("r") + 1).alias("rank"))


def _chosen(df):
    return df.select("doc_id", F.explode("chosen").alias("s")).select("doc_id", "s.idx", "s.text")


@query("t11_select_default", BASE + f" SELECT doc_id, idx, text FROM ranked WHERE rank <= {WANT}")
def select_default(spark, sf):
    return _chosen(summaries.summarize(docs(spark, sf), evaluate=False))


@query("t11_select_ratio", BASE + " SELECT doc_id, idx, text FROM ranked WHERE rank <= least(n, greatest(1, round_even(n * 0.15::DOUBLE, 0)::INT))")
def select_ratio(spark, sf):
    return _chosen(summaries.summarize(docs(spark, sf), ratio=0.15, evaluate=False))


@query("t12_select_chars", BASE + """, run AS (SELECT *, sum(cn) OVER (PARTITION BY doc_id ORDER BY rank) AS run_total FROM ranked)
SELECT doc_id, idx, text FROM (SELECT *, min(CASE WHEN run_total > 300 AND rank > 1 THEN rank END) OVER (PARTITION BY doc_id) AS cut FROM run) WHERE rank < coalesce(cut, 1000000000)""")
def select_chars(spark, sf):
    return _chosen(summaries.summarize(docs(spark, sf), chars=300, evaluate=False))


@query("t13_chunks", f"""WITH RECURSIVE {sent_ctes()},
r AS (SELECT doc_id, idx, length(text)::BIGINT AS used, 0 AS chunk, 0::BIGINT AS first FROM sent WHERE idx = 0
UNION ALL SELECT s.doc_id, s.idx, CASE WHEN r.used + length(s.text) > 1000 THEN length(p.text) + length(s.text) ELSE r.used + length(s.text) END,
r.chunk + CASE WHEN r.used + length(s.text) > 1000 THEN 1 ELSE 0 END, CASE WHEN r.used + length(s.text) > 1000 THEN r.idx ELSE r.first END
FROM r JOIN sent s ON s.doc_id = r.doc_id AND s.idx = r.idx + 1 JOIN sent p ON p.doc_id = r.doc_id AND p.idx = r.idx)
SELECT doc_id, chunk, first, max(idx) AS last, max(used) AS chars FROM r GROUP BY ALL""")
def chunks(spark, sf):
    return summaries.chunk_sentences(docs(spark, sf), 1000)


@query("t14_sliding_window")
def sliding(spark, sf):
    return _chosen(summaries.summarize(docs(spark, sf), max_input_chars=2000, evaluate=False))


@query("t15_quality", BASE + f""", c AS (SELECT * FROM ranked WHERE rank <= {WANT}),
a AS (SELECT doc_id, {_joined()} AS summary, count(*) AS k, sum(cn) AS total_cn, any_value(n) AS n, any_value(kws) AS kws FROM c GROUP BY doc_id),
e AS (SELECT a.*, length(text) AS oc, 1.0::DOUBLE - length(summary)::DOUBLE / length(text) AS comp, 1.0::DOUBLE - k::DOUBLE / a.n AS red, total_cn::DOUBLE / k AS mean,
len(list_filter(kws, lambda x: contains(lower(summary), x.t))) AS cov FROM a JOIN documents USING (doc_id)),
f AS (SELECT *, CASE WHEN len(kws) = 0 THEN 0.0::DOUBLE ELSE cov::DOUBLE / len(kws) END AS cover,
CASE WHEN mean BETWEEN 25 AND 70 THEN 1.0::DOUBLE WHEN mean < 25 THEN 0.6::DOUBLE ELSE greatest(0.5::DOUBLE, 1.0::DOUBLE - (mean - 70) / 150.0::DOUBLE) END AS reads FROM e)
SELECT doc_id, round(comp, 2) AS compression, round(red, 2) AS reduction, cov::BIGINT AS keywords_covered, len(kws)::BIGINT AS keywords_total,
greatest(0, least(100, round_even(100 * (0.35::DOUBLE * comp + 0.30::DOUBLE * cover + 0.20::DOUBLE * red + 0.15::DOUBLE * reads), 0)::INT)) AS score FROM f""")
def quality(spark, sf):
    s = summaries.summarize(docs(spark, sf))
    length = F.length("text")
    joined = s.join(docs(spark, sf), "doc_id")
    return joined.select(
        "doc_id", F.round(1.0 - F.length("summary") / length, 2).alias("compression"),
        F.round(1.0 - F.size("chosen") / F.col("sentence_count"), 2).alias("reduction"),
        F.col("keywords_covered").cast("long").alias("keywords_covered"), F.col("keywords_total").cast("long").alias("keywords_total"),
        "score")


@query("t16_summary", BASE + f" SELECT doc_id, {_joined()} AS summary FROM ranked WHERE rank <= {WANT} GROUP BY doc_id")
def summary(spark, sf):
    return summaries.summarize(docs(spark, sf), evaluate=False).select("doc_id", "summary")


_TLDR = ("CASE WHEN length(text) > CASE WHEN lang = 'zh' THEN 80 ELSE 140 END THEN "
         "regexp_replace(substr(text, 1, CASE WHEN lang = 'zh' THEN 80 ELSE 140 END), '[，。、；,.; ]+$', '') || '…' ELSE text END")


@query("t17_tldr", BASE + f" SELECT doc_id, {_TLDR} AS tldr FROM ranked WHERE rank = 1")
def tldr(spark, sf):
    return summaries.summarize(docs(spark, sf), evaluate=False).select("doc_id", "tldr")


@query("t18_brief", BASE + """, k AS (SELECT doc_id, string_agg(term, ',' ORDER BY rank) AS keywords FROM kw GROUP BY doc_id)
SELECT doc_id, coalesce(keywords, '') AS keywords, string_agg(idx::VARCHAR, ',' ORDER BY rank) AS candidates, any_value(n) AS total_sentences, any_value(length(d.text)) AS char_count
FROM ranked r JOIN documents d USING (doc_id) LEFT JOIN k USING (doc_id) WHERE rank <= 10 GROUP BY ALL""")
def brief(spark, sf):
    b = summaries.brief(docs(spark, sf))
    ids = F.array_join(F.transform("candidates", lambda c: c["index"].cast("string")), ",")
    return b.select("doc_id", F.array_join("keywords", ",").alias("keywords"), ids.alias("candidates"),
                    F.col("total_sentences").cast("long").alias("total_sentences"), F.col("char_count").cast("long").alias("char_count"))


def group_sql() -> str:
    stop = Q.any_list(T.EN_STOP)
    total = FOLD.format("list_transform(kws, lambda k: k.w)")
    return f"""WITH src AS (SELECT doc_id, source, text FROM documents), {sent_ctes('src')},
gs AS (SELECT s.*, source, row_number() OVER (PARTITION BY source ORDER BY doc_id, para, sent) - 1 AS gidx, count(*) OVER (PARTITION BY source) AS gn FROM sent s JOIN src USING (doc_id)),
full_text AS (SELECT source, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM src WHERE doc_id IN (SELECT doc_id FROM sent) GROUP BY source),
gd AS (SELECT source, {Q.words('text')} AS ws FROM full_text),
uni AS (SELECT source, 0 AS cls, w AS term, i AS pos FROM (SELECT source, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM gd) WHERE w NOT IN {stop} AND length(w) > 1),
bi AS (SELECT source, 1 AS cls, a || ' ' || b AS term, i AS pos FROM (SELECT source, unnest(ws[:-2]) AS a, unnest(ws[2:]) AS b, generate_subscripts(ws[2:], 1) - 1 AS i FROM gd)
 WHERE a NOT IN {stop} AND b NOT IN {stop} AND length(a) > 2 AND length(b) > 2),
kw0 AS (SELECT *, tf::DOUBLE * CASE cls WHEN 0 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS weight FROM (SELECT source, cls, term, min(pos) AS pos, count(*) AS tf FROM (SELECT * FROM uni UNION ALL SELECT * FROM bi) GROUP BY ALL)),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, cls, pos) AS rank FROM kw0) WHERE rank <= 8)"""


@query("t19_group_keywords", group_sql() + " SELECT source, term, weight, rank FROM kw")
def group_keywords(spark, sf):
    d = documents(spark, sf, "doc_id", "source", "text")
    return summaries.group_keywords(d, "source", width=100).select("source", "term", "weight", "rank")


def _group_scores() -> str:
    total = FOLD.format("list_transform(kws, lambda k: k.w)")
    cover = FOLD.format("list_transform(kws, lambda k: CASE WHEN contains(lower(text), k.t) THEN k.w ELSE 0.0::DOUBLE END)")
    return f""", kwl AS (SELECT source, list({{'t': term, 'w': weight}} ORDER BY rank) AS kws FROM kw GROUP BY source),
sc AS (SELECT *, {total} AS total, {cover} AS cov, len(string_split(text, ' ')) AS wn FROM gs JOIN kwl USING (source)),
scored AS (SELECT *, 0.55::DOUBLE * (cov / total) + 0.22::DOUBLE * CASE WHEN gidx = 0 THEN 1.0::DOUBLE WHEN gidx = gn - 1 THEN 0.7::DOUBLE WHEN gidx <= greatest(1, gn // 5) THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END
 + 0.15::DOUBLE * CASE WHEN wn BETWEEN 8 AND 35 THEN 1.0::DOUBLE WHEN wn < 8 THEN 0.4::DOUBLE ELSE greatest(0.4::DOUBLE, 1.0::DOUBLE - (wn - 35)::DOUBLE / 80.0::DOUBLE) END
 + 0.08::DOUBLE * CASE WHEN {SIGNAL} THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS score FROM sc)
SELECT source, doc_id, gidx, text, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, gidx) AS rank FROM scored)
WHERE rank <= least(gn, greatest(1, least(5, round_even(gn * 0.3::DOUBLE, 0)::INT)))"""


@query("t19_group_summary", group_sql() + _group_scores())
def group_summary(spark, sf):
    d = documents(spark, sf, "doc_id", "source", "text")
    return summaries.summarize_group(d, "source", width=100).select(
        "source", "doc_id", "gidx", "text", F.round("score", 9).alias("score"), "rank")


@query("t20_batch_index", BASE + f""", s AS (SELECT doc_id, any_value(lang) AS lang, {_joined()} AS summary FROM ranked WHERE rank <= 3 GROUP BY doc_id)
SELECT doc_id, lang, summary, {Q.sentences('summary')}[1] AS headline FROM s""")
def batch_index(spark, sf):
    return summaries.batch_index(docs(spark, sf)).select("doc_id", "lang", "summary", "headline")


@query("t21_hierarchical", BASE + f""", a AS (SELECT doc_id, list(text ORDER BY idx) FILTER (rank <= 3) AS l2, list(text ORDER BY idx) FILTER (rank <= 8) AS l3, any_value({_TLDR}) FILTER (rank = 1) AS l1 FROM ranked GROUP BY doc_id)
SELECT doc_id, l1, array_to_string(l2, '|') AS l2, array_to_string(list_filter(l3, lambda x: NOT list_contains(l2, x)), '|') AS l3 FROM a""")
def hierarchical(spark, sf):
    h = summaries.hierarchical(docs(spark, sf))
    return h.select("doc_id", "l1", F.array_join("l2", "|").alias("l2"), F.array_join("l3", "|").alias("l3"))


def compare_sql() -> str:
    stop = Q.any_list(T.EN_STOP_COMPARE)
    return f"""WITH {Q.REPLIES}, sides AS (SELECT pair_id, 'l' AS side, left_text AS text FROM pairs UNION ALL SELECT pair_id, 'r', right_text FROM pairs),
t AS (SELECT pair_id, side, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM (SELECT pair_id, side, list_filter({Q.words('text')}, lambda w: w NOT IN {stop}) AS ws FROM sides)),
c AS (SELECT pair_id, side, term, count(*) AS f, min(pos) AS pos FROM t GROUP BY ALL),
st AS (SELECT *, count(*) FILTER (f >= 2) OVER (PARTITION BY pair_id, side) AS strong FROM c),
rk AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY f DESC, pos) AS rank FROM st WHERE strong < 4 OR f >= 2),
ks AS (SELECT pair_id, side, list(term ORDER BY term) AS kw FROM rk WHERE rank <= 12 GROUP BY ALL)"""


@query("t22_keyword_sets", compare_sql() + " SELECT pair_id, side, array_to_string(kw, ',') AS kw FROM ks")
def keyword_sets(spark, sf):
    p = reply_pairs(spark, sf)
    texts = p.select("pair_id", F.explode(F.create_map(F.lit("l"), "left_text", F.lit("r"), "right_text")).alias("side", "text"))
    return summaries.keyword_set(texts, key=["pair_id", "side"]).select("pair_id", "side", F.array_join("kw", ",").alias("kw"))


@query("t23_compare", compare_sql() + """, w AS (SELECT p.pair_id, coalesce(l.kw, []) AS lk, coalesce(r.kw, []) AS rk, length(left_text) AS left_len, length(right_text) AS right_len FROM pairs p
LEFT JOIN ks l ON l.pair_id = p.pair_id AND l.side = 'l' LEFT JOIN ks r ON r.pair_id = p.pair_id AND r.side = 'r')
SELECT pair_id, left_len, right_len, len(list_intersect(lk, rk))::BIGINT AS n_overlap, round_even(CASE WHEN len(list_distinct(list_concat(lk, rk))) = 0 THEN 0.0::DOUBLE ELSE
len(list_intersect(lk, rk))::DOUBLE / len(list_distinct(list_concat(lk, rk))) END, 3) AS keyword_jaccard, right_len > left_len * 1.6::DOUBLE AS longer FROM w""")
def compare(spark, sf):
    c = summaries.compare(reply_pairs(spark, sf))
    return c.select("pair_id", "left_len", "right_len", F.size("keyword_overlap").cast("long").alias("n_overlap"), "keyword_jaccard",
                    F.array_contains("suggestions", "right_longer").alias("longer"))


def sim_sql(t_left: str = "left_text", t_right: str = "right_text") -> str:
    return f"""WITH {Q.REPLIES},
a AS (SELECT pair_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS i FROM (SELECT pair_id, {Q.sentences(t_left)} AS l FROM pairs)),
b AS (SELECT pair_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS j FROM (SELECT pair_id, {Q.sentences(t_right)} AS l FROM pairs)),
ta AS (SELECT *, {Q.sim_tokens('text')} AS tk FROM a), tb AS (SELECT *, {Q.sim_tokens('text')} AS tk FROM b),
sim AS (SELECT ta.pair_id, i, j, len(list_intersect(ta.tk, tb.tk))::DOUBLE / (len(ta.tk) + len(tb.tk) - len(list_intersect(ta.tk, tb.tk))) AS sim FROM ta JOIN tb USING (pair_id) WHERE len(list_intersect(ta.tk, tb.tk)) > 0)"""


@query("t24_sentence_jaccard", sim_sql() + " SELECT pair_id, i, j, round(sim, 9) AS sim FROM sim")
def sentence_jaccard(spark, sf):
    p = reply_pairs(spark, sf)
    a, b = similarity._sentences(p, "pair_id", "left_text", "i"), similarity._sentences(p, "pair_id", "right_text", "j")
    return similarity.sentence_matches(a, b, "pair_id").withColumn("sim", F.round("sim", 9))


_DIFF = sim_sql() + """, ba AS (SELECT pair_id, i, max(sim) AS best, arg_min(j, {'away': -sim, 'j': j}) AS j FROM sim GROUP BY ALL),
bb AS (SELECT pair_id, j, max(sim) AS best FROM sim GROUP BY ALL),
m AS (SELECT * FROM ba WHERE best >= 0.3), used AS (SELECT DISTINCT pair_id, j FROM m),
diff AS (SELECT a.pair_id, 'removed' AS change, i AS idx, NULL::BIGINT AS other_idx, NULL::DOUBLE AS score, a.text, NULL AS other_text FROM a LEFT JOIN ba USING (pair_id, i) WHERE coalesce(best, 0) < 0.3
UNION ALL SELECT m.pair_id, 'modified', m.i, m.j, round_even(m.best, 3), a.text, b.text FROM m JOIN a USING (pair_id, i) JOIN b ON b.pair_id = m.pair_id AND b.j = m.j WHERE best < 0.85
UNION ALL SELECT b.pair_id, 'added', b.j, NULL, NULL, b.text, NULL FROM b LEFT JOIN bb USING (pair_id, j) WHERE coalesce(best, 0) < 0.3 AND (b.pair_id, b.j) NOT IN (SELECT pair_id, j FROM used))"""


@query("t25_diff", _DIFF + " SELECT pair_id, change, idx, other_idx, score, text, other_text FROM diff")
def diff(spark, sf):
    return similarity.diff_documents(reply_pairs(spark, sf)).select("pair_id", "change", "idx", "other_idx", "score", "text", "other_text")


@query("t25_diff_counts", _DIFF + " SELECT pair_id, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified FROM diff GROUP BY pair_id")
def diff_counts(spark, sf):
    return similarity.diff_counts(similarity.diff_documents(reply_pairs(spark, sf)))


_CONS = sim_sql("right_text", "left_text") + """, best AS (SELECT pair_id, i, max(sim) AS best, arg_min(j, {'away': -sim, 'j': j}) AS j FROM sim GROUP BY ALL),
chk AS (SELECT a.pair_id, i AS idx, text, coalesce(best.j, -1) AS best_match_idx, round_even(coalesce(best, 0.0::DOUBLE), 3) AS best_match_score, coalesce(best, 0) >= 0.12 AS traceable FROM a LEFT JOIN best USING (pair_id, i))"""


@query("t26_consistency", _CONS + " SELECT * FROM chk")
def consistency(spark, sf):
    return similarity.consistency(reply_pairs(spark, sf))


@query("t26_verdict", _CONS + """, c AS (SELECT pair_id, count(*) AS n, count(*) FILTER (traceable) AS t FROM chk GROUP BY pair_id)
SELECT p.pair_id, coalesce(n, 0) AS summary_sentences, coalesce(t, 0) AS traceable, coalesce(n - t, 0) AS untraceable, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n = t THEN 'consistent' ELSE 'inconsistent' END AS verdict
FROM pairs p LEFT JOIN c USING (pair_id)""")
def verdict(spark, sf):
    p = reply_pairs(spark, sf)
    return similarity.consistency_verdict(p, similarity.consistency(p)).drop("traceable_ratio")


@query("t27_clean_summary", f"""
SELECT doc_id, array_to_string(list_transform(list_filter({Q.lines('text')}, lambda l: NOT regexp_matches(l, '^[[:space:]]*关键词[：:].*$') AND NOT regexp_matches(trim(l), '^#+[[:space:]]*(摘要|关键词)[[:space:]]*$')),
lambda l: regexp_replace(l, '（见原文第[0-9]+段·句[0-9]+）|（见第[0-9]+篇·第[0-9]+段·句[0-9]+）', '', 'g')), chr(10)) AS text
FROM (SELECT doc_id, '# 摘要' || chr(10) || replace(text, '.', '（见原文第1段·句2）.') || chr(10) || '关键词：a' AS text FROM documents)""")
def clean_summary(spark, sf):
    marked = F.concat(F.lit("# 摘要\n"), F.replace("text", F.lit("."), F.lit("（见原文第1段·句2）.")), F.lit("\n关键词：a"))
    return docs(spark, sf).select("doc_id", similarity.clean_summary(marked).alias("text"))


# --- structure -----------------------------------------------------------------------
_SHAPE = ("CASE (doc_id + i) % 7 WHEN 0 THEN '- ' || l WHEN 1 THEN 'Q: ' || l WHEN 2 THEN 'A: ' || l WHEN 3 THEN '| ' || l || ' | b | c | d |' "
          "WHEN 4 THEN l || '?' WHEN 5 THEN l ELSE 'term: ' || l END")


def _shaped(spark, sf):
    """Documents whose lines take turns as list item, question, answer, table row, ..."""
    lines = similarity.line_array(F.col("text"))

    def shape(ln, i):
        n = (F.col("doc_id") + i) % 7
        return (
            F.when(n == 0, F.concat(F.lit("- "), ln)).when(n == 1, F.concat(F.lit("Q: "), ln)).when(n == 2, F.concat(F.lit("A: "), ln))
            .when(n == 3, F.concat(F.lit("| "), ln, F.lit(" | b | c | d |")))
            .when(n == 4, F.concat(ln, F.lit("?"))).when(n == 5, ln).otherwise(F.concat(F.lit("term: "), ln))
        )

    return docs(spark, sf).select("doc_id", F.array_join(F.transform(lines, shape), "\n").alias("text"))


def _at(pattern: str, group: int) -> str:
    return f"regexp_extract(s, {Q.rx(pattern)}, {group})"


_S = structure
_ITEMS = f"""
WITH RECURSIVE ln AS (SELECT doc_id, unnest(l) AS l, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, {Q.lines('text')} AS l FROM documents)),
sh AS (SELECT doc_id, i AS pos, {_SHAPE} AS line FROM ln), i0 AS (SELECT *, {Q.strip('line')} AS s FROM sh),
i1 AS (SELECT *, s = '' AS blank, regexp_matches(line, {Q.rx(_S.QUESTION_MARK)}) AS is_q, regexp_matches(line, {Q.rx(_S.ANSWER_MARK)}) AS is_a,
  regexp_matches(line, {Q.rx(_S.TABLE_ROW)}) AS is_table, regexp_matches(line, {Q.rx(_S.LIST_MARK)}) AS is_list,
  regexp_matches(s, {Q.rx(_S.DEFINED_BY_VERB)}) AND length({_at(_S.DEFINED_BY_VERB, 2)}) >= 2 AS verb, {Q.strip(_at(_S.DEFINED_BY_VERB, 1))} AS vterm, {Q.strip(_at(_S.DEFINED_BY_VERB, 2))} AS vdesc,
  {Q.strip(_at(_S.DEFINED_BY_MARK, 1))} AS mterm, {Q.strip(_at(_S.DEFINED_BY_MARK, 2))} AS mdesc, regexp_matches(s, {Q.rx(_S.DEFINED_BY_MARK)}) AS marked FROM i0),
i2 AS (SELECT *, marked AND length(mterm) BETWEEN 1 AND 24 AND length(mdesc) >= 2 AS mark, is_q AND coalesce(lead(is_a) OVER w, false) AS opens, lead(line) OVER w AS next_line, lead(s) OVER w AS next_s
  FROM i1 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
i3 AS (SELECT *, coalesce(lag(opens) OVER (PARTITION BY doc_id ORDER BY pos), false) AS closes FROM i2),
i4 AS (SELECT *, NOT (blank OR is_table OR opens OR closes OR is_list OR verb OR mark) AND regexp_matches(s, {Q.rx(_S.ASKS)}) AS asks FROM i3),
i5 AS (SELECT *, coalesce(lag(asks) OVER (PARTITION BY doc_id ORDER BY pos), false) AND NOT (blank OR is_table OR is_list) AS may FROM i4),
tk AS (SELECT doc_id, pos, may AS taken FROM i5 WHERE pos = 0 UNION ALL SELECT i5.doc_id, i5.pos, i5.may AND NOT tk.taken FROM tk JOIN i5 ON i5.doc_id = tk.doc_id AND i5.pos = tk.pos + 1),
i6 AS (SELECT i5.*, taken, coalesce(lead(taken) OVER (PARTITION BY doc_id ORDER BY pos), false) AS next_taken FROM i5 JOIN tk USING (doc_id, pos)),
i7 AS (SELECT *, {Q.strip(f"regexp_replace(line, {Q.rx(_S.LIST_MARK)}, '')")} AS item, CASE WHEN opens THEN 'qa' WHEN taken OR blank THEN NULL
  WHEN is_table THEN CASE WHEN NOT regexp_matches(line, {Q.rx(_S.TABLE_RULE)}) THEN 'table' END WHEN closes THEN NULL
  WHEN is_list THEN CASE WHEN {Q.strip(f"regexp_replace(line, {Q.rx(_S.LIST_MARK)}, '')")} <> '' THEN 'list' END WHEN verb OR mark THEN 'definition' WHEN asks THEN 'qa' END AS type FROM i6),
i8 AS (SELECT doc_id, pos, type, opens AS explicit, s, item, CASE WHEN type = 'qa' THEN CASE WHEN opens THEN {Q.strip(f"regexp_replace(line, {Q.rx(_S.QUESTION_MARK)}, '')")} ELSE s END END AS question,
  CASE WHEN type = 'qa' THEN CASE WHEN opens THEN {Q.strip(f"regexp_replace(next_line, {Q.rx(_S.ANSWER_MARK)}, '')")} WHEN next_taken THEN next_s ELSE '' END END AS answer,
  CASE WHEN type = 'definition' THEN CASE WHEN verb THEN vterm ELSE mterm END END AS term, CASE WHEN type = 'definition' THEN CASE WHEN verb THEN vdesc ELSE mdesc END END AS desc,
  CASE WHEN type = 'table' THEN list_transform(string_split(regexp_extract(line, {Q.rx(_S.TABLE_ROW)}, 1), '|'), lambda c: {Q.strip('c')}) END AS cells FROM i7 WHERE type IS NOT NULL),
items AS (SELECT *, CASE type WHEN 'list' THEN item WHEN 'table' THEN s WHEN 'definition' THEN term || '：' || "desc" ELSE '问：' || question || '　答：' || answer END AS content FROM i8)"""


@query("t28_t32_items", _ITEMS + " SELECT doc_id, pos, type, content FROM items")
def items(spark, sf):
    return structure.extract_items(_shaped(spark, sf)).select("doc_id", "pos", "type", "content")


@query("t28_t29_questions", _ITEMS + " SELECT doc_id, pos, explicit, question, answer FROM items WHERE type = 'qa'")
def questions(spark, sf):
    return structure.extract_items(_shaped(spark, sf)).where("type = 'qa'").select("doc_id", "pos", "explicit", "question", "answer")


@query("t31_definitions", _ITEMS + " SELECT doc_id, pos, term, \"desc\" FROM items WHERE type = 'definition'")
def definitions(spark, sf):
    return structure.extract_items(_shaped(spark, sf)).where("type = 'definition'").select("doc_id", "pos", "term", "desc")


@query("t33_item_stats", _ITEMS + " SELECT doc_id, type, count(*) AS n FROM items GROUP BY ALL")
def item_stats(spark, sf):
    return structure.item_stats(structure.extract_items(_shaped(spark, sf)))


_LABEL = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in structure.TYPE_LABEL.items()) + " END"
_PLACE = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in structure.TYPE_ORDER.items()) + " END"


@query("a17_items_csv_rows", _ITEMS + f""", v AS (SELECT *, min(CASE WHEN type = 'table' THEN pos END) OVER (PARTITION BY doc_id) AS head,
CASE type WHEN 'qa' THEN [question, answer] WHEN 'definition' THEN [term, "desc"] WHEN 'table' THEN cells ELSE [content] END AS vs FROM items)
SELECT doc_id, {_PLACE} AS type_order, pos, {_LABEL} AS type, coalesce(vs[1], '') AS value1, coalesce(vs[2], '') AS value2,
CASE WHEN len(vs) > 3 THEN array_to_string(vs[3:], ' | ') ELSE coalesce(vs[3], '') END AS value3 FROM v WHERE type <> 'table' OR pos <> head""")
def csv_rows(spark, sf):
    return structure.items_to_csv_rows(structure.extract_items(_shaped(spark, sf)))


def _outlined(spark, sf):
    """Documents whose lines take turns as headings, list items and plain lines."""
    lines = similarity.line_array(F.col("text"))

    def shape(ln, i):
        n = (F.col("doc_id") * 3 + i) % 5
        body = F.concat(F.lit("x"), F.regexp_replace(ln, "[^A-Za-z ]", ""))
        return (
            F.when(n == 0, F.concat(F.lit("# "), body)).when(n == 1, F.concat(F.lit("## "), body))
            .when(n == 2, F.concat(F.lit("- "), body)).when(n == 3, F.concat(F.lit("  - "), body)).otherwise(F.concat(F.lit("    "), body))
        )

    return docs(spark, sf).select("doc_id", F.array_join(F.transform(lines, shape), "\n").alias("text"))


_OUT = f"""WITH ln AS (SELECT doc_id, unnest(l) AS l, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, {Q.lines('text')} AS l FROM documents)),
nd0 AS (SELECT doc_id, i AS pos, (doc_id * 3 + i) % 5 AS k, trim('x' || regexp_replace(l, '[^A-Za-z ]', '', 'g')) AS text FROM ln),
nd1 AS (SELECT *, last_value(CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS head FROM nd0),
nodes AS (SELECT doc_id, pos, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE coalesce(head, 0) + 1 + CASE k WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 2 END END AS depth, text FROM nd1)"""


@query("t34_outline", _OUT + " SELECT * FROM nodes")
def outline(spark, sf):
    return structure.outline(_outlined(spark, sf))


_TREE = _OUT + """, tree AS (SELECT n.*, (SELECT max(m.pos) FROM nodes m WHERE m.doc_id = n.doc_id AND m.pos < n.pos AND m.depth < n.depth) AS parent_pos FROM nodes n)"""


@query("t36_outline_tree", _TREE + " SELECT * FROM tree")
def outline_tree(spark, sf):
    return structure.outline_tree(structure.outline(_outlined(spark, sf)))


@query("t37_outline_stats", _TREE + " SELECT doc_id, count(*) AS node_count, max(depth) + 1 AS max_depth, count(*) FILTER (parent_pos IS NULL) AS root_count FROM tree GROUP BY doc_id")
def outline_stats(spark, sf):
    return structure.outline_stats(structure.outline_tree(structure.outline(_outlined(spark, sf))))


@query("t35_mindmap", f"""
WITH ln AS (SELECT doc_id, unnest(l) AS l, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, {Q.lines('text')} AS l FROM documents))
SELECT doc_id, i + 3 AS pos, (i % 3)::INT AS depth, 'n' || regexp_replace(l, '[^A-Za-z]', '', 'g') AS text FROM ln""")
def mindmap(spark, sf):
    lines = similarity.line_array(F.col("text"))
    body = F.transform(lines, lambda ln, i: F.concat(
        F.repeat(F.lit("  "), (i % 3).cast("int")), F.lit("id"), i.cast("string"), F.lit("((n"),
        F.regexp_replace(ln, "[^A-Za-z]+", ""), F.lit("))")))
    text = F.concat(F.lit("intro\n```mermaid\nmindmap\n"), F.array_join(body, "\n"), F.lit("\n```\noutro"))
    return structure.outline(docs(spark, sf).select("doc_id", text.alias("text")))


# --- retrieval, durations, capabilities -----------------------------------------------
@query("t38_retrieve", f"""
WITH {sent_ctes()}, q AS (SELECT item_id, list_filter(list_distinct({Q.words('lower(text)')}), lambda w: length(w) > 1) AS qt FROM benchmark),
s AS (SELECT doc_id, para, idx AS nth, text, list_filter(list_distinct({Q.words('lower(text)')}), lambda w: length(w) > 1) AS st FROM sent),
o AS (SELECT item_id, doc_id, para, nth, text, len(list_intersect(qt, st))::DOUBLE / len(qt) AS score FROM q, s WHERE list_has_any(qt, st))
SELECT item_id, doc_id, para, nth, text, round_even(score, 3) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, para, nth) AS rank FROM o) WHERE rank <= 3""")
def retrieve(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.posexplode(T.located_sentences(F.col("text"))).alias("nth", "s")).select(
        "doc_id", F.col("s.para").alias("para"), "nth", F.col("s.text").alias("text"))
    return similarity.retrieve(table(spark, sf, "benchmark"), rows)


@query("t42_duration", """
SELECT conv_id, turn, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]'))::BIGINT AS cjk, len(regexp_extract_all(text, '[A-Za-z]+'))::BIGINT AS latin,
round(len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) / 220.0::DOUBLE * 60.0::DOUBLE + len(regexp_extract_all(text, '[A-Za-z]+')) / 150.0::DOUBLE * 60.0::DOUBLE, 6) AS seconds FROM conversations""")
def duration(spark, sf):
    zh, words, seconds = summaries.est_duration(F.col("text"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", zh.cast("long").alias("cjk"), words.cast("long").alias("latin"), F.round(seconds, 6).alias("seconds"))


CAPS = {"search": ["the", "find"], "secrets": ["token", "password"], "network": ["http", "@", "ip "]}


def _occ(w: str) -> str:
    return f"(length(lower(text)) - length(replace(lower(text), {Q.lit(w)}, ''))) // {len(w)}"


@query("t43_capabilities", " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS capability, {' + '.join(_occ(w) for w in ws)} AS score FROM documents WHERE {' + '.join(_occ(w) for w in ws)} > 0"
    for c, ws in CAPS.items()))
def capabilities(spark, sf):
    return structure.match_capabilities(docs(spark, sf), CAPS)


@query("t43_best_match", "SELECT capability, min(doc_id) FILTER (score = top) AS best, max(top) AS score, count(*) - 1 AS n_alternatives FROM (SELECT *, max(score) OVER (PARTITION BY capability) AS top FROM (" +
       " UNION ALL ".join(
           f"SELECT doc_id, '{c}' AS capability, {' + '.join(_occ(w) for w in ws)} AS score FROM documents WHERE {' + '.join(_occ(w) for w in ws)} > 0"
           for c, ws in CAPS.items()) + ")) GROUP BY capability")
def best_match(spark, sf):
    return structure.best_match(structure.match_capabilities(docs(spark, sf), CAPS))
