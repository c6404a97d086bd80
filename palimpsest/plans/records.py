"""Registered queries: sources, transcripts, content-pack records, registry."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimpsest.functions import patterns as P
from palimpsest.functions.scale import number_rows
from palimpsest.operators import deident, pack, registry, transcript
from palimpsest.plans import sqlkit as Q
from palimpsest.plans.tables import corpus, documents, files, spread, table
from palimpsest.session import ensure_checkpoint_dir
from palimpsest.sources import corpus as src
from palimpsest.sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def s(col) -> F.Column:
    return F.col(col).cast("string")


# --- sources ---------------------------------------------------------------------------
@query("a01_read_corpus")
def read_corpus(spark, sf):
    return src.read_corpus(spark, sf).select("rel_path", "ext", "size")


def _case(column: str, groups: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} IN {Q.any_list(v)} THEN '{k}'" for k, v in groups.items()) + f" ELSE {default} END"


_CLASS = _case("ext", {"text": P.TEXT_EXT, "code": P.CODE_EXT, "extractable": P.EXTRACT_EXT, "image": P.IMAGE_EXT}, "'unsupported'")
_MEDIA = _case("ext", P.MEDIA_EXT, "NULL")


@query("a02_classify_inputs", f"WITH {Q.CORPUS} SELECT doc_id, ext, {_CLASS} AS input_class, {_MEDIA} AS media_type FROM corpus")
def classify(spark, sf):
    return src.classify_inputs(files(spark, sf)).select("doc_id", "ext", "input_class", "media_type")


@query("a03_discover", f"WITH {Q.CORPUS} SELECT rel_path, {_MEDIA} AS media_type FROM corpus WHERE {_MEDIA} IS NOT NULL")
def discover(spark, sf):
    f = files(spark, sf)
    return src.discover(f.select("rel_path").union(f.select("rel_path")), "rel_path")[0]


@query("a04_decode_text", "SELECT doc_id, text FROM documents")
def decode(spark, sf):
    utf8 = F.encode("text", "UTF-8")
    content = (
        F.when(F.col("doc_id") % 3 == 0, utf8).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8))
        .otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
    )
    d = documents(spark, sf, "doc_id", "text").withColumn("content", content)
    return d.select("doc_id", src.decode_text(F.col("content")).alias("text"))


def _actions(i: int) -> str:
    return "CASE category " + " ".join(f"WHEN '{k}' THEN {Q.lit(v[i])}" for k, v in P.SKIP_ACTIONS.items() if v[i]) + " END"


@query("a05_skip_manifest", f"WITH {Q.CORPUS}, c AS (SELECT rel_path, {_CLASS} AS category FROM corpus) SELECT rel_path, category, {_actions(0)} AS action, {_actions(1)} AS warning FROM c WHERE category IN ('image', 'unsupported')")
def skip_manifest(spark, sf):
    c = src.classify_inputs(files(spark, sf)).select("rel_path", F.col("input_class").alias("category"))
    return src.skip_manifest(c.where(F.col("category").isin("image", "unsupported")))


RULES = [("public", "glob", "*.md"), ("public", "path", "src2/en"), ("local", "path", "src1/")]
_EXEMPT = "CASE WHEN starts_with(rel_path, 'src1/') THEN 'local' WHEN starts_with(rel_path, 'src2/en/') THEN 'public' WHEN ends_with(rel_path, '.md') THEN 'public' END"


@query("a06_exemptions", f"WITH {Q.CORPUS} SELECT rel_path, {_EXEMPT} AS exempt FROM corpus")
def exemptions(spark, sf):
    return src.apply_exemptions(files(spark, sf), RULES).select("rel_path", "exempt")


@query("a06_exemption_table", f"WITH {Q.CORPUS} SELECT rel_path, {_EXEMPT} AS exempt FROM corpus")
def exemption_table(spark, sf):
    """The same rules as a table, among as many others as there are parts, none of which fits."""
    mine = spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "line long, scope string, how string, value string")
    more = table(spark, sf, "part").select((F.col("p_partkey") + len(RULES)).alias("line"), F.lit("local").alias("scope"), F.lit("path").alias("how"), F.concat(F.lit("parts/"), s("p_partkey"), F.lit("/")).alias("value"))
    return src.apply_exemption_table(files(spark, sf), mine.unionByName(more)).select("rel_path", "exempt")


@query("a07_exemption_evidence", f"""
WITH {Q.CORPUS}, {Q.pass_ctes('corpus', 'doc_id')}, {Q.hits_cte()}, h AS (SELECT doc_id, count(*) AS k FROM hits GROUP BY doc_id)
SELECT doc_id, exempt, octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha256, coalesce(k, 0) AS n_hits, coalesce(k, 0) > 0 AS declared_but_hit
FROM (SELECT doc_id, text, {_EXEMPT} AS exempt FROM corpus) LEFT JOIN h USING (doc_id) WHERE exempt IS NOT NULL""")
def evidence(spark, sf):
    c = src.apply_exemptions(corpus(spark, sf).select("doc_id", "rel_path", "text"), RULES)
    counts = deident.kind_counts(deident.scan_pass(c.select("doc_id", "text"), "mask"), ["doc_id"])
    out = src.exemption_evidence(c.where(F.col("exempt").isNotNull()), counts, content="text")
    return out.drop("reason")


@query("a08_zones", f"WITH {Q.CORPUS} SELECT CASE WHEN exempt = 'local' THEN 'local_only' ELSE 'uploadable' END AS zone, count(*) AS n FROM (SELECT {_EXEMPT} AS exempt FROM corpus) WHERE exempt IS NULL OR exempt = 'local' GROUP BY zone")
def zones(spark, sf):
    z = sinks.zoned(src.apply_exemptions(files(spark, sf), RULES))
    return z.groupBy("zone").agg(F.count(F.lit(1)).alias("n"))


@query("a08_written_zones", f"""
WITH {Q.CORPUS} SELECT doc_id, CASE WHEN exempt = 'local' THEN 'local_only' ELSE 'uploadable' END AS zone, sha256(text) AS sha256
FROM (SELECT doc_id, text, {_EXEMPT} AS exempt FROM corpus) WHERE exempt IS NULL OR exempt = 'local'""")
def written_zones(spark, sf):
    """What the zones' folders hold after writing."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/zones-{uuid.uuid4().hex}"
    sinks.write_zones(sinks.zoned(src.apply_exemptions(corpus(spark, sf).select("doc_id", "rel_path", "text"), RULES)).select("doc_id", "text", "zone"), path)
    return spark.read.parquet(path).select("doc_id", "zone", F.sha2("text", 256).alias("sha256"))


@query("a09_preprocessing_exceptions", f"WITH {Q.CORPUS} SELECT rel_path FROM corpus WHERE ext = '.xyz'")
def exceptions(spark, sf):
    m = files(spark, sf).withColumn("status", F.when(F.col("ext") == ".xyz", "exception").otherwise("ok"))
    return src.preprocessing_exceptions(m).select("rel_path")


@query("a10_load_names", "SELECT DISTINCT p_name AS name FROM part")
def load_names(spark, sf):
    return src.clean_names(table(spark, sf, "part").select(F.concat(F.lit("  "), "p_name", F.lit("\t")).alias("value")))


@query("a11_custom_map", "SELECT c_name AS original, CASE WHEN c_custkey % 2 = 0 THEN 'a=' || c_mktsegment ELSE c_mktsegment END AS replacement FROM customer WHERE c_custkey % 3 <> 0")
def load_custom_map(spark, sf):
    k = F.col("c_custkey")
    line = (
        F.when(k % 3 == 0, F.concat(F.lit("# "), "c_name", F.lit("=x")))
        .when(k % 2 == 0, F.concat_ws(" = ", "c_name", F.concat(F.lit("a="), "c_mktsegment")))
        .otherwise(F.concat("c_name", F.lit("\t"), "c_mktsegment"))
    )
    return src.parse_custom_map(table(spark, sf, "customer").select(line.alias("value")))


@query("a12_rows_to_text", "SELECT c_custkey, c_custkey::VARCHAR || ' | ' || coalesce(c_name, '') || ' | ' || c_nationkey::VARCHAR || ' | ' || coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS line FROM customer")
def rows_to_text(spark, sf):
    c = table(spark, sf, "customer").withColumn("seg", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return c.select("c_custkey", src.rows_to_text(c, ["c_custkey", "c_name", "c_nationkey", "seg"]).alias("line"))


@query("a13_contracts", "SELECT o_orderkey, 'transcript' AS source, o_orderpriority AS text, o_totalprice AS confidence, o_orderstatus AS language, NULL::VARCHAR AS raw_text FROM orders")
def contracts(spark, sf):
    o = spread(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus"))
    js = F.to_json(F.struct(
        F.lit("transcript").alias("source"), F.col("o_orderpriority").alias("text"), F.col("o_totalprice").alias("confidence"),
        F.create_map(F.lit("language"), "o_orderstatus").alias("fields")))
    c = src.parse_contracts(o.select("o_orderkey", js.alias("json")))
    return c.select("o_orderkey", "source", "text", "confidence", F.col("fields")["language"].alias("language"), "raw_text")


@query("a14_playlist", """
SELECT account, id, title, CASE k WHEN 0 THEN url WHEN 1 THEN url WHEN 2 THEN 'web::' || page_id ELSE '#id=' || page_id END AS url FROM (
SELECT *, row_number() OVER (PARTITION BY account ORDER BY page_id) AS rn FROM (SELECT page_id, page_id::VARCHAR AS id, 'acc' || (page_id % 7) AS account, page_id % 5 AS k, 't' || page_id AS title, url FROM pages) WHERE k < 4) WHERE rn <= 20""")
def playlist(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    k, i = F.col("page_id") % 5, s("page_id")
    entry = F.to_json(F.struct(
        i.alias("id"), F.concat(F.lit("t"), i).alias("title"), F.when(k == 0, F.col("url")).alias("webpage_url"),
        F.when(k == 1, F.col("url")).alias("url"), F.when(k == 2, "web").alias("ie_key")))
    line = F.when(k == 4, F.lit("{broken")).otherwise(entry)
    rows = p.select(F.concat(F.lit("acc"), (F.col("page_id") % 7).cast("string")).alias("account"), F.col("page_id").alias("line_no"), line.alias("line"))
    return src.parse_playlist(rows, limit=20).drop("line_no")


_URL = "url || CASE page_id % 6 WHEN 0 THEN '/playlist' WHEN 1 THEN '?u=youtube.com/@x' WHEN 2 THEN '#b23.tv/' WHEN 3 THEN '#v.douyin.com/' WHEN 4 THEN '#xhslink.com/' ELSE '' END"


@query("a15_account_platform", f"""
SELECT page_id, CASE WHEN contains(u, 'v.douyin.com/') THEN 'douyin' WHEN contains(u, 'xhslink.com/') THEN 'xiaohongshu' WHEN contains(u, 'b23.tv/') THEN 'bilibili'
WHEN contains(u, 'youtube.com/@') THEN 'youtube_channel' WHEN contains(u, '/playlist') OR contains(u, 'list=') THEN 'playlist' END AS platform FROM (SELECT page_id, lower({_URL}) AS u FROM pages)""")
def account_platform(spark, sf):
    from palimpsest.functions.detection import account_platform as platform

    tail = F.element_at(F.array(*[F.lit(x) for x in ("/playlist", "?u=youtube.com/@x", "#b23.tv/", "#v.douyin.com/", "#xhslink.com/", "")]),
                        (F.col("page_id") % 6 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", platform(F.concat("url", tail)).alias("platform"))


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(lower(html), {Q.lit(w)})" for w in words) + ")"


@query("a16_failure_class", f"SELECT page_id, {_has(P.DRM_WORDS)} AS drm, {_has(P.LOGIN_WORDS)} AS login FROM pages")
def failure_class(spark, sf):
    from palimpsest.functions.detection import failure_class as classes

    drm, login = classes(F.col("html"))
    return spread(table(spark, sf, "pages").select("page_id", "html")).select("page_id", drm.alias("drm"), login.alias("login"))


@query("a18_merge_sections", "SELECT 1 AS section_no, n_nationkey AS row_no, n_name AS value FROM nation UNION ALL SELECT 2, r_regionkey, r_name FROM region")
def merge_sections(spark, sf):
    n = table(spark, sf, "nation").select(F.lit(1).alias("section_no"), F.col("n_nationkey").alias("row_no"), F.col("n_name").alias("value"))
    r = table(spark, sf, "region").select(F.lit(2).alias("section_no"), F.col("r_regionkey").alias("row_no"), F.col("r_name").alias("value"))
    return sinks.merge_sections([n, r])


def _events(spark, sf):
    """Events as time-stamped segments of one stream per user."""
    e = table(spark, sf, "events")
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1e6
    return e.select("event_id", F.col("user_id").alias("stream"), F.col("event_type").alias("text"), start.alias("start"),
                    (start + F.col("value")).alias("end"), "value")


_SEG = "seg AS (SELECT event_id, user_id AS stream, event_type AS text, (epoch_us(ts) - 1704067200000000)::DOUBLE / 1000000.0::DOUBLE AS start, (epoch_us(ts) - 1704067200000000)::DOUBLE / 1000000.0::DOUBLE + value AS stop, value FROM events)"


def _srt(c: str) -> str:
    ms = f"round_even({c} * 1000, 0)::BIGINT"
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


@query("a19_to_srt", f"WITH {_SEG}, n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY start, stop) AS cue FROM seg) SELECT stream, cue, cue || chr(10) || {_srt('start')} || ' --> ' || {_srt('stop')} || chr(10) || text || chr(10) AS srt FROM n")
def to_srt(spark, sf):
    return transcript.to_srt(_events(spark, sf))


@query("a20_time_codes", """
SELECT l_orderkey, l_linenumber, CASE WHEN t >= 3600 THEN printf('[%02d:%02d:%02d]', t // 3600, t // 60 % 60, t % 60) ELSE printf('[%02d:%02d]', t // 60, t % 60) END AS code,
CASE WHEN l_extendedprice < 60 THEN printf('%d 秒', floor(l_extendedprice)::BIGINT) ELSE printf('%d 分 %d 秒', floor(l_extendedprice / 60)::BIGINT, floor(l_extendedprice % 60)::BIGINT) END AS duration
FROM (SELECT *, round_even(l_extendedprice, 0)::BIGINT AS t FROM lineitem)""")
def time_codes(spark, sf):
    p = F.col("l_extendedprice")
    return spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")).select(
        "l_orderkey", "l_linenumber", transcript.fmt_seconds(p).alias("code"), transcript.fmt_duration(p).alias("duration"))


# --- transcripts -----------------------------------------------------------------------
@query("e01_offset_segments", f"WITH {_SEG} SELECT event_id, round(start + stream * 10, 6) AS start, round(stop + stream * 10, 6) AS stop, round(start + stream * 10 + 1, 6) AS word_start FROM seg")
def offset_segments(spark, sf):
    words = F.array(F.struct(F.lit("w").alias("word"), (F.col("start") + 1).alias("start"), F.col("end").alias("end"), F.lit(0.5).alias("prob")))
    seg = _events(spark, sf).withColumn("words", words)
    out = transcript.offset_segments(seg, F.col("stream") * 10)
    return out.select("event_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("stop"), F.round(F.col("words")[0]["start"], 6).alias("word_start"))


@query("e02_mean_confidence", "SELECT l_orderkey, round_even(avg(l_linenumber / 8.0::DOUBLE), 3) AS confidence FROM lineitem GROUP BY l_orderkey")
def mean_confidence(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") / 8.0).alias("prob"))
    return transcript.mean_confidence(li, ["l_orderkey"])


def _parts(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("stream"), F.col("event_id").alias("part_no"), F.col("value").alias("duration"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.when(F.col("event_type") != "error", F.col("event_id") % 8 / 8.0).alias("confidence"))


@query("e03_merge_parts", "SELECT user_id AS stream, event_id AS part_no, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS \"offset\" FROM events")
def merge_parts(spark, sf):
    return transcript.merge_parts(_parts(spark, sf), width=1000)[0].select("stream", "part_no", F.round("offset", 4).alias("offset"))


@query("e03_merged_streams", "SELECT user_id AS stream, count(*) AS n_parts, round(sum(value), 4) AS duration, round(avg(CASE WHEN event_type <> 'error' THEN event_id % 8 / 8.0::DOUBLE END), 6) AS confidence, coalesce(min(CASE WHEN event_type <> 'error' THEN event_id END), min(event_id)) AS base_part FROM events GROUP BY user_id")
def merged_streams(spark, sf):
    m = transcript.merge_parts(_parts(spark, sf))[1]
    return m.withColumns({"duration": F.round("duration", 4), "confidence": F.round("confidence", 6)})


@query("e04_quality_tier", """
SELECT l_orderkey, l_linenumber, CASE WHEN c IS NULL THEN 'unknown' WHEN c < 0.5 THEN 'low' WHEN c < CASE WHEN l_linestatus = 'O' THEN 0.75 ELSE 0.85 END THEN 'medium' ELSE 'high' END AS tier
FROM (SELECT *, CASE WHEN l_returnflag <> 'R' THEN l_quantity / 50 END AS c FROM lineitem)""")
def quality_tier(spark, sf):
    c = F.when(F.col("l_returnflag") != "R", F.col("l_quantity") / 50)
    kind = F.when(F.col("l_linestatus") == "O", "transcript").otherwise("ocr")
    return spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_linestatus")).select(
        "l_orderkey", "l_linenumber", transcript.quality_tier(kind, c).alias("tier"))


@query("e05_confidence_gate", "SELECT l_orderkey, count(*) AS num_boxes, round_even(avg(l_linenumber / 8.0::DOUBLE), 3) AS avg_confidence, round_even(avg(l_linenumber / 8.0::DOUBLE), 3) < 0.5 AS suggest_upgrade FROM lineitem GROUP BY l_orderkey")
def confidence_gate(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") / 8.0).alias("score"))
    return transcript.confidence_gate(li, ["l_orderkey"], 0.5)


def _order_lines(spark, sf):
    """Line items with a number that is unique inside their order."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    order = ["l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]
    return number_rows(li, ["l_orderkey"], "l_partkey", order, "idx", 1_000_000)


_OL = "ol AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS idx FROM lineitem)"


def _segments(spark, sf, corrected: bool):
    """One document per order, one segment per line; corrections touch some of them."""
    li = _order_lines(spark, sf)
    raw = F.concat(F.lit("part "), s("l_partkey"), F.lit(" flag "), "l_returnflag")
    k = F.col("l_partkey") % 4
    fixed = F.when(k == 0, F.concat(F.lit("part "), s("l_partkey"), F.lit("1 flag "), "l_returnflag")).when(
        k == 1, F.replace(raw, F.lit("part"), F.lit("port"))).when(k == 2, F.concat(raw, F.lit(" as revised"))).otherwise(raw)
    rows = li.select(F.col("l_orderkey").alias("doc_id"), "idx", (fixed if corrected else raw).alias("text"))
    return rows.where(~((F.col("doc_id") % 5 == 0) & (F.col("idx") == 1))) if corrected else rows


_SEGS = _OL + """, raw AS (SELECT l_orderkey AS doc_id, idx, l_partkey % 4 AS k, 'part ' || l_partkey || ' flag ' || l_returnflag AS text, 'part ' || l_partkey || '1 flag ' || l_returnflag AS t0 FROM ol),
cor AS (SELECT doc_id, idx, CASE k WHEN 0 THEN t0 WHEN 1 THEN replace(text, 'part', 'port') WHEN 2 THEN text || ' as revised' ELSE text END AS text FROM raw WHERE NOT (doc_id % 5 = 0 AND idx = 1)),
ent AS (SELECT r.doc_id, r.idx, r.text AS raw, c.text AS corrected, CASE k WHEN 0 THEN '数字/单位规范' WHEN 1 THEN '同音/形近误识' ELSE '修订' END AS kind FROM raw r JOIN cor c USING (doc_id, idx) WHERE r.text <> c.text)"""


@query("e06_correction_entries", f"WITH {_SEGS} SELECT * FROM ent")
def correction_entries(spark, sf):
    return transcript.correction_entries(_segments(spark, sf, False), _segments(spark, sf, True))


@query("e07_correction_notes", f"WITH {_SEGS}, p AS (SELECT doc_id, kind, count(*) AS n, min(idx) AS f FROM ent GROUP BY ALL) SELECT doc_id, '共纠正 ' || sum(n) || ' 处：' || string_agg(kind || ' ' || n || ' 处', '、' ORDER BY f) AS notes FROM p GROUP BY doc_id")
def correction_notes(spark, sf):
    return transcript.correction_notes(transcript.correction_entries(_segments(spark, sf, False), _segments(spark, sf, True)))


@query("e08_apply_corrections", f"""WITH {_SEGS}, ok AS (SELECT doc_id FROM (SELECT doc_id, count(*) AS n FROM raw GROUP BY 1) JOIN (SELECT doc_id, count(*) AS n FROM cor GROUP BY 1) USING (doc_id, n))
SELECT r.doc_id, r.idx, coalesce(c.text, r.text) AS text, r.text AS raw_text, c.text IS NOT NULL AS applied FROM raw r LEFT JOIN (SELECT * FROM cor WHERE doc_id IN (SELECT doc_id FROM ok)) c USING (doc_id, idx)""")
def apply_corrections(spark, sf):
    return transcript.apply_corrections(_segments(spark, sf, False), _segments(spark, sf, True))


@query("e09_referenced_points", f"WITH {_SEG} SELECT event_id, round((start + stop) / 2, 2) AS timestamp FROM seg WHERE text = 'view'")
def referenced_points(spark, sf):
    seg = _events(spark, sf).withColumn("text", F.when(F.col("text") == "view", "As shown in this Figure").otherwise(F.col("text")))
    return transcript.referenced_points(seg).select("event_id", F.round((F.col("start") + F.col("end")) / 2, 2).alias("timestamp"))


@query("e10_silence_split", """
WITH f AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value AS rms FROM events),
q AS (SELECT *, rms / max(rms) OVER (PARTITION BY stream) < 0.25 AS quiet, count(*) OVER (PARTITION BY stream) AS n FROM f),
g AS (SELECT *, i - row_number() OVER (PARTITION BY stream, quiet ORDER BY i) AS grp FROM q),
runs AS (SELECT stream, min(i) AS a, count(*) AS run FROM g WHERE quiet GROUP BY stream, grp HAVING count(*) >= 2),
cuts AS (SELECT stream, a + run // 2 AS c FROM runs),
b AS (SELECT stream, c AS s FROM cuts UNION ALL SELECT DISTINCT stream, 0 FROM f),
p AS (SELECT b.stream, s, coalesce(lead(s) OVER (PARTITION BY b.stream ORDER BY s), n) AS e FROM b JOIN (SELECT DISTINCT stream, n FROM q) USING (stream)),
o AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY s, e) AS k FROM p),
m AS (SELECT *, sum(CASE WHEN k = 1 OR e - s >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY k) AS piece FROM o)
SELECT stream, piece, min(s) AS first_frame, max(e) AS end_frame FROM m GROUP BY stream, piece""")
def silence_split(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("stream"), "event_id", F.col("value").alias("rms"))
    frames = number_rows(e, ["stream"], "event_id", ["event_id"], "frame_idx", 1000).withColumn("frame_idx", F.col("frame_idx") - 1)
    return transcript.silence_split(frames, share=0.25, silence_frames=2, piece_frames=5, block=50)


_BITS = "list_reduce(list_prepend(0::HUGEINT, list_transform(embedding[1:64], lambda v: (v > 0)::INT::HUGEINT)), lambda a, b: a * 2 + b)"


@query("e11_keyframes", f"""
WITH RECURSIVE h AS (SELECT label AS stream, vec_id::DOUBLE AS t, {_BITS} AS hash, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
w AS (SELECT DISTINCT stream, 0::BIGINT AS i, 0::BIGINT AS taken, NULL::HUGEINT AS last, NULL::HUGEINT AS key, 0::BIGINT AS ordinal, NULL::DOUBLE AS t, NULL::HUGEINT AS hash, false AS keep FROM h
UNION ALL SELECT stream, i, taken + due::INT, CASE WHEN due THEN hash ELSE last END, CASE WHEN keep THEN hash ELSE key END, ordinal + keep::INT, t, hash, keep FROM (SELECT h.stream, h.i, w.taken, w.last, w.key, w.ordinal, h.t, h.hash,
  h.t >= w.taken * 2.0::DOUBLE AS due, h.t >= w.taken * 2.0::DOUBLE AND (w.last IS NULL OR bit_count(xor(h.hash, w.last)) > 8) AND (w.key IS NULL OR bit_count(xor(h.hash, w.key)) > 20) AS keep
  FROM w JOIN h ON h.stream = w.stream AND h.i = w.i + 1))
SELECT stream, t, (CASE WHEN hash >= 9223372036854775808 THEN hash - 18446744073709551616 ELSE hash END)::BIGINT AS hash, ordinal FROM w WHERE keep""")
def keyframes(spark, sf):
    """Sign bits of the first 64 vector components as the picture hash, one stream per label."""
    bits = F.slice("embedding", 1, 64)
    value = F.aggregate(bits, F.lit(0).cast("long"), lambda acc, v: F.shiftleft(acc, 1) + F.when(v > 0, 1).otherwise(0))
    e = table(spark, sf, "embeddings").select(F.col("label").alias("stream"), F.col("vec_id").cast("double").alias("t"), value.alias("hash"))
    return transcript.keyframes(e, interval=2.0, scene_bits=8, key_bits=20, block=100.0)


@query("e12_batch_report", "SELECT o_orderpriority AS account, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT NULL, NULL, count(*) FROM orders")
def batch_report(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("account"), F.col("o_orderstatus").alias("status"))
    return transcript.batch_report(o)


@query("e12_first_titles", "SELECT o_custkey AS account, count(*) AS n, array_to_string((list(o_orderkey ORDER BY o_orderkey))[:20], ',') AS titles FROM orders GROUP BY o_custkey")
def first_titles(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("id"), s("o_orderkey").alias("title"))
    return transcript.first_titles(o).withColumn("titles", F.array_join("titles", ","))


_KEY = "sha256(text) || ':' || sha256('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}')"


def _keyed(spark, sf):
    d = documents(spark, sf, "doc_id", "lang", "source", "text")
    opts = {"lang": F.col("lang"), "source": F.col("source"), "out_dir": F.lit("/tmp/x")}
    return d.select("doc_id", "lang", transcript.cache_key(F.col("text").cast("binary"), opts).alias("cache_key"))


@query("e13_cache_key", f"SELECT doc_id, {_KEY} AS cache_key FROM documents")
def cache_key(spark, sf):
    return _keyed(spark, sf).select("doc_id", "cache_key")


@query("e14_incremental", f"SELECT doc_id FROM documents WHERE {_KEY} NOT IN (SELECT {_KEY} FROM documents WHERE lang = 'en')")
def incremental(spark, sf):
    k = _keyed(spark, sf)
    return transcript.incremental(k, k.where("lang = 'en'").select("cache_key").distinct())[1].select("doc_id")


@query("e15_hints", "SELECT doc_id, CASE lang WHEN 'en' THEN 'en' WHEN 'fr' THEN 'fr' WHEN 'de' THEN 'de' ELSE 'es' END AS language, CASE WHEN doc_id % 2 = 0 THEN 'translate' ELSE 'transcribe' END AS task FROM documents")
def hints(spark, sf):
    full = F.when(F.col("lang") == "en", "英语").when(F.col("lang") == "fr", "法语").when(F.col("lang") == "de", "德语").otherwise("西班牙语")
    t = F.concat(full, F.when(F.col("doc_id") % 2 == 0, "翻译").otherwise("转写"))
    return table(spark, sf, "documents").select("doc_id", transcript.language_hint(t).alias("language"), transcript.task_hint(t).alias("task"))


@query("e16_boxes_to_text", f"WITH {_OL} SELECT l_orderkey, string_agg(l_returnflag || l_linenumber, chr(10) ORDER BY idx) AS text FROM ol GROUP BY l_orderkey")
def boxes_to_text(spark, sf):
    li = _order_lines(spark, sf).select("l_orderkey", F.col("idx").alias("box_no"), F.concat("l_returnflag", s("l_linenumber")).alias("text"))
    return transcript.boxes_to_text(li, ["l_orderkey"])


# --- content pack ------------------------------------------------------------------------
def _named(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    n = F.col("o_custkey") % 12
    name = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("讲义"), s("o_orderkey"), F.lit(".md"))).otherwise(
        F.concat(F.lit("第"), F.when(F.col("o_orderkey") % 2 == 0, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string")), F.lit("节_"), s("o_orderkey"), F.lit(".md")))
    return o.select("o_orderkey", name.alias("name"))


_NAME = "CASE WHEN o_orderstatus = 'F' THEN '讲义' || o_orderkey || '.md' ELSE '第' || CASE WHEN o_orderkey % 2 = 0 THEN lpad((o_custkey % 12)::VARCHAR, 2, '0') ELSE (o_custkey % 12)::VARCHAR END || '节_' || o_orderkey || '.md' END"


@query("f01_chapter_key", f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '' ELSE (o_custkey % 12)::VARCHAR END AS chapter, CASE WHEN o_orderstatus = 'F' THEN {_NAME} || '_' ELSE '第' || lpad((o_custkey % 12)::VARCHAR, 2, '0') || '节_' END AS prefix FROM orders")
def chapter_key(spark, sf):
    return _named(spark, sf).select("o_orderkey", pack.chapter_number(F.col("name")).alias("chapter"), pack.section_prefix(F.col("name")).alias("prefix"))


@query("f02_section_files", f"SELECT CASE WHEN o_orderstatus = 'F' THEN NULL ELSE '第' || (o_custkey % 12) || '章' END AS section, {_NAME} AS name FROM orders")
def section_files(spark, sf):
    n = _named(spark, sf)
    sections = table(spark, sf, "orders").select(F.concat(F.lit("第"), (F.col("o_custkey") % 12).cast("string"), F.lit("章")).alias("section")).distinct()
    return pack.section_files(n.select("name"), sections)


@query("f03_keyword_tokens", "SELECT item_id, array_to_string(list_filter(list_transform(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]{2,}|[A-Za-z][A-Za-z0-9_&+.-]{1,}'), lambda t: trim(t, '、，。：；！？·()（）【】[]《》\"''')), lambda t: length(t) >= 2), ' ') AS tokens FROM benchmark")
def kw_tokens(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(pack.kw_tokens(F.col("text")), " ").alias("tokens"))


@query("f04_keyword_hit", "SELECT p_partkey, contains(p_type, w) OR (length(w) >= 5 AND len(list_filter(range(1, length(w) - 1), lambda i: contains(p_type, substr(w, i, 3)))) > 0) AS hit FROM (SELECT p_partkey, p_type, p_name AS w FROM part)")
def kw_hit(spark, sf):
    return table(spark, sf, "part").select("p_partkey", pack.kw_hit(F.col("p_name"), F.col("p_type")).alias("hit"))


@query("f05_ocr_lines", "SELECT doc_id, len(list_filter(list_transform(CASE WHEN contains(text, chr(10)) THEN string_split(text, chr(10)) ELSE string_split(text, ' | ') END, lambda x: trim(x)), lambda x: x <> ''))::BIGINT AS n FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE replace(replace(text, chr(10), ' | '), chr(13), '') END AS text FROM documents)")
def ocr_lines(spark, sf):
    t = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.replace(F.replace("text", F.lit("\n"), F.lit(" | ")), F.lit("\r"), F.lit("")))
    return documents(spark, sf, "doc_id", "text").select("doc_id", F.size(pack.ocr_lines(t)).cast("long").alias("n"))


def _markdown(spark, sf):
    """One Markdown transcript per order: a heading per flag, an anchor and an image per line item."""
    li = _order_lines(spark, sf)
    q = F.col("l_quantity").cast("int")
    stamp = F.format_string("%02d:%02d", F.col("l_linenumber"), q % 60)
    anchor = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("▶ **"), stamp, F.lit("** part "), s("l_partkey"))).otherwise(
        F.concat(F.lit("["), stamp, F.lit("] part "), s("l_partkey")))
    img = F.when(q % 3 == 0, F.concat(F.lit("\n![p](img/"), s("l_partkey"), F.lit(".png)"))).otherwise("")
    body = F.concat(F.lit("### "), "l_returnflag", F.lit("\n"), anchor, F.lit("\n"), F.repeat(F.lit("word "), q), img)
    ordered = F.array_sort(F.collect_list(F.struct("idx", body.alias("b"))))
    return li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n").alias("text"))


_MD = _OL + """, li AS (SELECT *, idx AS k, l_quantity::INT AS q, count(*) FILTER (l_quantity::INT % 3 = 0)
 OVER (PARTITION BY l_orderkey ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS imgs FROM ol)"""


@query("f06_parse_anchors", f"WITH {_MD} SELECT l_orderkey AS doc_id, (3 * (k - 1) + imgs + 2)::INT AS line_no, CASE WHEN l_orderkey % 2 = 0 THEN 'arrow' ELSE 'ts' END AS mode, l_linenumber * 60 + q % 60 AS time_sec, printf('%02d:%02d', l_linenumber, q % 60) AS timecode, l_returnflag AS heading, 'part ' || l_partkey AS body FROM li")
def parse_anchors(spark, sf):
    return pack.parse_anchors(_markdown(spark, sf))


@query("f07_frame_index", "SELECT event_id, printf('frame_%04d_%02d.png', event_id // 50, event_id * 2 % 100) AS name, round(event_id / 50.0::DOUBLE, 2) AS ts, CASE WHEN event_type = 'view' THEN 'seg ' || event_id ELSE '' END AS segment_text FROM events")
def frame_index(spark, sf):
    e = table(spark, sf, "events")
    f = e.select("event_id", F.lit("v").alias("stem"), F.format_string("frame_%04d_%02d.png", F.floor(F.col("event_id") / 50), F.col("event_id") * 2 % 100).alias("name"))
    seg = e.where("event_type = 'view'").select(F.lit("v").alias("stem"), (F.col("event_id") / 50.0).alias("timestamp"), F.col("event_id").alias("segment_no"),
                                                F.concat(F.lit("seg "), s("event_id")).alias("segment_text"))
    return pack.frame_index(f, seg).select("event_id", "name", F.round("ts", 2).alias("ts"), "segment_text")


def signatures(spark, sf):
    """Vectors as 8-bit picture signatures, one section per label."""
    sig = F.transform("embedding", lambda v: F.floor((v + 1) * 127.5).cast("int"))
    return table(spark, sf, "embeddings").select(F.col("label").alias("section"), F.col("vec_id").alias("frame_id"), sig.alias("sig"))


_MAD = "(list_sum(list_transform(list_zip(x.sig, s.sig), lambda z: abs(z[1] - z[2])))::DOUBLE / len(s.sig))"


@query("f08_dedup_frames", f"""
WITH RECURSIVE s AS (SELECT label AS section, vec_id AS frame_id, list_transform(embedding, lambda v: floor((v + 1) * 127.5)::INT) AS sig, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
w AS (SELECT DISTINCT section, 0::BIGINT AS i, NULL::BIGINT AS frame_id, []::STRUCT(id BIGINT, sig INT[])[] AS kept, []::STRUCT(mad DOUBLE, id BIGINT)[] AS near FROM s
UNION ALL SELECT section, i, frame_id, CASE WHEN len(near) = 0 THEN list_append(kept, {{'id': frame_id, 'sig': sig}}) ELSE kept END, near FROM (SELECT s.section, s.i, s.frame_id, s.sig, w.kept,
  list_sort(list_filter(list_transform(w.kept, lambda x: {{'mad': {_MAD}, 'id': x.id}}), lambda y: y.mad <= 8)) AS near FROM w JOIN s ON s.section = w.section AND s.i = w.i + 1))
SELECT section, frame_id, len(near) = 0 AS selected, near[1].id AS dup_of, round_even(near[1].mad, 2) AS dup_mad FROM w WHERE i > 0""")
def dedup_frames(spark, sf):
    return pack.dedup_frames(signatures(spark, sf), threshold=8.0)


def _slides(spark, sf):
    k = F.col("o_custkey") % 6
    text = F.when(k == 0, "课程目录\na\nb").when(k == 1, "本节总结").when(k == 2, "讲师 张").when(k == 3, "ok").when(
        k == 4, "line one\nline two\nline three\nand a fourth").otherwise(F.repeat(F.lit("long knowledge text "), 20))
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", text.alias("ocr_text"), F.lit(None).cast("int").alias("num_boxes"),
                                             (F.col("o_orderkey") % 4 / 10.0).alias("ink"))


_SLIDE = """sl AS (SELECT o_orderkey, o_orderstatus, CASE o_custkey % 6 WHEN 0 THEN 'toc' WHEN 1 THEN 'summary' WHEN 2 THEN 'cover' WHEN 3 THEN 'transition' WHEN 4 THEN 'item_list' ELSE '' END AS subtype,
CASE WHEN o_custkey % 6 < 5 AND o_orderkey % 4 / 10.0 <= 0.12 THEN 'text_only' ELSE 'knowledge' END AS kind FROM orders)"""


@query("f09_classify_slides", f"WITH {_SLIDE} SELECT o_orderkey, subtype, kind FROM sl")
def classify_slides(spark, sf):
    return pack.classify_slides(_slides(spark, sf)).select("o_orderkey", "subtype", "kind")


@query("f10_slide_stats", f"WITH {_SLIDE} SELECT o_orderstatus, kind, count(*) AS n FROM sl GROUP BY ALL")
def slide_stats(spark, sf):
    return pack.slide_stats(pack.classify_slides(_slides(spark, sf)), ["o_orderstatus"])


def _anchor_inputs(spark, sf):
    e = _events(spark, sf)
    heads = F.when(F.col("event_id") % 3 == 0, "开场").when(F.col("event_id") % 3 == 1, "error report").otherwise("")
    a = e.where("text = 'purchase'").select(F.col("stream").alias("section"), F.col("event_id").alias("line_no"), F.col("start").alias("time_sec"),
                                            heads.alias("heading"), F.lit("click here").alias("body"), F.lit("arrow").alias("mode"))
    f = e.where("text IN ('view', 'click', 'error')").select(F.col("stream").alias("section"), F.col("event_id").alias("frame_id"), F.col("start").alias("ts"),
                                                             F.col("text").alias("ocr_text"))
    return a, f


@query("f11_anchor_check", f"""
WITH {_SEG}, a AS (SELECT *, CASE event_id % 3 WHEN 0 THEN '开场' WHEN 1 THEN 'error report' ELSE '' END AS heading FROM seg WHERE text = 'purchase'),
f AS (SELECT * FROM seg WHERE text IN ('view', 'click', 'error')),
c AS (SELECT a.stream, a.event_id AS line_no, f.event_id AS frame_id, CASE a.event_id % 3 WHEN 1 THEN (f.text = 'error')::INT WHEN 0 THEN 0 ELSE (f.text = 'click')::INT END AS score, (f.text = 'click')::INT AS alt,
 abs(round_even(f.start - a.start, 1)) AS near FROM a JOIN f USING (stream) WHERE abs(f.start - a.start) <= 3600),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream, line_no ORDER BY score DESC, alt DESC, near, frame_id) AS r FROM c) WHERE r = 1)
SELECT a.stream AS section, a.event_id AS line_no, CASE WHEN b.score >= 1 OR b.alt >= 1 THEN 'ok' WHEN a.event_id % 3 <> 1 THEN 'indeterminate' WHEN b.frame_id IS NOT NULL THEN 'drift' ELSE 'no_frame' END AS status,
b.frame_id AS best_frame FROM a LEFT JOIN b ON b.stream = a.stream AND b.line_no = a.event_id""")
def anchor_check(spark, sf):
    a, f = _anchor_inputs(spark, sf)
    return pack.anchor_check(a, f, window=3600.0).select("section", "line_no", "status", "best_frame")


def _shots(spark, sf):
    k = F.col("p_partkey") % 5
    n, i = (F.col("p_partkey") % 20 + 1).cast("string"), (F.col("p_size") % 30 + 1).cast("string")
    n2, i2 = F.lpad(n, 2, "0"), F.when(F.col("p_partkey") % 7 == 0, F.lpad(i, 3, "0")).otherwise(F.lpad(i, 2, "0"))
    name = (
        F.when(k == 0, F.concat(F.lit("第"), n2, F.lit("节_图"), i2, F.lit("_用光.png")))
        .when(k == 1, F.concat(F.lit("第"), n2, F.lit("节_图"), i2, F.lit("_light.jpg")))
        .when(k == 2, F.concat(F.lit("第7节_图3_光 线.png"))).when(k == 3, F.lit("a:b.png"))
        .otherwise(F.concat(F.lit("第"), n2, F.lit("节_图"), i2, F.lit("_构图 法.jpeg")))
    )
    return table(spark, sf, "part").select("p_partkey", "p_brand", name.alias("name"), F.col("p_type").alias("anchor_para"),
                                           F.when(k == 0, "___").when(k == 1, F.concat(F.lit("LIGHT light "), "p_type")).otherwise("unrelated words").alias("ocr_text"))


_ISSUES = "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'no_chinese' WHEN 2 THEN 'pattern,zero_padding,spaces' WHEN 3 THEN 'pattern,special_chars' ELSE 'spaces' END"


@query("f12_name_rules", f"SELECT p_partkey, p_partkey % 5 NOT IN (2, 3) AS pattern_ok, {_ISSUES} AS issues FROM part")
def name_rules(spark, sf):
    r = pack.name_rules(_shots(spark, sf))
    return r.select("p_partkey", "pattern_ok", F.array_join("issues", ",").alias("issues"))


@query("f12_padding", "SELECT p_brand, count(DISTINCT CASE WHEN p_partkey % 7 = 0 THEN 3 ELSE 2 END) > 1 AS pad_inconsistent FROM part WHERE p_partkey % 5 NOT IN (2, 3) GROUP BY p_brand")
def padding(spark, sf):
    return pack.padding_consistency(pack.name_rules(_shots(spark, sf)), ["p_brand"])


@query("f13_name_match", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'unverifiable' WHEN 1 THEN 'ok' ELSE 'mismatch' END AS verdict FROM part")
def name_match(spark, sf):
    return pack.name_match(pack.name_rules(_shots(spark, sf))).select("p_partkey", "verdict")


def _plan(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    start = F.col("o_custkey").cast("double")
    return o.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit("clip"), s("o_orderkey"))).alias("name"), s("o_custkey").alias("hash"),
        start.alias("start"), F.when(F.col("o_orderkey") % 13 == 0, start).otherwise(start + F.col("o_totalprice") / 1000).alias("end"))


@query("f14_validate_intervals", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'missing_name' ELSE 'empty_interval' END AS problem FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0")
def validate_intervals(spark, sf):
    return pack.validate_intervals(_plan(spark, sf)).select("o_orderkey", "problem")


@query("f15_plan_delta", "SELECT o_orderkey, o_orderkey % 11 <> 0 AND o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 AS reused FROM orders")
def plan_delta(spark, sf):
    p = _plan(spark, sf)
    shift = F.when(F.col("o_orderkey") % 4 == 0, 0.5).otherwise(0.001)
    done = p.where("o_orderkey % 3 = 0").select("name", "hash", (F.col("start") + shift).alias("start"), "end")
    return pack.plan_delta(p, done).select("o_orderkey", "reused")


@query("f16_clip_listing", "SELECT o_custkey AS section, 'clip' || o_orderkey AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS clip_no, floor(o_totalprice / 1000)::BIGINT AS duration FROM orders")
def clip_listing(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("section"), "o_orderkey", "o_totalprice")
    n = number_rows(o, ["section"], "o_orderkey", ["o_orderkey"], "clip_no", 10_000)
    return n.select("section", F.concat(F.lit("clip"), s("o_orderkey")).alias("name"), "clip_no", F.floor(F.col("o_totalprice") / 1000).alias("duration"))


_CLIPS = """c AS (SELECT o_custkey AS section, 'clip' || o_orderkey || '.mp4' AS filename, (o_orderkey % 97)::DOUBLE AS start, (o_orderkey % 97 + o_orderkey % 7)::DOUBLE AS stop,
  CASE WHEN o_orderkey % 3 = 0 THEN 'product ' || o_orderkey % 5 END AS product, o_orderkey % 2 = 0 AS has_copy FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY start, filename) AS no FROM c)"""


def _listing(spark, sf):
    key = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("section"), F.concat(F.lit("clip"), s("o_orderkey"), F.lit(".mp4")).alias("filename"), F.lit("out").alias("folder"),
        (key % 97).cast("double").alias("start"), (key % 97 + key % 7).cast("double").alias("end"), F.lit(None).cast("string").alias("transcript_title"), F.lit("even").alias("basis"),
        F.when(key % 3 == 0, F.concat(F.lit("product "), (key % 5).cast("string"))).alias("product_name"))
    return pack.clip_listing(o)


def _written(spark, rows, order):
    """The listing as the CSV file gives it back."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/listing-{uuid.uuid4().hex}"
    sinks.write_csv(rows, path, order)
    return spark.read.schema(rows.schema).option("header", True).option("nullValue", "\\N").option("emptyValue", "").csv(path)


@query("f16_clip_csv", f"""
WITH {_CLIPS} SELECT section AS "节次", section AS "节标题", no AS "段号", replace(filename, '.mp4', '') AS "段标题", '' AS "逐字稿对应标题", filename AS "文件名", 'out/' || filename AS "相对路径",
printf('%.2f', start) AS "起始", printf('%.2f', stop) AS "结束", printf('%.2f', stop - start) AS "时长_秒", 'even' AS "粒度来源" FROM n""")
def clip_csv(spark, sf):
    return _written(spark, pack.clip_rows(_listing(spark, sf)), ["节次", "段号"])


@query("f16_product_csv", f"""
WITH {_CLIPS}, f AS (SELECT DISTINCT section, section || '_' || product || '_文案.md' AS name FROM c WHERE has_copy AND product IS NOT NULL)
SELECT product AS "产品名", n.section AS "对应节次", no AS "段号", filename AS "视频文件", printf('%.2f', start) AS "起始", printf('%.2f', stop) AS "结束", printf('%.2f', stop - start) AS "时长_秒",
coalesce(f.name, '') AS "文案文件" FROM n LEFT JOIN f ON f.section = n.section AND f.name = n.section || '_' || product || '_文案.md' WHERE product IS NOT NULL""")
def product_csv(spark, sf):
    listing = _listing(spark, sf)
    there = listing.where("product_name is not null and cast(regexp_extract(filename, '[0-9]+', 0) as bigint) % 2 = 0").select(
        "section", F.concat_ws("_", F.col("section").cast("string"), "product_name", F.lit("文案.md")).alias("name"))
    return _written(spark, pack.product_rows(listing, there), ["对应节次", "段号"])


@query("f17_timeline", f"WITH {_SEG} SELECT stream AS section, CASE text WHEN 'purchase' THEN 1 ELSE 2 END AS part, start AS \"at\", text AS label FROM seg WHERE text IN ('purchase', 'view')")
def timeline(spark, sf):
    e = _events(spark, sf)
    a = e.where("text = 'purchase'").select(F.col("stream").alias("section"), F.col("start").alias("time_sec"), F.col("text").alias("heading"))
    c = e.where("text = 'view'").select(F.col("stream").alias("section"), "start", F.col("text").alias("name"))
    return pack.timeline(a, c)


@query("f18_ref_integrity", """
SELECT 'missing' AS issue, ref FROM (SELECT DISTINCT 'img/' || l_partkey || '.png' AS ref FROM lineitem WHERE l_quantity::INT % 3 = 0) WHERE ref NOT IN (SELECT 'img/' || p_partkey || '.png' FROM part WHERE p_size % 5 <> 0)
UNION ALL SELECT 'orphan', ref FROM (SELECT 'img/' || p_partkey || '.png' AS ref FROM part WHERE p_size % 5 <> 0) WHERE ref NOT IN (SELECT 'img/' || l_partkey || '.png' FROM lineitem WHERE l_quantity::INT % 3 = 0)""")
def ref_integrity(spark, sf):
    refs = pack.image_refs(_markdown(spark, sf))
    disk = table(spark, sf, "part").where("p_size % 5 != 0").select(F.concat(F.lit("img/"), s("p_partkey"), F.lit(".png")).alias("path"))
    return pack.ref_integrity(refs, disk)


@query("f19_coverage_gaps", f"WITH {_MD}, x AS (SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN 2 + 5 + 4 ELSE 7 END AS dummy FROM li) SELECT l_orderkey AS doc_id, k::INT AS block, l_returnflag AS heading, (q * 4 + length(CASE WHEN l_orderkey % 2 = 0 THEN '▶**' || printf('%02d:%02d', l_linenumber, q % 60) || '**part' || l_partkey ELSE '[' || printf('%02d:%02d', l_linenumber, q % 60) || ']part' || l_partkey END))::BIGINT AS n_chars FROM x WHERE q % 3 <> 0 AND n_chars >= 100")
def coverage_gaps(spark, sf):
    return pack.coverage_gaps(_markdown(spark, sf), min_chars=100)


@query("f20_anchor_flow", "WITH s AS (SELECT l_orderkey % 50 AS section, l_orderkey, l_orderkey % 2 = 0 AS arrow, l_orderkey % 3 = 0 AS kept FROM lineitem) SELECT section, sum(arrow::INT)::BIGINT AS n_source, sum((arrow AND kept)::INT)::BIGINT AS n_delivered, sum(arrow::INT) = 0 OR sum((arrow AND kept)::INT) > 0 AS ok FROM s GROUP BY section")
def anchor_flow(spark, sf):
    md = _markdown(spark, sf).withColumn("section", F.col("doc_id") % 50)
    return pack.anchor_flow(md, md.where("doc_id % 3 = 0"))


@query("f21_count_agreement", "WITH k AS (SELECT o_custkey AS c, 'o' AS src FROM orders UNION ALL SELECT o_custkey, 'l' FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT c_custkey, 'c' FROM customer) SELECT c AS custkey, count(*) FILTER (src = 'o') AS n_orders, count(*) FILTER (src = 'l') AS n_lines, count(*) FILTER (src = 'c') AS n_customers, count(*) FILTER (src = 'o') = count(*) FILTER (src = 'l') AND count(*) FILTER (src = 'l') = count(*) FILTER (src = 'c') AS agree FROM k GROUP BY c")
def count_agreement(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(o, "o_orderkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"))
    return pack.count_agreement({"orders": o, "lines": li, "customers": c}, "custkey")


@query("f22_records_complete", "SELECT l_orderkey AS section, array_to_string(list_sort(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(list(DISTINCT l_returnflag), x))), ',') AS missing, count(DISTINCT l_returnflag) = 3 AS complete FROM lineitem GROUP BY l_orderkey")
def records_complete(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("section"), F.col("l_returnflag").alias("record"))
    return pack.records_complete(li, ["A", "N", "R"]).withColumn("missing", F.array_join("missing", ","))


@query("f23_index_vs_disk", "SELECT k AS custkey, issue FROM (SELECT DISTINCT c_custkey AS k, 'missing_on_disk' AS issue FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'not_in_index' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))")
def index_vs_disk(spark, sf):
    return pack.index_vs_disk(table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey")),
                              table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey")), "custkey")


@query("f24_duration_check", "SELECT l_orderkey, l_linenumber, off, tiny FROM (SELECT l_orderkey, l_linenumber, l_quantity > 0 AND abs(l_quantity - l_linenumber * 7) >= 5 AS off, l_extendedprice <= 2000 AS tiny FROM lineitem) WHERE off OR tiny")
def duration_check(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("measured"), (F.col("l_linenumber") * 7).alias("planned"), F.col("l_extendedprice").alias("size"))
    return pack.duration_check(li, tiny=2000).select("l_orderkey", "l_linenumber", "off", "tiny")


@query("f25_gate_summary", "SELECT l_suppkey AS section, count(*) AS checks, count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'O') AS failed, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS warned, count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'O') > 0 AS blocked FROM lineitem GROUP BY l_suppkey")
def gate_summary(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("section"), (F.col("l_returnflag") != "R").alias("ok"), F.when(F.col("l_linestatus") == "O", "soft").otherwise("hard").alias("level"))
    return pack.gate_summary(li)


@query("f26_consolidate", """
WITH x AS (SELECT o_orderpriority AS section, 1 AS docs, CASE WHEN o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' THEN o_custkey % 3 END AS verify_failed FROM orders)
SELECT section, sum(docs)::BIGINT AS docs, sum(verify_failed)::BIGINT AS verify_failed, count(*) FILTER (verify_failed IS NULL) AS n_unverified, 0 AS is_total FROM x GROUP BY section
UNION ALL SELECT NULL, sum(docs)::BIGINT, coalesce(sum(verify_failed), 0)::BIGINT, count(*) FILTER (verify_failed IS NULL), 1 FROM x""")
def consolidate(spark, sf):
    x = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("section"), F.lit(1).alias("docs"),
        F.when((F.col("o_orderstatus") != "P") & (F.col("o_orderpriority") != "5-LOW"), F.col("o_custkey") % 3).alias("verify_failed"))
    return pack.consolidate(x, sums=["docs"], nullable=["verify_failed"])


@query("f27_ref_count", "SELECT l_orderkey AS doc_id, count(DISTINCT l_partkey) AS n_refs FROM lineitem WHERE l_quantity::INT % 3 = 0 GROUP BY l_orderkey")
def ref_count(spark, sf):
    return pack.ref_count(pack.image_refs(_markdown(spark, sf)), ["doc_id"])


@query("f28_transcript_meta", "SELECT o_orderkey AS stem, coalesce(round_even(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END, 2), 0.0) AS duration_sec, CASE WHEN o_orderkey % 2 = 0 THEN 'zh' ELSE o_orderstatus END AS language, o_custkey AS segments_count, o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0) AS degraded FROM orders")
def transcript_meta(spark, sf):
    o = table(spark, sf, "orders")
    c = o.select(F.col("o_orderkey").alias("stem"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("duration_sec"),
                 F.when(F.col("o_orderkey") % 2 == 0, "zh").alias("detected_language"), F.col("o_orderstatus").alias("language"),
                 F.col("o_custkey").alias("segments_count"), F.lit(None).cast("double").alias("confidence"))
    raw = o.where("o_custkey % 4 = 0").select(F.col("o_orderkey").alias("stem"))
    return pack.transcript_meta(c, raw).drop("confidence")


# --- registry ------------------------------------------------------------------------------
def _claims(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("capability"), F.col("l_suppkey").alias("component"))


@query("g01_overlaps", "SELECT l_partkey AS capability, count(DISTINCT l_suppkey) AS n_owners FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def overlaps(spark, sf):
    return registry.overlaps(_claims(spark, sf))


@query("g02_shares_with", "WITH c AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem) SELECT x.s AS a, y.s AS b, count(*) AS n_shared FROM c x JOIN c y ON x.p = y.p AND x.s <> y.s GROUP BY ALL")
def shares_with(spark, sf):
    return registry.shares_with(_claims(spark, sf), width=8)


@query("g03_version_key", "SELECT p_partkey, array_to_string([p_size % 4, 0, p_partkey % 9], '.') AS parts FROM part")
def version_key(spark, sf):
    v = F.concat((F.col("p_size") % 4).cast("string"), F.lit(".x."), (F.col("p_partkey") % 9).cast("string"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(registry.version_key(v).cast("array<string>"), ".").alias("parts"))


@query("g04_fingerprint_changes", f"WITH {Q.CORPUS} SELECT rel_path AS path, CASE WHEN doc_id % 10 = 0 THEN 'added' WHEN doc_id % 10 = 1 THEN 'removed' WHEN doc_id % 10 = 2 AND length(text) > 0 THEN 'changed' ELSE 'same' END AS change FROM corpus")
def fingerprint_changes(spark, sf):
    c = corpus(spark, sf).select("doc_id", F.col("rel_path").alias("path"), F.col("text").alias("content"))
    old = registry.fingerprints(c.where("doc_id % 10 != 0"))
    new = registry.fingerprints(c.where("doc_id % 10 != 1").withColumn(
        "content", F.when(F.col("doc_id") % 10 == 2, F.concat("content", F.lit("!"))).otherwise(F.col("content"))))
    return registry.fingerprint_changes(old, new)
