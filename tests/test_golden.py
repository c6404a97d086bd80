"""Hand-written rows, above all for text the supplied tables do not hold."""

from pyspark.sql import functions as F

from palimpsest.functions import detection as X
from palimpsest.functions import masking
from palimpsest.operators import deident, detect, pack, registry, similarity, structure, summaries, transcript
from palimpsest.sources import corpus as src


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def hits(spark, text, **options):
    passed = deident.scan_pass(docs(spark, text), "mask", **options)
    return [(r.kind, r.original, r.replacement) for r in deident.explode_hits(passed).orderBy("pass", "seq").collect()]


SAMPLE = "员工: 张伟 / 身份证: 110101199001011234 / 手机: 13800138000 / 工资卡: 6222021234567890123 / 邮箱: zhangwei@example.com"


def test_sample_round_trip(spark):
    for text in (SAMPLE, SAMPLE.replace(" / ", "\r\n"), SAMPLE.replace(" / ", "\n")):
        copies, found = deident.desensitize(docs(spark, text), "hybrid", names=["张伟"])
        copy = copies.first().text
        assert "110101199001011234" not in copy and "⟦T" in copy and "张*⟦T0001⟧" in copy
        assert deident.restore(copies, found)[0].first().text == text


def test_masks(spark):
    got = {k: (o, r) for k, o, r in hits(spark, SAMPLE, names=["张伟"])}
    assert got["id_card"] == ("110101199001011234", "110101********1234")
    assert got["phone"] == ("13800138000", "138****8000")
    assert got["bank_card"][1] == "*" * 15 + "0123"
    assert got["email"][1] == "z***@example.com"
    assert got["name"][1] == "张*"


def test_boundaries(spark):
    assert [h[0] for h in hits(spark, "手机13800138000，a13800138000 138001380009 ")] == ["phone"]


def test_cross_border_checks(spark):
    text = "SG123456789 MY987654321 TH555444333 WEBHOOK_CALLBACK_IP DE123456789 DEUTDEFF GB82WEST12345698765432 GB83WEST12345698765432"
    assert [(k, o) for k, o, _ in hits(spark, text)] == [
        ("iban", "GB82WEST12345698765432"), ("swift", "DEUTDEFF"), ("vat", "DE123456789")]


def test_marks_plate_passport_jwt_phone(spark):
    text = "【机密】 ★★绝密 密级：秘密 （内参） 内部编号： 京A12345 E12345678 eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK +86 138 0013 8003 "
    kinds = [h[0] for h in hits(spark, text)]
    assert kinds.count("state_secret") == 3 and kinds.count("internal_mark") == 2
    assert {"plate", "passport", "jwt", "intl_phone"} <= set(kinds)


def test_full_width_digits(spark):
    assert hits(spark, "手机：１３８００１３８０００")[0][:2] == ("phone", "13800138000")


def test_addresses(spark):
    found = [h for h in hits(spark, "中关村大街1号 广东省深圳市南山区 北京市朝阳区 技术路线", cn=True) if h[0] == "cn_address"]
    assert [h[1] for h in found] == ["中关村大街1号", "广东省深圳市南山区", "北京市朝阳区"]


def test_names_in_context(spark):
    assert ("cn_name", "张伟", "张*") in hits(spark, "联系人张伟", cn=True)
    assert not [h for h in hits(spark, "高兴地说", cn=True) if h[0] == "cn_name"]


def test_rare_characters_hide_the_whole_name(spark):
    row = spark.range(1).select(masking.mask_expr("name", F.lit("㐀明")), masking.mask_expr("name", F.lit("John Smith"))).first()
    assert tuple(row) == ("**", "J*** S****")


def test_messy_data_is_counted_not_masked(spark):
    text = "138-0013-8004 138 0013 8002 +86 138 0013 8003 1380013800 订单号：1234567890123456"
    n = {r.advice: r.n for r in detect.cleaning_report(docs(spark, text)).collect()}
    assert n["messy_phone_sep"] == 3 and n["messy_phone_short"] == 1 and n["messy_order_like"] == 1


def test_table_headers(spark):
    names = ["BuyerName", "姓名", "Consignee_Name", " Customer ", "BuyerPhone", "ShippingAddress", "", "item"]
    df = spark.createDataFrame([(n,) for n in names], "h string")
    assert [r.h for r in df.where(src.name_header(F.col("h"))).collect()] == names[:4]


def test_table_names(spark):
    df = spark.createDataFrame([("John Smith", "Wireless Earbuds"), ("Hans Müller", "X"), ("张伟", "Y")], "BuyerName string, Item string")
    assert {r.name for r in src.table_names(df).collect()} == {"John Smith", "Hans Müller"}


def test_secrets_only_in_code(spark):
    df = spark.createDataFrame([(1, "password = 'hunter22x'", ".py"), (2, "password = 'hunter22x'", ".txt")], "doc_id long, text string, ext string")
    rows = {r.doc_id: r.text for r in deident.desensitize(df, "mask", ext="ext")[0].collect()}
    assert rows == {1: "password = ***", 2: "password = 'hunter22x'"}


def test_sql_insert_values(spark):
    df = spark.createDataFrame([(1, "INSERT INTO users (id, password) VALUES (1, 's3cretpw')", ".sql")], "doc_id long, text string, ext string")
    assert "s3cretpw" not in deident.desensitize(df, "mask", ext="ext")[0].first().text


def test_custom_map_wins_and_takes_no_token(spark):
    copies, found = deident.desensitize(docs(spark, "call 13800138000 at ACME"), "token", custom={"ACME": "<corp>"})
    assert copies.first().text == "call T0001 at <corp>"
    assert {r.kind for r in found.collect()} == {"custom", "phone"}


def test_tokens_first_seen_order_across_blocks(spark):
    rows = [(i, f"13800138{900 - i:03d}") for i in range(30)]
    passed = deident.scan_pass(spark.createDataFrame(rows, "doc_id long, text string"), "mask")
    tokens = {r.original: r.token for r in deident.build_tokens(deident.explode_hits(passed), width=7).collect()}
    assert [tokens[t] for _, t in rows] == [f"T{i + 1:04d}" for i in range(30)]


def test_redact_is_not_reported_as_collision(spark):
    found = deident.desensitize(docs(spark, "13800138000 13800138001"), "redact")[1]
    assert deident.ambiguous_replacements(found).count() == 0 and deident.collisions(found).count() == 2


def test_decode(spark):
    text = "编码 Ünïcode"
    raw = [text.encode("utf-8"), b"\xef\xbb\xbf" + text.encode("utf-8"), b"\xff\xfe" + text.encode("utf-16-le"),
           b"\xfe\xff" + text.encode("utf-16-be"), "汉字编码".encode("gb18030")]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "i int, content binary")
    got = [r[0] for r in df.orderBy("i").select(src.decode_text(F.col("content"))).collect()]
    assert got == [text] * 4 + ["汉字编码"]


def test_hints(spark):
    df = docs(spark, "这是日文采访", "english meeting", "请翻译成英文", "")
    rows = df.orderBy("doc_id").select(transcript.language_hint(F.col("text")), transcript.task_hint(F.col("text"))).collect()
    assert [tuple(r) for r in rows] == [("ja", None), ("en", None), ("en", "translate"), (None, None)]


def test_deictic(spark):
    df = docs(spark, "如图所示，左边", "请看这张图。", "As shown in this figure", "plain sentence")
    assert [r[0] for r in df.orderBy("doc_id").select(transcript.points_at_picture(F.col("text"))).collect()] == [True, True, True, False]


def test_silence_split_tone(spark):
    loud = lambda t: t < 3 or 4 <= t < 7
    rows = [("a", i, 1.0 if loud(i * 0.02) else 0.0) for i in range(400)]
    pieces = transcript.silence_split(spark.createDataFrame(rows, "stream string, frame_idx long, rms double"), block=37).orderBy("piece").collect()
    assert len(pieces) >= 2 and 2.5 <= pieces[0].end_frame * 0.02 <= 4.5
    assert pieces[0].first_frame == 0 and pieces[-1].end_frame == 400


def test_account_urls(spark):
    urls = {"https://www.douyin.com/user/x": "douyin", "https://xhslink.com/a": "xiaohongshu", "https://space.bilibili.com/1": "bilibili",
            "https://www.youtube.com/@x": "youtube_channel", "https://x.com/playlist?list=1": "playlist",
            "https://www.bilibili.com/video/BV1": None, "https://youtube.com/watch?v=1": None}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", X.account_platform(F.col("u")).alias("p"))
    assert {r.u: r.p for r in df.collect()} == urls


def test_contract_with_missing_fields(spark):
    df = spark.createDataFrame([('{"source":"ocr","text":"t"}',)], "json string")
    row = src.parse_contracts(df).first()
    assert row.source == "ocr" and row.raw_text is None and row.corrected is None


def test_version_order(spark):
    df = spark.createDataFrame([("1.10",), ("1.9",), ("",), ("v1.2",)], "v string")
    assert [r.v for r in df.orderBy(registry.version_key(F.col("v"))).collect()] == ["", "v1.2", "1.9", "1.10"]


def test_structured_items(spark):
    text = "问：甲？\n答：乙\n- 一\n2. 二\n| a | b |\n|---|---|\n水是指液体\n为什么？\n因为\n谁？\n哪里？\n那里"
    rows = structure.extract_items(docs(spark, text)).orderBy("pos").collect()
    assert [(r.type, r.question or r.term or r.content) for r in rows] == [
        ("qa", "甲？"), ("list", "一"), ("list", "二"), ("table", "| a | b |"), ("definition", "水"), ("qa", "为什么？"), ("qa", "谁？")]
    assert [r.answer for r in rows if r.type == "qa"] == ["乙", "因为", "哪里？"]


def test_mindmap_takes_precedence(spark):
    text = "# ignored\n```mermaid\nmindmap\n  root((Top))\n    a[One]\n      Two words\n```"
    rows = structure.outline_tree(structure.outline(docs(spark, text))).orderBy("pos").collect()
    assert [(r.depth, r.text) for r in rows] == [(1, "Top"), (2, "One"), (3, "Two words")]
    assert [r.parent_pos for r in rows] == [None, 3, 4]


def test_summary_in_chinese_cites(spark):
    text = "研究发现城市绿化改善城市空气。城市绿化需要投入。天气不错\n\n因此城市绿化值得继续投入。"
    row = summaries.summarize(docs(spark, text), length=2, cite=True).first()
    assert row.lang == "zh" and "（见原文第1段·句1）" in row.summary and "城市" in row.keywords


def test_clean_summary(spark):
    df = docs(spark, "# 摘要\n甲。（见原文第1段·句2）\n关键词：乙")
    assert df.select(similarity.clean_summary(F.col("text"))).first()[0] == "甲。"


def test_anchor_without_heading_is_indeterminate(spark):
    a = spark.createDataFrame([("s", 1, 100.0, "开场", "x", "arrow"), ("s", 2, 500.0, "光圈快门", "y", "arrow"), ("s", 3, 104.0, "光圈快门", "", "arrow")],
                              "section string, line_no int, time_sec double, heading string, body string, mode string")
    f = spark.createDataFrame([("s", 1, 101.0, "无关"), ("s", 2, 103.0, "光圈快门讲解")], "section string, frame_id int, ts double, ocr_text string")
    got = {r.line_no: (r.status, r.best_frame) for r in pack.anchor_check(a, f).collect()}
    assert got == {1: ("indeterminate", 1), 2: ("no_frame", None), 3: ("ok", 2)}


def test_rarer_surnames_are_masked(spark):
    rows = {r.text for r in deident.desensitize(spark.createDataFrame([(1, "姓名：褚卫国"), (2, "联系人阮小二")], "doc_id long, text string"), "redact", cn=True)[0].collect()}
    assert not any(n in t for t in rows for n in ("褚卫国", "阮小二"))


def test_deep_outline(spark):
    text = "\n".join("  " * i + f"- n{i}" for i in range(70))
    tree = {r.pos: r.parent_pos for r in structure.outline_tree(structure.outline(docs(spark, text))).collect()}
    assert tree == {i: i - 1 if i else None for i in range(70)}


def test_many_chinese_runs(spark):
    df = spark.createDataFrame([(1, "甲乙 " * 30_000, "g"), (2, "丙丁 " * 30_000, "g")], "doc_id long, text string, src string")
    assert summaries.keyword_rows(summaries.indexed(df)).where("rank = 1").count() == 2
    first = [r.term for r in summaries.group_keywords(df, "src", 2).orderBy("rank").collect()]
    assert first == ["甲乙", "丙丁"]  # alike in weight: the earlier document's comes first


def test_hits_parted_by_one_character(spark):
    """A character that ends one hit also lets the next begin, as in the reference's look-arounds."""
    rows = [(1, "at 10.0.0.1 10.0.0.2 10.0.0.3."), (2, "call +49 151 2345678 +33 6 1234 5678 now"), (3, "110101199001011234 110101199001011235")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.value for r in detect.find_kind(df, "ip").orderBy("pos").collect()] == ["10.0.0.1", "10.0.0.2", "10.0.0.3"]
    assert [r.value for r in detect.find_kind(df, "intl_phone").orderBy("pos").collect()] == ["+49 151 2345678", "+33 6 1234 5678"]
    assert detect.precheck(df, ["idcard"]).count() == 2
