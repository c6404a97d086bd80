"""Structured items, outlines and capability matching from plain text.

Everything works on lines.  A document is exchanged once on its key before its
lines are exploded; the windows below reuse that partitioning and are bounded
by one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.functions import text as T
from palimpsest.functions.patterns import D, WS
from palimpsest.functions.scale import by_key, pinned
from palimpsest.functions.splice import let
from palimpsest.operators.similarity import line_array
from palimpsest.session import cut_lineage

# --- fixed values: line patterns ---------------------------------------------
QUESTION_MARK = rf"(?i)^[{WS}]*(问|问题|Q|Question)[{WS}]*[:：.、)]"
ANSWER_MARK = rf"(?i)^[{WS}]*(答|答案|A|Answer)[{WS}]*[:：.、)]"
LIST_MARK = rf"^[{WS}]*([-*+][{WS}]+|{D}+[.、)][{WS}]+|（{D}+）[{WS}]+|\(?{D}+\)[{WS}]+)"
TABLE_ROW = rf"^[{WS}]*\|(.+)\|[{WS}]*$"
TABLE_RULE = rf"^[{WS}]*\|?[{WS}:\-|]+\|?[{WS}]*$"
DEFINED_BY_MARK = rf"^(.{{1,24}}?)[{WS}]*(?:[:：]|——|--|—)[{WS}]*(.+)$"
DEFINED_BY_VERB = rf"^(.{{1,24}}?)[{WS}]*(?:是指|即是|即|称为|称作)[{WS}]*(.+)$"
ASKS = rf"[？?][{WS}]*$"
HEADING = rf"^(#{{1,6}})[{WS}]+(.*[^{WS}])[{WS}]*$"
BULLET = rf"^([{WS}]*)([-*+]|{D}+[.、)][{WS}]+|（{D}+）[{WS}]+|\(?{D}+\)[{WS}]+)[{WS}]*(.*[^{WS}])?[{WS}]*$"
FENCE = rf"(?i)^[{WS}]*```(\w*)[{WS}]*$"
MINDMAP = rf"^[{WS}]*mindmap[{WS}]*$"
TYPE_LABEL = {"qa": "问答", "list": "列表项", "definition": "定义/说明", "table": "表格"}
TYPE_ORDER = {"qa": 0, "list": 1, "definition": 2, "table": 3}


def lines(df: DataFrame, *, key: str = "doc_id", text: str = "text", exchange: bool = True) -> DataFrame:
    """``key, pos, line`` with one exchange on the key."""
    base = df.select(key, text)
    if exchange:
        base = by_key(base, key)
    return base.select(key, F.posexplode(line_array(F.col(text))).alias("pos", "line"))


def _matches(col: Column, pat: str) -> Column:
    return F.rlike(col, F.lit(pat))


def extract_items(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Question/answer, list, definition and table items of each document.

    Precedence per line: table, explicit pair, list, definition, question.  A
    question takes the next plain line as its answer and that line is not read
    again; with several questions in a row this alternates, so a line is taken
    when the run of possible takings that ends on it has odd length.
    """
    w = W.partitionBy(key).orderBy("pos")
    ln, s = F.col("line"), F.col("s")
    rows = lines(df, key=key, text=text).withColumn("s", pinned(T.strip(ln)))
    by_verb, by_mark = F.regexp_extract(s, DEFINED_BY_VERB, 2), T.strip(F.regexp_extract(s, DEFINED_BY_MARK, 2))
    mark_term = T.strip(F.regexp_extract(s, DEFINED_BY_MARK, 1))
    rows = rows.withColumns({
        "is_q": _matches(ln, QUESTION_MARK), "is_a": _matches(ln, ANSWER_MARK), "blank": s == "",
        "is_table": _matches(ln, TABLE_ROW), "is_list": _matches(ln, LIST_MARK),
        "verb": _matches(s, DEFINED_BY_VERB) & (F.length(by_verb) >= 2),
        "mark": _matches(s, DEFINED_BY_MARK) & F.length(mark_term).between(1, 24) & (F.length(by_mark) >= 2),
    })
    rows = rows.withColumns({
        "opens": F.col("is_q") & F.coalesce(F.lead("is_a").over(w), F.lit(False)),
        "next_line": F.lead("line").over(w), "next_s": F.lead("s").over(w),
    }).withColumn("closes", F.coalesce(F.lag("opens").over(w), F.lit(False)))
    free = ~F.col("blank") & ~F.col("is_table") & ~F.col("opens") & ~F.col("closes") & ~F.col("is_list")
    rows = rows.withColumn("asks", free & ~F.col("verb") & ~F.col("mark") & _matches(s, ASKS))
    takes = F.coalesce(F.lag("asks").over(w), F.lit(False)) & ~F.col("blank") & ~F.col("is_table") & ~F.col("is_list")
    rows = rows.withColumn("may_take", takes).withColumn(
        "island", F.count_if(~F.col("may_take")).over(w.rowsBetween(W.unboundedPreceding, 0))
    )
    run = F.count_if("may_take").over(W.partitionBy(key, "island").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("taken", F.col("may_take") & (run % 2 == 1))
    rows = rows.withColumn("next_taken", F.coalesce(F.lead("taken").over(w), F.lit(False)))

    cells = F.transform(F.split(F.regexp_extract(ln, TABLE_ROW, 1), r"\|", -1), T.strip)
    item = T.strip(F.regexp_replace(ln, LIST_MARK, ""))
    q_text, a_text = T.strip(F.regexp_replace(ln, QUESTION_MARK, "")), T.strip(
        F.regexp_replace("next_line", ANSWER_MARK, ""))
    live = ~F.col("taken")
    kind = (
        F.when(F.col("opens"), "qa")
        .when(~live | F.col("blank"), None)
        .when(F.col("is_table"), F.when(~_matches(ln, TABLE_RULE), "table"))
        .when(F.col("closes"), None)
        .when(F.col("is_list"), F.when(item != "", "list"))
        .when(F.col("verb") | F.col("mark"), "definition")
        .when(F.col("asks"), "qa")
    )
    rows = rows.withColumn("type", kind).where(F.col("type").isNotNull())
    paired, defined = F.col("opens"), F.col("type") == "definition"
    question = F.when(F.col("type") == "qa", F.when(paired, q_text).otherwise(s))
    answer = F.when(F.col("type") == "qa", F.when(paired, a_text).when(F.col("next_taken"), F.col("next_s")).otherwise(""))
    term = F.when(defined, F.when(F.col("verb"), T.strip(F.regexp_extract(s, DEFINED_BY_VERB, 1))).otherwise(mark_term))
    desc = F.when(defined, F.when(F.col("verb"), T.strip(by_verb)).otherwise(by_mark))
    content = (
        F.when(F.col("type") == "list", item).when(F.col("type") == "table", s)
        .when(defined, F.concat(term, F.lit("："), desc))
        .otherwise(F.concat(F.lit("问："), question, F.lit("　答："), answer))
    )
    return rows.select(
        key, "pos", "type", paired.alias("explicit"), question.alias("question"), answer.alias("answer"),
        term.alias("term"), desc.alias("desc"), F.when(F.col("type") == "table", cells).alias("cells"),
        content.alias("content"),
    )


def item_stats(items: DataFrame, key: str = "doc_id") -> DataFrame:
    return items.groupBy(key, "type").agg(F.count(F.lit(1)).alias("n"))


def items_to_csv_rows(items: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Rows ``type, value1..value3``; cells beyond the third are folded into it.

    Only the first table row of a document is a header and is left out.
    """
    first_table = F.min(F.when(F.col("type") == "table", F.col("pos"))).over(W.partitionBy(key))
    body = items.withColumn("_first", first_table).where(
        (F.col("type") != "table") | (F.col("pos") != F.col("_first"))
    )
    values = (
        F.when(F.col("type") == "qa", F.array("question", "answer"))
        .when(F.col("type") == "definition", F.array("term", "desc"))
        .when(F.col("type") == "table", F.col("cells"))
        .otherwise(F.array("content"))
    )
    folded = F.when(
        F.size(values) > 3,
        F.concat(F.slice(values, 1, 2), F.array(F.array_join(F.slice(values, F.lit(3), F.size(values)), " | "))),
    ).otherwise(values)
    label = F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_LABEL.items() for x in kv]), F.col("type"))
    place = F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_ORDER.items() for x in kv]), F.col("type"))
    shown = body.withColumn("_v", folded)
    return shown.select(
        key, place.alias("type_order"), "pos", label.alias("type"),
        *[F.coalesce(F.get("_v", F.lit(i)), F.lit("")).alias(f"value{i + 1}") for i in range(3)],
    )


def _clean_node(raw: Column) -> Column:
    """Strip icon and break syntax, the node id and its outer brackets."""
    def plain(raw: Column) -> Column:
        s = T.strip(F.when(F.contains(raw, F.lit("::icon(")), F.regexp_replace(raw, r"::icon\([^)]*\)", "")).otherwise(raw))
        s = let(s, lambda x: F.when(F.contains(x, F.lit("<")), F.regexp_replace(x, rf"(?i)<br[{WS}]*/?>", " ")).otherwise(x))
        return F.regexp_replace(s, rf"^([A-Za-z0-9_\-]+)(?=[{WS}]*[\[({{])", "")

    def opened(s: Column) -> Column:
        # one round per opening bracket strips (( )), [ ], { } and their combinations
        layers = F.sequence(F.lit(1), F.regexp_count(s, F.lit(r"[\[({]")) + 1)
        return F.aggregate(layers, s, lambda acc, _: F.when(
            F.rlike(acc, F.lit(r"(?s)^(?:\(.*\)|\[.*\]|\{.*\})$")), T.strip(F.substr(acc, F.lit(2), F.length(acc) - 2))
        ).otherwise(acc))

    return let(let(raw, plain), opened)


def outline(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Outline nodes ``key, pos, depth, text``.

    A fenced mind-map block takes precedence; otherwise headings set the level
    and list items or plain lines hang below the last heading by indentation.
    """
    w = W.partitionBy(key).orderBy("pos")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(key)
    ln = F.col("line")
    rows = lines(df, key=key, text=text).withColumn("fence", _matches(ln, FENCE))
    rows = rows.withColumn("n_fence", F.count_if("fence").over(upto))
    opener = F.col("fence") & (F.col("n_fence") % 2 == 1)
    inside = ~F.col("fence") & (F.col("n_fence") % 2 == 1)
    names = opener & F.lower(F.regexp_extract(ln, FENCE, 1)).contains("mindmap")
    starts = inside & _matches(ln, MINDMAP)
    rows = rows.withColumns({"inside": inside, "starts": starts, "flag": names | starts})
    rows = rows.withColumn("block", F.min(F.when(F.col("flag"), F.col("n_fence"))).over(whole))
    in_block = F.col("inside") & (F.col("n_fence") == F.col("block"))
    rows = rows.withColumn("started", F.count_if(in_block & F.col("starts")).over(before) > 0)
    heads = F.when(_matches(ln, HEADING), F.length(F.regexp_extract(ln, HEADING, 1)))
    rows = rows.withColumn("head", heads).withColumn("last_head", F.last("head", ignorenulls=True).over(upto))

    map_indent = F.length(ln) - F.length(F.ltrim(ln))  # blank lines are no nodes
    map_depth = F.when(map_indent >= 2, F.floor(map_indent / 2)).when(map_indent > 0, 1).otherwise(0)
    under = F.coalesce("last_head", F.lit(0)) + 1
    bullet = _matches(ln, BULLET)
    indent = F.when(bullet, F.length(F.regexp_extract(ln, BULLET, 1))).otherwise(F.length(ln) - F.length(F.ltrim(ln)))
    label = (
        F.when(F.col("head").isNotNull(), T.strip(F.regexp_extract(ln, HEADING, 2)))
        .when(bullet, T.strip(F.coalesce(F.regexp_extract(ln, BULLET, 3), F.lit(""))))
        .otherwise(T.strip(ln))
    )
    depth = F.when(F.col("head").isNotNull(), F.col("head")).otherwise(under + F.floor(indent / 2))
    is_map = F.col("block").isNotNull()
    use = F.when(is_map, in_block & F.col("started") & ~F.col("starts")).otherwise(F.lit(True))
    node = pinned(F.when(use, F.when(is_map, _clean_node(T.strip(ln))).otherwise(label)))
    return rows.select(
        key, "pos", F.when(is_map, map_depth).otherwise(depth).cast("int").alias("depth"), node.alias("text"),
    ).where(F.col("text") != "")


#: Nodes of a document that are put in order in one row.
OUTLINE_BLOCK = 512

_OPEN = "array<struct<depth:int,pos:bigint>>"


def _branches(nodes: Column) -> Column:
    """``struct<open, done>`` of a block: the branch left open at its end, and each node's parent in the block (null: none there)."""
    start = F.struct(F.array().cast(_OPEN).alias("open"), F.array().cast("array<bigint>").alias("done"))

    def step(state: Column, node: Column) -> Column:
        above = F.filter(state["open"], lambda o: o["depth"] < node["depth"])
        own = F.struct(node["depth"].cast("int").alias("depth"), node["pos"].cast("bigint").alias("pos"))
        return F.struct(F.concat(above, F.array(own)).cast(_OPEN).alias("open"),
                        F.concat(state["done"], F.array(F.get(above, F.size(above) - 1)["pos"])).alias("done"))

    return F.aggregate(nodes, start, step)


def outline_tree(nodes: DataFrame, *, key: str = "doc_id", block: int | None = None) -> DataFrame:
    """Parent of each node: the nearest earlier node with a smaller depth.

    Nodes are taken in blocks of a document's places.  A block finds the
    parents inside it and hands on its open branch, whose depths only grow.  A
    node without a parent in its block looks for the last block before it that
    holds a smaller depth: such nodes and such branches are few per block, and
    what is put in order per document is one small row for each of them.
    """
    n = block or OUTLINE_BLOCK
    rows = nodes.select(key, F.floor(F.col("pos") / n).alias("_b"), F.struct("pos", "depth", "text").alias("n"))
    rows = rows.groupBy(key, "_b").agg(F.array_sort(F.collect_list("n")).alias("n"))
    rows = cut_lineage(rows.withColumn("s", pinned(_branches(F.col("n")))))
    found = rows.select(key, "_b", F.posexplode(F.arrays_zip("n", "s.done")).alias("i", "z")).select(
        key, "_b", F.col("z.n.pos").alias("pos"), F.col("z.n.depth").alias("depth"), F.col("z.n.text").alias("text"), F.col("z.done").alias("parent_pos"))
    # Depths that a block's branch holds, and depths it asks for, as marks on one line: the last mark below decides.
    held = rows.select(key, "_b", F.explode("s.open").alias("o")).select(key, "_b", F.col("o.depth").alias("depth"), F.col("o.pos").alias("at"))
    asked = found.where("parent_pos is null").select(key, "_b", "depth").distinct()
    levels = asked.select(key, "depth").distinct().withColumnRenamed("depth", "level")
    below = held.join(levels, key).where(F.col("depth") < F.col("level")).groupBy(key, "level", "_b").agg(F.max("at").alias("at"))
    marks = below.select(key, "level", "_b", "at", F.lit(False).alias("asks")).unionByName(
        asked.select(key, F.col("depth").alias("level"), "_b", F.lit(None).cast("bigint").alias("at"), F.lit(True).alias("asks")))
    before = W.partitionBy(key, "level").orderBy("_b").rangeBetween(W.unboundedPreceding, -1)
    answers = marks.withColumn("_up", F.max("at").over(before)).where("asks").select(key, "_b", F.col("level").alias("depth"), "_up")
    out = found.join(answers, [key, "_b", "depth"], "left")
    up = F.coalesce("parent_pos", "_up")
    return out.select(key, "pos", "depth", "text", up.cast(nodes.schema["pos"].dataType).alias("parent_pos"))


def outline_stats(tree: DataFrame, key: str = "doc_id") -> DataFrame:
    return tree.groupBy(key).agg(
        F.count(F.lit(1)).alias("node_count"), (F.max("depth") + 1).alias("max_depth"),
        F.count_if(F.col("parent_pos").isNull()).cast("long").alias("root_count"),
    )


def match_capabilities(df: DataFrame, capabilities: dict[str, list[str]], *, key: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """Per document and capability, how often its keywords occur; documents without any drop out.

    The (short, driver-side) keyword table becomes one array column, so the text
    is read once and never joined.
    """
    low = F.lower(text)

    def occurrences(word: str) -> Column:
        gone = F.length(low) - F.length(F.replace(low, F.lit(word), F.lit("")))
        return (gone / len(word)).cast("long")

    scores = F.array(*[
        F.struct(F.lit(cap).alias("capability"),
                 sum((occurrences(w.lower()) for w in words), F.lit(0).cast("long")).alias("score"))
        for cap, words in capabilities.items()
    ])
    return df.select(key, F.explode(F.filter(scores, lambda s: s["score"] > 0)).alias("c")).select(key, "c.*")


def best_match(matches: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Per capability the best document and the number of alternatives."""
    best = F.max(F.struct("score", (-F.col(key)).alias("neg")))
    return matches.groupBy("capability").agg(best.alias("b"), F.count(F.lit(1)).alias("n")).select(
        "capability", (-F.col("b.neg")).alias("best"), F.col("b.score").alias("score"),
        (F.col("n") - 1).alias("n_alternatives"),
    )
