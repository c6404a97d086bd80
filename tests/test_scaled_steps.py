"""Steps that were made to grow no faster than their input, against plain versions of them."""

import random
import re

from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.scale import by_key_and_size
from palimpsest.operators import pack, similarity, structure, summaries
from palimpsest.operators.similarity import line_array
from palimpsest.plans import detection
from palimpsest.sources import segments


def _texts(seed: int, parts: list[str], n: int = 300) -> list[tuple[int, str]]:
    rnd = random.Random(seed)
    return [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))) for i in range(n)] + [(n, None), (n + 1, "")]


def test_sentences_are_counted_as_they_are_cut(spark):
    df = spark.createDataFrame(_texts(1, ["a", "b c", " ", "\n", "\r\n", "。", "!", "?!", "…", "；", "　", "\x85", "\x0b", "\n \n", "😀"]), "doc_id long, text string")
    rows = df.select(T.sentence_count(F.col("text")), F.size(T.located_sentences(F.col("text"))), F.size(T.sentence_array(F.col("text")))).where("text is not null").collect()
    assert all(a == b == c for a, b, c in rows)


def test_lines_have_no_empty_tail(spark):
    df = spark.createDataFrame(_texts(2, ["a", "b", "\n", "\r", "\r\n", "\x0b", "\x1c", "\x85", "\u2028"]), "doc_id long, text string")
    cut = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
    for text, lines in df.select("text", line_array(F.col("text"))).collect():
        assert lines == (None if text is None else re.split(cut, re.sub(f"({cut})\\Z", "", text)))


def test_coverage_gaps_in_a_row(spark):
    """Sections are told inside a document's row: no lines are exchanged or sorted."""
    rows = [(1, "intro\n### A\n" + "word " * 60 + "\n### B\n![x](y.png)\n" + "w" * 300 + "\n#### deep\n" + "v" * 150 + "\n### C \nfew"),
            (2, "## One\n" + "x" * 210 + "\n## Two\n\n![x] " + "y" * 250), (3, "none"), (4, None), (5, "")]
    out = pack.coverage_gaps(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect())) == [(1, 1, "A", 240), (2, 1, "One", 210), (2, 2, "Two", 254)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_tasks_of_ngrams_are_bounded_by_their_texts(spark):
    df = spark.createDataFrame([(i, "甲乙丙甲乙 乙丙") for i in range(400)], "doc_id long, text string")
    assert by_key_and_size(df, "doc_id", "text", chars=20).rdd.getNumPartitions() == 160
    counts = summaries.ngram_counts(df, 2)
    assert {(r.term, r.tf, r.df) for r in counts.where("doc_id = 7").collect()} == {("甲乙", 2, 1), ("乙丙", 2, 2), ("丙甲", 1, 1)}
    exchanges = counts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges == 1  # the texts', none of the n-grams


def test_chinese_extras_use_every_core(spark):
    assert detection.chinese_extras(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_group_sentences_are_placed_by_document(spark):
    """Also for rows that share a place, null groups and documents without a sentence."""
    rows = [("a", 1, "x. y! z"), ("a", 250, "p? q"), ("a", 120, " \n "), ("b", 5, "one"), (None, 3, "u! v"), (None, 300, "w"), ("a", 130, None)]
    out = summaries.group_sentences(spark.createDataFrame(rows, "src string, doc_id long, text string"), "src", width=100)
    assert sorted((r.src or "", r.gidx, r.text) for r in out.collect()) == [
        ("", 0, "u!"), ("", 1, "v"), ("", 2, "w"), ("a", 0, "x. y!"), ("a", 1, "z"), ("a", 2, "p?"), ("a", 3, "q"), ("b", 0, "one")]


def test_files_are_dealt_to_a_bounded_number_of_tasks(monkeypatch):
    reader = segments._Reader({"path": "/none"})
    monkeypatch.setattr(reader, "_parts", lambda: {s: {n: f"{s}/{n}" for n in range(50_000)} for s in ("a", "b")})
    dealt = reader.partitions({"a": 9}, {"a": 49_999, "b": 49_999})
    assert len(dealt) <= segments.TASKS
    assert [f[:2] for p in dealt for f in p.files] == [("a", n) for n in range(10, 50_000)] + [("b", n) for n in range(50_000)]


def test_small_pairs_are_compared_in_their_row(spark):
    """No exchange and no job ahead for them; the first of equally good sources counts, and large pairs give the same."""
    rows = [("a", "x y z? p q? x y z?", "x y z! y q? nothing?"), ("b", None, "one?"), ("c", "one?", None), ("d", "", "u?"), ("e", "--?", "--? u?"), (None, "k l?", "l k?")]
    df = spark.createDataFrame(rows, "pair_id string, left_text string, right_text string")
    out = similarity.consistency(df)
    got = {tuple(r) for r in out.select("pair_id", "idx", "best_match_idx", "best_match_score", "traceable").collect()}
    assert got == {("a", 0, 0, 1.0, True), ("a", 1, 1, 0.333, True), ("a", 2, -1, 0.0, False), ("b", 0, -1, 0.0, False), ("d", 0, -1, 0.0, False),
                   ("e", 0, -1, 0.0, False), ("e", 1, -1, 0.0, False), (None, 0, 0, 1.0, True)}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    large = {tuple(r) for r in similarity.consistency(df.where("pair_id = 'a'"), bound=3).select("pair_id", "idx", "best_match_idx", "best_match_score", "traceable").collect()}
    assert large == {r for r in got if r[0] == "a"}


def test_outline_cleans_a_node_once(spark):
    """A node's text is not copied into the filter behind it."""
    text = "```mermaid\nmindmap\n  a((Top))::icon(fa fa-x)\n\t b[One<BR/>two]\n   \t \n    ::icon(y)\n      {{[deep]}}  \n  c < d\n```\nafter"
    nodes = structure.outline(spark.createDataFrame([(1, text), (2, "# H \r\n- x\x0b  plain\u2028"), (3, None)], "doc_id long, text string"))
    assert nodes._jdf.queryExecution().executedPlan().toString().count("::icon\\([^)]*") == 1
    assert sorted((r.doc_id, r.pos, r.depth, r.text) for r in nodes.collect()) == [
        (1, 2, 1, "Top"), (1, 3, 0, "One two"), (1, 6, 3, "deep"), (1, 7, 1, "c < d"), (2, 0, 1, "H"), (2, 1, 2, "x"), (2, 2, 3, "plain")]
