"""Archives, mixing, URL filters and the pipeline."""

import os
import random
import re
from collections import defaultdict

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import catalog, common, language, mixing, urls, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def plain(df):
        return sorted(tuple("null" if pd.isna(v) else str(v) if isinstance(v, str) else repr(float(v)) for v in r) for r in df[columns].astype(object).itertuples(index=False))

    assert plain(got) == plain(want)


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalog.queries()) == list(range(1, 14))


# --- WARC ---------------------------------------------------------------------

PAGES = [(1, "http://a/ b\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 3_000_000), (6, "u", "WARC/1.1\r\n\r\nWARC/1.0"), (7, "u", "once"),
         (9, "u", "twice"), (9, "v", "twice"), (8, "w", "twice"), (None, "u", "nulls"), (None, "u", "<p>é</p>")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_round_trip(spark, compression):
    path = common.folder(spark, "warc-test")
    warc.write_warc(pages(spark), path, compression=compression)
    back = warc.read_warc(spark, path)
    best = defaultdict(list)
    for i, _, h in PAGES:
        best[h or ""].append(i)
    top = {h: max((i for i in ids if i is not None), default=None) for h, ids in best.items()}
    want = [(i, len((h or "").encode()), warc.digest_of((h or "").encode()), "response" if i == top[h or ""] else "revisit", None if i == top[h or ""] else top[h or ""]) for i, _, h in PAGES]
    assert sorted([tuple(r) for r in warc.page_digests(back).collect()], key=repr) == sorted(want, key=repr)
    bodies = {r.record_id: r.payload for r in back.where("record_type = 'response'").collect()}
    assert bytes(bodies["urn:x-page:5"]) == b"x" * 3_000_000 and bytes(bodies["urn:x-page:6"]).startswith(b"WARC/1.1") and bytes(bodies["urn:x-page:4"]) == b""
    assert back.where("target_uri = 'http://a/%20b%0A'").count() == 1
    assert back.where(F.col("record_type").isin("revisit", "metadata")).select("record_id").count() == sum(w[3] == "revisit" for w in want)


def test_warc_least_bytes_and_empty(spark):
    path = common.folder(spark, "warc-test")
    warc.write_warc(pages(spark), path, least=1)
    assert {(r.page_id, r.record_type) for r in warc.page_digests(warc.read_warc(spark, path)).collect() if r.page_id in (3, 4)} == {(3, "response"), (4, "response")}
    path = common.folder(spark, "warc-test")
    warc.write_warc(pages(spark).limit(0), path)
    assert warc.page_digests(warc.read_warc(spark, path)).count() == 0


def test_warc_filters_reach_the_source(spark):
    path = common.folder(spark, "warc-test")
    warc.write_warc(pages(spark), path)
    some = warc.read_warc(spark, path).where("record_type = 'response' and target_uri like 'u%'").select("record_id")
    assert some.count() == sum(1 for r in warc.archive_rows(pages(spark)).collect() if r.record_type == "response" and (r.target_uri or "").startswith("u"))
    reader = warc.WarcReader(path, ["record_id"], None)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("content_length",), 5), warc.IsNotNull(("target_uri",))]))
    assert left == [warc.EqualTo(("content_length",), 5)] and len(reader.tests) == 2
    parts = reader.partitions()
    assert sum(len(p.paths) for p in parts) == sum(f.endswith(".gz") for f in os.listdir(path.removeprefix("file:")))


def test_unwanted_bodies_are_passed_over():
    """A plain archive is not read where a record is unwanted; a broken body there does no harm."""
    import io

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out

    def rec(i, kind, payload):
        return warc.record({"record_type": kind, "record_id": f"urn:x:{i}", "target_uri": "u", "refers_to": None, "payload": payload, "payload_length": len(payload), "payload_digest": "A"}, "d")

    raw = rec(1, "response", b"\xff" * 5_000_000) + rec(2, "response", b"small") + rec(3, "response", b"\0" * 5_000_000)
    stream = Counting(raw)
    got = list(warc.records(warc._Members(stream, False), lambda r: r["record_id"] == "urn:x:2"))
    assert [r["payload"] for r in got] == [b"small"] and stream.taken < 400_000
    with pytest.raises(EOFError):
        list(warc.records(warc._Members(io.BytesIO(raw[:-100]), False)))
    with pytest.raises(ValueError):
        list(warc.records(warc._Members(io.BytesIO(b"no archive\r\n\r\n"), False)))


# --- mixing -------------------------------------------------------------------

def test_targets_by_resharing():
    rng = random.Random(2)
    for _ in range(200):
        sizes = {s: rng.choice([0, 1, 10, 100, 10_000]) for s in rng.sample([None, "a", "b", "B", "é", "zz", ""], rng.randint(1, 7))}
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        capped, target = set(), {}
        while True:  # as the contract says it
            left, open_ = sum(sizes.values()) - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
            target = {s: 3 * sizes[s] if s in capped else weight[s] * left / open_ for s in order}
            over = {s for s in order if target[s] > 3 * sizes[s]}
            if not over:
                break
            capped |= over
        got = mixing.share_targets(sizes)
        assert all(got[s] == pytest.approx(target[s]) for s in order)


def test_route_meets_quotas_at_least_repetition():
    # Two sources share a pattern; what is shared goes where it is short.
    words = [100, 100, 10]
    got = mixing.route(list(zip([("a",), ("a", "b"), ("b",)], words, strict=True)), {"a": 100, "b": 120})
    assert sum(got) == 220 and sum(max(0, g - w) for g, w in zip(got, words, strict=True)) == 10
    assert mixing.route([(("a",), 10)], {"a": 1000}) == [30]
    assert mixing.route([(("a", "b"), 50), (("c",), 5)], {"a": 60, "b": 70, "c": 0}) == [130, 0]
    # Cheapest: nobody is repeated while fresh words are left.
    assert mixing.route([(("a",), 50), (("a", "b"), 100)], {"a": 120, "b": 30}) == [50, 100]


def mix_docs(spark, rows):
    return spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, source string, text string, taken string")


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 7)
    rng = random.Random(3)
    rows = [(i, rng.choice(["a"] * 9 + ["b", "c", "d", None]), " ".join("w" for _ in range(rng.randint(0, 30)))) for i in range(500)]
    rows += [(900, "a", None), (901, "empty", ""), (None, "a", "x y"), (3, rows[3][1], rows[3][2]), (902, None, "\t\n ")]
    docs = mix_docs(spark, rows)
    got = mixing.mix_rows(docs).collect()
    assert len(got) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size and r.source_size >= r.size
    want = mixing.share_targets(size)
    assert all(target[s] == want[s] and abs(taken[s] - want[s]) <= 60 for s in size)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_rows(docs.repartition(5)).collect()))
    picked = mixing.mixed(docs)
    assert picked.columns == docs.columns
    words = picked.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == sum(r.taken for r in got)
    assert mixing.mix_rows(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_mix_of_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b"], "w " * 10) for i in range(300)], "doc_id long, s array<string>, text string")
    got = mixing.mix(docs, F.col("s")).withColumn("taken", F.col("size") * F.col("_copies")).groupBy("_pattern").agg(F.sum("taken").alias("t")).collect()
    assert sum(r.t for r in got) == pytest.approx(4000, abs=60)  # each source's sizes count: 2,000 words each


# --- URLs ---------------------------------------------------------------------

URLS = [(1, "http://X.Example.NET/en/1?x"), (2, "https://example.net/de/1"), (3, "http://a.example.com/de/5#f"), (4, "http://q.org/fr/x"), (5, "http://q.org/en/x"), (6, None), (7, "no scheme"),
        (8, "://"), (9, "http://badexample.com/de/1"), (10, "http://example.net"), (11, "http://net/a"), (12, "ftp://h/a//b/"), (13, "http://h?/x"), (13, "http://h?/x"), (14, "http://h/" + "a/" * 3000)]


def test_url_rules(spark):
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame([(*u, "old") for u in URLS], "page_id long, url string, verdict string")).collect()}
    want = {1: ("x.example.net", "/en/1", "example.net/en/", "allow"), 2: ("example.net", "/de/1", "net/", "block"), 3: ("a.example.com", "/de/5", "example.com/de/", "block"),
            4: ("q.org", "/fr/x", "org/fr/", "allow"), 5: ("q.org", "/en/x", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
            9: ("badexample.com", "/de/1", None, "allow"), 10: ("example.net", "", None, "allow"), 11: ("net", "/a", "net/", "block"), 12: ("h", "/a//b/", None, "allow"), 13: ("h", "", None, "allow")}
    assert all((got[i].host, got[i].path, got[i].rule, got[i].verdict) == w for i, w in want.items()) and got[14].verdict == "allow"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_templates(spark):
    """Labelled pages of a template decide its other pages; alike branches are one; identifiers are wildcards."""
    rules = [("block", "bad.org/spam/x"), ("block", "bad.org/junk/x"), ("allow", "bad.org/good/x")]
    rows = [f"http://bad.org/{d}/x{i}" for d in ("spam", "junk", "good") for i in range(20)]
    rows += ["http://bad.org/spam/y7", "http://bad.org/junk/y8", "http://bad.org/good/y9", "http://bad.org/other/y1", "http://else.org/spam/y1"]
    rows += [f"http://wide.org/{'abcdefghijklmnopqrstuvwxyz'[i]}word/p" for i in range(26)]
    got = {r.url: r for r in urls.judge(spark.createDataFrame([(u,) for u in rows], "url string"), rules=rules).collect()}
    assert [got[u].verdict for u in rows[60:65]] == ["block", "block", "allow", "allow", "allow"]
    assert got["http://bad.org/spam/y7"].rule is None and got["http://bad.org/spam/y7"].template.endswith("/*")
    assert {got[u].template for u in rows[65:]} == {"*/p"}  # a node with many rare children


# --- the pipeline -------------------------------------------------------------

def test_pipeline_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    said = {r.doc_id: r for r in language.identify(docs.select("doc_id", "text"), language.fit(docs)).collect()}
    left = [r for r in rows if said[r.doc_id].lang_pred != "und" and not said[r.doc_id].ambiguous]
    best = {}
    for r in left:
        k = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        if k not in best or (-len(r.text), r.doc_id) < (-len(best[k].text), best[k].doc_id):
            best[k] = r
    left = list(best.values())
    from test_llm_sets import jaccard_brute

    first = {i: c for i, _, c in jaccard_brute([(r.doc_id, r.text) for r in left], 5, 80)}
    left = [r for r in left if first[r.doc_id] == r.doc_id]
    frame = spark.createDataFrame(left, docs.schema)
    counts = {r.doc_id: r.taken // r.size for r in mixing.mix_rows(frame).collect() if r.size}
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] += 1
    assert dict(got) == {i: n for i, n in counts.items() if n}
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "jaccard_join", "mixing", "sentencepiece"]
    stage = spark.read.parquet(f"{SF}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = common.materialize(f(spark, stage, SF), "pipeline-test")
        assert stage.columns == docs.columns, name


def test_pipeline_on_nothing_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(40).unionByName(spark.createDataFrame([(None, "hello there", None, None, 1), (7, None, "en", None, 0), (8, "", None, "s", 0)], docs.schema))
    for start in (docs.limit(0), odd):
        stage = start
        for _, f in corpus_pipeline.STAGES:
            stage = common.materialize(f(spark, stage, SF), "pipeline-test")
        assert stage.count() >= 0
