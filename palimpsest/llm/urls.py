"""URL filters: host rules, and for the rest a path-template tree per host.  DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import heavy, join_unique, materialize, registry, table

QUERIES, SQL, query = registry()

#: (verdict, rule): a rule is a host and a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A child is variable if its parent has at least this many different ones and it holds a smaller share than one in as many.
FAN = 16
#: Branches are alike if the chi-square of their labels is at most this (5 %, one degree of freedom).
ALIKE = 3.84
#: Labelled pages that a branch and its siblings need each to be compared.
LEAST = 5
#: A template is rejected if (blocked + 1) / (labelled + 2) is at least REJECT tenths.
REJECT = 9

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` and for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones win
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def shaped(path: Column) -> Column:
    """The path's segments, those with a digit or over 40 characters (identifiers, dates, digests) as ``*``."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike("[0-9]") | (F.char_length(s) > 40), F.lit("*")).otherwise(s))


def _templates(paths: DataFrame) -> DataFrame:
    """``host, segments, labelled, blocked, n`` -> ``host, segments, template``, all levels of the tree at once."""
    ids = paths.withColumn("_path", F.xxhash64("host", "segments"))
    steps = ids.where(F.size("segments") > 0).select(
        "host", "segments", "_path", "n", "labelled", "blocked", F.posexplode("segments").alias("depth", "segment"))
    steps = steps.withColumn("parent", F.xxhash64("host", F.expr("slice(segments, 1, depth)"), "depth")).drop("segments")
    nodes = steps.groupBy("host", "parent", "segment").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    whole = nodes.groupBy("host", "parent").agg(
        F.count(F.lit(1)).alias("_children"), *[F.sum(c).alias(f"_{c}") for c in ("n", "labelled", "blocked")])
    nodes = nodes.join(whole, ["host", "parent"])
    n1, b1 = F.col("labelled").cast("double"), F.col("blocked").cast("double")
    n, b = F.col("_labelled").cast("double"), F.col("_blocked").cast("double")
    n2, b2 = n - n1, b - b1
    gap = b1 * n2 - b2 * n1
    alike = (n1 >= LEAST) & (n2 >= LEAST) & (gap * gap * n <= F.lit(ALIKE) * n1 * n2 * b * (n - b))
    variable = (F.col("_children") >= FAN) & (F.col("n") * FAN < F.col("_n"))
    nodes = nodes.select("host", "parent", "segment", F.when(variable | alike, F.lit("*")).otherwise(F.col("segment")).alias("_part"))
    parts = steps.select("host", "_path", "depth", "parent", "segment").join(nodes, ["host", "parent", "segment"])
    made = parts.groupBy("_path").agg(F.array_sort(F.collect_list(F.struct("depth", "_part"))).alias("_parts"))
    made = made.select("_path", F.array_join(F.col("_parts._part"), "/").alias("template"))
    return ids.join(made, "_path", "left").select("host", "segments", "n", "labelled", "blocked", F.coalesce("template", F.lit("")).alias("template"))


def judge(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``pages`` (all columns) with ``host, path, rule, template, verdict``; columns of these names are replaced.

    Rules decide the pages they fit, and these are the labelled ones.  For the
    rest, each host has a tree of path segments: identifiers become wildcards,
    so do the rare children of a node with many, and branches whose labelled
    pages do not differ from their siblings' are merged into one wildcard
    branch.  A template is rejected if the smoothed share of blocked among its
    labelled pages, (blocked + 1) / (labelled + 2), reaches 0.9; a template
    without enough of them is allowed.  A null url, or one without ``://``,
    has an empty host and path, and is judged like any other.
    """
    rows = pages.drop("host", "path", "rule", "template", "verdict").withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_said", said).withColumn("_segments", shaped(F.col("path")))
    paths = rows.groupBy("host", F.col("_segments").alias("segments")).agg(
        F.count(F.lit(1)).alias("n"), F.count("_said").alias("labelled"), F.count(F.when(F.col("_said") == "block", 1)).alias("blocked"))
    paths = materialize(paths, "url-paths")
    known = materialize(_templates(paths), "url-templates")
    score = known.groupBy("host", "template").agg(F.sum("labelled").alias("_l"), F.sum("blocked").alias("_b"))
    reject = score.where((F.col("_b") + 1) * 10 >= (F.col("_l") + 2) * REJECT).select("host", "template", F.lit("block").alias("_verdict"))
    verdicts = materialize(known.join(reject, ["host", "template"], "left").select(
        "host", F.col("segments").alias("_segments"), "n", "template", F.coalesce("_verdict", F.lit("allow")).alias("_verdict")), "url-verdicts")
    total = verdicts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = join_unique(rows, verdicts.drop("n"), ["host", "_segments"], heavy(verdicts, "n", total))
    return out.withColumn("verdict", F.coalesce("_said", "_verdict")).drop("_said", "_segments", "_verdict")


@query("op10_url_filter", rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u),
s AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS said,
  list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') OR length(x) > 40 THEN '*' ELSE x END) AS seg FROM r),
p AS (SELECT host, seg, count(*) AS n, count(said) AS l, count(CASE WHEN said = 'block' THEN 1 END) AS b FROM s GROUP BY host, seg),
e AS (SELECT host, seg, n, l, b, unnest(range(len(seg))) AS depth FROM p WHERE len(seg) > 0),
st AS (SELECT *, seg[1:depth] AS parent, seg[depth + 1] AS segment FROM e),
nd AS (SELECT host, parent, segment, sum(n) AS n, sum(l)::DOUBLE AS n1, sum(b)::DOUBLE AS b1 FROM st GROUP BY ALL),
wh AS (SELECT *, count(*) OVER w AS children, sum(n) OVER w AS wn, sum(n1) OVER w AS wl, sum(b1) OVER w AS wb FROM nd WINDOW w AS (PARTITION BY host, parent)),
dc AS (SELECT host, parent, segment, CASE WHEN (children >= {FAN} AND n * {FAN} < wn) OR (n1 >= {LEAST} AND wl - n1 >= {LEAST}
  AND (b1 * (wl - n1) - (wb - b1) * n1) * (b1 * (wl - n1) - (wb - b1) * n1) * wl <= {ALIKE}::DOUBLE * n1 * (wl - n1) * wb * (wl - wb)) THEN '*' ELSE segment END AS part FROM wh),
tm AS (SELECT st.host, st.seg, string_agg(dc.part, '/' ORDER BY st.depth) AS template FROM st JOIN dc USING (host, parent, segment) GROUP BY st.host, st.seg),
kn AS (SELECT p.*, coalesce(tm.template, '') AS template FROM p LEFT JOIN tm USING (host, seg)),
sc AS (SELECT host, template, (sum(b) + 1) * 10 >= (sum(l) + 2) * {REJECT} AS bad FROM kn GROUP BY host, template)
SELECT s.page_id, s.host, s.path, s.rule, kn.template, coalesce(s.said, CASE WHEN sc.bad THEN 'block' ELSE 'allow' END) AS verdict
FROM s JOIN kn USING (host, seg) JOIN sc ON sc.host = s.host AND sc.template = kn.template""")
def url_filter(spark, sf):
    return judge(table(spark, sf, "pages").select("page_id", "url")).drop("url")
