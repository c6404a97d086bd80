"""Mixing sources to target weights: a min-cost flow over membership patterns, then seeded selection."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from palimpsest.llm.common import materialize, registry, table

QUERIES, SQL, query = registry()

WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = "mix"
#: Documents in a block of the seeded order; only the block where a quota ends is put in order.
BLOCK_ROWS = 2_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share_targets(sizes: dict[str | None, int], weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> dict[str | None, float]:
    """Targets of sources from their sizes: shares of the whole by weight, none above ``repeats`` times its size.

    Sources take the weights in turn, by code point, null last.  The excess of
    a source that stops at its limit is shared again by weight.
    """
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_weight = sum(sizes.values()), sum(weight.values())
    out: dict[str | None, float] = {}
    for s in sorted(order, key=lambda s: (Fraction(repeats * sizes[s], weight[s]), order.index(s))):
        most = repeats * sizes[s]
        if weight[s] * left > most * open_weight:
            out[s], left, open_weight = float(most), left - most, open_weight - weight[s]
        else:
            out[s] = weight[s] * left / open_weight
    return out


def _groups(members: list[tuple]) -> list[list[int]]:
    """Patterns that share sources, directly or through others."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, sources in enumerate(members):
        for s in sources:
            parent[find(("s", s))] = find(("p", i))
    out = defaultdict(list)
    for i in range(len(members)):
        out[find(("p", i))].append(i)
    return list(out.values())


def route(patterns: list[tuple[tuple, int]], quotas: dict, repeats: int = REPEATS) -> list[int]:
    """Words to take from each pattern ``(sources, words)`` so that sources meet their quotas at least repetition.

    A min-cost flow: pattern p offers its words ``repeats`` times, the n-th
    time at cost n - 1 a word (a convex cost), to any of its sources; a source
    takes its quota.  Solved by shortest augmenting paths, apart for patterns
    that share no source.
    """
    taken = [0] * len(patterns)
    for group in _groups([p[0] for p in patterns]):
        graph: dict = defaultdict(dict)  # node -> node -> [room, cost]

        def edge(a, b, room, cost, graph=graph):
            graph[a][b] = [room, cost]
            graph[b].setdefault(a, [0, -cost])

        for i in group:
            sources, words = patterns[i]
            for n in range(repeats):
                edge("in", (i, n), words, n)
                edge((i, n), (i,), words, 0)
            for s in set(sources):
                edge((i,), ("s", s), repeats * words, 0)
                edge(("s", s), "out", int(quotas[s]), 0)
        while True:
            cost, via, queue, waiting = {"in": 0}, {}, deque(["in"]), {"in"}
            while queue:
                a = queue.popleft()
                waiting.discard(a)
                for b, (room, c) in graph[a].items():
                    if room > 0 and cost[a] + c < cost.get(b, 1 << 60):
                        cost[b], via[b] = cost[a] + c, a
                        if b not in waiting:
                            queue.append(b)
                            waiting.add(b)
            if "out" not in via:
                break
            path, b = [], "out"
            while b != "in":
                path.append((via[b], b))
                b = via[b]
            amount = min(graph[a][b][0] for a, b in path)
            for a, b in path:
                graph[a][b][0] -= amount
                graph[b][a][0] += amount
        for i in group:
            taken[i] = sum(graph[(i, n)]["in"][0] for n in range(repeats))
    return taken


def mix(docs: DataFrame, sources: Column, key: str = "doc_id", text: str = "text", weights: Sequence[int] = WEIGHTS,
        repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """How often the mix takes each document.

    ``sources`` is an array of the source names (null allowed) a document
    belongs to; words count for one of them each time they are taken.  Returns
    ``_key, _pattern, size, _rows, _copies`` once per key, pattern and size
    (rows that repeat all three are taken together; ``_rows`` counts them),
    with ``_members`` and, for each of its sources, ``_targets`` and
    ``_source_sizes``.  Selection follows the MD5 of seed and key, so reruns
    agree.  A null text has size 0 and is never taken; a null key is a key;
    an empty table gives none.

    Only one row per pattern (and per source) comes to the driver, for the
    flow; patterns are sets of sources, few beside documents.
    """
    spark = docs.sparkSession
    name = F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("~")))))
    units = docs.select(F.col(key).alias("_key"), F.to_json(name).alias("_pattern"), word_count(F.col(text)).alias("size"))
    units = units.groupBy("_key", "_pattern", "size").agg(F.count(F.lit(1)).alias("_rows"))
    units = materialize(units.withColumn("_order", F.md5(F.concat_ws(":", F.lit(seed), F.col("_key").cast("string")))), "mix-units")
    words = F.col("size") * F.col("_rows")
    stats = units.groupBy("_pattern").agg(F.sum(words).alias("words"), F.count(F.lit(1)).alias("n"))
    found = stats.withColumn("members", F.from_json("_pattern", T.ArrayType(T.StringType()))).orderBy("_pattern").collect()

    def plain(s: str) -> str | None:
        return s[1:] if s != "~" else None

    sizes: dict = defaultdict(int)
    for r in found:
        for s in r.members:
            sizes[plain(s)] += r.words
    targets = share_targets(sizes, weights, repeats) if sizes else {}
    patterns = [(tuple(plain(s) for s in r.members), r.words) for r in found]
    taken = route(patterns, {s: int(t + 0.5) for s, t in targets.items()}, repeats)
    rows = []
    for r, (members, total), got in zip(found, patterns, taken, strict=True):
        passes = min(got // total, repeats) if total else 0
        rows.append((r._pattern, list(members), passes, got - passes * total, -(-r.n // BLOCK_ROWS),
                     [targets[s] for s in members], [sizes[s] for s in members]))
    schema = ("_pattern string, _members array<string>, _passes long, _extra long, _blocks long, _targets array<double>,"
              " _source_sizes array<long>")
    plan = F.broadcast(spark.createDataFrame(rows, schema))
    place = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")
    units = units.join(plan, "_pattern").withColumn("_block", F.expr("_blocks").cast("long") * place)
    units = units.withColumn("_block", F.shiftrightunsigned("_block", 32))
    blocks = units.groupBy("_pattern", "_extra", "_block").agg(F.sum(words).alias("_words"))
    upto = W.partitionBy("_pattern").orderBy("_block").rowsBetween(W.unboundedPreceding, 0)
    blocks = blocks.withColumn("_end", F.sum("_words").over(upto)).where("_end > _extra")
    ends = blocks.groupBy("_pattern").agg(F.min_by(F.struct("_block", (F.col("_end") - F.col("_words")).alias("start")), "_block").alias("_e"))
    ends = F.broadcast(ends.select("_pattern", F.col("_e._block").alias("_last"), F.col("_e.start").alias("_start")))
    units = units.join(ends, "_pattern", "left")
    inside = units.where("_block = _last").withColumn("_before", F.col("_start") + F.coalesce(F.sum(words).over(
        W.partitionBy("_pattern").orderBy("_order", "_key", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = inside.withColumn("_more", (2 * F.col("_before") + words <= 2 * F.col("_extra")).cast("long")).drop("_before")
    # A pattern whose remainder ends in no block is used up by it: every unit counts.
    outside = units.where("_last is null or _block <> _last").withColumn(
        "_more", F.when(F.col("_last").isNull(), (F.col("_extra") > 0).cast("long")).otherwise((F.col("_block") < F.col("_last")).cast("long")))
    done = outside.unionByName(inside).withColumn("_copies", F.when(F.col("size") > 0, F.col("_passes") + F.col("_more")).otherwise(F.lit(0).cast("long")))
    return done.select("_key", "_pattern", "_members", "size", "_rows", "_copies", "_targets", "_source_sizes")


def pattern_of(sources: Column) -> Column:
    """The pattern column that :func:`mix` makes of ``sources``."""
    name = F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("~")))))
    return F.to_json(name)


def mix_rows(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: ``key, source, size, source_size, target, taken``; each document has one source."""
    got = mix(docs, F.array(F.col(source)), key, text, **options)
    got = got.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    return got.select(F.col("_key").alias(key), F.col("_members")[0].alias(source), "size", F.col("_source_sizes")[0].alias("source_size"),
                      F.col("_targets")[0].alias("target"), (F.col("size") * F.col("_copies")).alias("taken"))


def mixed(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, all columns as they are."""
    got = mix(docs, F.array(F.col(source)), key, text, **options).where("_copies > 0").select("_key", "_pattern", "size", "_copies")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("_row"), F.col(key).alias("_k"), pattern_of(F.array(F.col(source))).alias("_p"), word_count(F.col(text)).alias("_s"))
    on = rows["_k"].eqNullSafe(got["_key"]) & (rows["_p"] == got["_pattern"]) & (rows["_s"] == got["size"])
    out = rows.join(got, on).select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"))
    return out.select("_row.*")


@query("op9_mixing", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM s),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER (ORDER BY 3 * source_size / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws, row_number() OVER (ORDER BY 3 * source_size / w, i) AS k FROM w),
f AS (SELECT *, min(CASE WHEN w * rest <= 3 * source_size * ws THEN k END) OVER () AS k0 FROM l),
t AS (SELECT f.source, f.source_size, CASE WHEN f.k0 IS NULL OR f.k < f.k0 THEN (3 * f.source_size)::DOUBLE ELSE (f.w * g.rest)::DOUBLE / g.ws::DOUBLE END AS target FROM f LEFT JOIN f AS g ON g.k = f.k0),
q AS (SELECT *, least(floor(target + 0.5), 3 * source_size)::BIGINT AS quota FROM t),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE quota // source_size END AS passes FROM q),
c AS (SELECT d.*, p.source_size, p.target, p.passes, p.quota - p.passes * p.source_size AS extra,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, target, (size * (passes + CASE WHEN 2 * before + size <= 2 * extra THEN 1 ELSE 0 END))::BIGINT AS taken FROM c""")
def mixing(spark, sf):
    return mix_rows(table(spark, sf, "documents"))
