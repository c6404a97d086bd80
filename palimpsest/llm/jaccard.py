"""N-gram Jaccard join: documents whose shingle sets are similar, as connected components, by exact set-similarity search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.llm.common import HOT_SHARE, components, heavy, join_unique, materialize, registry, table
from palimpsest.llm.words import mix, row_shingles, slices, word_hashes

QUERIES, SQL, query = registry()

#: Words in a shingle, and similarity in hundredths, of the query.
SHINGLE, PERCENT = 4, 85
#: Frequent shingles that come last in the order of all shingles.  Any order gives the same links; this one saves work.
FREQUENT = 1 << 18
#: Shingles that a task counts at a time to find frequent ones.
COUNTED = 1 << 21
#: Parts that elements are dealt to by their hash; sets of which the parts' sizes agree too little can't be similar.
PARTS = 256
#: Members of a group that one task holds by these sizes alone, and as many that it looks up.
GROUP_MEMBERS = 2048
#: Elements of sets that one task holds of a group's members, and of those that it looks up.
GROUP_ELEMENTS = 750_000


def prefix_length(n, percent: int):
    """Elements of a set of ``n`` of which a similar set must share one, whatever the order of elements."""
    return n - (percent * n + 99) // 100 + 1


def _sets(batch: pa.RecordBatch, column: int, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row."""
    hashes, bounds, _, _ = word_hashes(batch.column(column))
    for s in row_shingles(hashes, bounds, k):
        yield np.unique(s)


def _digest(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(int(np.int64(np.sum(mix(s ^ np.uint64(c)), dtype=np.uint64).view(np.int64))) for c in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179))


def sketch(s: np.ndarray) -> bytes:
    """How many elements of the set fall into each part: bytes, or 32-bit numbers where one is too large for a byte."""
    n = np.bincount((s >> np.uint64(17)).astype(np.int64) % PARTS, minlength=PARTS)
    return n.astype(np.uint8 if n.max(initial=0) < 256 else "<u4").tobytes()


def most_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An upper bound of the overlaps of sets with sketches ``a`` and ``b`` (rows or a single one)."""
    return np.minimum(a, b).sum(axis=-1, dtype=np.int64)


def _survey(k: int):
    """Rows ``(kind, a, n, b, c, s)``: each document (1) with its set's size, digest and sketch, and shingles that repeat (2) with a count and a document that has them."""
    names = ["kind", "a", "n", "b", "c", "s"]

    def rows(kind, a, n, b, c, s=None):
        longs = [pa.array(x, pa.int64()) for x in (a, n, b, c)]
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(n), pa.int32()), *longs, pa.array(s or [None] * len(n), pa.binary())], names=names)

    def counted(held: list[np.ndarray], owners: list[int]) -> pa.RecordBatch:
        found, first, n = np.unique(np.concatenate(held), return_index=True, return_counts=True)
        owner = np.array(owners, dtype=np.int64)[np.searchsorted(np.cumsum([len(s) for s in held]), first[n > 1], "right")]
        found, n = found[n > 1].view(np.int64), n[n > 1]
        return rows(2, found, n, owner, np.zeros(len(n), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        owners: list[int] = []
        total, seen = 0, set()
        for batch in batches:
            for part in slices(batch, 1):
                size, digest, sketches = [], [], []
                for i, s in zip(part.column(0).to_pylist(), _sets(part, 1, k), strict=True):
                    size.append(len(s))
                    sketches.append(sketch(s))
                    digest.append(_digest(s))
                    if i is not None and len(s) and digest[-1] not in seen:
                        seen.add(digest[-1])
                        held.append(s)
                        owners.append(i)
                        total += len(s)
                yield rows(1, part.column(0), size, [d[0] for d in digest], [d[1] for d in digest], sketches)
                if total > COUNTED:
                    yield counted(held, owners)
                    held, owners, total = [], [], 0
        if held:
            yield counted(held, owners)

    return run


def _prefixes(k: int, percent: int, frequent):
    """Rows ``(token, id, leader)``: the elements of each document's prefix.  Of equal sets that one task meets, one counts.

    Elements of many documents have their leader from the survey; any set will
    do.  Their lists need not meet, so their tokens are mixed with the document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank, hot, leaders = frequent.value
        seen: set = set()
        for batch in batches:
            for part in slices(batch, 1):
                ids, tokens, owners = part.column(0).to_pylist(), [], []
                for i, s in enumerate(_sets(part, 1, k)):
                    if not len(s) or ids[i] is None or (d := _digest(s)) in seen:
                        continue
                    seen.add(d)
                    n = int(prefix_length(len(s), percent))
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        often = known[at] == s
                        rare = s[~often]
                        if len(rare) < n:
                            rest = s[often]
                            rare = np.concatenate([rare, rest[np.argsort(rank[at[often]], kind="stable")]])
                        s = rare
                    tokens.append(s[:n])
                    owners.append(np.full(n, ids[i], dtype=np.int64))
                if tokens:
                    token, owner = np.concatenate(tokens), np.concatenate(owners)
                    led, leader = np.zeros(len(token), dtype=bool), np.zeros(len(token), dtype=np.int64)
                    if len(hot):
                        at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                        led, leader = hot[at] == token, leaders[at]
                        token = np.where(led, mix(token ^ mix(owner.view(np.uint64))), token)
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(owner), pa.array(leader, mask=~led)], names=["token", "id", "leader"])

    return run


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = [s.view(np.int64) for s in _sets(part, 1, k)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "elements"])

    return run


class Lists:
    """Inverted lists of sets in bands of size, for looking up overlaps with a set.

    ``overlap`` holds each set's known overlap with a leader.  A band is
    skipped when no size in it fits, or when the overlaps with the leader
    leave no room for the overlap that is asked for.
    """

    def __init__(self, sets: list[np.ndarray], overlap: np.ndarray, percent: int):
        self.percent = percent
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        self.bands, start = [], 0
        while start < len(order):
            stop = int(np.searchsorted(sizes[order], sizes[order[start]] * 100 // percent, "right"))
            stop = max(stop, start + 1)
            members = order[start:stop]
            tokens = np.concatenate([sets[m] for m in members])
            owner = np.repeat(np.arange(len(members)), sizes[members])
            by = np.argsort(tokens, kind="stable")
            self.bands.append((members, sizes[members], overlap[members], tokens[by], owner[by]))
            start = stop

    def similar(self, s: np.ndarray, leader: np.ndarray, shared: int) -> Iterator[np.ndarray]:
        """Places of the sets similar to ``s``, whose overlap with the leader is ``shared``."""
        n, p = len(s), self.percent
        out, more = np.setdiff1d(leader, s, assume_unique=True), np.setdiff1d(s, leader, assume_unique=True)
        for members, sizes, overlap, tokens, owner in self.bands:
            if sizes[0] * p > 100 * n or sizes[-1] * 100 < p * n:
                continue
            room = np.minimum(overlap, shared) + np.minimum(sizes - overlap, n - shared)
            fits = room * (100 + p) >= p * (sizes + n)
            if not fits.any():
                continue
            if len(out) + len(more) < n:  # like the leader: correct the leader's overlaps
                got = overlap + _count(more, tokens, owner, len(members)) - _count(out, tokens, owner, len(members))
            else:
                got = _count(s, tokens, owner, len(members))
            hit = fits & (got * (100 + p) >= p * (sizes + n))
            if hit.any():
                yield members[hit]


def _count(s: np.ndarray, tokens: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many elements of ``s`` each owner has."""
    a, b = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
    size = b - a
    a, size = a[size > 0], size[size > 0]
    if not len(a):
        return np.zeros(n, dtype=np.int64)
    at = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return np.bincount(owner[at], minlength=n)


def _screen(percent: int):
    """Adds ``may``: whether two sets can be similar by their sizes and sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "leader_n")]
            a, b = (_sketches(batch.column(c).to_pylist()) for c in ("s", "leader_s"))
            most = np.minimum(most_shared(a, b), np.minimum(*size))
            may = (100 + percent) * most >= percent * (size[0] + size[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("leader", "id", "rep", "leader_rep", "n")), pa.array(may)],
                                             names=["leader", "id", "rep", "leader_rep", "n", "may"])

    return run


def _sketches(rows: list[bytes]) -> np.ndarray:
    """A row of numbers a sketch: bytes if all are, else 32-bit numbers."""
    wide = np.array([len(r) > PARTS for r in rows], dtype=bool)
    if not wide.any():
        return np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, PARTS)
    out = np.empty((len(rows), PARTS), dtype=np.uint32)
    for some, kind in ((wide, "<u4"), (~wide, np.uint8)):
        out[some] = np.frombuffer(b"".join(rows[i] for i in np.flatnonzero(some)), dtype=kind).reshape(-1, PARTS)
    return out


def _candidates(percent: int):
    """Of a group's members, those that can be similar to one in another component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members, asks = (pdf[pdf["kind"] == k].sort_values("n", kind="stable") for k in (1, 2))
        hit: set[int] = set()
        if len(members) and len(asks):
            sizes, comps, ids = (members[c].to_numpy() for c in ("n", "component", "id"))
            table = _sketches(members["s"].tolist())
            for i, comp, n, own in zip(asks["id"], asks["component"], asks["n"], _sketches(asks["s"].tolist()), strict=True):
                a, b = np.searchsorted(sizes, -(-percent * n // 100)), np.searchsorted(sizes, 100 * n // percent, "right")
                other = a + np.flatnonzero(comps[a:b] != comp)
                most = np.minimum(most_shared(table[other], own), np.minimum(sizes[other], n))
                found = other[(100 + percent) * most >= percent * (sizes[other] + n)]
                if len(found):
                    hit.add(int(i))
                    hit.update(ids[found].tolist())
        leader = int(pdf["leader"].iloc[0])
        return pd.DataFrame([(leader, i) for i in sorted(hit)], columns=["leader", "id"], dtype="int64")

    return run


def _complete(percent: int):
    """Links across components within a group of sets that have one leader."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        def plain(kind):
            some = pdf[pdf["kind"] == kind]
            return some, [np.asarray(e, dtype=np.int64) for e in some["elements"]]

        _, leader = plain(0)
        members, sets = plain(1)
        asks, asked = plain(2)
        links: list[tuple[int, int]] = []
        if leader and sets and asked:
            def shared(s: np.ndarray) -> int:
                return len(np.intersect1d(s, leader[0], assume_unique=True))

            lists = Lists(sets, np.array([shared(s) for s in sets]), percent)
            ids, comps = members["rep"].to_numpy(), members["component"].to_numpy()
            for rep, comp, s in zip(asks["rep"], asks["component"], asked, strict=True):
                for found in lists.similar(s, leader[0], shared(s)):
                    other = comps[found]
                    _, first = np.unique(other, return_index=True)  # one link to a component says it all
                    links.extend((int(rep), int(ids[found[f]])) for f in first if other[f] != comp)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``key, n_shingles, component_id``.

    A-Z count as a-z; words are ``[^\\x20\\x09-\\x0D]+``; a document's set has
    its distinct runs of ``shingle`` words, a shorter one's whole as its only
    element; without words it is empty and linked with nothing.  Documents
    link when 100 * intersection >= ``percent`` * union; ``component_id`` is
    the smallest key reachable.  Nulls are empty texts; rows with a null key
    are linked with nothing and have a null component; rows that repeat a key
    share its links.  Shingles are compared by 64-bit hashes.

    Exact for any data.  Equal sets are one.  Similar sets share an element of
    their prefixes in an order of all elements, so each prefix element has a
    list of sets; each list's smallest set (a frequent element's: one that has
    it) is its leader, and every other one is compared with it, where sketches leave room for a link.  That joins
    large groups in a number of comparisons that grows with their size, not
    its square.  Only sets of one leader that are still in different
    components are compared with each other: sketches leave out those that
    can't be similar to any, and the rest are looked up in lists in blocks of
    similar size that are skipped where the overlaps with the leader leave no
    room, with a set's overlaps derived from the leader's by the elements in
    which the two differ.
    """
    spark = docs.sparkSession
    small = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    survey = materialize(small.mapInArrow(_survey(shingle), "kind int, a long, n long, b long, c long, s binary"), "jaccard-survey")
    rows = survey.where("kind = 1").select(F.col("a").alias("id"), "n", "b", "c")
    prefixes = F.sum(F.when(F.col("n") > 0, F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1))
    total, entered = rows.agg(F.count(F.lit(1)), F.coalesce(prefixes, F.lit(0))).first()
    often = survey.where("kind = 2").groupBy("a").agg(F.sum("n").alias("n"), F.min("b").alias("b")).where("n > 2").orderBy(F.desc("n"), "a").limit(FREQUENT).toArrow()
    known, count = often["a"].to_numpy().astype(np.int64).view(np.uint64), often["n"].to_numpy()
    by = np.argsort(known)
    rank = np.empty(len(known), dtype=np.int64)
    rank[np.lexsort((known, count))] = np.arange(len(known))
    hot = by[count[by] * HOT_SHARE > entered]
    frequent = spark.sparkContext.broadcast((known[by], rank[by], known[hot], often["b"].to_numpy()[hot]))

    # Classes of equal sets.
    classes = rows.where("n > 0 and id is not null").groupBy("n", "b", "c").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("_size"))
    classes = materialize(classes, "jaccard-classes")
    shared = classes.where("_size > 1")
    member = join_unique(rows, shared, ["n", "b", "c"], heavy(shared, "_size", total))
    member = materialize(member.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")), "jaccard-members")

    # Each list's sets against its leader: sketches first, then the sets that may be similar.  Entries are exchanged once and not written.
    entries = small.mapInArrow(_prefixes(shingle, percent, frequent), "token long, id long, leader long")
    leader = F.coalesce("leader", F.min("id").over(W.partitionBy("token")))
    pairs = materialize(entries.select("id", leader.alias("leader")).where("id <> leader").select("leader", "id").distinct(), "jaccard-pairs")
    needed = pairs.select("id").unionByName(pairs.select(F.col("leader").alias("id"))).distinct()
    drawn = survey.where("kind = 1").select(F.col("a").alias("id"), "s").dropDuplicates(["id"]).join(needed, "id")
    drawn = materialize(drawn.join(member.dropDuplicates(["id"]), "id"), "jaccard-sketches")
    often = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("_n"))
    frequent_leader = materialize(heavy(often, "_n", pairs.count()).select("leader"), "jaccard-hot")

    def with_leader(left: DataFrame, right: DataFrame) -> DataFrame:
        hot = right.join(F.broadcast(frequent_leader), "leader", "left_semi")
        return join_unique(left, right, ["leader"], hot, "inner")

    first = drawn.select(F.col("id").alias("leader"), F.col("rep").alias("leader_rep"), F.col("n").alias("leader_n"), F.col("s").alias("leader_s"))
    screened = with_leader(pairs, first).join(drawn, "id").where("leader_rep <> rep")
    screened = materialize(screened.mapInArrow(_screen(percent), "leader long, id long, rep long, leader_rep long, n long, may boolean"), "jaccard-screened")

    def sets_of(ids: DataFrame) -> DataFrame:
        rows = small.join(ids.distinct(), "id", "left_semi").mapInArrow(_set_rows(shingle), "id long, elements array<long>")
        return materialize(rows.groupBy("id").agg(F.max("elements").alias("elements")), "jaccard-sets")

    alike = screened.where("may")
    sets = sets_of(alike.select("id").unionByName(alike.select(F.col("leader").alias("id"))))
    compared = with_leader(alike, sets.select(F.col("id").alias("leader"), F.col("elements").alias("_l"))).join(sets, "id")
    both = F.size("_l") + F.size("elements")
    shared = F.size(F.array_intersect("_l", "elements"))
    links = compared.where((100 + percent) * shared >= percent * both).select(F.col("leader_rep").alias("a"), F.col("rep").alias("b"))
    settled = materialize(components(links, "jaccard-components"), "jaccard-settled")

    # What is left: sets of one leader in different components.
    placed = screened.drop("may").join(settled.select(F.col("node").alias("rep"), "component"), "rep", "left")
    placed = placed.withColumn("component", F.coalesce("component", "rep"))

    def groups(members: DataFrame, weight: str, size: int) -> DataFrame:
        """Leaders with members in several components, the largest of these, and the blocks that members and others are dealt to."""
        per = members.groupBy("leader", "component").agg(F.count(F.lit(1)).alias("_sets"), F.sum(weight).alias("_w"))
        group = per.groupBy("leader").agg(F.max(F.struct("_sets", "component", "_w")).alias("_top"), F.count(F.lit(1)).alias("_parts"), F.sum("_w").alias("_all"))
        return materialize(group.where("_parts > 1").select(
            "leader", F.col("_top.component").alias("_most"), F.ceil(F.col("_all") / size).cast("int").alias("_blocks"),
            F.ceil((F.col("_all") - F.col("_top._w")) / size).cast("int").alias("_asks")), "jaccard-groups")

    def dealt(members: DataFrame, group: DataFrame, columns: list[str]) -> DataFrame:
        """Members (kind 1) meet those outside the largest component (kind 2) in all pairs of blocks."""
        each = F.explode(F.sequence(F.lit(0), F.col("_asks") - 1))
        rows = members.join(group, "leader")
        targets = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")).withColumn("ask", each).withColumn("kind", F.lit(1))
        asks = rows.where("component <> _most").withColumn("ask", F.pmod(F.xxhash64("id", F.lit(1)), F.col("_asks")).cast("int")).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("kind", F.lit(2))
        return targets.select("leader", "block", "ask", "kind", *columns).unionByName(asks.select("leader", "block", "ask", "kind", *columns))

    by = ["leader", "block", "ask"]
    open_ = placed.withColumn("_one", F.lit(1))
    group = groups(open_, "_one", GROUP_MEMBERS)
    if not group.isEmpty():
        work = dealt(placed.join(drawn.select("id", "s"), "id"), group, ["id", "component", "n", "s"])
        chosen = materialize(work.groupBy(*by).applyInPandas(_candidates(percent), "leader long, id long").distinct(), "jaccard-chosen")
        placed = placed.join(chosen, ["leader", "id"], "left_semi")
        group = groups(placed, "n", GROUP_ELEMENTS)
    if not group.isEmpty():
        sets = sets_of(chosen.select("id").unionByName(group.select(F.col("leader").alias("id"))))
        work = dealt(placed.join(sets, "id"), group, ["rep", "component", "elements"])
        heads = sets.select(F.col("id").alias("leader"), "elements").join(group, "leader").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        heads = heads.withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("_asks") - 1))).select(
            *by, F.lit(0).alias("kind"), F.col("leader").alias("rep"), F.col("leader").alias("component"), "elements")
        found = work.unionByName(heads).groupBy(*by).applyInPandas(_complete(percent), "a long, b long")
        found = materialize(found.distinct(), "jaccard-found")
        if not found.isEmpty():
            again = settled.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found)
            settled = materialize(components(again, "jaccard-components"), "jaccard-settled")
    joined = settled.where("node <> component").select(F.col("node").alias("rep"), "component")
    often = member.where("rep is not null").groupBy("rep").agg(F.count(F.lit(1)).alias("_n"))
    hot = joined.join(F.broadcast(heavy(often, "_n", total).select("rep")), "rep", "left_semi")
    known_rep = member.where("rep is not null")
    out = join_unique(known_rep, joined, ["rep"], hot).select("id", "n", F.coalesce("component", "rep").alias("component"))
    # A component's number is its smallest representative, which is the smallest key of its class.
    out = out.unionByName(member.where("rep is null").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those linked, directly or through others, to a smaller key; columns as they are."""
    groups = similar_groups(docs, key, text, **options)
    lost = groups.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("_key")).distinct()
    return docs.join(lost, docs[key] == F.col("_key"), "left_anti")


@query("op6_jaccard_join")
def jaccard_join(spark, sf):
    return similar_groups(table(spark, sf, "documents").select("doc_id", "text"))
