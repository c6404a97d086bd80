"""Who provides what: overlaps, shared capabilities, versions, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.scale import number_rows
from palimpsest.session import cut_lineage


def overlaps(claims: DataFrame, *, thing: str = "capability", owner: str = "component") -> DataFrame:
    """Things claimed by at least two owners: ``thing, n_owners``."""
    pairs = claims.select(thing, owner).distinct()
    return pairs.groupBy(thing).agg(F.count(F.lit(1)).alias("n_owners")).where("n_owners > 1")


def overlap_owners(claims: DataFrame, *, thing: str = "capability", owner: str = "component") -> DataFrame:
    """The owners of each overlapping thing, one row each."""
    return claims.select(thing, owner).distinct().join(overlaps(claims, thing=thing, owner=owner), thing)


#: Rows of a thing up to which its owners are one array.
CLAIMS = 256
#: Owners of more than one claim in this many, so fewer than that, have their rows dealt by the other owner too.
OFTEN = 128


def shares_with(claims: DataFrame, *, thing: str = "capability", owner: str = "component", width: int = 64) -> DataFrame:
    """Pairs of different owners that share a thing, with how many they share.

    The owners of a thing are gathered once, and each goes on with all that
    follow it as one row, not a row a pair.  A thing of more than
    :data:`CLAIMS` claims would pair all its owners inside one task: its owners
    are numbered and cut into tiles of ``width``, and each tile meets those
    that follow, so the work on it is spread over its tile pairs.  Rows of an
    owner of very many things are dealt by the other owner.
    """
    rows = claims.select(F.col(thing).alias("_t"), F.col(owner).alias("a")).where("_t is not null and a is not null")
    many = cut_lineage(rows.groupBy("_t").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CLAIMS).select("_t"))
    few = rows.join(F.broadcast(many), "_t", "left_anti").groupBy("_t").agg(F.array_sort(F.collect_set("a")).alias("_o"))
    numbered = few.select("_o", F.posexplode("_o").alias("_na", "a"))
    lists = numbered.select("a", F.slice("_o", F.col("_na") + 2, F.size("_o")).alias("_b")).where(F.size("_b") > 0)
    if not many.isEmpty():
        numbered = number_rows(
            rows.join(F.broadcast(many), "_t", "left_semi").distinct().withColumn("_h", F.pmod(F.xxhash64("a"), F.lit(1024))),
            ["_t"], "_h", ["_h", "a"], "_n", 64,
        )
        tiles = numbered.groupBy("_t", F.floor(F.col("_n") / width).cast("long").alias("_tile")).agg(F.array_sort(F.collect_list("a")).alias("_o"))
        last = tiles.groupBy("_t").agg(F.max("_tile").alias("_last"))
        left = tiles.join(last, "_t").select("_t", F.col("_tile").alias("_from"), F.col("_o").alias("_a"), F.explode(F.sequence("_tile", "_last")).alias("_tile"))
        met = left.join(tiles, ["_t", "_tile"])
        # within a tile each pair once; between tiles the smaller owner first
        above = F.transform("_a", lambda x: F.struct(x.alias("a"), F.filter("_o", lambda y: y > x).alias("_b")))
        below = F.when(F.col("_from") < F.col("_tile"), F.transform("_o", lambda x: F.struct(x.alias("a"), F.filter("_a", lambda y: y > x).alias("_b"))))
        wide = met.select(F.explode(F.concat(above, F.coalesce(below, F.slice(above, 1, 0)))).alias("_r")).select("_r.*").where(F.size("_b") > 0)
        lists = lists.unionByName(wide)
    total = rows.count()
    often = cut_lineage(rows.groupBy("a").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * OFTEN > total).select("a", F.lit(True).alias("_hot")))
    dealt = lists.join(F.broadcast(often), "a", "left")
    whole = dealt.where("_hot is null").select("a", F.lit(0).alias("_part"), "_b")
    parts = dealt.where("_hot").select("a", F.explode("_b").alias("b")).select("a", F.pmod(F.xxhash64("b"), F.lit(1024)).cast("int").alias("_part"), F.array("b").alias("_b"))
    spread = whole.unionByName(parts).repartition("a", "_part")
    counted = spread.select("a", "_part", F.explode("_b").alias("b")).groupBy("a", "_part", "b").agg(F.count(F.lit(1)).alias("n_shared"))
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return counted.select(F.explode(ways).alias("p"), "n_shared").select("p.a", "p.b", "n_shared")


def version_key(version: Column) -> Column:
    """Dotted version as a comparable array; bad parts count as 0, nothing sorts first."""
    v = F.coalesce(version, F.lit(""))
    parts = F.transform(F.split(v, r"\."), lambda p: F.coalesce(F.trim(p).try_cast("int"), F.lit(0)))
    return F.when(v == "", F.array().cast("array<int>")).otherwise(parts)


def fingerprints(files: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    return files.select(path, F.sha2(F.col(content).cast("binary"), 256).alias("sha256"),
                        F.octet_length(content).cast("long").alias("size"))


def fingerprint_changes(old: DataFrame, new: DataFrame, path: str = "path") -> DataFrame:
    """added / removed / changed / same per path."""
    a = old.select(path, F.col("sha256").alias("_old"))
    b = new.select(path, F.col("sha256").alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") != F.col("_new"), "changed").otherwise("same")
    )
    return a.join(b, path, "full").select(path, change.alias("change"))
